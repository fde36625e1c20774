"""E2 import warnings: which imports a set of moves may break.

Only the statements of moved files are exploded (moves are joined to the
parsed files first), and existence is looked up in the tree on disk: a path index
(``sources.inventory.path_index``), which needs no shuffle, or a plain inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.functions.text import fmt
from treeline.operators.moves import path_state
from treeline.session import write_table


def _parent(path: F.Column) -> F.Column:
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.array_join(F.slice(parts, 1, n - 1), "/")).otherwise(F.lit("."))


def _join_dir(d: F.Column, name: F.Column) -> F.Column:
    return F.when(d == ".", name).otherwise(F.concat(d, F.lit("/"), name))


def moved_statements(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Statements of moved files with the move's source and target directories."""
    m = moves.select("repo_id", F.col("ord").alias("move_ord"), "source", "target")
    f = files.filter(F.col("extension") == ".py").select(
        "repo_id", F.col("relative_path").alias("source"), "stmts")
    j = m.join(f, ["repo_id", "source"], "inner")
    s = j.select("repo_id", "move_ord", "source", "target",
                 F.posexplode("stmts").alias("stmt_no", "s"))
    return s.select(
        "repo_id", "move_ord", "source", "target", "stmt_no",
        F.col("s.module").alias("module"), F.col("s.is_relative").alias("is_relative"),
        F.col("s.level").alias("level"), F.col("s.line_number").alias("line_number"),
        F.col("s.names").alias("names"),
        _parent(F.col("source")).alias("source_dir"), _parent(F.col("target")).alias("target_dir"))


_RISK_COLUMNS = ["repo_id", "move_ord", "source", "stmt_no", "module", "is_relative", "level",
                 "line_number", "names", "kind", "reason", "affected"]


def _risks(st: DataFrame, moves: DataFrame, disk: DataFrame) -> DataFrame:
    """J5, J6 and J12 in one pass over statements of files that change directory.

    Both ask for the same file, the first part of the module next to the moved file: each
    distinct one is looked up once in ``disk`` (a path index or an inventory), and once among the moves.
    """
    first = F.split(F.col("module"), r"\.")[0]
    st = (st.filter(F.col("source_dir") != F.col("target_dir"))
          .withColumn("mod", F.when(~F.col("is_relative") | (F.col("module") != ""), first))
          .withColumn("candidate", _join_dir(F.col("source_dir"), F.concat("mod", F.lit(".py")))))
    found = path_state(st.select("repo_id", F.col("candidate").alias("path")), disk) \
        .filter("is_file").select("repo_id", F.col("path").alias("candidate"), F.lit(True).alias("on_disk"))
    # a file has one MOVE at most, so the list of its targets is short
    moving = moves.groupBy("repo_id", F.col("source").alias("candidate")).agg(
        F.collect_list(F.coalesce("target", F.lit(""))).alias("targets"))
    j = (st.join(found, ["repo_id", "candidate"], "left")
         .join(moving, ["repo_id", "candidate"], "left")
         .withColumn("on_disk", F.coalesce("on_disk", F.lit(False))))
    none = F.array(F.lit(None).cast("string"))
    j = j.filter(F.col("is_relative") | F.col("on_disk")).withColumn(
        "other_target", F.explode(F.when(F.col("is_relative"), none).otherwise(F.coalesce("targets", none))))
    other_dir = _parent(F.col("other_target"))
    stays = F.col("other_target").isNull()
    j = j.filter(F.col("is_relative") | stays | (other_dir != F.col("target_dir")))
    file = F.concat(F.col("mod"), F.lit(".py"))
    reason = (F.when(F.col("is_relative"), fmt(K.IMPORT_RELATIVE, source_dir=F.col("source_dir"),
                                               target_dir=F.col("target_dir")))
              .when(stays, fmt(K.IMPORT_SIBLING_STAYS, module=F.col("mod"), source_dir=F.col("source_dir")))
              .otherwise(fmt(K.IMPORT_SIBLING_MOVES, module=F.col("mod"), file=file, other_dir=other_dir)))
    hit = F.col("mod").isNotNull() & (F.col("on_disk") | F.col("targets").isNotNull())
    affected = (F.when(~F.col("is_relative"), F.array("candidate")).when(hit, F.array(file))
                .otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("is_relative"), F.lit("relative")).otherwise(F.lit("sibling"))
    return j.withColumns({"kind": kind, "reason": reason, "affected": affected}).select(*_RISK_COLUMNS)


def relative_import_risk(st: DataFrame, moves: DataFrame, disk: DataFrame) -> DataFrame:
    """J5 + J12: relative statement of a file that changes directory."""
    return _risks(st.filter("is_relative"), moves, disk)


def sibling_import_risk(st: DataFrame, moves: DataFrame, disk: DataFrame) -> DataFrame:
    """Absolute import of a ``.py`` that sits next to the moved file."""
    return _risks(st.filter("NOT is_relative"), moves, disk)


def import_warnings(moves: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """J5 and J6 over the MOVE proposals, in move then statement order.

    The files are read and their statements exploded once: the statements at risk are written,
    as they are read for the distinct files they ask about and again for the answers.
    """
    mv = moves.filter(F.col("action") == "move") if "action" in moves.columns else moves
    st = moved_statements(mv, files).filter(F.col("source_dir") != F.col("target_dir"))
    return _risks(write_table(st, "moved-statements"), mv, disk).withColumn("import_text", R.import_text(
        F.col("module"), F.col("is_relative"), F.col("level"), F.col("names")))


def warning_text(warnings: DataFrame) -> DataFrame:
    """The printed warning (first three affected files)."""
    lines = F.array_compact(F.array(
        fmt(K.WARNING_HEAD, source=F.col("source")),
        fmt(K.WARNING_LINE, line=F.col("line_number").cast("string"), statement=F.col("import_text")),
        fmt(K.WARNING_RISK, reason=F.col("reason")),
        F.when(F.size("affected") > 0,
               fmt(K.WARNING_AFFECTED, files=F.array_join(F.slice("affected", 1, 3), ", ")))))
    return warnings.select("repo_id", "move_ord", "stmt_no", "source",
                           F.array_join(lines, "\n").alias("text"))


def warning_counts(warnings: DataFrame, repo_list: DataFrame) -> DataFrame:
    """Import warnings per repository, 0 when none."""
    c = warnings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("import_warnings_count"))
    return repo_list.join(c, "repo_id", "left").select(
        "repo_id", F.coalesce(F.col("import_warnings_count"), F.lit(0)).cast("bigint")
        .alias("import_warnings_count"))
