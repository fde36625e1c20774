"""E1 ``propose``: MOVE and FLAG proposals per repository.

Proposal order (the reference prints in walk order) is made explicit as
``(phase, ord)``: phase 1 = per-file MOVE / trash FLAG in file order, phase 2 =
duplicate groups by their first file, phase 3 = root-file flags.

Table ``proposals``: repo_id, phase, ord, action, source, target, reason,
risk, details struct<category, current_location, suggestion, total_count,
examples array<string>, remaining>. The full member list of a duplicate flag
is the long table ``all_duplicates`` (never gathered into one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.functions.text import fmt
from treeline.operators.ordering import first_k, number_within

DETAILS_TYPE = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("current_location", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("examples", T.ArrayType(T.StringType())),
    T.StructField("remaining", T.StringType()),
])

PROPOSAL_COLUMNS = ["repo_id", "phase", "ord", "action", "source", "target", "reason", "risk",
                    "details"]


def _details(category=None, current_location=None, suggestion=None, total_count=None,
             examples=None, remaining=None) -> Column:
    def v(x, t):
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        v(category, "string").alias("category"),
        v(current_location, "string").alias("current_location"),
        v(suggestion, "string").alias("suggestion"),
        v(total_count, "bigint").alias("total_count"),
        (examples if examples is not None else F.lit(None)).cast("array<string>").alias("examples"),
        v(remaining, "string").alias("remaining"),
    )


def with_repo_type(files: DataFrame, types: DataFrame) -> DataFrame:
    """One row per repository on the right; AQE broadcasts it when small."""
    return files.join(types.select("repo_id", "repo_type"), "repo_id", "inner")


def profile_name(repo_type: Column) -> Column:
    """python_dominant -> python, everything else -> nextjs."""
    return F.when(repo_type == "python_dominant", F.lit("python")).otherwise(F.lit("nextjs"))


def profile_patterns(profile: Column) -> Column:
    """Duplicate patterns of a profile, from the fixed 3-row profile list."""
    out = F.array().cast("array<string>")
    for name, patterns in K.PROFILES:
        out = F.when(profile == name, F.array(*[F.lit(p) for p in patterns]).cast("array<string>")) \
               .otherwise(out)
    return out


def profiles_table(spark) -> DataFrame:
    """The ecosystem profile dimension (3 rows) for joins and reports."""
    return spark.createDataFrame([(n, p) for n, p in K.PROFILES],
                                 "profile string, ignored_duplicate_patterns array<string>")


def candidates(files_typed: DataFrame) -> DataFrame:
    """all files of python repos, ``.py`` files of mixed repos, none else."""
    rt = F.col("repo_type")
    return files_typed.filter((rt == "python_dominant")
                              | ((rt == "mixed") & (F.col("extension") == ".py")))


def per_file_proposals(files_typed: DataFrame) -> DataFrame:
    """Phase 1: P11 placement, P12 target, F3 no-op drop, P13 risk, P14 reason, F8 trash."""
    c = candidates(files_typed).filter(~R.correctly_placed())
    c = c.withColumn("target", R.target_path())
    trash = c.filter(F.col("category") == "trash").select(
        "repo_id", F.lit(1).alias("phase"), F.col("file_seq").alias("ord"),
        F.lit("flag").alias("action"), F.col("relative_path").alias("source"),
        F.lit(None).cast("string").alias("target"), F.lit(K.TRASH_REASON).alias("reason"),
        F.lit("low").alias("risk"), _details(category="trash").alias("details"))
    moves = c.filter(F.col("target").isNotNull() & (F.col("target") != F.col("relative_path"))) \
        .select("repo_id", F.lit(1).alias("phase"), F.col("file_seq").alias("ord"),
                F.lit("move").alias("action"), F.col("relative_path").alias("source"),
                "target", R.move_reason().alias("reason"), R.move_risk().alias("risk"),
                _details(category=F.col("category"),
                         current_location=R.current_location(K.ROOT_DETAIL_LOCATION)).alias("details"),
                (F.col("repo_type") == "python_dominant").alias("_keep_move"))
    return moves.unionByName(trash.withColumn("_keep_move", F.lit(True)))


def duplicate_members(files: DataFrame) -> DataFrame:
    """Members of every same-name group (lower-cased name), exempt names skipped."""
    return (files.filter(~F.col("name").isin(*K.DUPLICATE_EXEMPT))
            .select("repo_id", F.lower("name").alias("group_name"), "file_seq",
                    "relative_path", "name"))


def duplicate_groups(files: DataFrame, types: DataFrame) -> DataFrame:
    """A8 + F10 + F11 + P15: one FLAG per group of more than one file.

    Counting is a partial aggregate; the first three members come from a
    first-k window (partial limit before the shuffle), so a hot group never
    lands whole in one task.
    """
    m = duplicate_members(files)
    counts = m.groupBy("repo_id", "group_name").agg(F.count(F.lit(1)).alias("total_count")) \
              .filter(F.col("total_count") > 1)
    first3 = first_k(m, ["repo_id", "group_name"], [F.col("file_seq")], 3)
    ex = first3.groupBy("repo_id", "group_name").agg(
        F.array_sort(F.collect_list(F.struct("rn", "relative_path", "name", "file_seq")))
         .alias("ex"))
    g = (counts.join(ex, ["repo_id", "group_name"], "inner")
         .join(types.select("repo_id", "repo_type"), "repo_id", "inner"))
    first = F.col("ex")[0]
    g = g.withColumns({
        "first_name": first["name"],
        "first_path": first["relative_path"],
        "first_seq": first["file_seq"],
        "patterns": profile_patterns(profile_name(F.col("repo_type"))),
    })
    low_first = F.lower(F.col("first_name"))
    g = g.filter(~F.exists("patterns", lambda p: low_first.contains(p)))
    remaining = F.when(F.col("total_count") > 3,
                       fmt(K.DUPLICATE_REMAINING, n=(F.col("total_count") - 3).cast("string")))
    return g.select(
        "repo_id", F.lit(2).alias("phase"), F.col("first_seq").alias("ord"),
        F.lit("flag").alias("action"), F.col("first_path").alias("source"),
        F.lit(None).cast("string").alias("target"),
        fmt(K.DUPLICATE_REASON, n=F.col("total_count").cast("string"),
            name=F.col("first_name")).alias("reason"),
        R.duplicate_risk(F.col("first_name")).alias("risk"),
        _details(total_count=F.col("total_count"),
                 examples=F.transform("ex", lambda e: e["relative_path"]),
                 remaining=remaining).alias("details"),
    )


def all_duplicates(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every member of every duplicate flag, in file order.

    (repo_id, ord) is the key of the flag among the proposals of phase 2, ``position`` counts from
    1. A long table, numbered over range slices: a group with most of a repository's files
    is cut into many tasks and never gathered.
    """
    flags = proposals.filter(F.col("phase") == 2).select(
        "repo_id", "ord", F.lower(F.element_at(F.split("source", "/"), -1)).alias("group_name"))
    m = duplicate_members(files).join(flags, ["repo_id", "group_name"])
    return number_within(m, ["repo_id", "ord"], ["file_seq"], "position").select(
        "repo_id", "ord", "position", "file_seq", "relative_path")


def root_python_flags(files_typed: DataFrame) -> DataFrame:
    """``.py`` at the root of python repos, except setup.py / manage.py."""
    return files_typed.filter(
        (F.col("repo_type") == "python_dominant") & (F.col("depth") == 1)
        & (F.col("extension") == ".py") & ~F.col("name").isin(*K.ROOT_FLAG_EXEMPT)
    ).select("repo_id", F.lit(3).alias("phase"), F.col("file_seq").alias("ord"),
             F.lit("flag").alias("action"), F.col("relative_path").alias("source"),
             F.lit(None).cast("string").alias("target"), F.lit(K.ROOT_FLAG_REASON).alias("reason"),
             F.lit("low").alias("risk"),
             _details(suggestion=K.ROOT_FLAG_SUGGESTION).alias("details"))


def gate_moves(proposals: DataFrame, types: DataFrame) -> DataFrame:
    """MOVE survives only in python_dominant repositories (mixed loses them too)."""
    t = types.select("repo_id", F.col("repo_type").alias("_rt"))
    return (proposals.join(t, "repo_id", "inner")
            .filter((F.col("action") != "move") | (F.col("_rt") == "python_dominant"))
            .drop("_rt"))


def suppress_redundant_flags(proposals: DataFrame) -> DataFrame:
    """Drop 'Python file at repository root' flags of files that have a MOVE."""
    moved = proposals.filter(F.col("action") == "move").select(
        "repo_id", F.col("source").alias("_src")).distinct()
    redundant = ((F.col("action") == "flag") & F.col("reason").contains(K.ROOT_FLAG_REASON)
                 & ~F.col("reason").startswith(K.DUPLICATE_PREFIX))
    flags = proposals.filter(redundant)
    kept_flags = flags.join(moved, (flags["repo_id"] == moved["repo_id"])
                            & (flags["source"] == moved["_src"]), "left_anti")
    return proposals.filter(~redundant).unionByName(kept_flags)


def moves_here(typed: DataFrame) -> Column:
    """Row-level test: this file yields a MOVE that survives the F7 gate."""
    cand = (F.col("repo_type") == "python_dominant")
    tgt = R.target_path()
    return (cand & ~R.correctly_placed() & tgt.isNotNull()
            & (tgt != F.col("relative_path")))


def row_proposals(typed: DataFrame) -> DataFrame:
    """Phases 1 and 3 in one pass: every file emits the proposals it causes.

    A MOVE, a trash flag and a root flag come from one row of ``files``, so the F7 gate and
    the J4 suppression are conditions on that row: a list of up to three proposals, exploded once.
    """
    python = F.col("repo_type") == "python_dominant"
    rows = typed.filter(python | (F.col("category") == "trash")).withColumns(
        {"target": R.target_path(), "_astray": ~R.correctly_placed()})
    candidate = python | ((F.col("repo_type") == "mixed") & (F.col("extension") == ".py"))
    moves = (python & F.col("_astray") & F.col("target").isNotNull()
             & (F.col("target") != F.col("relative_path")))
    trash = candidate & F.col("_astray") & (F.col("category") == "trash")
    root = (python & (F.col("depth") == 1) & (F.col("extension") == ".py")
            & ~F.col("name").isin(*K.ROOT_FLAG_EXEMPT) & ~moves)

    def proposal(phase, action, target, reason, risk, details):
        return F.struct(F.lit(phase).alias("phase"), F.lit(action).alias("action"), target.alias("target"),
                        reason.alias("reason"), risk.alias("risk"), details.alias("details"))

    none = F.lit(None).cast("string")
    emitted = F.array_compact(F.array(
        F.when(moves, proposal(1, "move", F.col("target"), R.move_reason(), R.move_risk(), _details(
            category=F.col("category"), current_location=R.current_location(K.ROOT_DETAIL_LOCATION)))),
        F.when(trash, proposal(1, "flag", none, F.lit(K.TRASH_REASON), F.lit("low"),
                               _details(category="trash"))),
        F.when(root, proposal(3, "flag", none, F.lit(K.ROOT_FLAG_REASON), F.lit("low"),
                              _details(suggestion=K.ROOT_FLAG_SUGGESTION)))))
    return rows.select("repo_id", F.col("file_seq").alias("ord"), F.col("relative_path").alias("source"),
                       F.explode(emitted).alias("p")).select(
        "repo_id", "p.phase", "ord", "p.action", "source", "p.target", "p.reason", "p.risk", "p.details")


def all_proposals(files: DataFrame, types: DataFrame) -> DataFrame:
    """U1 of the three phases, with F7 and J4 applied.

    One scan of ``files`` emits phases 1 and 3 (``row_proposals``); the duplicate groups
    read names and paths only, for their counts and for their first members.
    ``per_file_proposals``, ``root_python_flags``, ``gate_moves`` and ``suppress_redundant_flags``
    are the same rules one by one, for arbitrary proposal tables.
    """
    props = row_proposals(with_repo_type(files, types)).unionByName(duplicate_groups(files, types))
    return props.select(*PROPOSAL_COLUMNS)


def sequenced(proposals: DataFrame) -> DataFrame:
    """Proposals whose ``ord`` is a number, as the sequential steps need it.

    Those of an inventory without ``file_seq`` carry the walk key of their file there; they are
    numbered in that order within each repository and phase, over range slices.
    """
    if not isinstance(proposals.schema["ord"].dataType, T.BinaryType):
        return proposals
    return number_within(proposals, ["repo_id", "phase"], ["ord"], "_n").withColumn(
        "ord", F.col("_n")).select(*proposals.columns)


def flat(proposals: DataFrame) -> DataFrame:
    """Scalar view of proposals (arrays joined with '|')."""
    d = F.col("details")
    return proposals.select(
        "repo_id", F.col("phase").cast("bigint").alias("phase"), F.col("ord").cast("bigint").alias("ord"),
        "action", "source", "target", "reason", "risk",
        d["category"].alias("category"), d["current_location"].alias("current_location"),
        d["suggestion"].alias("suggestion"), d["total_count"].alias("total_count"),
        F.array_join(d["examples"], "|").alias("examples"), d["remaining"].alias("remaining"))
