"""E3 ``apply``: decisions, validation, sequential application, new inventory.

Files are never moved here. Applying moves produces (a) one result row per
executed proposal and (b) a new version of the inventory table with
``relative_path`` replaced for every successful move. The repository root of
a tree is written as ``repo_id`` in messages (the reference prints absolute
paths of one machine).

Dry run (J10) is set-based: nothing moves, so every check reads the tree as
it is. A real run (G1) is sequential; it is replayed per connected component
of moves that share a path (``components``), with only the touched paths'
initial state shipped to the Python step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.functions.text import fmt, render
from treeline.operators.components import ancestors, components, move_edges
from treeline.operators.repo import with_all_repos
from treeline.session import checkpoint_dir, ship_package, write_table


def _parent(path: F.Column) -> F.Column:
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.array_join(F.slice(parts, 1, n - 1), "/"))


def _full(path: F.Column) -> F.Column:
    return F.concat(F.col("repo_id"), F.lit("/"), path)


# --------------------------------------------------------------------------
# decisions
# --------------------------------------------------------------------------

def with_decisions(moves: DataFrame, decisions: DataFrame, approve_all: bool = False) -> DataFrame:
    """Y / yes approve, n / no (and anything else) decline, default no.

    ``q`` ends the review of a repository: that move and every later one are
    left out. ``approve_all`` is the auto-approve switch.
    """
    mv = moves.filter(F.col("action") == "move")
    if approve_all:
        return mv.withColumn("decision", F.lit("y")).withColumn("approved", F.lit(True))
    d = decisions.select("repo_id", "source", F.lower(F.trim("decision")).alias("decision"))
    j = mv.join(d, ["repo_id", "source"], "left").withColumn(
        "decision", F.coalesce("decision", F.lit("n")))
    quit_at = j.filter(F.col("decision") == "q").groupBy("repo_id").agg(
        F.min(F.struct("phase", "ord")).alias("q_at"))
    j = j.join(quit_at, "repo_id", "left").filter(
        F.col("q_at").isNull() | (F.struct("phase", "ord") < F.col("q_at"))).drop("q_at")
    return j.withColumn("approved", F.col("decision").isin("y", "yes"))


# --------------------------------------------------------------------------
# disk facts of the touched paths
# --------------------------------------------------------------------------

def path_state(paths: DataFrame, disk: DataFrame) -> DataFrame:
    """(repo_id, path) -> is_file, is_dir on the tree ``disk``.

    ``disk`` is a path index (``sources.inventory.path_index``), which is read where it
    lies, or an inventory (repo_id, relative_path). A directory exists when some file lies
    below it. Of an inventory only the ancestors that are asked about are kept (semi join
    before the distinct).
    """
    asked = paths.select("repo_id", "path").filter(F.col("path").isNotNull()).distinct()
    if "is_dir" in disk.columns:
        return asked.join(disk, ["repo_id", "path"], "left").select(
            "repo_id", "path", F.coalesce("is_file", F.lit(False)).alias("is_file"),
            F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    # (repo_id, relative_path) is unique in an inventory: a semi join, no distinct
    files = (disk.select("repo_id", F.col("relative_path").alias("path"))
             .join(asked, ["repo_id", "path"], "left_semi")
             .withColumn("is_file", F.lit(True)))
    parts = F.split(F.col("relative_path"), "/")
    dirs = (disk.select("repo_id", parts.alias("p"))
            .filter(F.size("p") > 1)
            .select("repo_id", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p")
            .select("repo_id", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path"))
            .join(asked, ["repo_id", "path"], "left_semi").distinct()
            .withColumn("is_dir", F.lit(True)))
    return (asked.join(files, ["repo_id", "path"], "left").join(dirs, ["repo_id", "path"], "left")
            .select("repo_id", "path", F.coalesce("is_file", F.lit(False)).alias("is_file"),
                    F.coalesce("is_dir", F.lit(False)).alias("is_dir")))


def attach_states(df: DataFrame, roles: dict[str, str], disk: DataFrame,
                  key: str = "node") -> DataFrame:
    """Add ``<prefix>_file`` / ``<prefix>_dir`` for each role column, with one
    lookup: roles are exploded into rows, joined once, folded back per row."""
    names = list(roles)
    exploded = df.select("repo_id", key, F.posexplode(F.array(*[F.col(roles[n]) for n in names]))
                         .alias("_role", "path"))
    st = path_state(exploded.select("repo_id", "path"), disk)
    j = exploded.join(st, ["repo_id", "path"], "left")
    aggs = []
    for i, n in enumerate(names):
        aggs.append(F.max(F.when(F.col("_role") == i, F.col("is_file"))).alias(f"{n}_file"))
        aggs.append(F.max(F.when(F.col("_role") == i, F.col("is_dir"))).alias(f"{n}_dir"))
    per_row = j.groupBy("repo_id", key).agg(*aggs)
    cols = [f"{n}_{k}" for n in names for k in ("file", "dir")]
    return df.join(per_row, ["repo_id", key], "left").na.fill(False, cols)


def _with_states(mv: DataFrame, disk: DataFrame) -> DataFrame:
    mv = mv.withColumn("tparent", _parent(F.col("target")))
    return attach_states(mv, {"src": "source", "tgt": "target", "par": "tparent"}, disk)


# --------------------------------------------------------------------------
# J10 + P22: dry-run validation and messages
# --------------------------------------------------------------------------

def validation_error(with_states: DataFrame) -> F.Column:
    """The first failing check, in the reference's order (null when valid)."""
    s, t = F.col("source"), F.col("target")
    return (F.when(s.isNull(), F.lit(K.MSG_NO_SOURCE))
            .when(t.isNull(), F.lit(K.MSG_NO_TARGET))
            .when(~F.col("src_file") & ~F.col("src_dir"), fmt(K.MSG_SOURCE_MISSING, path=_full(s)))
            .when(~F.col("src_file"), fmt(K.MSG_SOURCE_NOT_FILE, path=_full(s)))
            .when(F.col("tgt_file") | F.col("tgt_dir"), fmt(K.MSG_TARGET_EXISTS, path=_full(t)))
            .when(F.col("par_file") & ~F.col("par_dir"),
                  fmt(K.MSG_PARENT_NOT_DIR, path=_full(F.col("tparent")))))


def validate_moves(approved: DataFrame, disk: DataFrame) -> DataFrame:
    """J10 + P22 (dry run): one result per approved MOVE, nothing moves."""
    mv = _with_states(approved.filter(F.col("approved"))
                      .withColumn("node", F.col("ord").cast("bigint")), disk)
    err = validation_error(mv)
    return mv.select(
        "repo_id", "phase", "ord", "action", "source", "target", "risk",
        err.isNull().alias("success"), F.lit(False).alias("skipped"),
        F.when(err.isNull(), fmt(K.MSG_DRY_RUN_MOVE, source=F.col("source"), target=F.col("target")))
         .otherwise(fmt(K.MSG_VALIDATION_FAILED, error=err)).alias("message"))


def unsupported_results(proposals: DataFrame) -> DataFrame:
    """P22 for non-MOVE proposals: skipped, never successful."""
    return proposals.filter(F.col("action") != "move").select(
        "repo_id", "phase", "ord", "action", "source", "target", "risk",
        F.lit(False).alias("success"), F.lit(True).alias("skipped"),
        fmt(K.MSG_UNSUPPORTED, action=F.col("action")).alias("message"))


def execution_summary(results: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Total, successful, failed (neither success nor skipped), skipped; with ``repos`` (repo_id)
    zeros for repositories without a result."""
    return with_all_repos(results.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success") & ~F.col("skipped")).alias("failed"),
        F.count_if(F.col("skipped")).alias("skipped")), repos)


# --------------------------------------------------------------------------
# G1: real run, replayed per component
# --------------------------------------------------------------------------

RESULT_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("node", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("message", T.StringType()),
])


def _ancestors_of(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def replay_moves(pdf: pd.DataFrame) -> pd.DataFrame:
    """Apply the moves of each component in order against the tree they leave.

    ``pdf`` may hold many components (a hash bucket); each starts from the
    initial state of its own paths.
    """
    out = []
    pdf = pdf.sort_values(["repo_id", "component", "node"])
    for _, comp in pdf.groupby(["repo_id", "component"], sort=False):
        out.extend(_replay_component(comp))
    return pd.DataFrame(out, columns=["repo_id", "node", "success", "message"])


def _replay_component(pdf: pd.DataFrame) -> list[tuple]:
    state: dict[str, str | None] = {}
    rows = list(pdf.itertuples(index=False))
    for r in rows:
        for p, f, d in ((r.source, r.src_file, r.src_dir), (r.target, r.tgt_file, r.tgt_dir),
                        (r.tparent, r.par_file, r.par_dir), (r.tanc_file, True, False)):
            if p is not None and p not in state:
                state[p] = "file" if f else ("dir" if d else None)
    out = []
    for r in rows:
        repo, s, t = r.repo_id, r.source, r.target

        def fail(template, **kw):
            out.append((repo, r.node, False, render(K.MSG_VALIDATION_FAILED, error=render(template, **kw))))

        if s is None:
            fail(K.MSG_NO_SOURCE); continue
        if t is None:
            fail(K.MSG_NO_TARGET); continue
        if state.get(s) is None:
            fail(K.MSG_SOURCE_MISSING, path=f"{repo}/{s}"); continue
        if state.get(s) != "file":
            fail(K.MSG_SOURCE_NOT_FILE, path=f"{repo}/{s}"); continue
        if state.get(t) is not None:
            fail(K.MSG_TARGET_EXISTS, path=f"{repo}/{t}"); continue
        parent = r.tparent
        if parent is not None and state.get(parent) == "file":
            fail(K.MSG_PARENT_NOT_DIR, path=f"{repo}/{parent}"); continue
        blocked = next((a for a in _ancestors_of(t) if state.get(a) == "file"), None)
        if blocked is not None:
            out.append((repo, r.node, False, render(
                K.MSG_EXEC_FAILED, error=render(K.MSG_NOT_A_DIRECTORY, path=f"{repo}/{blocked}"))))
            continue
        for a in _ancestors_of(t):
            state[a] = "dir"
        state[s] = None
        state[t] = "file"
        out.append((repo, r.node, True, render(K.MSG_MOVED, source=s, target=t)))
    return out


def replay_buckets(df: DataFrame, fn, schema, buckets: int | None = None) -> DataFrame:
    """Run ``fn`` over hash buckets of components (bounded group count).

    Components are independent, so a bucket replays each of its components
    from its own initial state; a large repository spreads over the buckets.
    """
    spark = df.sparkSession
    ship_package(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = F.pmod(F.xxhash64("repo_id", "component"), F.lit(buckets))
    return df.withColumn("_bucket", b).groupBy("_bucket").applyInPandas(
        lambda pdf: fn(pdf.drop(columns=["_bucket"])), schema=schema)


def _file_ancestor(mv: DataFrame, disk: DataFrame, col: str = "target") -> DataFrame:
    """The proper ancestor of ``col`` that is a file on disk (at most one: a
    file has nothing below it), as ``tanc_file``; null when there is none."""
    anc = mv.select("repo_id", "node", F.explode(ancestors(F.col(col))).alias("path"))
    files = disk.select("repo_id", F.col("relative_path").alias("path"))
    hit = anc.join(files, ["repo_id", "path"], "left_semi").groupBy("repo_id", "node") \
             .agg(F.min("path").alias("tanc_file"))
    return mv.join(hit, ["repo_id", "node"], "left")


def simple_groups(mv: DataFrame) -> DataFrame:
    """(repo_id, target) groups whose moves interact only through that target.

    A move is simple when no other move writes what it reads and it writes
    nothing another move reads: its source is no move's target and no
    target's ancestor, and no other move's source; its target is no move's source and no target's
    ancestor; no ancestor of its target is any move's source or target. A
    group is simple when all of its moves are.
    """
    srcs = mv.select("repo_id", F.col("source").alias("path"))
    tgts = mv.select("repo_id", F.col("target").alias("path"))
    ancs = mv.select("repo_id", F.explode(ancestors(F.col("target"))).alias("path"))
    ends = srcs.unionByName(tgts)
    m = mv.select("repo_id", "node", "source", "target")
    bad_src = m.join(tgts.unionByName(ancs).withColumnRenamed("path", "source"),
                     ["repo_id", "source"], "left_semi").select("repo_id", "node")
    bad_tgt = m.join(srcs.unionByName(ancs).withColumnRenamed("path", "target"),
                     ["repo_id", "target"], "left_semi").select("repo_id", "node")
    bad_anc = (m.select("repo_id", "node", F.explode(ancestors(F.col("target"))).alias("path"))
               .join(ends, ["repo_id", "path"], "left_semi").select("repo_id", "node"))
    again = m.groupBy("repo_id", "source").count().filter("count > 1").select("repo_id", "source")
    bad_again = m.join(again, ["repo_id", "source"], "left_semi").select("repo_id", "node")
    bad = bad_src.unionByName(bad_tgt).unionByName(bad_anc).unionByName(bad_again).distinct().withColumn("bad", F.lit(True))
    flagged = m.join(bad, ["repo_id", "node"], "left")
    return (flagged.groupBy("repo_id", "target")
            .agg(F.bool_and(F.col("bad").isNull()).alias("simple"))
            .filter("simple").drop("simple"))


def _resolve_simple(mv: DataFrame) -> DataFrame:
    """Set-based outcome of simple groups: the first move that passes the checks
    on the initial tree takes the target; every later valid one finds it taken."""
    err = validation_error(mv)
    blocked = fmt(K.MSG_EXEC_FAILED, error=fmt(K.MSG_NOT_A_DIRECTORY, path=_full(F.col("tanc_file"))))
    m = mv.withColumn("_err", F.when(err.isNotNull(), fmt(K.MSG_VALIDATION_FAILED, error=err))
                               .when(F.col("tanc_file").isNotNull(), blocked))
    winner = m.filter(F.col("_err").isNull()).groupBy("repo_id", "target") \
              .agg(F.min("node").alias("_win"))
    m = m.join(winner, ["repo_id", "target"], "left")
    taken = fmt(K.MSG_VALIDATION_FAILED, error=fmt(K.MSG_TARGET_EXISTS, path=_full(F.col("target"))))
    return m.select(
        "repo_id", "node",
        (F.col("_err").isNull() & (F.col("node") == F.col("_win"))).alias("success"),
        F.when(F.col("_err").isNotNull(), F.col("_err"))
         .when(F.col("node") == F.col("_win"),
               fmt(K.MSG_MOVED, source=F.col("source"), target=F.col("target")))
         .otherwise(taken).alias("message"))


def apply_moves(approved: DataFrame, disk: DataFrame) -> DataFrame:
    """G1: execute approved MOVEs for real, each seeing the tree left by earlier ones.

    Groups of moves that only share a target are resolved set-based; the rest
    (chains through sources, parents, created directories) are split into
    connected components and replayed in hash buckets.
    """
    mv = approved.filter(F.col("approved")).withColumn("node", F.col("ord").cast("bigint"))
    # the moves with their initial states feed several branches: write them once
    checkpoint_dir(mv.sparkSession)
    mv = _file_ancestor(_with_states(mv, disk), disk).checkpoint(eager=True)
    simple = simple_groups(mv).withColumn("_simple", F.lit(True))
    mv = mv.join(simple, ["repo_id", "target"], "left") \
           .withColumn("_simple", F.coalesce("_simple", F.lit(False))).checkpoint(eager=True)
    easy = _resolve_simple(mv.filter("_simple"))
    hard = mv.filter(~F.col("_simple"))
    comp = components(move_edges(hard))
    hard = hard.join(comp, ["repo_id", "node"], "left") \
               .withColumn("component", F.coalesce("component", F.col("node")))
    cols = ["repo_id", "component", "node", "source", "target", "tparent", "tanc_file",
            "src_file", "src_dir", "tgt_file", "tgt_dir", "par_file", "par_dir"]
    res = replay_buckets(hard.select(*cols), replay_moves, RESULT_SCHEMA).unionByName(easy)
    return (mv.select("repo_id", "node", "phase", "ord", "action", "source", "target", "risk")
            .join(res, ["repo_id", "node"]).drop("node")
            .withColumn("skipped", F.lit(False)))


def new_inventory(raw: DataFrame, results: DataFrame, order: str = "ord") -> DataFrame:
    """Next version of the inventory: each file where the successful moves left it.

    A file may be moved on by a later move of the same run (``order`` gives the
    sequence), so the touched files follow their moves until none is left: one
    round for each link of the longest chain, over touched files only. Where ``file_seq`` is
    the walk key of the path, it follows the path.
    """
    done = write_table(
        results.filter(F.col("success") & (F.lower("action") == "move")).select(
            "repo_id", F.col("source").alias("_path"), F.col("target").alias("_to"),
            F.col(order).cast("bigint").alias("_at")), "done-moves")
    place = (raw.select("repo_id", "relative_path", F.col("relative_path").alias("_path"))
             .join(done.select("repo_id", "_path").distinct(), ["repo_id", "_path"], "left_semi")
             .distinct().withColumn("_since", F.lit(None).cast("bigint")))
    while True:
        later = F.col("_since").isNull() | (F.col("_at") > F.col("_since"))
        step = (place.join(done, ["repo_id", "_path"]).filter(later)
                .groupBy("repo_id", "relative_path").agg(F.min(F.struct("_at", "_to")).alias("_next")))
        place = write_table(
            place.join(step, ["repo_id", "relative_path"], "left").select(
                "repo_id", "relative_path", F.coalesce("_next._to", "_path").alias("_path"),
                F.coalesce("_next._at", "_since").alias("_since"),
                F.col("_next").isNotNull().alias("_moved")), "moved-files")
        if place.filter("_moved").limit(1).count() == 0:
            break
        place = place.drop("_moved")
    new = place.select("repo_id", "relative_path", F.col("_path").alias("_to"))
    moved = (raw.join(new, ["repo_id", "relative_path"], "left")
             .withColumn("relative_path", F.coalesce("_to", "relative_path")).drop("_to"))
    if dict(raw.dtypes).get("file_seq") == "binary":
        moved = moved.withColumn("file_seq", R.walk_key(F.col("relative_path")))
    return moved
