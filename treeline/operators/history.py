"""E3 ``rollback`` and the execution history (F12, W2, W3, W5, G2, A17, S4 records).

History rows: repo_id, seq (order of the entry), executed_at, action,
source, target, success, skipped, risk (+ message when written by us).
Undone moves stay in the history and can be picked again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import constants as K
from treeline.functions.text import fmt, render
from treeline.operators.components import ancestors, components, move_edges
from treeline.operators.moves import (_ancestors_of, _file_ancestor, attach_states, new_inventory,
                                       replay_buckets)
from treeline.session import checkpoint_dir
from treeline.operators.ordering import first_k


def undoable(history: DataFrame) -> DataFrame:
    """action MOVE (any case), success is true, skipped is not true."""
    return history.filter((F.upper("action") == "MOVE") & (F.col("success") == F.lit(True))
                          & ~F.coalesce(F.col("skipped") == F.lit(True), F.lit(False)))


def last_moves(history: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` undoable moves, newest first (``undo_rank`` 1 = newest).

    ``n`` must be positive; ``None`` (or n >= count) selects every entry.
    The rank comes from a first-k window, so each map task forwards at most
    ``n`` rows per repository.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be a positive number")
    u = undoable(history)
    if n is None:
        return u.withColumn("undo_rank", F.lit(None).cast("bigint"))
    return first_k(u, ["repo_id"], [F.col("seq").desc()], n, name="undo_rank") \
        .withColumn("undo_rank", F.col("undo_rank").cast("bigint"))


def _rollback_states(sel: DataFrame, disk: DataFrame) -> DataFrame:
    return attach_states(sel, {"tgt": "target", "src": "source"}, disk, key="seq")


def _rollback_record(df: DataFrame) -> DataFrame:
    return df.select(
        "repo_id", F.col("seq").alias("undone_seq"),
        F.lit("move").alias("action"),
        F.col("target").alias("source"), F.col("source").alias("target"),
        "success", F.lit(False).alias("skipped"), "message", F.lit("high").alias("risk"),
        fmt(K.ROLLBACK_REASON, source=F.col("source"), target=F.col("target")).alias("reason"))


def rolled_back_inventory(disk: DataFrame, results: DataFrame) -> DataFrame:
    """The inventory after a real rollback: moves are undone newest first."""
    return new_inventory(disk, results.withColumn("_undo_order", -F.col("undone_seq")),
                         order="_undo_order")


def fail_fast(results: DataFrame) -> DataFrame:
    """Keep results up to and including the first failure (newest first).

    Processing runs in descending ``seq``, so the first failure is the failed
    entry with the largest seq; a grouped max marks the cut.
    """
    cut = results.filter(~F.col("success")).groupBy("repo_id").agg(
        F.max("seq").alias("_cut"))
    return (results.join(cut, "repo_id", "left")
            .filter(F.col("_cut").isNull() | (F.col("seq") >= F.col("_cut"))).drop("_cut"))


def rollback_dry_run(history: DataFrame, disk: DataFrame, n: int | None) -> DataFrame:
    """G2 with dry_run: every undo is checked against the tree as it is; W3 cut."""
    sel = _rollback_states(last_moves(history, n), disk)
    ok_target = F.col("tgt_file") | F.col("tgt_dir")
    ok_source = ~(F.col("src_file") | F.col("src_dir"))
    full = lambda c: F.concat(F.col("repo_id"), F.lit("/"), F.col(c))
    msg = (F.when(~ok_target, fmt(K.MSG_ROLLBACK_TARGET_MISSING, path=full("target")))
           .when(~ok_source, fmt(K.MSG_ROLLBACK_SOURCE_EXISTS, path=full("source")))
           .otherwise(fmt(K.MSG_DRY_RUN_ROLLBACK, source=F.col("target"), target=F.col("source"))))
    res = sel.withColumn("success", ok_target & ok_source).withColumn("message", msg)
    return _rollback_record(fail_fast(res))


ROLLBACK_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("node", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("message", T.StringType()),
])


def replay_rollback(pdf: pd.DataFrame) -> pd.DataFrame:
    """Undo each component's entries newest first, each on the tree left so far."""
    out = []
    pdf = pdf.sort_values(["repo_id", "component", "seq"], ascending=[True, True, False])
    for _, comp in pdf.groupby(["repo_id", "component"], sort=False):
        out.extend(_undo_component(comp))
    return pd.DataFrame(out, columns=["repo_id", "node", "success", "message"])


def _undo_component(pdf: pd.DataFrame) -> list[tuple]:
    state: dict[str, str | None] = {}
    rows = list(pdf.itertuples(index=False))
    for r in rows:
        for p, f, d in ((r.target, r.tgt_file, r.tgt_dir), (r.source, r.src_file, r.src_dir),
                        (r.tanc_file, True, False)):
            if p is not None and p not in state:
                state[p] = "file" if f else ("dir" if d else None)
    out = []
    for r in rows:
        back_from, back_to = r.target, r.source
        if state.get(back_from) is None:
            out.append((r.repo_id, r.seq, False,
                        render(K.MSG_ROLLBACK_TARGET_MISSING, path=f"{r.repo_id}/{back_from}")))
            continue
        if state.get(back_to) is not None:
            out.append((r.repo_id, r.seq, False,
                        render(K.MSG_ROLLBACK_SOURCE_EXISTS, path=f"{r.repo_id}/{back_to}")))
            continue
        blocked = next((a for a in _ancestors_of(back_to) if state.get(a) == "file"), None)
        if blocked is not None:
            out.append((r.repo_id, r.seq, False, render(
                K.MSG_ROLLBACK_FAILED, error=render(K.MSG_NOT_A_DIRECTORY, path=f"{r.repo_id}/{blocked}"))))
            continue
        for a in _ancestors_of(back_to):
            state[a] = "dir"
        # the moved path keeps its kind; a directory's untracked contents are not followed
        state[back_to] = state[back_from]
        state[back_from] = None
        out.append((r.repo_id, r.seq, True, render(K.MSG_ROLLED_BACK, source=back_from, target=back_to)))
    return out


def rollback(history: DataFrame, disk: DataFrame, n: int | None) -> DataFrame:
    """G2 for real: undo entries newest first; stop at the first failure.

    Entries interact only through shared paths, so each component is replayed
    on its own (without stopping); the first failure of the repository is
    then the failed entry with the largest seq over all components, and W3
    keeps everything up to it. Effects after the cut never happen, and no
    entry before the cut depends on another component, so this equals one
    sequential pass.
    """
    sel = last_moves(history, n).withColumn("node", F.col("seq").cast("bigint"))
    # the undo moves target -> source: directories are made below ``source``
    checkpoint_dir(sel.sparkSession)
    sel = _file_ancestor(_rollback_states(sel, disk), disk, col="source").checkpoint(eager=True)
    iso = isolated_entries(sel).withColumn("_iso", F.lit(True))
    sel = sel.join(iso, ["repo_id", "node"], "left") \
             .withColumn("_iso", F.coalesce("_iso", F.lit(False))).checkpoint(eager=True)
    easy = _undo_static(sel.filter("_iso"))
    hard = sel.filter(~F.col("_iso"))
    comp = components(move_edges(hard, a="target", b="source"))
    hard = hard.join(comp, ["repo_id", "node"], "left") \
               .withColumn("component", F.coalesce("component", F.col("node")))
    cols = ["repo_id", "component", "seq", "source", "target", "tanc_file", "tgt_file", "tgt_dir",
            "src_file", "src_dir"]
    res = replay_buckets(hard.select(*cols), replay_rollback, ROLLBACK_SCHEMA).unionByName(easy)
    res = res.withColumnRenamed("node", "seq")
    joined = sel.drop("success", "message").join(res, ["repo_id", "seq"])
    return _rollback_record(fail_fast(joined))


def isolated_entries(sel: DataFrame) -> DataFrame:
    """Undo entries that share no path with any other selected entry.

    An undo reads and writes its two paths and makes the directories above
    its destination; an entry is isolated when neither path is another
    entry's path, neither is an ancestor of any entry's destination, and no
    ancestor of its destination is any entry's path. Its outcome is then
    fixed by the initial tree.
    """
    ends = sel.select("repo_id", "node", F.explode(F.array("target", "source")).alias("path"))
    shared = ends.groupBy("repo_id", "path").agg(F.count_distinct("node").alias("c")) \
                 .filter(F.col("c") > 1).select("repo_id", "path")
    ancs = sel.select("repo_id", "node", F.explode(ancestors(F.col("source"))).alias("path"))
    bad = (ends.join(shared, ["repo_id", "path"], "left_semi").select("repo_id", "node")
           .unionByName(ends.join(ancs.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
                        .select("repo_id", "node"))
           .unionByName(ancs.join(ends.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
                        .select("repo_id", "node"))
           .distinct())
    return sel.select("repo_id", "node").join(bad, ["repo_id", "node"], "left_anti")


def _undo_static(sel: DataFrame) -> DataFrame:
    """Outcome of isolated undo entries, from the initial tree alone."""
    full = lambda c: F.concat(F.col("repo_id"), F.lit("/"), F.col(c))
    ok_target = F.col("tgt_file") | F.col("tgt_dir")
    ok_source = ~(F.col("src_file") | F.col("src_dir"))
    blocked = F.col("tanc_file").isNotNull()
    msg = (F.when(~ok_target, fmt(K.MSG_ROLLBACK_TARGET_MISSING, path=full("target")))
           .when(~ok_source, fmt(K.MSG_ROLLBACK_SOURCE_EXISTS, path=full("source")))
           .when(blocked, fmt(K.MSG_ROLLBACK_FAILED,
                              error=fmt(K.MSG_NOT_A_DIRECTORY, path=full("tanc_file"))))
           .otherwise(fmt(K.MSG_ROLLED_BACK, source=F.col("target"), target=F.col("source"))))
    return sel.select("repo_id", "node", (ok_target & ok_source & ~blocked).alias("success"),
                      msg.alias("message"))


def rollback_history_records(results: DataFrame, heads: DataFrame) -> DataFrame:
    """S4 records of a real rollback: action ROLLBACK, risk high, numbered after ``heads``
    (repo_id, last: the last seq of each repository, see ``sources.commits``)."""
    top = results.groupBy("repo_id").agg(F.max("undone_seq").alias("_top"))
    r = results.join(heads, "repo_id", "left").join(top, "repo_id")
    return r.select(
        "repo_id",
        (F.coalesce("last", F.lit(0)) + 1 + F.col("_top") - F.col("undone_seq")).alias("seq"),
        F.localtimestamp().alias("executed_at"), F.lit("ROLLBACK").alias("action"),
        "source", "target", "success", "skipped", "message", "risk")


def apply_history_records(results: DataFrame, heads: DataFrame) -> DataFrame:
    """S4 records of a real apply, written only for repositories with a success and numbered
    after ``heads``."""
    ok = results.filter("success").select("repo_id").distinct()
    low = results.groupBy("repo_id").agg(F.min("ord").alias("_low"))
    r = results.join(ok, "repo_id", "left_semi").join(heads, "repo_id", "left").join(low, "repo_id")
    return r.select(
        "repo_id", (F.coalesce("last", F.lit(0)) + 1 + F.col("ord") - F.col("_low")).alias("seq"),
        F.localtimestamp().alias("executed_at"), "action", "source", "target", "success",
        "skipped", "message", "risk")


def recent_history(history: DataFrame, k: int = 20) -> DataFrame:
    """The last ``k`` entries newest first, with the repository's total."""
    total = history.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_entries"))
    last = first_k(history, ["repo_id"], [F.col("seq").desc()], k, name="position")
    return last.join(total, "repo_id").withColumn("position", F.col("position").cast("bigint"))


def rollback_summary(results: DataFrame) -> DataFrame:
    """Total, successful, failed operations of a rollback."""
    return results.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"))

