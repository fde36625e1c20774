"""E2 preview: impact summary, new directories and the before / after tree.

Trees are drawn from all paths they are given, however many a repository has:
last siblings are grouped maxima, nodes, lines and what stands before them are running
values over range slices of one sort. Only
the before / after view draws the first 50 affected files per side.
Drawing rules: directories sort before files, then by name; a node is a file
iff its own path is in the list (a path always sorts before the paths below
it, so it is the first to create its node); nothing below a file is drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions.text import fmt
from treeline.operators.ordering import before, first_k
from treeline.session import write_table

MAX_FILES = 50
_GREATEST = "\U0010FFFF"    # sorts after every other part of a path
PIPE, SPACE, TEE, ELBOW = K.TREE_PIPE, K.TREE_SPACE, K.TREE_TEE, K.TREE_ELBOW


def affected_files(proposals: DataFrame) -> DataFrame:
    """Distinct sources of MOVE and FLAG proposals."""
    return proposals.filter(F.col("action").isin("move", "flag")) \
                    .select("repo_id", F.col("source").alias("path")).distinct()


def after_state(proposals: DataFrame) -> DataFrame:
    """Each affected path, replaced by its target when it moves."""
    aff = affected_files(proposals)
    mv = proposals.filter(F.col("action") == "move").select(
        "repo_id", F.col("source").alias("path"), F.col("target"))
    return (aff.join(mv, ["repo_id", "path"], "left")
            .select("repo_id", F.col("path").alias("source"),
                    F.coalesce("target", "path").alias("path")))


def affected_paths(proposals: DataFrame) -> DataFrame:
    """All affected paths per repository and side ('before' / 'after'), each once."""
    before = affected_files(proposals).select("repo_id", F.lit("before").alias("side"), "path")
    after = after_state(proposals).select("repo_id", F.lit("after").alias("side"), "path")
    return before.unionByName(after.distinct())


def limit_affected(proposals: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """L2: first ``max_files`` paths per repository and side, in path order.

    Columns: repo_id, side ('before' / 'after'), pos, path, affected_total.
    The after list keeps one entry per affected file, so two moves to one
    target stay two entries before the cut.
    """
    before = affected_files(proposals).withColumn("side", F.lit("before"))
    after = after_state(proposals).select("repo_id", "path", F.lit("after").alias("side"),
                                          F.col("source").alias("_tie"))
    before = before.withColumn("_tie", F.col("path"))
    both = before.unionByName(after)
    cut = first_k(both, ["repo_id", "side"], [F.split("path", "/"), F.col("_tie")], max_files,
                  name="pos")
    total = affected_files(proposals).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("affected_total"))
    return cut.join(total, "repo_id").select(
        "repo_id", "side", F.col("pos").cast("bigint").alias("pos"), "path", "affected_total")


def tree_nodes(paths: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Every path prefix once per ``keys`` group, with ``is_file``.

    Input columns: ``keys`` + ``path``. Output: keys, node (path prefix), nparts,
    name, parent ('' at the top), depth, is_file; nodes below a file dropped.

    One sort of the paths, part by part: what lies below a path stands right behind it, in the
    interval from the path to the path with a greatest part added. A path is below a file iff
    it stands before the end of an earlier path's interval (a running maximum), and the nodes
    that it brings are its prefixes longer than what it shares with the path before.
    ``few``: the groups are bounded (T3's cut).
    """
    p = paths.select(*keys, F.split("path", "/").alias("parts")).distinct() \
        .withColumn("_end", F.concat("parts", F.array(F.lit(_GREATEST))))
    p = before(p, keys, ["parts"], {"_open": ("max", "_end"), "_prev": ("last", "parts")}, few)
    p = p.filter(F.col("_open").isNull() | (F.col("_open") <= F.col("parts")))
    differs = F.zip_with("_prev", "parts", lambda a, b: ~a.eqNullSafe(b))
    shared = F.coalesce(F.array_position(differs, True) - 1, F.lit(0))
    return p.select(*keys, "parts", F.explode(F.sequence(shared + 1, F.size("parts").cast("long"))).alias("_d")) \
        .select(*keys, F.slice("parts", 1, F.col("_d").cast("int")).alias("nparts"),
                F.col("_d").cast("int").alias("depth"), (F.col("_d") == F.size("parts")).alias("is_file")) \
        .withColumns({
            "node": F.array_join("nparts", "/"), "name": F.element_at("nparts", -1),
            "parent": F.array_join(F.slice("nparts", 1, F.col("depth") - 1), "/")})


def last_siblings(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` with ``is_last``: the greatest (is_file, name) below its parent.

    A grouped maximum, so a directory with very many entries is summed up
    before the shuffle and never sorted in one task.
    """
    last = nodes.groupBy(*keys, "parent").agg(
        F.max(F.struct("is_file", "name")).alias("_last"))
    return (nodes.join(last, [*keys, "parent"])
            .withColumn("is_last", F.struct("is_file", "name") == F.col("_last")).drop("_last"))


def tree_lines(nodes: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """T2 (+ W4): one drawn line per node and its position in the drawing.

    In drawing order the directories above a node are the last ones before it at each lesser
    depth, so what stands before its name is a running state: whether the last directory of
    depth 1, 2, ... was the last of its siblings. The plan has one such column for every level of
    the deepest directory. Lines are numbered in the same pass, over range slices; ``few`` says
    that a group is bounded (T3's cut).
    """
    n = last_siblings(nodes, keys)
    # sort key: (is_file, name) of every ancestor-or-self; ancestors are directories
    n = n.withColumn("skey", F.concat(
        F.transform(F.slice("nparts", 1, F.col("depth") - 1),
                    lambda x: F.struct(F.lit(False).alias("f"), x.alias("n"))),
        F.array(F.struct(F.col("is_file").alias("f"), F.col("name").alias("n")))))
    n = write_table(n.select(*keys, "node", "name", "depth", "is_file", "is_last", "skey"), "tree-nodes")
    deepest = n.filter(~F.col("is_file")).agg(F.max("depth")).first()[0] or 0
    levels = range(1, deepest + 1)
    n = n.withColumns({"_one": F.lit(1)} | {
        f"_at{k}": F.when((F.col("depth") == k) & ~F.col("is_file"), F.col("is_last")) for k in levels})
    n = before(n, keys, ["skey"], {"_lines": ("sum", "_one")} | {
        f"_last{k}": ("last", f"_at{k}") for k in levels}, few)
    pieces = [F.when(F.col("depth") > k, F.when(F.col(f"_last{k}"), F.lit(SPACE)).otherwise(F.lit(PIPE)))
              .otherwise(F.lit("")) for k in levels]
    text = F.concat(*pieces, F.when(F.col("is_last"), F.lit(ELBOW)).otherwise(F.lit(TEE)),
                    F.col("name"), F.when(F.col("is_file"), F.lit("")).otherwise(F.lit("/")))
    return n.select(*keys, "node", "is_file", "is_last", text.alias("text"),
                    (F.col("_lines") + 1).alias("line_no"))


def tree_diff(proposals: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Before / after drawings of repositories with moves.

    Columns: repo_id, side, line_no, text; line 0 is '.', and a last line holds
    the '... showing 50 of n affected files' note when the list was cut.
    """
    with_moves = proposals.filter(F.col("action") == "move").select("repo_id").distinct()
    # the cut feeds the nodes, the lines and the heads: written once
    cut = write_table(limit_affected(proposals.join(with_moves, "repo_id", "left_semi"), max_files),
                      "tree-cut")
    keys = ["repo_id", "side"]
    lines = tree_lines(tree_nodes(cut.select(*keys, "path"), keys, few=True), keys, few=True) \
        .select(*keys, "line_no", "text")
    heads = cut.select(*keys, "affected_total").distinct()
    top = heads.select(*keys, F.lit(0).cast("bigint").alias("line_no"), F.lit(".").alias("text"))
    notes = heads.filter(F.col("affected_total") > max_files).select(
        *keys, F.lit(1_000_000_000).cast("bigint").alias("line_no"),
        fmt(K.TREE_NOTE, shown=str(max_files), total=F.col("affected_total").cast("string")).alias("text"))
    return top.unionByName(lines).unionByName(notes)


def new_directories(proposals: DataFrame) -> DataFrame:
    """Every ancestor directory of a MOVE target (existing ones included)."""
    t = proposals.filter(F.col("action") == "move").select("repo_id", F.split("target", "/").alias("p"))
    t = t.filter(F.size("p") > 1)
    d = t.select("repo_id", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p")
    return d.select("repo_id", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("directory")) \
            .distinct()


def impact_summary(proposals: DataFrame, repo_list: DataFrame) -> DataFrame:
    """Moves, flags, MOVE risk breakdown, duplicate groups, new directories."""
    p = proposals.groupBy("repo_id").agg(
        F.count_if(F.col("action") == "move").alias("total_moves"),
        F.count_if(F.col("action") == "flag").alias("total_flags"),
        F.count_if((F.col("action") == "move") & (F.col("risk") == "high")).alias("high"),
        F.count_if((F.col("action") == "move") & (F.col("risk") == "medium")).alias("medium"),
        F.count_if((F.col("action") == "move") & (F.col("risk") == "low")).alias("low"),
        F.count_if((F.col("action") == "flag") & F.col("reason").contains(K.DUPLICATE_PREFIX))
         .alias("duplicate_groups"))
    nd = new_directories(proposals).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("new_directories"))
    cols = ["total_moves", "total_flags", "high", "medium", "low", "duplicate_groups",
            "new_directories"]
    return (repo_list.join(p, "repo_id", "left").join(nd, "repo_id", "left")
            .na.fill(0, cols)
            .select("repo_id", *[F.col(c).cast("bigint").alias(c) for c in cols]))


def new_directories_preview(proposals: DataFrame, k: int = 5) -> DataFrame:
    """L3: first ``k`` new directories in string order and the '(+n more)' tail."""
    nd = new_directories(proposals)
    total = nd.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    first = first_k(nd, ["repo_id"], [F.col("directory")], k).groupBy("repo_id").agg(
        F.array_join(F.array_sort(F.collect_list("directory")), ", ").alias("head"))
    text = F.concat(F.col("head"), F.when(F.col("n") > k, fmt(K.NEW_DIRS_MORE, n=(F.col("n") - k).cast("string")))
                    .otherwise(F.lit("")))
    return total.join(first, "repo_id").select(
        "repo_id", F.col("n").cast("bigint").alias("new_directories"), text.alias("preview"))
