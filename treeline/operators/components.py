"""Connected components of moves that touch the same paths.

Applying or undoing moves is sequential: a move sees the tree left by the
earlier ones. Two moves can only influence each other through a path both
touch, so the moves of a repository split into independent components; each
component is replayed on its own (``applyInPandas`` per component), which
spreads a large repository over many tasks.

Components come from label propagation over (move, path) edges: every path
takes the smallest label of its moves, every move the smallest label of its
paths, until nothing changes. Each round is two partial aggregations and two
joins; the labels are checkpointed every round so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import checkpoint_dir


def ancestors(path: F.Column) -> F.Column:
    """Proper ancestor directories of a path, shortest first ([] at the root)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                     lambda k: F.array_join(F.slice(parts, 1, k), "/"))) \
            .otherwise(F.array().cast("array<string>"))


def move_edges(moves: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(repo_id, node, key) edges: each move's two paths, plus those ancestors of
    its ``b`` path that are themselves some move's path in the same repository
    (only then can a created directory or a parent file interact)."""
    direct = moves.select("repo_id", "node", F.explode(F.array(a, b)).alias("key")) \
                  .filter(F.col("key").isNotNull())
    touched = direct.select("repo_id", "key").distinct()
    anc = moves.select("repo_id", "node", F.explode(ancestors(F.col(b))).alias("key"))
    anc = anc.join(touched, ["repo_id", "key"], "left_semi")
    return direct.unionByName(anc).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(repo_id, node) -> component (smallest node id of the component)."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    edges = edges.checkpoint(eager=True)
    labels = edges.select("repo_id", "node").distinct().withColumn("label", F.col("node"))
    labels = labels.checkpoint(eager=True)
    while True:  # labels only decrease, so this ends after at most diameter rounds
        key_label = edges.join(labels, ["repo_id", "node"]).groupBy("repo_id", "key") \
                         .agg(F.min("label").alias("label"))
        new = (edges.join(key_label, ["repo_id", "key"]).groupBy("repo_id", "node")
               .agg(F.min("label").alias("label"))
               .join(labels.withColumnRenamed("label", "old"), ["repo_id", "node"])
               .withColumn("changed", F.col("label") != F.col("old")).drop("old")
               .checkpoint(eager=True))
        labels = new.drop("changed")
        if new.filter("changed").limit(1).count() == 0:
            break
    return labels.withColumnRenamed("label", "component")
