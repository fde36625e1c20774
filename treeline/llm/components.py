"""Connected components of similarity links, by least labels.

Every node takes the least label among its neighbours and then the label of its
label (pointer jumping), so the number of rounds grows with the logarithm of
the longest chain. Labels are written to the shared folder after each round:
lineage stays short and a lost executor rereads files. The least label per node
is a partial aggregation, so a node with very many links is summed up before
the shuffle; the joins are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import write_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component: its least node."""
    both = write_table(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter(F.col("a") != F.col("b")).distinct(), f"{name}-edges")
    labels = write_table(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        reach = (both.join(labels.withColumnRenamed("node", "b"), "b")
                 .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = (labels.join(reach, "node", "left")
                .select("node", F.col("label").alias("old"),
                        F.least("label", F.coalesce("near", "label")).alias("label")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = write_table(
            step.join(jump, "label", "left")
            .select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"),
            f"{name}-labels")
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
