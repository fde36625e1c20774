"""Numbering and first-k selection without gathering a group into one task.

A repository can hold a third of all rows, so a plain
``row_number() OVER (PARTITION BY repo_id ORDER BY ...)`` would sort that
third in one task. ``number_within`` numbers rows by range-partitioning on the
full sort key (which splits a hot repository across many tasks), numbering
inside each range slice, and adding the count of the repository's rows in all
earlier slices (a table with one row per slice and repository). The sliced
rows are checkpointed once so that numbering and counting see the same cut.

``first_k`` keeps the first ``k`` rows per group with ``row_number <= k``:
Spark plans a partial ``WindowGroupLimit`` before the shuffle, so each map task
forwards at most ``k`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import checkpoint_dir

# spark.sql.optimizer.windowGroupLimitThreshold by default
_PARTIAL_LIMIT = 1000


def number_within(df: DataFrame, keys: list[str], order: list[Column | str],
                  name: str = "n", slices: int | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, ... in ``order`` within each ``keys`` group."""
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # The range bounds come from a sample, so a recomputation may cut the
    # slices differently; a reliable checkpoint (shared folder named by
    # spark.checkpoint.dir) fixes one cut for both branches below.
    checkpoint_dir(spark)
    ranged = (df.repartitionByRange(slices, *[F.col(k) for k in keys], *order_cols)
              .withColumn("_slice", F.spark_partition_id())
              .checkpoint(eager=True))
    w_local = Window.partitionBy("_slice", *keys).orderBy(*order_cols)
    local = ranged.withColumn("_local", F.row_number().over(w_local))
    per_slice = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))) \
                       .drop("_cnt")
    return (local.join(offsets, [*keys, "_slice"], "inner")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_slice", "_local", "_off"))


_BEFORE = {  # what a running value starts from, and how two slices' values make one
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _running(kind: str, value: Column | str) -> Column:
    return F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)


def before(df: DataFrame, keys: list[str], order: list[Column | str],
           values: dict[str, tuple[str, str]], few: bool = False) -> DataFrame:
    """Add running values over the rows before, in ``order`` within ``keys``.

    ``values`` maps a new column to (kind, column): the ``sum``, the ``max`` or the ``last`` value that is
    not null. Range slices as in ``number_within``, so that a large group spreads over tasks;
    ``few`` says that groups are bounded and a plain window will do.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ahead = Window.unboundedPreceding, -1
    if few:
        w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(*ahead)
        rows = df.select("*", *[_running(kind, c).over(w).alias(n) for n, (kind, c) in values.items()])
        return rows.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint")
                                 for n, (kind, _) in values.items() if kind == "sum"})
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(slices, *[F.col(k) for k in keys], *order_cols)
              .withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True))
    rows_before = Window.partitionBy("_slice", *keys).orderBy(*order_cols).rowsBetween(*ahead)
    slices_before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*ahead)
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)])
    totals = {n: F.max_by(c, F.when(F.col(c).isNotNull(), place)) if kind == "last" else getattr(F, kind)(c)
              for n, (kind, c) in values.items()}
    offsets = ranged.groupBy(*keys, "_slice").agg(*[t.alias(f"_t_{n}") for n, t in totals.items()])
    offsets = offsets.select(*keys, "_slice", *[_running(kind, f"_t_{n}").over(slices_before).alias(f"_s_{n}")
                                                for n, (kind, _) in values.items()])
    local = ranged.select("*", *[_running(kind, c).over(rows_before).alias(f"_l_{n}")
                                 for n, (kind, c) in values.items()])
    joined = local.join(offsets, [*keys, "_slice"])
    added = {n: _BEFORE[kind](F.col(f"_s_{n}"), F.col(f"_l_{n}")) for n, (kind, _) in values.items()}
    return joined.select(*df.columns, *[
        (c.cast("bigint") if values[n][0] == "sum" else c).alias(n) for n, c in added.items()])


def first_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int,
            name: str = "rn") -> DataFrame:
    """Rows 1..k per group in ``order`` (partial top-k before the shuffle).

    Spark plans the partial limit up to ``_PARTIAL_LIMIT`` rows; beyond it the
    rows are numbered over range slices, so a large k sorts no group in one task.
    """
    if k > _PARTIAL_LIMIT:
        return number_within(df, keys, order, name).filter(F.col(name) <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
