"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source with the share p of all tokens gets the weight ``p^a / sum(p^a)``. The
exponent a lies between 0 (equal weights) and 1 (natural shares). It is bisected
until the entropy of the weights is ``entropy_share`` of the entropy of equal
weights; where that would repeat a source more than ``max_repeats`` times, it is
bisected until the largest repetition is that limit. Natural shares stay as they
are when their entropy already suffices.

Each pass over the table of sources evaluates fifteen exponents inside the
current bracket, four halvings at once, so the sources are never collected, however
many there are.

A source with weight w and T tokens has the token budget ``floor(w * budget)``:
``floor(budget / T)`` whole epochs and one partial epoch. Its documents are dealt
into blocks of about ``BLOCK_TOKENS`` tokens by a hash. In each epoch the blocks
are permuted, and the documents within them, by hashes with the epoch's number.
The partial epoch takes documents in that order while their running sum stays
within what is left: whole blocks by the running sum of block totals (one row
per block), documents one by one only in the block where the budget ends. So a
source with a third of all rows is split by blocks everywhere.

Tokens are counted as longest runs without white space (space, tab, line feed,
carriage return).

Defined results: null source is a source of its own. Null and empty texts have
no tokens and are never drawn. Repeated rows are drawn each for itself. A null
doc_id hashes like any other value. Without tokens the result is empty. All
columns of ``docs`` are passed through by ``mix``, whatever their names; the
plan's columns start with ``mix_`` and replace columns of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import write_table

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
SEED = "mix"
ROUNDS = 10            # of four halvings each
BROADCAST_ROWS = 50_000

PLAN = ("mix_tokens", "mix_epoch", "mix_block", "mix_block_rank", "mix_order")


def token_count(text: Column) -> Column:
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), "[ \\t\\n\\r]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string")
                                    for p in parts]))


def _number(hexes: Column) -> Column:
    """The first 60 bits of an md5 in hex as a number."""
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def _counted(docs: DataFrame) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    key = _hash(SEED, source, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # The caller's columns travel as one: their names meet none of the names used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in PLAN])
    return docs.select(row.alias("__mix_row"), source.alias("__mix_source"),
                       token_count(F.col("text")).alias("mix_tokens"), key.alias("__mix_key"))


def sources(docs: DataFrame) -> DataFrame:
    """(__mix_source, total): the tokens of every source that has any."""
    return (_counted(docs).groupBy("__mix_source").agg(F.sum("mix_tokens").alias("total"))
            .filter("total > 0"))


def _sums(table: DataFrame, all_tokens: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(sum p^a, sum p^a ln p, largest p^a / p) for each exponent, in one pass."""
    p = F.col("total") / F.lit(float(all_tokens))
    aggs = []
    for k, a in enumerate(exponents):
        power = F.pow(p, F.lit(a))
        aggs += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(p)).alias(f"l{k}"),
                 F.max(power / p).alias(f"r{k}")]
    row = table.agg(*aggs).first()
    return [(row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]) for k in range(len(exponents))]


def exponent(table: DataFrame, budget: float, entropy_share: float = ENTROPY_SHARE,
             max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for a table of sources, rounded to six decimals."""
    n, all_tokens = table.agg(F.count("*"), F.sum("total")).first()
    if n < 2:
        return 1.0
    goal = entropy_share * math.log(n)

    def enough_entropy(a, z, l, r):  # true up to some exponent, then false
        return math.log(z) - a * l / z >= goal

    def few_repeats(a, z, l, r):     # false up to some exponent, then true
        return budget / all_tokens * r / z <= max_repeats

    def bisect(holds, at_low: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / 16 for k in range(1, 16)]
            same = [holds(a, *s) == at_low for a, s in zip(grid, _sums(table, all_tokens, grid))]
            k = same.index(False) if False in same else 15
            points = [low, *grid, high]
            low, high = points[k], points[k + 1]
        return (low + high) / 2

    (ends,) = _sums(table, all_tokens, [1.0])
    a = 1.0 if enough_entropy(1.0, *ends) else bisect(enough_entropy, True)
    (there,) = _sums(table, all_tokens, [a])
    if not few_repeats(a, *there):
        a = bisect(few_repeats, False) if few_repeats(1.0, *ends) else 1.0
    return round(a, 6)


def budgets(table: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
            max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(__mix_source, total, weight, allowed, epochs, rest) of a table of sources."""
    all_tokens = table.agg(F.sum("total")).first()[0] or 0
    budget = all_tokens if budget is None else budget
    if not all_tokens:
        return table.selectExpr("__mix_source", "total", "0D AS weight", "0L AS allowed",
                                "0L AS epochs", "0L AS rest")
    a = exponent(table, budget, entropy_share, max_repeats)
    ((z, _, _),) = _sums(table, all_tokens, [a])
    weight = F.pow(F.col("total") / F.lit(float(all_tokens)), F.lit(a)) / F.lit(z)
    allowed = F.floor(F.round(weight * F.lit(float(budget)), 3)).cast("long")
    return (table.withColumn("weight", weight).withColumn("allowed", allowed)
            .withColumn("epochs", F.floor(F.col("allowed") / F.col("total")).cast("long"))
            .withColumn("rest", F.col("allowed") - F.col("epochs") * F.col("total")))


def _small(table: DataFrame) -> DataFrame:
    """The table marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
        max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, once for each time they are drawn, with the plan's columns:
    ``mix_tokens``, ``mix_epoch``, ``mix_block``, ``mix_block_rank`` (place of the block
    in the epoch) and ``mix_order`` (sorts the documents of a block)."""
    counted = _counted(docs).filter("mix_tokens > 0")
    totals = write_table(sources(docs), "mix-sources")
    plan = write_table(budgets(totals, budget, entropy_share, max_repeats)
                       .withColumn("blocks", F.ceil(F.col("total") / block_tokens)), "mix-plan")
    block = F.pmod(_number(F.col("__mix_key")), F.col("__mix_blocks")).alias("mix_block")
    dealt = counted.join(_small(plan.select("__mix_source", F.col("blocks").alias("__mix_blocks"))), "__mix_source") \
                   .select(*counted.columns, block)
    order = F.col("block_order")
    earlier = (Window.partitionBy("__mix_source").orderBy(order, "mix_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    sums = write_table(
        dealt.groupBy("__mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
        .join(plan, "__mix_source")
        .withColumn("block_order", _hash(SEED, F.col("__mix_source"), F.col("epochs"), F.col("mix_block")))
        .withColumn("before", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)))
        .select("__mix_source", "mix_block", "block_tokens", "epochs", "rest", "before"), "mix-blocks")
    state = sums.select("__mix_source", "mix_block", *[F.col(c).alias(f"__mix_{c}") for c in
                                                       ("block_tokens", "epochs", "rest", "before")])
    rows = dealt.join(_small(state), ["__mix_source", "mix_block"])
    before, rest = F.col("__mix_before"), F.col("__mix_rest")
    epochs = F.col("__mix_epochs")
    end = before + F.col("__mix_block_tokens")
    times = epochs + F.when(end <= rest, 1).otherwise(0)
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("mix_epoch")
    keep = [*counted.columns, "mix_block"]
    whole = rows.filter(times > 0).select(*keep, epoch)
    run = (Window.partitionBy("__mix_source", "mix_block").orderBy("mix_order", "__mix_row.doc_id")
           .rowsBetween(Window.unboundedPreceding, 0))
    split = (rows.filter((before < rest) & (end > rest))
             .withColumn("mix_order", _hash(SEED, epochs, F.col("__mix_key")))
             .withColumn("__mix_sum", F.sum("mix_tokens").over(run))
             .filter(before + F.col("__mix_sum") <= rest)
             .select(*keep, epochs.alias("mix_epoch")))
    drawn = whole.unionByName(split)
    rank = _ranks(sums)
    return (drawn.join(_small(rank), ["__mix_source", "mix_block", "mix_epoch"])
            .withColumn("mix_order", _hash(SEED, F.col("mix_epoch"), F.col("__mix_key")))
            .select("__mix_row.*", *PLAN))


def _ranks(sums: DataFrame) -> DataFrame:
    """(__mix_source, mix_block, mix_epoch, mix_block_rank) for every epoch of every block."""
    times = F.sequence(F.lit(0).cast("long"), F.col("epochs"))
    each = sums.select("__mix_source", "mix_block", F.explode(times).alias("mix_epoch"))
    place = Window.partitionBy("__mix_source", "mix_epoch").orderBy(
        _hash(SEED, F.col("__mix_source"), F.col("mix_epoch"), F.col("mix_block")), "mix_block")
    return each.withColumn("mix_block_rank", F.row_number().over(place).cast("long"))
