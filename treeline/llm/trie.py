"""Conversation prefix trie by fixed-length blocks of turns.

The nodes are the distinct sequences of first turns (role, text) of the given
conversations, from the root without a turn. Prefixes are named by a depth and a
128-bit hash that is the exclusive or of hashes of (place, role, text): the name of a longer
prefix follows from a shorter one's and the turns between.

* Block digests first: the turns of a conversation are cut into blocks of ``BLOCK``
  turns, and conversations are grouped by the prefix before a block and the block's
  own digest. One aggregation over one row per block gives the members of every
  block, copies collapsing before the shuffle.
* Turn boundaries only where siblings diverge: where all members that enter a block
  go through the same turns of it, its inner nodes are those of one chain and have
  the block's members. Only where the blocks after one prefix differ are the
  boundaries inside them refined, by grouping the distinct blocks (not the
  conversations) by every turn prefix.

Sums over subtrees need no walk. A conversation *owns* the nodes of which it is the
smallest member: they are the end of its path, from some depth on. So the leaves
below a node are its members that own a leaf, and a sum over its subtree is the
sum of its members' whole totals, less what the node's own owner has above it.
Both sums over members are again an aggregation of blocks.

No conversation, node or group is gathered: places of turns, prefix hashes and running
sums come from range slices, blocks hold ``BLOCK`` turns, and the members that end at
a node are joined to text slice by slice, so that the digest of a node's list reads
packed pieces in order.

``rebuilt`` makes the conversations that op12 counts: of conversation c, the first h original turns of conversation
c - c % 20, then c's own turns after its first h, with h = crc32(decimal c) % 4.

Defined results: turns are ordered by turn (null first), equal ones by role and text;
null role or text is empty; repeated rows are turns of their own. Rows with null
conv_id belong to no conversation and are ignored. A conversation whose turns are all
replaced by nothing is a member of the root alone. An empty table has no nodes, not
even the root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import each_batch
from treeline.operators.ordering import number_within
from treeline.session import write_table

BLOCK = 4
SHARED = 20        # conversations that share a beginning
PIECE_IDS = 4096   # ids in one packed piece of a list

#: words of a text: runs of anything but the ASCII white space
_WORD = "[^\\x20\\x09-\\x0D]+"


def _running(df: DataFrame, key: str, order: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Add what stands before each row of its ``key``: ``columns`` maps a new name to
    (aggregate, column), the aggregate over all earlier rows in ``order``.

    Rows are dealt by ranges of (key, order) and written, so that a key of any size
    spreads over tasks; the slices' own totals are added up per key.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = write_table(df.repartitionByRange(slices, key, order)
                         .withColumn("slice_no", F.spark_partition_id()), "trie-slices")

    def plus(kind: str, a: Column, b: Column) -> Column:
        a, b = F.coalesce(a, F.lit(0).cast("long")), F.coalesce(b, F.lit(0).cast("long"))
        return a.bitwiseXOR(b) if kind == "bit_xor" else a + b

    before = Window.partitionBy("slice_no", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(key, "slice_no").agg(
        *[F.expr(f"{kind}({c})").alias(f"slice_{n}") for n, (kind, c) in columns.items()])
    # one row for each slice of a key
    totals = totals.select(key, "slice_no", *[F.expr(f"{kind}(slice_{n})").over(earlier).alias(f"slice_{n}")
                                              for n, (kind, _) in columns.items()])
    local = ranged.select("*", *[F.expr(f"{kind}({c})").over(before).alias(f"local_{n}")
                                 for n, (kind, c) in columns.items()])
    return local.join(totals, [key, "slice_no"]).select(
        *df.columns, *[plus(kind, F.col(f"slice_{n}"), F.col(f"local_{n}")).alias(n)
                       for n, (kind, _) in columns.items()])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and the (conv_id, place, role, text) of their rebuilt
    turns, places from 1."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    turns = number_within(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"),
                                               F.col("text")], "place")
    heads = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("place") <= 3))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ids = counts.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"),
                        (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(base, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    # at most three turns of a conversation, for the others of its twenty
    first = (ids.select("conv_id", "base", "taken")
             .join(heads.select(F.col("conv_id").alias("base"), "place", "role", "text"), "base")
             .filter("place <= taken").select("conv_id", "place", "role", "text"))
    own = (turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("place > h")
           .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"),
                   "role", "text"))
    return ids.select("conv_id"), first.unionByName(own)


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: conv_id, block (from 0), turns (array of p1, p2, words: the name of the
    prefix up to each turn), before1, before2 (the name of the prefix before the block)."""
    # (length of the role, role, text) is one string for one turn only
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    single = turns.select(
        "conv_id", "place", F.floor((F.col("place") - 1) / size).cast("long").alias("block"),
        F.xxhash64(F.lit(1), "place", key).alias("h1"), F.xxhash64(F.lit(2), key, "place").alias("h2"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))
    packed = single.groupBy("conv_id", "block").agg(     # at most `size` turns
        F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "words"))).alias("turns"),
        F.expr("bit_xor(h1)").alias("x1"), F.expr("bit_xor(h2)").alias("x2"))
    chained = _running(packed, "conv_id", "block",
                       {"before1": ("bit_xor", "x1"), "before2": ("bit_xor", "x2")})
    def named(k: int, i: Column) -> Column:
        return F.aggregate(F.slice("turns", 1, i + 1), F.col(f"before{k}"),
                           lambda a, u: a.bitwiseXOR(u[f"h{k}"])).alias(f"p{k}")

    prefix = F.transform("turns", lambda t, i: F.struct(named(1, i), named(2, i),
                                                        t["words"].alias("words")))
    return chained.select("conv_id", "block", "before1", "before2", prefix.alias("turns"))


def _end(name: str) -> Column:
    return F.element_at("turns", -1)[name]


def _per_node(rows: DataFrame, sums: dict[str, str], size: int) -> DataFrame:
    """Aggregates of blocks' rows (``sums``: new name -> column) carried to every node below the
    root: depth, p1, p2, the parent's q1, q2, words, owner (least conv_id) and the sums."""
    grouped = rows.groupBy("block", "before1", "before2", _end("p1").alias("end1"), _end("p2").alias("end2"),
                           F.size("turns").alias("length")).agg(
        F.min("conv_id").alias("owner"), F.any_value("turns").alias("turns"),
        *[F.sum(c).alias(n) for n, c in sums.items()])
    grouped = write_table(grouped, "trie-blocks")
    entry = ["block", "before1", "before2"]
    siblings = grouped.groupBy(*entry).agg(F.count(F.lit(1)).alias("siblings"))
    chain = F.transform("turns", lambda t, i: F.struct(
        (F.col("block") * size + i + 1).alias("depth"), t["p1"].alias("p1"), t["p2"].alias("p2"),
        F.when(i == 0, F.col("before1")).otherwise(F.col("turns")[i - 1]["p1"]).alias("q1"),
        F.when(i == 0, F.col("before2")).otherwise(F.col("turns")[i - 1]["p2"]).alias("q2"),
        t["words"].alias("words")))
    inner = grouped.join(siblings, entry).select(
        "siblings", F.explode(chain).alias("node"), "owner", *sums)
    columns = ["depth", "p1", "p2", "q1", "q2", "words"]
    inner = inner.select("siblings", *[F.col(f"node.{c}").alias(c) for c in columns], "owner", *sums)
    alone = inner.filter("siblings = 1").drop("siblings")
    refined = inner.filter("siblings > 1").groupBy("depth", "p1", "p2").agg(
        *[F.any_value(c).alias(c) for c in ("q1", "q2", "words")], F.min("owner").alias("owner"),
        *[F.sum(n).alias(n) for n in sums])
    return alone.unionByName(refined.select(*alone.columns))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p1, p2, conv_id) -> pieces of each node's list: its first id, its text."""
    key, first, held, out = None, None, [], []

    def close():
        if held:
            out.append({"depth": key[0], "p1": key[1], "p2": key[2], "first": first,
                        "n": len(held), "piece": ",".join(held)})

    for batch in batches:
        for *k, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "conv_id"))):
            if k != key or len(held) == PIECE_IDS:
                close()
                key, first, held = k, conv, []
            held.append(str(conv))
        if out:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> the SHA-256 of every node's list, and how many ids it has."""
    key, sha, n = None, None, 0

    def row():
        return {"depth": key[0], "p1": key[1], "p2": key[2], "ends": n, "ends_sha256": sha.hexdigest()}

    for batch in batches:
        out = []
        for *k, size, text in zip(*(batch.column(c).to_pylist()
                                    for c in ("depth", "p1", "p2", "n", "piece"))):
            if k != key:
                if key is not None:
                    out.append(row())
                key, sha, n = k, hashlib.sha256(), 0
            else:
                sha.update(b",")
            sha.update(text.encode())
            n += size
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()])


def _ends(ids: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(depth, p1, p2, ends, ends_sha256) of the nodes at which conversations end."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct(
        (F.col("block") * size + F.size("turns")).alias("depth"), _end("p1").alias("p1"),
        _end("p2").alias("p2"))).alias("last"))
    zero = F.lit(0).cast("long")
    at = ids.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"last.{c}").cast("long"), zero).alias(c) for c in ("depth", "p1", "p2")])
    order = ["depth", "p1", "p2", "conv_id"]
    slices = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = each_batch(at.select(*order).repartitionByRange(slices, *order).sortWithinPartitions(*order),
                        _packed, "depth long, p1 long, p2 long, first long, n long, piece string")
    order[-1] = "first"
    return each_batch(pieces.repartition("depth", "p1", "p2").sortWithinPartitions(*order), _digest,
                      "depth long, p1 long, p2 long, ends long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, role, text) of conversations ``ids``."""
    ids = write_table(ids, "trie-ids")
    rows = write_table(blocks(turns, size), "trie-turns")
    name = ["depth", "p1", "p2"]
    zero = F.lit(0).cast("long")
    ends = write_table(_ends(ids, rows, size), "trie-ends")

    # pass 1: members, owners, children
    below = _per_node(rows.withColumn("one", F.lit(1).cast("long")), {"n_convs": "one"}, size)
    root = ids.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")) \
        .filter("n_convs > 0").select(
            zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"),
            F.lit(None).cast("long").alias("q2"), zero.alias("words"), "owner", "n_convs")
    nodes = below.unionByName(root)
    nodes = nodes.join(ends, name, "left").withColumn("ends", F.coalesce("ends", zero))
    # a node is a leaf if all its members end there
    nodes = nodes.withColumns({"leaf": (F.col("ends") == F.col("n_convs")).cast("long"),
                               "weight": (F.col("n_convs") - 1) * F.col("words")})
    nodes = write_table(_running(nodes, "owner", "depth", {"above": ("sum", "weight")}), "trie-nodes")

    # pass 2: what members own, summed up for every node
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved")).filter("leaves > 0 OR saved > 0")
    owned = write_table(owned, "trie-owned")
    sums = {"n_leaves": "leaves", "all_saved": "saved"}
    held = _per_node(rows.join(owned, "conv_id"), sums, size).select(*name, *sums)
    all_of = owned.agg(*[F.sum(c).alias(n) for n, c in sums.items()]) \
        .select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), *sums)
    nodes = nodes.join(held.unionByName(all_of), name, "left")

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, name, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"),
                           F.col("p2").alias("q2"), F.col("owner").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "q1", "q2"], "left")
    return nodes.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("all_saved", zero) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
