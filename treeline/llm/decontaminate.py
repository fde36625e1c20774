"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked up inside long documents by containment, the share
of an item's distinct word shingles that a document has. A document's own size
must not matter, so the sketches are taken of the items only: an item is
represented by the ``k`` smallest of its shingles under one random permutation
(a bottom-k MinHash), and a document is a candidate when any of its shingles is
one of them.

Items are partitioned by their number of shingles (up to 1, 2, 4, 8, ...). A
document that has at least the share ``threshold`` of an item with ``q``
shingles lacks at most ``q - ceil(threshold * q)`` of them, so with one more
minimum than that it must show at least one. Each size partition takes the
``k`` that its largest item needs; small partitions get by with two or three
minima. The search therefore misses nothing. Candidates are verified by the
exact containment of their shingle sets.

The documents are scanned where they lie: no shuffle of texts, and nothing per
document leaves its task but the matches. The distinct texts of the items travel
to the tasks in blocks of ``block_chars`` characters; each block is one scan, so a
large benchmark costs time but never more memory. An item's copies are one text
there, and their ids are joined to the matches afterwards, so an item repeated
without bound fills no block.

Defined results: null and empty documents or items match nothing (no words, no
shingles). An item of one to four words is a single shingle of all its words
and is found only in documents that are these words alone (a longer document
has shingles of five words). Repeated documents or items are matched each for
itself; ``matches`` then reports a (doc_id, item_id) pair once with its largest
containment. A null id is kept as null. Other columns are ignored by
``matches`` and passed through by ``clean``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch, in_driver_blocks, text_key
from treeline.llm.words import row_shingles, shingles, slices, text_bytes, words

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_CHARS = 8_000_000

SCHEMA = "doc_id long, key binary, item_shingles long, matched long, containment double"


def size_partition(count: int) -> int:
    """Upper size of an item's partition: the next power of two."""
    return 1 << max(0, (count - 1).bit_length())


def minima(upper: int, threshold: float) -> int:
    """Minima that make a contained item of a partition certain to be found."""
    return upper - math.ceil(threshold * upper - 1e-9) + 1


class Sketches:
    """Shingles and bottom-k sketches of a block of items."""

    def __init__(self, texts: list[str | None], n: int, threshold: float):
        self.threshold = threshold
        sets = [s for _, s in row_shingles(pa.array(texts, pa.large_string()), n)]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # Shingle hashes are already scrambled: the smallest are a random choice.
        picked = [s[:minima(size_partition(len(s)), threshold)] for s in sets if len(s)]
        self.sketch = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.uint64)
        all_s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(all_s, kind="stable")
        self.shingle, self.owner = all_s[order], owner[order]
        self.door = np.zeros(1 << 16, bool)
        self.door[(self.sketch & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """Positions of a document batch's shingles that are in some sketch."""
        maybe = np.flatnonzero(self.door[(s & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.sketch):
            return maybe[:0]
        at = np.searchsorted(self.sketch, s[maybe])
        at[at == len(self.sketch)] = 0
        return maybe[self.sketch[at] == s[maybe]]

    def verified(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for the items contained in shingle list ``s``."""
        s = np.unique(s)
        a = np.searchsorted(self.shingle, s, side="left")
        b = np.searchsorted(self.shingle, s, side="right")
        hit = np.flatnonzero(b > a)
        owners = [self.owner[i:j] for i, j in zip(a[hit].tolist(), b[hit].tolist())]
        if not owners:
            return []
        items, shared = np.unique(np.concatenate(owners), return_counts=True)
        need = np.ceil(self.threshold * self.sizes[items] - 1e-9)
        return [(int(i), int(c)) for i, c, k in zip(items, shared, need) if c >= k]


def _scan(column, sketches: Sketches, n: int):
    """(row, item, shared) for all matches of a text column."""
    buf, offsets = text_bytes(column)
    for i, j in slices(offsets):
        h, c = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        s, m = shingles(h, c, n)
        ends = np.cumsum(m)
        rows = np.unique(np.searchsorted(ends, sketches.candidates(s), side="right"))
        for r in rows.tolist():
            for item, shared in sketches.verified(s[ends[r] - m[r]:ends[r]]):
                yield i + r, item, shared


def _blocks(items: DataFrame, n: int, threshold: float, limit: int):
    """(keys, sketches) of the distinct texts of the items, block by block."""
    text = F.col("text").cast("string")
    rows = (items.select(text_key(text).alias("key"), text.alias("text")).groupBy("key")
            .agg(F.first("text", ignorenulls=True).alias("text")))
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    for block in in_driver_blocks(rows, "key", size, limit):
        yield [bytes(r.key) for r in block], Sketches([r.text for r in block], n, threshold)


def matches(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_shingles, matched, containment) of all contained items."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    found = None
    for keys, sketches in _blocks(items, n, threshold, block_chars):
        shared = spark.sparkContext.broadcast((keys, sketches))

        def scan(batches, shared=shared):
            item_keys, sk = shared.value
            for batch in batches:
                hits = list(_scan(batch.column("text"), sk, n))
                doc = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc[r] for r, _, _ in hits], pa.int64()),
                    pa.array([item_keys[i] for _, i, _ in hits], pa.binary()),
                    pa.array([int(sk.sizes[i]) for _, i, _ in hits], pa.int64()),
                    pa.array([c for _, _, c in hits], pa.int64()),
                    pa.array([c / sk.sizes[i] for _, i, c in hits], pa.float64()),
                ], names=["doc_id", "key", "item_shingles", "matched", "containment"])

        part = each_batch(source, scan, SCHEMA)
        found = part if found is None else found.unionByName(part)
    # One row for each document id and text, then one for each item id of the text.
    best = F.max(F.struct("containment", "matched", "item_shingles")).alias("best")
    ids = items.select(text_key(F.col("text").cast("string")).alias("key"),
                       F.col("item_id").cast("long").alias("item_id")).distinct()
    return (found.groupBy("doc_id", "key").agg(best).join(ids, "key")
            .groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
            .select("doc_id", "item_id", "best.item_shingles", "best.matched",
                    "best.containment"))


def clean(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no item."""
    spark = docs.sparkSession
    kept = docs
    for _, sketches in _blocks(items, n, threshold, block_chars):
        shared = spark.sparkContext.broadcast(sketches)

        def scan(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = batch.column(batch.schema.get_field_index("text"))
                for row, _, _ in _scan(texts, shared.value, n):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        kept = each_batch(kept, scan, kept.schema)
    return kept
