"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

The score of a word w after u, v (order 3, backoff factor 0.4)::

    log c(u v w) / c(u v)         if c(u v w) >= cutoff
    log 0.4 + log c(v w) / c(v)   else if c(v w) >= cutoff
    log 0.16 + log c(w) / N       else

(one backoff less at a document's second word, none at its first); counts are
over all documents, N is their number of words. An n-gram seen only once in the
corpus is not evidence for itself, hence the cutoff of 2. A document's score is
the sum over its words.

Relationally: the n-grams of all documents are exploded, counted in tables
partitioned by their hash, the counts joined back, and the logs summed per
document. To keep the shuffles small the rows are packed: a chunk is a few
million words of whole documents, and one row carries a chunk's distinct n-grams
of one order and one hash range as a sorted array with their counts (delta-coded
byte planes, compressed). The count table's
partition adds up the chunks' arrays and answers each with the totals in the
same order, so neither keys nor positions travel back. Each n-gram is sent once
by each chunk, so a word that makes up a third of the corpus is one entry per
chunk. Hash ranges follow from the corpus's number of words, so a partition
holds about ``RANGE_WORDS`` entries of an order at any size.

Chunks are written to the shared folder first (each document as codes into the
chunk's list of word hashes): both scans see the same chunks even if tasks are
run again. A document longer than a chunk is a chunk of its own.

Defined results: null and empty texts, and texts without words, have 0 words,
score 0 and a null mean. Repeated rows count and are scored each for itself; a
null doc_id is kept. Without documents the result is empty. Other columns are
not read. N-grams with equal 64-bit hashes count as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch, groups
from treeline.llm.words import mix64, slices, stream, text_bytes, words
from treeline.session import write_bucketed

ORDER = 3
BACKOFF = 0.4
CUTOFF = 2
CHUNK_WORDS = 2_000_000
RANGE_WORDS = 2_000_000

SCORES = "doc_id long, n_words long, score double, mean double"
_CHUNK = "chunk long, n_words long, doc_ids array<long>, sizes binary, vocabulary binary, codes binary"


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes (all first bytes, all second bytes, ...), compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data, dtype) -> np.ndarray:
    data = memoryview(data)
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The documents as chunks of word codes, written to the shared folder."""
    def cut(batches):
        nth = 0
        ids: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0

        def row():
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            vocabulary, codes, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # common words get small codes
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + nth], pa.int64()),
                 pa.array([len(h)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()),
                 pa.array([vocabulary[order].tobytes()], pa.binary()),
                 pa.array([pack(place[codes])], pa.binary())],
                names=["chunk", "n_words", "doc_ids", "sizes", "vocabulary", "codes"])

        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                h, c = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                if held and held + len(h) > chunk_words:
                    yield row()
                    ids, sizes, hashes, held, nth = [], [], [], 0, nth + 1
                ids += doc[i:j]
                sizes.append(c)
                hashes.append(h)
                held += len(h)
        if ids:
            yield row()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    # bucketed by chunk: the replies come to the chunks, which stay where they are
    return write_bucketed(each_batch(source, cut, _CHUNK), ["chunk"], "lm_chunks")


def _rows(batches):
    """Rows as dictionaries, one at a time: a chunk is large."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def _words_of(row) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words per document) of a chunk row."""
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    sizes = np.frombuffer(row["sizes"], np.int64)
    codes = unpack(row["codes"], np.uint32) if len(vocabulary) else np.zeros(0, np.uint32)
    return vocabulary[codes], sizes


def _ngrams(h: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word) of the n-grams within documents, in order."""
    total = len(h)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    radix = stream(0xA0 + n, n)
    runs = total - n + 1
    with np.errstate(over="ignore"):
        full = np.zeros(runs, np.uint64)
        for j in range(n):
            full += h[j:j + runs] * radix[j]
    inside = np.ones(runs, bool)
    ends = np.cumsum(sizes)
    for back in range(1, n):  # a run may not cross the end of a document
        at = ends - back
        at = at[(at >= 0) & (at < runs)]
        inside[at] = False
    first = np.flatnonzero(inside)
    return mix64(full[first]), first


def _distinct(h: np.ndarray, sizes: np.ndarray, order: int):
    """For n = 1..order: (n, distinct n-grams ascending, their counts)."""
    for n in range(1, order + 1):
        keys, count = np.unique(_ngrams(h, sizes, n)[0], return_counts=True)
        yield n, keys, count


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range starts in sorted keys (ranges: a power of two)."""
    if ranges == 1:
        return np.array([0, len(keys)])
    bits = np.uint64(64 - int(math.log2(ranges)))
    edges = np.arange(1, ranges, dtype=np.uint64) << bits
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _send(order: int, ranges: int):
    def send(batches):
        for row in _rows(batches):
            h, sizes = _words_of(row)
            for n, keys, count in _distinct(h, sizes, order):
                cuts = _cuts(keys, ranges)
                count = count.astype(np.uint32)
                some = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n * ranges + r for r in some], pa.int64()),
                     pa.array([row["chunk"]] * len(some), pa.int64()),
                     pa.array([pack_sorted(keys[cuts[r]:cuts[r + 1]]) for r in some], pa.binary()),
                     pa.array([pack(count[cuts[r]:cuts[r + 1]]) for r in some], pa.binary())],
                    names=["part", "chunk", "keys", "counts"])
    return send


def _add_up(batches):
    """A partition of the count table: totals of its n-grams, per chunk in the chunk's order."""
    for group in groups(batches, "part"):
        keys = [unpack_sorted(k.as_buffer()) for k in group.column("keys")]
        count = np.concatenate([unpack(c.as_buffer(), np.uint32) for c in group.column("counts")])
        _, entry = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(entry, weights=count)[entry].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        for r, (end, own) in enumerate(zip(ends, keys)):
            yield pa.RecordBatch.from_arrays(
                [group.column("chunk").slice(r, 1).combine_chunks(),
                 group.column("part").slice(r, 1).combine_chunks(),
                 pa.array([pack(total[end - len(own):end])], pa.binary())],
                names=["chunk", "part", "totals"])


def _score(order: int, ranges: int, backoff: float, cutoff: int, corpus_words: int):
    def per_word(h, sizes, totals):
        """Log score of every word of a chunk."""
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(h)) - starts           # words before it in its document
        counts = []                                  # by order: count of the n-gram ending here
        for n in range(1, order + 1):
            grams, first = _ngrams(h, sizes, n)
            keys, entry = np.unique(grams, return_inverse=True)
            c = np.zeros(len(h))
            if len(grams):
                c[first + n - 1] = totals[n][entry]
            counts.append(c)
        score = np.log(counts[0] / max(1, corpus_words))
        score += math.log(backoff) * np.minimum(place, order - 1)
        for n in range(2, order + 1):                # longer matches replace shorter ones
            hit = np.flatnonzero((place >= n - 1) & (counts[n - 1] >= cutoff))
            score[hit] = np.log(counts[n - 1][hit] / counts[n - 2][hit - 1]) \
                + math.log(backoff) * (np.minimum(place[hit], order - 1) - (n - 1))
        return score

    def score(batches):
        for row in _rows(batches):
            h, sizes = _words_of(row)
            totals: dict[int, np.ndarray] = {}
            replies = sorted((r["part"], r["totals"]) for r in row["replies"] or [])
            for n in range(1, order + 1):
                own = [unpack(t, np.uint64) for p, t in replies if p // ranges == n]
                totals[n] = np.concatenate(own) if own else np.zeros(0, np.uint64)
            ends = np.cumsum(sizes)
            summed, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
            if len(some):  # each document on its own, for the sum's precision
                summed[some] = np.add.reduceat(per_word(h, sizes, totals), (ends - sizes)[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(summed),
                 pa.array(np.where(sizes > 0, summed / np.maximum(sizes, 1), 0.0),
                          mask=sizes == 0)],
                names=["doc_id", "n_words", "score", "mean"])
    return score


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, cutoff: int = CUTOFF,
          chunk_words: int = CHUNK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """(doc_id, n_words, score, mean) of every row: natural logs, summed and per word."""
    spark = docs.sparkSession
    packed = chunks(docs, chunk_words)
    corpus_words = packed.agg(F.sum("n_words")).first()[0] or 0
    ranges = 1 << max(0, math.ceil(math.log2(max(1, corpus_words) / range_words)))
    sent = each_batch(packed, _send(order, ranges), "part long, chunk long, keys binary, counts binary")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges * order, 20_000))
    tables = sent.repartition(slots, "part").sortWithinPartitions("part", "chunk")
    replies = (each_batch(tables, _add_up, "chunk long, part long, totals binary")
               .groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias("replies")))
    return each_batch(packed.join(replies, "chunk", "left"),
                      _score(order, ranges, backoff, cutoff, corpus_words), SCORES)
