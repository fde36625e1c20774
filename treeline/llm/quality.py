"""Quality: votes of the nearest labelled documents in a latent-semantic space.

Every text becomes a vector of ``TERMS`` hashed terms: its words, whether a word
repeats the one before it, and the kinds of three bytes in a row (lower or upper
case, digit, beyond ASCII, space, line end, sorts of punctuation), so that both what
is said and how it is set show. Terms are weighted by log(1 + count) times the inverse
document frequency over all documents, and vectors have length 1.

A truncated singular value decomposition of the labelled sample's vectors gives
``FACTORS`` latent factors. The labelled vectors in that space are broadcast
(``SAMPLE_ROWS`` x ``FACTORS`` numbers, a fixed bound), and each document's cosine
with every one of them is computed exactly, as products of blocks of
documents with the whole matrix. The ``NEIGHBOURS`` most similar ones (and those as
similar as the last of them) vote with weight cosine ** ``POWER``::

    score = sum(weight * label) / sum(weight)

Only rows of ``labels`` with crc32(doc_id as text) mod 3 other than 1 are learned
from, at most ``SAMPLE_ROWS`` ids (those with the least hash) and as many different
texts of them; equal rows vote as one with their number as weight. Nothing but
the text enters a vector. Document frequencies cover all documents.

Defined results: a text without terms (null, empty, or below three bytes without a word) has no
direction and gets the share of label 1 in the sample, and so does one that is at
right angles to all labelled texts; without any labelled text the score is 0.5.
Labels above 0 count as 1; null ids and labels are ignored; of several labels for one
id the greatest counts. Every row of documents returns one row, repeated rows
and null ids (never held out) included. Texts are read whole. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch
from treeline.llm.toxicity import _sample
from treeline.llm.words import PIECE, slices, stream, text_bytes, words

SAMPLE_ROWS = 6000
TERMS = 4096
FACTORS = 64
NEIGHBOURS = 31
POWER = 16
BLOCK = 256            # documents in one product
FOLDS, HELD = 3, 1

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_KINDS = 32


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)                  # control characters
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 4
    kind[0x20], kind[[9, 10, 13]] = 5, 6
    for b in range(0x21, 0x7F):
        if not kind[b]:
            kind[b] = 7 + b % 25
    return kind


_KIND = _kinds()
_SLOT = (stream(0x7E2A, _KINDS ** 3) % np.uint64(TERMS)).astype(np.int64)
_AGAIN = (stream(0xA6A1, 2) % np.uint64(TERMS)).astype(np.int64)   # a word as before, another one


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def blocks(column) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of terms per row) of blocks of a text column."""
    buf, offsets = text_bytes(column)
    for i, j in slices(offsets, PIECE):
        for a in range(i, j, BLOCK):
            b = min(j, a + BLOCK)
            yield a, _counts(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def _counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total = np.zeros(n * TERMS, np.int64)
    hashes, number = words(buf, offsets)
    row = np.repeat(np.arange(n), number)
    total += np.bincount(row * TERMS + (hashes % np.uint64(TERMS)).astype(np.int64),
                         minlength=len(total))
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    total += np.bincount(row * TERMS + _AGAIN[1 - same], minlength=len(total))
    for a in range(0, len(buf) - 2, PIECE):
        b = min(len(buf), a + PIECE + 2)
        kind = _KIND[buf[a:b]]
        row = np.searchsorted(offsets, np.arange(a, b), side="right") - 1 if n > 1 \
            else np.zeros(b - a, np.int64)
        inside = row[:-2] == row[2:]
        slot = _SLOT[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
        total += np.bincount((row[:-2] * TERMS + slot)[inside], minlength=len(total))
    return total.reshape(n, TERMS)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + documents with the term)) of every term, over all documents."""
    def count(batches):
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, counts in blocks(batch.column("text")):
                seen += (counts > 0).sum(axis=0)
                n += len(counts)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, TERMS)), pa.array(np.append(seen[some], n))],
            names=["term", "n"])

    rows = (each_batch(docs.select(F.col("text").cast("string").alias("text")), count,
                       "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(TERMS + 1)     # TERMS + 1 numbers, however many documents there are
    for r in rows:
        total[r.term] = r.n
    return np.log((1 + total[-1]) / (1 + total[:-1]))


def _vectors(counts: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    x *= inverse.astype(np.float32)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(length, 1e-12)[:, None]
    return x


@dataclass
class Model:
    inverse: np.ndarray    # of each term
    factors: np.ndarray    # TERMS x FACTORS
    vectors: np.ndarray    # labelled texts x FACTORS, of length 1
    labels: np.ndarray     # of each labelled text
    weights: np.ndarray    # how many rows it stands for
    prior: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_vectors(counts, self.inverse) @ self.factors)

    def vote(self, places: np.ndarray) -> np.ndarray:
        """Score of each row of latent vectors."""
        if not len(self.labels):
            return np.full(len(places), self.prior)
        near = np.maximum(places @ self.vectors.T, 0)
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= least[:, None], near, 0).astype(np.float64) ** POWER * self.weights
        rest = 1e-12
        return np.clip((weight @ self.labels + rest * self.prior) / (weight.sum(axis=1) + rest), 0, 1)


def _unit(z: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return np.where(length > 1e-6, z / np.maximum(length, 1e-6), 0).astype(np.float32)


def _latent(x: np.ndarray, factors: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors of the rows of ``x``, by subspace iteration."""
    k = min(factors, *x.shape)
    q = np.random.default_rng(13).normal(size=(x.shape[1], min(x.shape[1], k + 8))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        factors: int = FACTORS) -> Model:
    """Model from the labelled rows that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).select(
        "doc_id", (F.col("quality") > 0).cast("int").alias("grade"))
    sample = _sample(docs, known, sample_rows)

    def sparse(batches):
        for batch in batches:
            for a, counts in blocks(batch.column("text")):
                some = batch.slice(a, len(counts))
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("doc_id", "key", "grade", "weight")),
                     pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())),
                     pa.array([c[x] for c, x in zip(counts, at)], pa.list_(pa.int64()))],
                    names=["doc_id", "key", "grade", "weight", "at", "n"])

    inverse = inverse_frequencies(docs)
    # at most `sample_rows` different rows, each of at most TERMS numbers
    rows = (each_batch(sample, sparse, "doc_id long, key string, grade int, weight long, "
                                       "at array<int>, n array<long>")
            .groupBy("doc_id", "key", "grade", "weight")
            .agg(F.first("at").alias("at"), F.first("n").alias("n"))
            .orderBy("doc_id", "key").collect())
    if not rows:
        return Model(inverse, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32),
                     np.zeros(0), np.zeros(0), 0.5)
    y = np.array([r.grade for r in rows], float)
    weight = np.array([r.weight for r in rows], float)
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        x[k, r.at] = r.n
    x = _vectors(x, inverse)
    v = _latent(x, factors)
    return Model(inverse, v, _unit(x @ v), y, weight, float((weight * y).sum() / weight.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a fixed size, see above

    def scan(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, counts in blocks(batch.column("text")):
                out[a:a + len(counts)] = shared.value.vote(shared.value.place(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out),
                 pa.array((out >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return each_batch(source, scan, SCHEMA)
