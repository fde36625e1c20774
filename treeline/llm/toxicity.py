"""Toxicity: cumulative-link ordinal regression over sparse text features.

Severity has ordered grades 0 (clean), 1, 2, ... The proportional-odds model
puts every document on one scale, ``w . x``, and cuts that scale at ordered
thresholds that all share the weights::

    P(grade <= k) = sigmoid(theta_k - w . x),   theta_0 < theta_1 < ...

``x`` is sparse: ``log(1 + count)`` of words and of the first four and five
bytes of words (other languages inflect), restricted to the features whose
document frequency differs most between clean and toxic training rows. Texts
are read whole; a feature counts however late it stands.

Training uses at most ``SAMPLE_ROWS`` labelled ids, those with the smallest
hash, and of their documents at most ``SAMPLE_ROWS`` different (doc_id, text).
Rows equal in both are one training row with their number as weight. Feature
statistics are Spark aggregations over the sample; the driver receives
``FEATURES`` features and the sparse training rows in those features, both
bounded by these parameters however often an id is repeated. Scoring is one scan of all
documents without a shuffle.

``labels`` holds only toxic 0/1. ``severity_grades`` refines it: toxic rows
whose load of markers (selected features commoner in toxic rows) reaches the
toxic rows' median are grade 2, the other toxic rows grade 1. ``fit`` itself
takes any integer grades.

Defined results: null and empty texts have no features; they get the base rate
of the thresholds, which is grade 0 unless most training rows are toxic. Label
rows with null id or grade are ignored; of several labels for one id the
highest grade counts; label ids without document are ignored, repeated
documents train once each (as weight). Without training rows, or with a single grade
among them, everything is grade 0 with severity 0. ``score`` returns a row for
each input row, repeated rows and null ids included; ``accepted`` passes rows
through with all their columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch
from treeline.llm.words import slices, text_bytes, words
from treeline.session import write_table

SAMPLE_ROWS = 20_000
FEATURES = 4096
MIN_Z = 4.0
PREFIXES = (4, 5)
REJECT = 0.5

SCHEMA = "doc_id long, grade int, severity double, p_toxic double"


@dataclass
class Model:
    features: np.ndarray   # sorted feature hashes
    weights: np.ndarray    # aligned with features
    thresholds: np.ndarray  # one fewer than grades

    def probabilities(self, load: np.ndarray) -> np.ndarray:
        """P(grade = k) for each row's ``w . x``."""
        if not len(self.thresholds):
            return np.ones((len(load), 1))
        below = _sigmoid(self.thresholds[None, :] - load[:, None])
        edges = np.hstack([np.zeros((len(load), 1)), below, np.ones((len(load), 1))])
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _feature_counts(column):
    """(first row, number of rows, row, feature, count) for slices of a text column."""
    buf, offsets = text_bytes(column)
    for i, j in slices(offsets):
        h, c, cut = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], PREFIXES)
        row = np.repeat(np.arange(j - i), c)
        feature = np.concatenate([h, *cut])
        row = np.concatenate([row] * (1 + len(cut)))
        keep = feature != 0
        yield i, j - i, row[keep], feature[keep]


def _selected(row: np.ndarray, feature: np.ndarray, features: np.ndarray):
    """(row, position in ``features``, count) of the selected features."""
    if not len(features) or not len(feature):
        none = np.zeros(0, np.int64)
        return none, none, none
    door = np.zeros(1 << 16, bool)
    door[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(door[(feature & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(features, feature[maybe])
    at[at == len(features)] = 0
    ok = features[at] == feature[maybe]
    code, count = np.unique(row[maybe[ok]] * len(features) + at[ok], return_counts=True)
    return code // len(features), code % len(features), count


def _sample(docs: DataFrame, grades: DataFrame, rows: int) -> DataFrame:
    """(doc_id, key, grade, weight, text) of the rows of at most ``rows`` different
    (doc_id, text) of at most ``rows`` graded ids; ``weight`` rows are equal to each."""
    graded = (grades.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("grade").cast("int").alias("grade"))
              .dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.md5(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))
    # At most `rows` ids and texts: a fixed bound, whatever the size of the documents.
    kept = (source.drop("text").join(F.broadcast(graded), "doc_id")
            .groupBy("doc_id", "key", "grade").agg(F.count("*").alias("weight"))
            .orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(rows))
    kept = write_table(kept, "toxicity-sample")
    return source.join(F.broadcast(kept), ["doc_id", "key"]) \
                 .select("doc_id", "key", "grade", "weight", "text")


def _select_features(sample: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the selected features and the sign of their log-odds."""
    def count(batches):
        for batch in batches:
            toxic = batch.column("grade").to_numpy(zero_copy_only=False) > 0
            for i, m, row, feature in _feature_counts(batch.column("text")):
                order = np.lexsort((row, feature))
                row, feature = row[order], feature[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
                row, feature = row[new], feature[new]
                names, where = np.unique(feature, return_inverse=True)
                t = np.bincount(where, weights=toxic[i + row], minlength=len(names))
                n = np.bincount(where, minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(t.astype(np.int64)),
                     pa.array(n.astype(np.int64))], names=["feature", "toxic", "docs"])

    totals = sample.agg(F.sum((F.col("grade") > 0).cast("long")), F.count("*")).first()
    toxic, n = int(totals[0] or 0), int(totals[1])
    if toxic == 0 or toxic == n:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = (each_batch(sample, count, "feature long, toxic long, docs long")
              .groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("ab")))
    a, b = F.col("a") + 0.5, F.col("ab") - F.col("a") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (n - toxic + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    picked = (counts.select("feature", z.alias("z")).filter(F.abs("z") >= MIN_Z)
              .orderBy(F.abs("z").desc(), "feature").limit(features).collect())
    names = np.array([r.feature for r in picked], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r.z for r in picked])[order]


def _rows(sample: DataFrame, features: np.ndarray):
    """The sample's different sparse rows: (doc_id, grade, weight, at, n), in a fixed order."""
    def sparse(batches):
        for batch in batches:
            n = batch.num_rows
            at: list[list[int]] = [[] for _ in range(n)]
            count: list[list[int]] = [[] for _ in range(n)]
            for i, _, row, feature in _feature_counts(batch.column("text")):
                for r, f, c in zip(*(x.tolist() for x in _selected(row, feature, features))):
                    at[i + r].append(f)
                    count[i + r].append(c)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "grade", "weight")),
                 pa.array(at, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))],
                names=["doc_id", "key", "grade", "weight", "at", "n"])

    rows = (each_batch(sample, sparse, "doc_id long, key string, grade int, weight long, "
                                       "at array<int>, n array<int>")
            .groupBy("doc_id", "key", "grade", "weight")
            .agg(F.first("at").alias("at"), F.first("n").alias("n")).collect())
    return sorted(rows, key=lambda r: (r.doc_id, list(r.at), list(r.n)))


def _median(weighted: list[tuple[float, int]]) -> float:
    """Median of values that stand ``weight`` times each; 0 without values."""
    if not weighted:
        return 0.0
    value, weight = (np.array(x) for x in zip(*sorted(weighted)))
    ends = np.cumsum(weight)
    middle = [(ends[-1] - 1) // 2, ends[-1] // 2]
    return float(value[np.searchsorted(ends, middle, side="right")].mean())


def severity_grades(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
                    features: int = FEATURES) -> DataFrame:
    """(doc_id, grade) of at most ``sample_rows`` labelled documents, see above."""
    spark = docs.sparkSession
    binary = labels.select("doc_id", F.col("toxic").alias("grade"))
    sample = _sample(docs, binary, sample_rows)
    names, z = _select_features(sample, features)
    rows = _rows(sample, names)
    marks = np.maximum(z, 0)
    load = [float((marks[list(r.at)] * np.log1p(list(r.n))).sum()) if len(r.at) else 0.0
            for r in rows]
    middle = _median([(x, r.weight) for x, r in zip(load, rows) if r.grade > 0])
    out = [(r.doc_id, 0 if r.grade <= 0 else 1 + (x >= middle)) for x, r in zip(load, rows)]
    return spark.createDataFrame([(d, int(g)) for d, g in out], "doc_id long, grade int")


def fit(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS,
        features: int = FEATURES) -> Model:
    sample = _sample(docs, grades, sample_rows)
    names, _ = _select_features(sample, features)
    rows = _rows(sample, names)
    top = max((r.grade for r in rows), default=0)
    if top <= 0 or not len(names):
        return Model(names[:0], np.zeros(0), np.zeros(0))
    y = np.array([max(0, r.grade) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r.at) for r in rows])
    col = np.array([f for r in rows for f in r.at], np.int64)
    x = np.log1p(np.array([c for r in rows for c in r.n], np.float64))
    weight = np.array([r.weight for r in rows], float)
    w, theta = _fit_cumulative(y, weight, row, col, x, len(names), top)
    return Model(names, w, theta)


def _fit_cumulative(y, weight, row, col, x, n_features, top, l2=1e-3, steps=400, rate=0.05):
    """Penalised likelihood by full-batch Adam; gaps between thresholds are exponentials."""
    n = weight.sum()
    seen = np.array([weight[y <= k].sum() for k in range(top)]) + 0.5
    base = np.log(seen / (n + 1 - seen))
    gaps = np.log(np.maximum(np.diff(base), 0.05))
    p = np.concatenate([np.zeros(n_features), base[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w = p[:n_features]
        theta = np.cumsum(np.concatenate([p[n_features:n_features + 1],
                                          np.exp(p[n_features + 1:])]))
        load = np.bincount(row, weights=w[col] * x, minlength=len(y))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        lo, hi = _sigmoid(edges[y] - load), _sigmoid(edges[y + 1] - load)
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / like, weight * lo * (1 - lo) / like
        g_load = (d_hi - d_lo) / n          # of the negative log-likelihood
        g_theta = np.zeros(top)
        np.add.at(g_theta, y[y < top], -d_hi[y < top] / n)
        np.add.at(g_theta, y[y > 0] - 1, d_lo[y > 0] / n)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=g_load[row] * x, minlength=n_features)
                            + l2 * w / n_features, tail[:1], tail[1:] * np.exp(p[n_features + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    theta = np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
    return p[:n_features], theta


def _grades(column, model: Model) -> np.ndarray:
    """P(grade = k) per row of a text column."""
    load = np.zeros(len(column))
    for i, m, row, feature in _feature_counts(column):
        r, f, c = _selected(row, feature, model.features)
        load[i:i + m] = np.bincount(r, weights=model.weights[f] * np.log1p(c), minlength=m)
    return model.probabilities(load)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, grade, severity, p_toxic) of every row: the most probable grade,
    the expected grade, and the probability of any grade above 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            p = _grades(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.argmax(axis=1).astype(np.int32)),
                 pa.array(p @ np.arange(p.shape[1], dtype=float)),
                 pa.array(1.0 - p[:, 0])], names=["doc_id", "grade", "severity", "p_toxic"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    return each_batch(source, scan, SCHEMA)


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows, all columns as they are, whose probability of being toxic is below ``reject``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            p = _grades(texts, shared.value)
            yield batch.filter(pa.array(1.0 - p[:, 0] < reject))

    return each_batch(docs, scan, docs.schema)
