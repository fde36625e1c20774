"""Token-ID files: whole texts as token ids in entropy-coded blocks.

``write`` makes three Parquet tables in a folder:

* ``frequencies`` (id, freq): the shared static frequency table, from counts
  over all ids of all documents (one row for each id that occurs).
* ``chunks`` (part, chunk, ids): numbers of ids, for global positions.
* ``blocks`` (part, chunk, block, docs, data): ``data`` is one block in the
  format of ``rans``, ``docs`` says which documents' ids it holds. A block can
  be decoded alone, and in parallel from its checkpoints.

Documents are in ascending order of doc_id (null first; equal ids by the md5
of their text): a range shuffle deals them to parts, each part is sorted and
tokenised once into chunks of about ``CHUNK`` ids, which are kept in the shared
folder while the frequencies are counted. Tasks hold one chunk at a time; a
long document runs on over blocks and chunks. Everything is written by Spark's
own Parquet writer, so a lost executor's tasks are simply run again and the
files can be on any file system.

Defined results: null counts as empty; an empty text is the end id alone.
Repeated documents are written once each. Without documents the tables are
empty. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import rans
from treeline.llm.bpe import Encoder
from treeline.llm.common import KEPT, each_batch, text_key
from treeline.llm.rans import ranges

END_ID = 0
CHUNK = 32 * rans.BLOCK
TOGETHER = rans.TOGETHER * rans.BLOCK // CHUNK   # chunks coded side by side


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


KEPT.append(_encoder.cache_clear)


def _cut(at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The ranges of ``n`` numbers from ``at`` on, cut at multiples of ``width``: of each piece
    which range it is of, which multiple it follows, its first number and its length."""
    first = at // width
    pieces = (at + n - 1) // width - first + 1
    owner = np.repeat(np.arange(len(at)), pieces)
    nth = ranges(first, pieces)
    begin = np.maximum(at[owner], nth * width)
    return owner, nth, begin, np.minimum((at + n)[owner], (nth + 1) * width) - begin


def _docs(*columns) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_DOCS.value_type))


def _chunks(definition: str):
    """Sorted documents of a part -> its chunks of ids; the last says how often each id occurs
    in the part."""
    def tokenise(batches):
        encoder = _encoder(definition)
        part, chunk, start, nth = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        docs: list[pa.Array] = []
        times = np.zeros(encoder.tokenizer.get_vocab_size(), np.int64)

        def row(used):
            data = np.concatenate(ids)
            inside = pa.concat_arrays(docs)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()),
                 pa.array([len(data)], pa.int64()),
                 pa.ListArray.from_arrays([0, len(inside)], inside).cast(_DOCS),
                 pa.array([data.tobytes()], pa.binary()),
                 pa.array([used], pa.list_(pa.int32())), pa.array([times[used]], pa.list_(pa.int64()))],
                names=["part", "chunk", "n", "docs", "ids", "used", "times"])

        for batch in batches:
            column = batch.column("text")
            # About two megabytes of text at a time.
            width = max(1, int(2e6 * batch.num_rows / max(1, column.nbytes)))
            for a in range(0, batch.num_rows, width):
                doc_ids = batch.column("doc_id").slice(a, width)
                coded, sizes = encoder.encode(column.slice(a, width))
                own = sizes + 1
                first = np.cumsum(own) - own
                data = np.full(own.sum(), END_ID, encoder.dtype)
                data[ranges(first, sizes)] = coded
                times += np.bincount(data, minlength=len(times))
                owner, inside, at, n = _cut(start + first, own, CHUNK)
                ends = np.flatnonzero(np.diff(inside, append=-1)) + 1
                for b, e in zip([0, *ends.tolist()], ends.tolist()):
                    if inside[b] > chunk:
                        yield row(np.zeros(0, np.int32))
                        ids, docs, chunk = [], [], int(inside[b])
                    which = owner[b:e]
                    docs.append(_docs(doc_ids.take(pa.array(which)), nth + which,
                                      start + first[which], at[b:e] - chunk * CHUNK, n[b:e]))
                    ids.append(data[at[b] - start:at[e - 1] + n[e - 1] - start])
                start, nth = start + len(data), nth + len(sizes)
        if ids:
            yield row(np.flatnonzero(times).astype(np.int32))
    return tokenise


_DOC = "struct<doc_id: long, nth: long, start: long, at: long, n: long>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()),
                            ("at", pa.int64()), ("n", pa.int64())]))


def _encode_chunks(frequencies, dtype):
    def encode(batches):
        table = rans.Table(frequencies.value)
        for whole in batches:
            for r in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(r, TOGETHER)
                cut, docs, inside, chunk, block = [], [], [], [], []
                for k in range(batch.num_rows):
                    ids = np.frombuffer(batch.column("ids")[k].as_buffer(), dtype)
                    own = batch.column("docs")[k].values
                    at, n = (own.field(f).to_numpy() for f in ("at", "n"))
                    owner, nth, begin, size = _cut(at, n, rans.BLOCK)
                    docs.append(_docs(*(own.field(f).take(pa.array(owner)) for f in ("doc_id", "nth", "start")),
                                      begin - nth * rans.BLOCK, size))
                    cut += [ids[a:a + rans.BLOCK] for a in range(0, len(ids), rans.BLOCK)]
                    numbers = np.bincount(nth)
                    inside.append(numbers)
                    chunk.append(np.full(len(numbers), k))
                    block.append(np.arange(len(numbers), dtype=np.int32))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(inside))])
                chunk = pa.array(np.concatenate(chunk))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(chunk), batch.column("chunk").take(chunk),
                     pa.array(np.concatenate(block)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.concat_arrays(docs)).cast(_DOCS),
                     pa.array(rans.encode(cut, table), pa.binary())],
                    names=["part", "chunk", "block", "docs", "data"])
    return encode


def write(docs: DataFrame, path: str, definition: str) -> None:
    """Write the token files of ``docs`` to folder ``path``; ``definition``: a tokenizer's JSON."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    width = Tokenizer.from_str(definition).get_vocab_size()
    dtype = np.uint16 if width < 1 << 16 else np.uint32
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = text_key(F.col("text"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"))
               .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), key)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key))
    each_batch(ordered, _chunks(definition),
               f"part int, chunk int, n long, docs array<{_DOC}>, ids binary, used array<int>, "
               "times array<long>", keep=True) \
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    counted = (tokens.select(F.explode(F.arrays_zip("used", "times")).alias("u"))
               .groupBy(F.col("u.used").alias("id")).agg(F.sum("u.times").alias("n"))
               .collect())  # at most the vocabulary
    counts = np.zeros(width, np.int64)
    for r in counted:
        counts[r.id] = r.n
    freq = rans.Table.scaled(counts)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id int, freq int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")
    tokens.select("part", "chunk", F.col("n").alias("ids")) \
        .write.mode("overwrite").parquet(f"{path}/chunks")
    shared = spark.sparkContext.broadcast(freq)
    each_batch(tokens.select("part", "chunk", "docs", "ids"), _encode_chunks(shared, dtype),
               f"part int, chunk int, block int, docs array<{_DOC}>, data binary") \
        .write.mode("overwrite").parquet(f"{path}/blocks")


def frequencies(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    freq = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return freq


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids of all earlier parts. One row per part."""
    total = spark.read.parquet(f"{path}/chunks").groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stretches of documents as decoded from the blocks:
    (part, nth, doc_id, start, chunk, block, ids array<int>); ``start`` is the document's
    position within its part."""
    return _decoded(spark, path, "ids array<int>", lambda ids: pa.array([x.astype(np.int32)
                                                                        for x in ids],
                                                                       pa.list_(pa.int32())))


def _decoded(spark: SparkSession, path: str, field: str, column) -> DataFrame:
    shared = spark.sparkContext.broadcast(frequencies(spark, path))

    def decode(batches):
        table = rans.Table(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, rans.TOGETHER):
                batch = whole.slice(a, rans.TOGETHER)
                ids = rans.decode(batch.column("data").to_pylist(), table)
                docs = batch.column("docs")
                flat = docs.flatten()
                owner = np.repeat(np.arange(batch.num_rows),
                                  docs.value_lengths().to_numpy(zero_copy_only=False))
                at, n = flat.field("at").to_pylist(), flat.field("n").to_pylist()
                pieces = [ids[o][i:i + k] for o, i, k in zip(owner.tolist(), at, n)]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(take), flat.field("nth"), flat.field("doc_id"),
                     flat.field("start"), batch.column("chunk").take(take),
                     batch.column("block").take(take), flat.field("n"), column(pieces)],
                    names=["part", "nth", "doc_id", "start", "chunk", "block", "n",
                           field.split()[0]])

    return each_batch(spark.read.parquet(f"{path}/blocks"), decode,
                      "part int, nth long, doc_id long, start long, chunk int, block int, "
                      f"n long, {field}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    def crc(pieces):
        return pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64())

    stretch = F.struct("chunk", "block", "crc", "n").alias("s")
    whole = (_decoded(spark, path, "crc long", crc).groupBy("part", "nth")
             .agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"),
                  F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(stretch)).alias("s")))

    @F.pandas_udf("long")
    def joined(crcs, sizes):
        import pandas as pd

        out = []
        for c, n in zip(crcs, sizes):
            total = int(c[0])
            for x, k in zip(c[1:], n[1:]):
                total = rans.crc32_joined(total, int(x), 4 * int(k))
            out.append(total)
        return pd.Series(out, dtype="int64")

    # A document within one block needs no joining.
    one, several = whole.filter(F.size("s") == 1), whole.filter(F.size("s") > 1)
    rows = one.withColumn("crc", F.col("s")[0]["crc"]).unionByName(
        several.withColumn("crc", joined(F.col("s.crc"), F.col("s.n"))))
    return (rows.join(_starts(spark, path), "part")
            .select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens",
                    F.col("crc").alias("ids_crc32")))
