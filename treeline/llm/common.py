"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokenizer_json(path: str | None = None) -> str:
    """A tokenizer's definition, read on the driver and sent to the tasks as text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_key(text: Column) -> Column:
    """128-bit key of a whole text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


#: What a Python worker keeps from one task to the next, as functions that drop it.
KEPT: list[Callable[[], None]] = []


def release() -> None:
    """Give freed memory back to the system: workers live on, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def each_batch(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
               schema, keep: bool = False) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors.

    A task first drops what earlier tasks of other operators kept in its worker
    (``keep``: this one uses it), and gives freed memory back when it ends.
    """
    ship_package(df.sparkSession)
    names = df.columns
    odd = any("." in c or "`" in c for c in names)  # Spark would read these as paths
    if odd:
        df = df.toDF(*[f"c{k}" for k in range(len(names))])

    def task(batches):
        if not keep:
            for drop in KEPT:
                drop()
        if odd:
            batches = (b.rename_columns(names) for b in batches)
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(key)
        ends = values.dictionary_encode() if not pa.types.is_dictionary(values.type) else values
        codes = ends.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            value = values[a].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def in_driver_blocks(df: DataFrame, key: str, size: Column, limit: int) -> Iterator[list]:
    """Rows of a query set in blocks whose ``size`` adds up to about ``limit``.

    The number of blocks follows from the total, so what the driver holds and
    broadcasts at a time is bounded however large the query set is.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // limit))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    for b in range(blocks):
        yield df.filter(part == b).collect() if blocks > 1 else df.collect()
