"""Inventory and history sources and sinks.

The reference keeps one JSON history file per tree and rewrites it on every
run; here the history is an append-only table of committed runs (``commits``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import rules as R
from treeline.session import write_bucketed
from treeline.sources.commits import CommittedTable

RAW_FILES_COLUMNS = {
    "repo_id": T.StringType(),
    "file_seq": T.LongType(),
    "relative_path": T.StringType(),
    "size": T.LongType(),
}

HISTORY_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("executed_at", T.TimestampNTZType()),
    T.StructField("action", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("skipped", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("risk", T.StringType()),
])


def validate_inventory(df: DataFrame) -> DataFrame:
    """Schema check of a listed inventory; ``content`` may be string or binary.

    Binary content is decoded as UTF-8 JVM-side (``decode``), so the parse
    job always sees text.

    Without ``file_seq`` files stand in the order of (depth, parts): the column then holds the
    binary ``walk_key`` of the path. It needs no numbering, so snapshots can be appended, and
    everything that orders by ``file_seq`` (or ``ord``, which proposals take from it) works alike.
    """
    for name in RAW_FILES_COLUMNS:
        if name not in df.columns and name != "file_seq":
            raise ValueError(f"inventory lacks column {name!r}")
    if "file_seq" not in df.columns:
        df = df.withColumn("file_seq", R.walk_key(F.col("relative_path").cast("string")))
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name, typ in RAW_FILES_COLUMNS.items():
        if name == "file_seq" and isinstance(fields[name], T.BinaryType):
            continue
        if type(fields[name]) is not type(typ):
            df = df.withColumn(name, F.col(name).cast(typ))
    if "content" not in fields:
        df = df.withColumn("content", F.lit(None).cast("string"))
    elif isinstance(fields["content"], T.BinaryType):
        # like reading with errors ignored: invalid sequences are dropped, and
        # text_ok remembers that the bytes were not valid UTF-8
        raw_text = F.col("content").cast("string")
        df = df.withColumns({
            "text_ok": F.coalesce(F.col("text_ok"), F.is_valid_utf8(raw_text))
            if "text_ok" in fields else F.is_valid_utf8(raw_text),
            "content": F.when(F.is_valid_utf8(raw_text), raw_text).otherwise(
                F.regexp_replace(F.make_valid_utf8(raw_text), "\uFFFD", "")),
        })
    # text mode: every line end is a line feed
    df = df.withColumn("content", F.regexp_replace("content", "\r\n?", "\n"))
    if "text_ok" not in df.columns:
        df = df.withColumn("text_ok", F.lit(None).cast("boolean"))
    return df.select(*RAW_FILES_COLUMNS, "content", "text_ok")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An already listed inventory (a code corpus) stored as Parquet."""
    return validate_inventory(spark.read.parquet(path))


def path_index(raw: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every path of an inventory, its directories included, once: (repo_id, path, is_file, is_dir).

    Written as a table bucketed by (repo_id, path), so that the existence lookups of imports
    and moves shuffle only what they ask about. The key holds the path, so a repository
    with most of the files spreads over all buckets; directories are summed up before
    the shuffle.
    """
    parts = F.split(F.col("relative_path"), "/")
    files = raw.select("repo_id", F.col("relative_path").alias("path"), F.lit(True).alias("is_file"))
    dirs = (raw.select("repo_id", parts.alias("p")).filter(F.size("p") > 1)
            .select("repo_id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
            .select("repo_id", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path"),
                    F.lit(False).alias("is_file")))
    paths = files.unionByName(dirs).groupBy("repo_id", "path").agg(
        F.bool_or("is_file").alias("is_file"), F.bool_or(~F.col("is_file")).alias("is_dir"))
    return write_bucketed(paths, ["repo_id", "path"], "paths", buckets)


def write_proposals(proposals: DataFrame, path: str, fmt: str = "json",
                    mode: str = "overwrite") -> None:
    """S3: one record per proposal.

    ``json``: one JSON line per proposal (null fields kept, like the
    reference); ``text``: ``repo_id<TAB>[n] ...`` per proposal in display
    order, newlines escaped; ``parquet``: the table itself. Rows are ordered
    by repository and proposal order within each file; the text files are cut by
    (repository, number), so a large repository spreads over several.
    """
    record = F.struct(
        F.col("action"), F.col("source"), F.col("target"), F.col("reason"),
        F.col("risk"), F.col("details"))
    ordered = proposals.sortWithinPartitions("repo_id", "phase", "ord")
    if fmt == "json":
        (ordered.select(F.to_json(F.struct(F.col("repo_id"), record.alias("proposal")),
                                  {"ignoreNullFields": "false"}).alias("value"))
         .write.mode(mode).text(path))
    elif fmt == "parquet":
        ordered.write.mode(mode).parquet(path)
    elif fmt == "text":
        # numbered in display order, one block per proposal (P19 text, W1 number)
        from treeline.operators.reports import proposal_numbers, proposal_text
        num = proposal_numbers(proposals).select("repo_id", "phase", "ord", "number")
        txt = proposal_text(proposals)
        block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("text"))
        (txt.join(num, ["repo_id", "phase", "ord"])
         .repartitionByRange("repo_id", "number").sortWithinPartitions("repo_id", "number")
         .select(F.concat(F.col("repo_id"), F.lit("\t"), F.regexp_replace(block, "\n", "\\\\n"))
                 .alias("value"))
         .write.mode(mode).text(path))
    else:
        raise ValueError(f"unknown format {fmt!r}")


def history_table(spark: SparkSession, path: str) -> CommittedTable:
    """The history: runs that append to one table, each exactly once."""
    return CommittedTable(spark, path, HISTORY_SCHEMA, key="repo_id", number="seq")


def append_history(records: DataFrame | Callable[[DataFrame], DataFrame], path: str,
                   run: str | None = None, spark: SparkSession | None = None) -> bool:
    """Append a run's records; earlier entries are never rewritten.

    ``records`` may be a function of the table's heads (repo_id, last seq), which numbers the
    records after what is committed. A run id that is already committed changes nothing and
    returns False, so a job that is tried again doubles no rows.
    """
    make = records if callable(records) else lambda heads: records
    spark = spark or records.sparkSession
    return history_table(spark, path).commit(run or uuid.uuid4().hex, make)


def read_history(spark: SparkSession, path: str, before_run: str | None = None) -> DataFrame:
    """The committed history; an absent table reads as empty.

    ``before_run``: as that run found it, so that a run tried again decides as it did before.
    """
    table = history_table(spark, path)
    return table.read(table.snapshot(before_run))


REFERENCE_ENTRY = ("array<struct<timestamp:string, action:string, source:string, target:string, "
                   "success:boolean, skipped:boolean, message:string, risk:string>>")


def read_reference_history(spark: SparkSession, path: str) -> DataFrame:
    """S5 for existing history files of the single-folder tool.

    ``path`` names files (or a glob) holding one JSON array each; the file's
    base name without ``.json`` becomes ``repo_id`` (e.g. ``repo007.json``).
    Each file is one tree's history, read whole and parsed with a fixed
    schema; the array position becomes ``seq``.
    """
    whole = spark.read.text(path, wholetext=True)
    base = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)
    parsed = whole.select(base.alias("repo_id"),
                          F.posexplode(F.from_json("value", REFERENCE_ENTRY)).alias("pos", "e"))
    return parsed.select(
        "repo_id", (F.col("pos") + 1).cast("bigint").alias("seq"),
        F.to_timestamp_ntz(F.col("e.timestamp")).alias("executed_at"),
        *[F.col(f"e.{c}").alias(c) for c in ("action", "source", "target", "success", "skipped",
                                             "message", "risk")])
