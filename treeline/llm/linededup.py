"""Line dedup: later occurrences of repeated three-line windows are removed.

Every three consecutive lines of a document are a window; a document of one or
two lines is a single, shorter window. Windows are hashed (md5 of their text).
A window that stands in more than one place of the corpus is kept where it
stands first, by doc_id (null first) and line; every other occurrence covers
its lines, and a line covered by any window is removed. Windows of white space
only neither count nor cover.

Occurrences are summed up per window before they are shuffled, so a window in a
third of all documents is one row per task. The join that finds the later
occurrences is a plain equi-join whose large side adaptive execution can split.
Texts are shuffled once, to meet the covered lines of their document.

Defined results: null counts as empty: one empty line, never removed. Rows with
equal doc_id and text are one document with one result, given for each row;
documents with equal doc_id and different texts are different documents, in the
order of a hash of the text. Repetition within a document counts like any
other. Other columns are passed through by ``dedupe`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_LEAST = -(1 << 63)


def _place(docs: DataFrame, *more: Column) -> DataFrame:
    """``__id`` and ``__text``, which identify a document, ``__lines``, and the columns ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("__id"),
                       F.xxhash64(F.col("doc_id").isNull(), text).alias("__text"),
                       F.split(text, "\n").alias("__lines"), *more)


def occurrences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __text, at, hash) of every window that is not blank."""
    n = F.size("__lines")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("__lines", i + 1, window), "\n"))
    hashes = F.transform(texts, lambda t: F.when(F.trim(F.translate(t, "\n\t\r", "   ")) != "",
                                                 F.unhex(F.md5(t))))
    return (_place(docs).select("__id", "__text", F.posexplode(hashes).alias("at", "hash"))
            .filter(F.col("hash").isNotNull()))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __text, __starts): where later occurrences start, per document."""
    every = occurrences(docs, window)
    place = F.struct("__id", "__text", "at")
    first = (every.groupBy("hash")
             .agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter("first < last").select("hash", "first"))
    later = every.join(first, "hash").filter(F.struct("__id", "__text", "at") != F.col("first"))
    return later.groupBy("__id", "__text").agg(F.sort_array(F.collect_set("at")).alias("__starts"))


def _removed(n: Column, starts: Column, window: int) -> Column:
    """Sorted distinct line numbers covered by windows at ``starts``."""
    reach = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + window - 1)))
    return F.filter(F.array_distinct(reach), lambda i: i < n)


def dedupe(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with ``text`` reduced to the lines kept, and ``dedup_lines`` (how many there
    were), ``dedup_removed`` (line numbers, from 0); these replace columns of that name."""
    names = [c for c in docs.columns if c not in ("dedup_lines", "dedup_removed")]
    cover = covered(docs, window)
    n = F.size("__lines")
    none = F.array().cast("array<int>")
    # The caller's columns travel as one: their names meet none of the names used here.
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    rows = (_place(docs, row)
            .join(cover, ["__id", "__text"], "left")
            .withColumn("dedup_lines", n.cast("long"))
            .withColumn("dedup_removed", F.when(F.col("__starts").isNull(), none)
                        .otherwise(_removed(n, F.col("__starts"), window))))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dedup_removed"))
    text = F.when(F.size("dedup_removed") == 0, F.col("__row.text").cast("string")) \
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return rows.select(*[(text if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in names],
                       "dedup_lines", "dedup_removed")
