"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL functions only.

A document is the multiset of its paragraphs (lines). Every paragraph is hashed
to a wide vector and a document's fingerprint is the sum of the vectors:

* ``sums``: eight lanes of 32 bits from the paragraph's SHA-256, added modulo
  2^32. Documents with the same paragraphs, in any order, have equal sums.
* ``signs``: sixty counters from the paragraph's sentences. Bit i of a
  sentence's hash says whether lane i counts it; with the number of sentences
  n, ``2 * count - n`` is the sum of random signs. Two counters share a long,
  as numbers modulo 2^30.
* ``paragraphs`` and ``sentences``: how many were added.

With ``units=SHINGLES`` the counters are fed with every three consecutive pieces
of a paragraph instead of its sentences (``sentences`` is then their number). A
piece is a run without spaces, cut every 16 characters, so texts of one
sentence, without punctuation or without spaces keep their likeness when a part
of them is replaced. The registered query reads sentences, as its SQL does;
there a text of one long sentence loses all likeness with any edit of it.
Fingerprints of different units must not be added or compared.

Adding paragraphs or whole fingerprints is lane-wise addition (``plus``),
taking them away is subtraction (``minus``); texts are never needed again.

``likeness`` reads the signs: the squared difference of two sign vectors
estimates the number of sentences that are in one document only, their squared
lengths the numbers of sentences; likeness is 1 - difference / (sum of squared
lengths), cut off at 0. It is 1 for equal fingerprints, about the shared part
for edited texts, and near 0 (error about 0.1) for unrelated ones.

A paragraph of fewer than three pieces is one shingle, a blank one none.
A sentence ends at a line's end or at ``.``, ``!`` or ``?`` before spaces.
Empty sentences do not count; empty paragraphs do.

``with_edits`` pairs each document with the next one by descending doc_id (null
last; equal ids by md5 of the text; after the last comes the first). Ids are
numbered over range slices, so no task sees all of them. Rows with equal doc_id
and text are one document with one result, given for each row. Texts are
shuffled once; what a document needs of the next is cut to a third of its own
length before it is sent.

Defined results: null counts as empty; an empty text is one empty paragraph and
no sentence. A single document is its own next one. Without documents the
result is empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.ordering import number_within
from treeline.session import write_table

SUM_LANES = 8
PACKED = 30
SENTENCES, SHINGLES = "sentences", "shingles"
SHINGLE = 3
PIECE = 16
_MOD = (1 << 32) - 1
_FIELD = (1 << 30) - 1
_PAIR = 1 | 1 << 30


def _total(values: Column, part) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + part(v))


def _sentences(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the hashes of the sentences."""
    sentences = F.filter(F.split(F.regexp_replace(F.col(text), "([.!?]) +", "$1\n"), "\n"),
                         lambda x: x != "")
    return df.withColumn(name, F.transform(
        sentences, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")))


def _shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the hashes of the shingles of every paragraph."""
    pieces = F.filter(F.transform(F.split(F.col(text), "\n"), lambda p: F.regexp_extract_all(
        p, F.lit(f"[^ \\t\\r]{{1,{PIECE}}}"), F.lit(0))), lambda w: F.size(w) > 0)
    w = f"{name}_pieces"
    runs = F.transform(F.col(w), lambda x: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(x) - (SHINGLE - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(x, i, SHINGLE))))
    return df.withColumn(w, pieces).withColumn(name, F.flatten(runs)).drop(w)


def with_fingerprint(df: DataFrame, text: str, name: str, units: str = SENTENCES) -> DataFrame:
    """Add the fingerprint struct ``name`` of string column ``text``.

    The hashes of paragraphs and units are columns of their own in between,
    so that each is made once and not once for every lane.
    """
    h, s = f"__{name}_digests", f"__{name}_sentences"
    lines = F.split(F.col(text), "\n")
    hashed = {SENTENCES: _sentences, SHINGLES: _shingles}[units](
        df.withColumn(h, F.transform(lines, lambda p: F.sha2(p, 256))), text, s)

    def lane(k):
        return _total(F.col(h), lambda d: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")) \
            .bitwiseAND(F.lit(_MOD))

    def packed(i):
        return _total(F.col(s), lambda x: F.shiftright(x, i).bitwiseAND(F.lit(_PAIR)))

    return hashed.withColumn(name, F.struct(
        F.array(*[lane(k) for k in range(SUM_LANES)]).alias("sums"),
        F.size(h).cast("long").alias("paragraphs"), F.size(s).cast("long").alias("sentences"),
        F.array(*[packed(i) for i in range(PACKED)]).alias("signs"))).drop(h, s)


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.struct(
        F.zip_with(a["sums"], b["sums"], lambda x, y: (x + y).bitwiseAND(F.lit(_MOD))).alias("sums"),
        (a["paragraphs"] + b["paragraphs"]).alias("paragraphs"),
        (a["sentences"] + b["sentences"]).alias("sentences"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x + y).alias("signs"))


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.struct(
        F.zip_with(a["sums"], b["sums"], lambda x, y: (x - y).bitwiseAND(F.lit(_MOD))).alias("sums"),
        (a["paragraphs"] - b["paragraphs"]).alias("paragraphs"),
        (a["sentences"] - b["sentences"]).alias("sentences"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x - y).alias("signs"))


def _lanes(fp: Column) -> Column:
    """The sixty sign sums."""
    count = F.concat(F.transform(fp["signs"], lambda x: x.bitwiseAND(F.lit(_FIELD))),
                     F.transform(fp["signs"], lambda x: F.shiftright(x, 30)))
    return F.transform(count, lambda c: 2 * c - fp["sentences"])


def text_of(fp: Column) -> Column:
    """The fingerprint as a string: sums in hex, the two numbers, the counters."""
    sums = F.array_join(F.transform(fp["sums"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    count = F.concat(F.transform(fp["signs"], lambda x: x.bitwiseAND(F.lit(_FIELD))),
                     F.transform(fp["signs"], lambda x: F.shiftright(x, 30)))
    return F.concat_ws("-", sums, fp["paragraphs"].cast("string"), fp["sentences"].cast("string"),
                       F.array_join(F.transform(count, lambda c: c.cast("string")), "."))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the likeness (0 to 1) of fingerprint columns ``a`` and ``b``."""
    x, y = f"__{name}_a", f"__{name}_b"
    square = lambda v: _total(v, lambda d: d * d)
    lanes = df.withColumns({x: _lanes(F.col(a)), y: _lanes(F.col(b))})
    apart = square(F.zip_with(F.col(x), F.col(y), lambda p, q: p - q)).cast("double")
    whole = (square(F.col(x)) + square(F.col(y))).cast("double")
    same = F.col(a) == F.col(b)
    value = F.when(same, 1.0).when(whole == 0, 0.0) \
             .otherwise(F.greatest(F.lit(0.0), 1.0 - apart / F.greatest(whole, F.lit(1.0))))
    return lanes.withColumn(name, value).drop(x, y)


def with_edits(docs: DataFrame, units: str = SENTENCES) -> DataFrame:
    """(doc_id, n_chars, edited, fp, edited_fp, next_fp) of every row: the fingerprints of
    the text, of the text whose last third is replaced by the beginning of the next
    document, and of that next document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"))
    base = base.withColumn("key", key)
    ids = base.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    numbered = write_table(number_within(ids, [], order), "fingerprint-order")
    total = max(1, numbered.count())
    receiver = numbered.select((F.col("n") % total + 1).alias("n"), F.col("key").alias("to"),
                               F.col("doc_id").alias("to_id"), F.col("n_chars").alias("to_chars"))
    link = numbered.select("n", "key").join(receiver, "n").drop("n")
    # Both uses below read the same columns by the same key: one shuffle of the texts.
    printed = with_fingerprint(base.select("key", "text"), "text", "fp", units)
    cut = F.floor(F.col("to_chars") / 3).cast("int")
    sent = (printed.join(link, "key")
            .select(F.col("to").alias("key"), F.col("to_id").alias("doc_id"),
                    F.col("to_chars").alias("n_chars"), cut.alias("cut"),
                    F.substring(F.col("text"), F.lit(1), cut).alias("head"),
                    F.col("fp").alias("next_fp"))
            .dropDuplicates(["key"]))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")),
                      F.col("head"))
    both = printed.join(sent, "key").withColumn("edited", edited)
    return with_fingerprint(both.select("doc_id", "n_chars", "edited", "fp", "next_fp"),
                            "edited", "edited_fp", units)


def digests(docs: DataFrame, units: str = SENTENCES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_edits(docs, units).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = likeness(rows, "fp", "edited_fp", "near_edited")
    rows = likeness(rows, "fp", "next_fp", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"),
                       text_of(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited",
                       "near_next")
