"""URL filters: rules, and a Bloom filter cascade of listed hosts.

``parts`` cuts a URL into host and path; ``rule_of`` finds the longest rule
(host and path prefix) that fits. What no rule decides is decided by a list of
hosts, kept as a Bloom filter cascade: level 1 holds all listed keys, level 2
those keys of the corpus that level 1 takes for listed by mistake, level 3 the
listed keys that level 2 takes for such a mistake, and so on until a level makes
no mistake. As the levels are built over the complete universe of the corpus's
keys, every key of it is judged exactly, and pages need no join: a key is looked
up level by level, and the first level that does not know it decides.

Keys enter as two 64-bit hashes. A level's bits are made where its keys lie (a
bitmap per task, combined as 64-bit words by bit_or) and only the finished
bitmap comes to the driver. The universe is dealt into shards of about
``SHARD_KEYS`` listed keys, each with its own cascade. Level 1 of a shard with r
listed and s other keys errs at most at the rate r / s, so level 2 holds about r
keys at most, however large the universe is: a cascade has about 1.44 * log2(s / r)
bits for each listed key in level 1 and 10 in level 2, at 1,000 others for each
listed key three megabytes. Pages are judged with ``SHARDS_TOGETHER`` shards at a
time, so neither the driver nor a task holds more than that, however long the list
is.

Defined results: a null url, or one without ``://``, has an empty host and path;
the empty host fits no rule and is listed only if the list names it. Null hosts
in the list are ignored, repeated ones count once, hosts that no page has are
ignored (they are outside the universe). An empty list allows everything.
Repeated pages are judged each for itself. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch
from treeline.llm.words import mix64
from treeline.session import write_table

# (host, path, verdict): fits the host and its subdomains where the path starts so.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# A host is listed if one of its labels has one of these words between hyphens.
LISTED_WORDS = ("spam", "pills", "casino", "adult")

ERROR_RATE = 0.01
SHARD_KEYS = 1_000_000
SHARDS_TOGETHER = 16


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def listed_by_word(host: Column, words=LISTED_WORDS) -> Column:
    return host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


class Level:
    """One Bloom filter: ``bits`` bits, ``probes`` positions per key."""

    def __init__(self, keys: int, error: float, salt: int):
        self.bits = max(64, 64 * math.ceil(-keys * math.log(error) / math.log(2) ** 2 / 64))
        self.probes = max(1, round(self.bits / max(1, keys) * math.log(2)))
        self.probes = min(self.probes, max(1, math.ceil(-math.log2(error))))
        self.salt = salt
        self.words = np.zeros(self.bits // 64, np.uint64)

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(probes x keys) bit positions."""
        with np.errstate(over="ignore"):
            a = mix64(a.view(np.uint64) + np.uint64(self.salt))
            b = mix64(b.view(np.uint64) + np.uint64(self.salt)) | np.uint64(1)
            k = np.arange(self.probes, dtype=np.uint64)[:, None]
            return ((a + k * b) % np.uint64(self.bits)).astype(np.int64)

    def knows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        bit = self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        return bit.all(axis=0)


def listed(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys are listed: the first level that does not know a key decides."""
    result = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for depth, level in enumerate(levels):
        known = level.knows(a[open_], b[open_])
        result[open_[~known]] = depth % 2 == 1
        open_ = open_[known]
    result[open_] = len(levels) % 2 == 1
    return result


def _fill(level: Level, keys: DataFrame) -> Level:
    """The level with the bits of all ``keys`` (a, b)."""
    blank = level

    def bitmap(batches):
        words = np.zeros_like(blank.words)
        for batch in batches:
            at = blank.positions(batch.column("a").to_numpy(), batch.column("b").to_numpy()).reshape(-1)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))],
                                         names=["word", "bits"])

    rows = (each_batch(keys.select("a", "b"), bitmap, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    level.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return level


def _known(level: Level, keys: DataFrame) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.knows(batch.column("a").to_numpy(),
                                                           batch.column("b").to_numpy())))

    return each_batch(keys, test, "a long, b long")


def cascade(universe: DataFrame, error: float = ERROR_RATE) -> list[Level]:
    """The levels for one shard's universe (a, b, listed)."""
    inside = universe.filter("listed").select("a", "b")
    outside = universe.filter("NOT listed").select("a", "b")
    levels: list[Level] = []
    n = inside.count()
    rate = min(error, n / max(1, outside.count())) if n else error
    while n:
        level = _fill(Level(n, rate, len(levels) + 1), inside)
        rate = error
        levels.append(level)
        mistaken = write_table(_known(level, outside), "url-level")
        n = mistaken.count()
        inside, outside = mistaken, inside
    return levels


def judge(pages: DataFrame, hosts: DataFrame, rules=RULES, error: float = ERROR_RATE,
          shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url);
    ``hosts`` (host) is the list."""
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    a, b = _hashes(F.col("host"))
    names = hosts.select(lower_ascii(F.col("host").cast("string")).alias("host")).dropna().distinct()
    universe = write_table(
        cut.select("host").distinct().join(names.withColumn("listed", F.lit(True)), "host", "left")
        .select(a.alias("a"), b.alias("b"), F.coalesce("listed", F.lit(False)).alias("listed")),
        "url-universe")
    shards = max(1, math.ceil(universe.filter("listed").count() / shard_keys))
    shard = F.pmod(F.col("a"), F.lit(shards))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                      a.alias("a"), b.alias("b"))
    out = None
    for first in range(0, shards, SHARDS_TOGETHER):
        some = range(first, min(shards, first + SHARDS_TOGETHER))
        levels = {k: cascade(universe.filter(shard == k), error) for k in some}
        mine = rows.filter((shard >= some.start) & (shard < some.stop)) if shards > SHARDS_TOGETHER else rows
        part = _apply(mine, levels, shards)
        out = part if out is None else out.unionByName(part)
    return out


def _apply(rows: DataFrame, levels: dict[int, list[Level]], shards: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    schema = rows.drop("a", "b").schema

    def verdicts(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            hit = np.zeros(len(a), bool)
            of = a % shards  # numpy's remainder, like pmod, is never negative
            for k, cascade_ in shared.value.items():
                own = np.flatnonzero(of == k)
                hit[own] = listed(cascade_, a[own], b[own])
            by_list = pa.array(np.where(hit, "block", "allow"), pa.string())
            verdict = pc.coalesce(batch.column("verdict").cast(pa.string()), by_list)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), verdict],
                names=["page_id", "host", "path", "rule", "verdict"])

    return each_batch(rows, verdicts, schema)

