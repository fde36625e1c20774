"""Inventories without ``file_seq``: the order of depth and segments, without numbering."""

import random

from helpers import raw_df
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from treeline.functions import rules as R
from treeline.operators.ordering import number_within
from treeline.plans import entrypoints as EP
from treeline.sources import fixtures as fx
from treeline.sources import inventory as INV


def test_key_sorts_like_depth_and_segments(spark):
    rng = random.Random(5)
    names = ["a", "a.py", "a b", "a-b", "ab", "A", "_", "~", "\u00e9", "\u4e2d", "\U0001f600", "\x01", ""]
    paths = list({"/".join(rng.choice(names) for _ in range(rng.randint(1, 40 if k % 50 == 0 else 4)))
                  for k in range(800)})
    keys = {r.p: bytes(r.k) for r in spark.createDataFrame([(p,) for p in paths], "p string")
            .select("p", R.walk_key(F.col("p")).alias("k")).collect()}
    want = sorted(paths, key=lambda p: (p.count("/"), [s.encode() for s in p.split("/")]))
    assert sorted(paths, key=keys.get) == want
    assert len(set(keys.values())) == len(paths)


def test_same_proposals_as_with_numbers(spark, tmp_path):
    """Reports, documents and a real run do not depend on how the same order is given."""
    raw = fx.raw_files(spark, SF_SMALL).drop("file_seq").checkpoint(eager=True)
    w = Window.partitionBy("repo_id").orderBy(F.size(F.split("relative_path", "/")), F.split("relative_path", "/"))
    numbered = EP.propose(raw.withColumn("file_seq", F.row_number().over(w)))
    # appended snapshots, in any order of rows
    path = str(tmp_path / "inventory")
    for k in (1, 0):
        raw.filter(F.pmod(F.xxhash64("relative_path"), F.lit(2)) == k).orderBy(F.rand(k)) \
           .write.mode("append").parquet(path)
    bare = EP.propose(INV.read_inventory(spark, path), file_backed=True)
    assert dict(bare.proposals.dtypes)["ord"] == "binary"

    def same(a, b):
        b = b.select(*a.columns)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0

    same(numbered.proposals.drop("ord"), bare.proposals.drop("ord"))
    same(numbered.numbered().drop("ord"), bare.numbered().drop("ord"))
    same(numbered.text().drop("ord"), bare.text().drop("ord"))
    same(numbered.document_chunks(), bare.document_chunks())
    same(numbered.all_duplicates().drop("ord", "file_seq"), bare.all_duplicates().drop("ord", "file_seq"))
    done = [EP.apply(p, None, history_path=str(tmp_path / f"history{k}"), execute=True, approve_all=True)
            for k, p in enumerate((numbered, bare))]
    same(done[0].results.drop("ord"), done[1].results.drop("ord"))
    same(done[0].new_inventory.select("repo_id", "relative_path"), done[1].new_inventory.select("repo_id", "relative_path"))
    # the key follows the moved file, and the next run starts from it
    after = done[1].new_inventory
    assert after.filter(F.col("file_seq") != R.walk_key(F.col("relative_path"))).count() == 0
    assert dict(INV.validate_inventory(after).dtypes)["file_seq"] == "binary"
    seqs = [EP.history_view(spark, str(tmp_path / f"history{k}"), 10_000).select("repo_id", "source", "position")
            for k in range(2)]
    assert seqs[0].count() == seqs[1].count() > 0
    undone = EP.rollback(spark, str(tmp_path / "history1"), disk=after, n=10_000, execute=True)
    assert undone.results.filter("success").count() == done[1].results.filter("success").count()
    left = undone.new_inventory.select("repo_id", "relative_path")
    assert left.exceptAll(raw.select("repo_id", "relative_path")).count() == 0


def test_a_large_repository_is_numbered_in_slices(spark):
    """No window over a repository: its moves are numbered within range slices."""
    from treeline.operators.proposals import sequenced
    raw = INV.validate_inventory(spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 'big', concat('r', id)) AS repo_id", "concat('d', id % 7, '/f', id, '.py') AS relative_path",
        "id AS size"))
    p = raw.select("repo_id", F.lit(1).alias("phase"), F.col("file_seq").alias("ord"), "relative_path")
    rows = sequenced(p).filter("repo_id = 'big'").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(1, 1001))
    paths = [r.relative_path for r in rows]
    assert paths == sorted(paths, key=lambda x: x.split("/"))
    assert sequenced(p.withColumn("ord", F.lit(7))).select("ord").first().ord == 7


def test_missing_path_is_still_an_error(spark):
    import pytest
    with pytest.raises(ValueError, match="relative_path"):
        INV.validate_inventory(spark.createDataFrame([("r", 1)], "repo_id string, size long"))
    with pytest.raises(ValueError, match="size"):
        INV.validate_inventory(raw_df(spark, ["a.py"]).drop("size"))
    assert number_within(INV.validate_inventory(raw_df(spark, ["b/a.py", "z.py"]).drop("file_seq")),
                         ["repo_id"], ["file_seq"]).orderBy("n").collect()[0].relative_path == "z.py"
