"""Incremental propose: two snapshots arrive, each is proposed on its own."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from treeline.plans import entrypoints as EP
from treeline.sources import fixtures as fx
from treeline.streaming.incremental import propose_stream


def test_propose_stream_matches_batch(spark, tmp_path):
    raw = fx.raw_files(spark, SF_SMALL).checkpoint(eager=True)
    inbox = str(tmp_path / "inbox")
    first = raw.filter(F.col("repo_id") < "repo050")
    first.coalesce(1).write.parquet(inbox + "/a")
    q = propose_stream(spark, inbox + "/*", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    raw.filter(F.col("repo_id") >= "repo050").coalesce(1).write.parquet(inbox + "/b")
    q = propose_stream(spark, inbox + "/*", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out" / "proposals"))
    assert got.select("snapshot").distinct().count() == 2
    want = EP.propose(raw).proposals
    cols = ["repo_id", "phase", "ord", "action", "source", "target", "reason", "risk"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
