"""Committed tables: runs tried again, runs at the same time, attempts that die, compaction."""

import pytest
from pyspark.sql import functions as F

from treeline.operators import history as HI
from treeline.sources import commits
from treeline.sources import inventory as INV


def entries(spark, rows):
    """(repo_id, ord, source) as the results of an apply."""
    return spark.createDataFrame(rows, "repo_id string, ord long, source string").select(
        "repo_id", "ord", F.lit("move").alias("action"), "source", F.concat(F.lit("t/"), "source").alias("target"),
        F.lit("low").alias("risk"), F.lit(True).alias("success"), F.lit(False).alias("skipped"),
        F.lit("ok").alias("message"))


def seqs(spark, path, before_run=None):
    return sorted((r.repo_id, r.seq, r.source) for r in INV.read_history(spark, path, before_run).collect())


def test_a_run_tried_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "h")
    assert seqs(spark, path) == []
    for attempt in range(2):
        done = INV.append_history(lambda heads: HI.apply_history_records(
            entries(spark, [("a", 5, "x"), ("a", 9, "y"), ("b", 1, "z")]), heads), path, "one", spark)
        assert done == (attempt == 0)
    assert seqs(spark, path) == [("a", 1, "x"), ("a", 5, "y"), ("b", 1, "z")]
    INV.append_history(lambda heads: HI.apply_history_records(
        entries(spark, [("a", 2, "v"), ("c", 2, "w")]), heads), path, "two", spark)
    assert seqs(spark, path)[2:4] == [("a", 6, "v"), ("b", 1, "z")]
    assert seqs(spark, path, before_run="two") == [("a", 1, "x"), ("a", 5, "y"), ("b", 1, "z")]
    assert seqs(spark, path, before_run="one") == []
    assert seqs(spark, path, before_run="never committed") == seqs(spark, path)


def test_runs_at_the_same_time_keep_both(spark, tmp_path):
    path = str(tmp_path / "h")
    asked = []

    def slow(heads):
        if not asked:      # another run commits while this one is at work
            INV.append_history(lambda h: HI.apply_history_records(
                entries(spark, [("a", 1, "fast"), ("b", 1, "fast")]), h), path, "fast", spark)
        asked.append(heads.count())
        return HI.apply_history_records(entries(spark, [("a", 1, "slow")]), heads)

    assert INV.append_history(slow, path, "slow", spark)
    assert asked == [0, 2]           # numbered again after the faster run
    assert seqs(spark, path) == [("a", 1, "fast"), ("a", 2, "slow"), ("b", 1, "fast")]


def test_an_attempt_that_dies_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    make = lambda heads: HI.apply_history_records(entries(spark, [("a", 1, "x")]), heads)
    with monkeypatch.context() as m:
        m.setattr(commits.CommittedTable, "_publish", lambda self, manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            INV.append_history(make, path, "one", spark)
    assert seqs(spark, path) == []
    assert INV.append_history(make, path, "one", spark)
    assert seqs(spark, path) == [("a", 1, "x")]


def test_compaction_and_plain_files(spark, tmp_path, monkeypatch):
    """Numbers and time travel hold over compacted manifests; files from before the log stay."""
    monkeypatch.setattr(commits, "COMPACT", 3)
    path = str(tmp_path / "h")
    zero = spark.createDataFrame([], "repo_id string, last long")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in INV.HISTORY_SCHEMA.fields]
    HI.apply_history_records(entries(spark, [("a", 1, "old"), ("z", 1, "old")]), zero) \
        .select(*cols).write.parquet(path)
    assert len(seqs(spark, path)) == 2
    for k in range(7):
        INV.append_history(lambda heads, k=k: HI.apply_history_records(
            entries(spark, [("a", 1, f"r{k}"), (f"only{k}", 1, "x")]), heads), path, f"run{k}", spark)
    assert [s for r, s, _ in seqs(spark, path) if r == "a"] == list(range(1, 9))
    table = INV.history_table(spark, path)
    assert {r.repo_id: r["last"] for r in table.heads().collect()} == \
        {"a": 8, "z": 1} | {f"only{k}": 1 for k in range(7)}
    assert len(table.snapshot().heads) == 2          # back to version 6 only
    for k in range(7):
        seen = seqs(spark, path, before_run=f"run{k}")
        assert [s for r, s, _ in seen if r == "a"] == list(range(1, k + 2))
        heads = table.heads(table.snapshot(f"run{k}"))
        assert heads.filter("repo_id = 'a'").first()["last"] == k + 1


def test_next_numbers_come_from_the_heads(spark, tmp_path):
    """Numbering a run reads no records of the history."""
    path = str(tmp_path / "h")
    INV.append_history(lambda h: HI.apply_history_records(entries(spark, [("a", 1, "x")]), h), path, "one", spark)
    files = INV.history_table(spark, path).heads().inputFiles()
    assert files and all("/heads/" in f for f in files)


def test_manifest_is_not_overwritten(spark, tmp_path):
    table = INV.history_table(spark, str(tmp_path / "h"))
    one = {"version": 1, "run": "a", "data": "data/a", "heads": "heads/a"}
    assert table._publish(one)
    assert not table._publish(one | {"run": "b"})
    assert table.snapshot().runs == ["a"]
