"""End-to-end invariants on the fixture inventory."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from treeline.operators import moves as MV
from treeline.plans import entrypoints as EP
from treeline.sources import fixtures as fx


def test_propose_invariants(spark):
    p = EP.propose(fx.raw_files(spark, SF_SMALL))
    typed = p.proposals.join(p.types, "repo_id")
    # no MOVE outside python_dominant
    assert typed.filter((F.col("action") == "move") & (F.col("repo_type") != "python_dominant")).count() == 0
    # one flag per duplicate group
    dup = p.proposals.filter(F.col("phase") == 2)
    assert dup.count() == dup.select("repo_id", F.lower("source")).distinct().count()
    # at most one MOVE per file, never a no-op
    mv = p.moves
    assert mv.count() == mv.select("repo_id", "source").distinct().count()
    assert mv.filter(F.col("source") == F.col("target")).count() == 0


def test_apply_then_rollback_restores_inventory(spark, tmp_path):
    raw = fx.raw_files(spark, SF_SMALL)
    p = EP.propose(raw)
    hist = str(tmp_path / "history")
    a = EP.apply(p, None, history_path=hist, execute=True, approve_all=True)
    done = a.results.filter("success").count()
    assert done > 0
    after = a.new_inventory.checkpoint(eager=True)
    assert after.count() == raw.count()
    assert after.select("repo_id", "relative_path").distinct().count() == raw.count()
    r = EP.rollback(spark, hist, disk=after, n=10_000, execute=True, run="undo")
    assert r.results.filter("success").count() == done
    restored = r.new_inventory
    diff = restored.select("repo_id", "relative_path").exceptAll(raw.select("repo_id", "relative_path"))
    assert diff.count() == 0
    # tried again: the same outcome, recorded once
    entries = EP.history_view(spark, hist, 10_000).count()
    again = EP.rollback(spark, hist, disk=after, n=10_000, execute=True, run="undo")
    assert again.results.filter("success").count() == done
    assert EP.history_view(spark, hist, 10_000).count() == entries
    # the history keeps the run and the rollback
    view = EP.history_view(spark, hist, 20)
    assert view.filter(F.col("action") == "ROLLBACK").count() > 0


def test_preview_shapes(spark):
    p = EP.propose(fx.raw_files(spark, SF_SMALL))
    v = EP.preview(p, fx.git_status(spark, p.raw), fx.git_tracked(spark, p.raw), fx.repos(spark, p.raw))
    assert v.confidence.count() == p.types.count()
    assert v.tree.filter(F.col("text") == ".").count() == 2 * p.moves.select("repo_id").distinct().count()
