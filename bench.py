"""Benchmark of the entry points on the driver's tables.

Runs propose / preview / apply / rollback over the inventory derived from
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and
prints one JSON line. Stages share one set of checkpointed tables, as one run
of the tool does; every stage forces its full result.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation
from pyspark.sql import functions as F  # noqa: E402

from treeline.operators import confidence as CF  # noqa: E402
from treeline.operators import gitinfo as GI  # noqa: E402
from treeline.operators import history as HI  # noqa: E402
from treeline.operators import imports as IM  # noqa: E402
from treeline.operators import moves as MV  # noqa: E402
from treeline.operators import preview as PV  # noqa: E402
from treeline.operators import reports as RE  # noqa: E402
from treeline.operators import repo as RP  # noqa: E402
from treeline.plans import entrypoints as EP  # noqa: E402
from treeline.plans.context import Tables  # noqa: E402
from treeline.session import checkpoint_dir, get_spark  # noqa: E402
from treeline.sources import fixtures as FX  # noqa: E402
from treeline.sources.trees import scan_trees  # noqa: E402


def _force(df) -> int:
    """Compute every column of every row (a count would let Catalyst drop them)."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus, app_name="treeline-bench")
    t = Tables(spark, sf_dir)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def stage(name, fn):
        t0 = time.time()
        out = fn()
        rows[name] = _force(out) if out is not None else 0
        times[name] = round(time.time() - t0, 3)

    # start-up (JIT, Python workers) and input generation (the driver's tables hold no
    # inventory): timed, not counted in the value
    stage("warmup", lambda: spark.range(0, 100_000, numPartitions=cpus)
          .mapInPandas(lambda it: it, schema="id long").groupBy((F.col("id") % 7).alias("k")).count())
    stage("fixture_inventory", lambda: t.raw)
    stage("scan_describe", lambda: t.files)
    stage("propose", lambda: t.proposals)
    stage("path_index", lambda: t.paths)
    stage("reports", lambda: RE.proposal_rollup(t.proposals).unionByName(
        RE.proposals_document(t.proposals).selectExpr("repo_id", "'doc' AS dimension",
                                                      "document AS value", "total_proposals AS n")))
    stage("proposal_numbers", lambda: RE.proposal_numbers(t.proposals))
    warnings = {}

    def _warn():
        warnings["w"] = IM.import_warnings(t.moves, t.files, t.paths).checkpoint(eager=True)
        return warnings["w"]
    stage("import_warnings", _warn)
    stage("git_warnings", lambda: GI.git_warnings(t.moves, t.git_status, t.git_tracked, t.repos))
    stage("confidence", lambda: CF.confidence(
        t.types, RP.repo_summary(t.files), t.proposals,
        IM.warning_counts(warnings["w"], RP.repo_ids(t.raw))))
    stage("tree_preview", lambda: PV.tree_diff(t.proposals))
    stage("impact_summary", lambda: PV.impact_summary(t.proposals, RP.repo_ids(t.raw)))
    approved = MV.with_decisions(t.moves, t.decisions)
    stage("apply_dry_run", lambda: MV.validate_moves(approved, t.paths))
    stage("apply_real", lambda: MV.apply_moves(approved, t.raw))
    stage("rollback_dry_run", lambda: HI.rollback_dry_run(t.history, t.history_files, 10))
    stage("rollback_real", lambda: HI.rollback(t.history, t.history_files, 10))

    # the reference's own scan: walk real folders and describe them. The
    # folders are written from the fixture once (timed, not counted).
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bench-trees-{uuid.uuid4().hex}"
    stage("fixture_write_trees", lambda: FX.materialize_trees(t.raw, folder))
    stage("tree_scan_describe", lambda: EP.analyze(scan_trees(spark, folder)).files)
    excluded = ["warmup", "fixture_inventory", "fixture_write_trees"]
    total = round(sum(v for k, v in times.items() if k not in excluded), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    raw_rows = t.raw.count()
    kept = rows["scan_describe"]            # files that survive the scan filter (as the reference counts)
    rates = {"inventory_files": raw_rows, "kept_files": kept,
             "describe_files_per_sec": round(kept / max(times["scan_describe"], 1e-9), 1),
             "tree_scan_files_per_sec": round(rows["tree_scan_describe"]
                                              / max(times["tree_scan_describe"], 1e-9), 1),
             "reference_describe_files_per_sec": round(361 / 0.279, 1)}
    print(json.dumps({"metric": "end_to_end_sec", "value": total, "unit": "sec",
                      "queries": times, "rows": rows, "rates": rates, "sf": sf, "cpus": cpus,
                      "excluded_from_value": excluded}))
    spark.stop()


if __name__ == "__main__":
    main()
