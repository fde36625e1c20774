"""Batch job for spark-submit: the tool's commands over many trees, writing tables.

    spark-submit treeline/plans/job.py propose --trees /mnt/trees --out s3://bucket/run1
    spark-submit treeline/plans/job.py preview --inventory .../inventory --out ... \\
        --git-status .../git_status --git-tracked .../git_tracked --repos .../repos
    spark-submit treeline/plans/job.py apply --inventory ... --decisions .../decisions \\
        --history .../history --out ... [--execute] [--yes]
    spark-submit treeline/plans/job.py rollback --history .../history --disk .../inventory \\
        --undo-last 5 --out ... [--execute]
    spark-submit treeline/plans/job.py history --history .../history --out ...

Inputs are Parquet tables (or ``--trees`` for a folder of trees); every
result is written as a Parquet table under ``--out`` (proposal records also
as JSON lines). Nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from treeline.plans import entrypoints as EP  # noqa: E402
from treeline.sources import inventory as INV  # noqa: E402
from treeline.sources.trees import scan_trees  # noqa: E402


def _inventory(spark: SparkSession, args) -> DataFrame:
    if args.trees:
        return scan_trees(spark, args.trees)
    if args.inventory:
        return INV.read_inventory(spark, args.inventory)
    raise SystemExit("give --trees or --inventory")


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def run(spark: SparkSession, argv: list[str]) -> None:
    ap = argparse.ArgumentParser(prog="treeline")
    ap.add_argument("command", choices=["analyze", "propose", "preview", "apply", "rollback", "history"])
    ap.add_argument("--trees")
    ap.add_argument("--inventory")
    ap.add_argument("--out", required=True)
    ap.add_argument("--git-status")
    ap.add_argument("--git-tracked")
    ap.add_argument("--repos")
    ap.add_argument("--decisions")
    ap.add_argument("--history")
    ap.add_argument("--disk")
    ap.add_argument("--run", help="id of this run: the history records it once, however often it is tried")
    ap.add_argument("--undo-last", type=int)
    ap.add_argument("--execute", action="store_true")
    ap.add_argument("--yes", action="store_true")
    args = ap.parse_args(argv)
    read = spark.read.parquet

    if args.command == "history":
        _write(EP.history_view(spark, args.history), args.out, "history_view")
        return
    if args.command == "rollback":
        if args.undo_last is None:
            _write(EP.history_view(spark, args.history), args.out, "history_view")
            return
        r = EP.rollback(spark, args.history, read(args.disk), args.undo_last, execute=args.execute,
                        run=args.run)
        _write(r.results, args.out, "rollback_results")
        _write(r.summary, args.out, "rollback_summary")
        if r.new_inventory is not None:
            _write(r.new_inventory, args.out, "inventory")
        return

    raw = _inventory(spark, args)
    if args.command == "analyze":
        a = EP.analyze(raw, file_backed=not args.trees)
        _write(a.summary, args.out, "summary")
        _write(a.extensions, args.out, "extensions")
        return
    p = EP.propose(raw, file_backed=not args.trees)
    if args.command == "propose":
        _write(p.types, args.out, "repo_types")
        _write(p.proposals, args.out, "proposals")
        _write(p.rollup(), args.out, "proposal_rollup")
        _write(p.documents(), args.out, "proposal_documents")
        _write(p.document_chunks(), args.out, "document_chunks")
        INV.write_proposals(p.proposals, f"{args.out.rstrip('/')}/proposals_json", "json")
        return
    if args.command == "preview":
        v = EP.preview(p, read(args.git_status) if args.git_status else None,
                       read(args.git_tracked) if args.git_tracked else None,
                       read(args.repos) if args.repos else None)
        for name in ("impact", "new_directories", "tree", "import_warnings", "git_warnings",
                     "confidence"):
            _write(getattr(v, name), args.out, name)
        return
    if args.command == "apply":
        decisions = read(args.decisions) if args.decisions else None
        a = EP.apply(p, decisions, history_path=args.history, execute=args.execute,
                     approve_all=args.yes, run=args.run)
        _write(a.results, args.out, "apply_results")
        _write(a.summary, args.out, "apply_summary")
        if a.new_inventory is not None:
            _write(a.new_inventory, args.out, "inventory")


if __name__ == "__main__":
    session = SparkSession.builder.appName("treeline").getOrCreate()
    run(session, sys.argv[1:])
