"""The four entry points of the tool, as lazy Spark plans over many repositories.

``analyze`` / ``propose`` / ``preview`` / ``apply`` / ``rollback`` take tables
(not a folder on one machine) and return DataFrames. Shared tables are
written once as Parquet into the shared folder named by
``spark.checkpoint.dir`` so that every report starts from them.

Typical use::

    raw = scan_trees(spark, "/mnt/trees")             # or read_inventory(spark, path)
    p = propose(raw)
    p.proposals.write.parquet(...)
    v = preview(p, git_status, git_tracked, repos)
    a = apply(p, decisions, disk=raw, history_path=".../history", execute=True)
    r = rollback(spark, ".../history", disk=a.new_inventory, n=5, execute=True)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import confidence as CF
from treeline.operators import files as FL
from treeline.operators import gitinfo as GI
from treeline.operators import history as HI
from treeline.operators import imports as IM
from treeline.operators import moves as MV
from treeline.operators import preview as PV
from treeline.operators import proposals as PR
from treeline.operators import reports as RE
from treeline.operators import repo as RP
from treeline.session import write_table
from treeline.sources import inventory as INV


def _keep(df: DataFrame) -> DataFrame:
    return write_table(df, "run")


@dataclass
class Analysis:
    raw: DataFrame
    files: DataFrame
    summary: DataFrame
    extensions: DataFrame


@dataclass
class Proposals(Analysis):
    types: DataFrame
    proposals: DataFrame

    @property
    def moves(self) -> DataFrame:
        return self.proposals.filter(F.col("action") == "move")

    @cached_property
    def paths(self) -> DataFrame:
        """Path index of the inventory, written when it is first asked for."""
        return INV.path_index(self.raw)

    def rollup(self) -> DataFrame:
        return RE.proposal_rollup(self.proposals)

    def documents(self) -> DataFrame:
        return RE.proposals_document(self.proposals)

    def all_duplicates(self) -> DataFrame:
        return PR.all_duplicates(self.files, self.proposals)

    def document_chunks(self) -> DataFrame:
        """The repositories' whole JSON documents, in ordered chunks."""
        return RE.document_chunks(self.proposals, self.all_duplicates(), RP.repo_ids(self.raw))

    def records(self) -> DataFrame:
        return RE.proposal_records(self.proposals)

    def numbered(self) -> DataFrame:
        return RE.proposal_numbers(self.proposals)

    def text(self) -> DataFrame:
        return RE.proposal_text(self.proposals)


def analyze(raw: DataFrame, file_backed: bool = False) -> Analysis:
    """``analyze``: scan filter, file facts, per-repository summary and extensions.

    An inventory that is not ``file_backed`` (the tree listing) is written to
    Parquet once, so that the parse, the existence checks and the reports do
    not list the trees again. An inventory without ``file_seq`` is taken in the order
    of its paths (``validate_inventory``).
    """
    raw = INV.validate_inventory(raw)
    if not file_backed:
        raw = _keep(raw)
    files = _keep(FL.build_files(raw))
    return Analysis(raw, files, RP.repo_summary(files, RP.repo_ids(raw)), RP.top_extensions(files))


def propose(raw: DataFrame, file_backed: bool = False) -> Proposals:
    """``propose``: repository type, classification and all proposals."""
    a = analyze(raw, file_backed)
    types = _keep(RP.repo_types(a.files, a.raw))
    props = _keep(PR.all_proposals(a.files, types))
    return Proposals(a.raw, a.files, a.summary, a.extensions, types, props)


@dataclass
class Preview:
    impact: DataFrame
    new_directories: DataFrame
    tree: DataFrame
    import_warnings: DataFrame
    git_warnings: DataFrame
    confidence: DataFrame


def preview(p: Proposals, git_status: DataFrame | None = None, git_tracked: DataFrame | None = None,
            repos: DataFrame | None = None, is_dry_run: bool = True) -> Preview:
    """``preview``: impact, tree before / after, import and git warnings, confidence."""
    spark = p.files.sparkSession
    repo_list = RP.repo_ids(p.raw)
    warnings = _keep(IM.import_warnings(p.moves, p.files, p.paths))
    if git_status is None or git_tracked is None or repos is None:
        git = spark.createDataFrame([], "repo_id string, warning_type string, message string, "
                                        "details array<string>, total bigint")
    else:
        git = GI.git_warnings(p.moves, git_status, git_tracked, repos)
    conf = CF.confidence(p.types, p.summary, p.proposals, IM.warning_counts(warnings, repo_list),
                         is_dry_run=is_dry_run)
    return Preview(PV.impact_summary(p.proposals, repo_list), PV.new_directories(p.proposals),
                   PV.tree_diff(p.proposals), warnings, git, conf)


@dataclass
class Applied:
    results: DataFrame
    summary: DataFrame
    new_inventory: DataFrame | None


def apply(p: Proposals, decisions: DataFrame | None, disk: DataFrame | None = None,
          history_path: str | None = None, execute: bool = False,
          approve_all: bool = False, run: str | None = None) -> Applied:
    """``apply``: decisions, then a dry run (default) or a real, sequential run.

    A real run returns the next inventory version and appends the results to
    the history table when a repository had at least one success; with a ``run`` id
    only once, however often the run is tried.
    """
    spark = p.files.sparkSession
    on_raw = disk is None
    disk = p.raw if on_raw else disk
    if decisions is None:
        decisions = spark.createDataFrame([], "repo_id string, source string, decision string")
    approved = MV.with_decisions(PR.sequenced(p.moves), decisions, approve_all=approve_all)
    if not execute:
        res = MV.validate_moves(approved, p.paths if on_raw else disk)
        return Applied(res, MV.execution_summary(res, p.types), None)
    res = _keep(MV.apply_moves(approved, disk))
    if history_path:
        INV.append_history(lambda heads: HI.apply_history_records(res, heads), history_path, run, spark)
    return Applied(res, MV.execution_summary(res, p.types), MV.new_inventory(disk, res))


@dataclass
class RolledBack:
    results: DataFrame
    summary: DataFrame
    new_inventory: DataFrame | None = None


def rollback(spark: SparkSession, history_path: str, disk: DataFrame, n: int,
             execute: bool = False, run: str | None = None) -> RolledBack:
    """``rollback --undo-last n``: newest undoable moves first, stop at the first failure.

    A real run returns the next inventory version, as ``apply`` does. A ``run`` that is tried
    again sees the history as it was before its first try, and is recorded once.
    """
    if n <= 0:
        raise ValueError("--undo-last must be a positive number")
    hist = INV.read_history(spark, history_path, before_run=run)
    if not execute:
        res = HI.rollback_dry_run(hist, disk, n)
        return RolledBack(res, HI.rollback_summary(res))
    res = _keep(HI.rollback(hist, disk, n))
    INV.append_history(lambda heads: HI.rollback_history_records(res, heads), history_path, run, spark)
    return RolledBack(res, HI.rollback_summary(res), HI.rolled_back_inventory(disk, res))


def history_view(spark: SparkSession, history_path: str, k: int = 20) -> DataFrame:
    """``rollback`` without ``--undo-last``: the last ``k`` entries and the total."""
    return HI.recent_history(INV.read_history(spark, history_path), k)
