"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, derives the inventory fixtures from the
driver's tables, applies its operator over the whole tables and returns
scalar columns (arrays joined with '|') whose names match the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.operators import facts as FA
from treeline.operators import files as FL
from treeline.operators import proposals as PR
from treeline.operators import repo as RP
from treeline.operators.ordering import number_within
from treeline.plans.context import Tables
from treeline.sources import inventory as INV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_RUNS: dict[tuple[str, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """One set of written tables per Spark application and table folder.

    The shared tables are derived and written once, then read by every query
    of the same application, as one run of the tool would.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = Tables(spark, sf_dir)
    return _RUNS[key]


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(tables_for(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


def _bar(c) -> F.Column:
    return F.array_join(c, "|")


# --------------------------------------------------------------------- sources
@query("S2_read_inventory")
def s2(t: Tables) -> DataFrame:
    """An inventory written as Parquet, with a column too many and one of another type, read
    against the raw_files contract."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/inventory-{uuid.uuid4().hex}"
    t.raw.withColumns({"size": F.col("size").cast("int"), "owner": F.lit("x")}).write.parquet(path)
    return INV.read_inventory(t.spark, path).select("repo_id", "file_seq", "relative_path", "size")


@query("S2_without_file_seq")
def s2w(t: Tables) -> DataFrame:
    """Two snapshots appended without ``file_seq``: files in the order of depth and segments."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/inventory-{uuid.uuid4().hex}"
    bare = t.raw.drop("file_seq")
    for part in (bare.filter("size % 2 = 1"), bare.filter("size % 2 = 0")):
        part.write.mode("append").parquet(path)
    files = INV.read_inventory(t.spark, path)
    return number_within(files, ["repo_id"], ["file_seq"], "position").select(
        "repo_id", "position", "relative_path", "size")


@query("S6_file_records")
def s6(t: Tables) -> DataFrame:
    r = FL.file_records(t.files)
    return r.withColumn("imports", _bar("imports"))


# ----------------------------------------------------------------- projections
@query("P1_path_parts")
def p1(t: Tables) -> DataFrame:
    return t.files.select("repo_id", "relative_path", "name", "extension", "parent",
                          F.col("depth").cast("bigint").alias("depth"),
                          _bar("parts").alias("parts"), "content_sample")


@query("P2_name_flags")
def p2(t: Tables) -> DataFrame:
    return t.files.select("repo_id", "relative_path",
                          R.name_is_executable(F.col("name")).alias("name_executable"),
                          R.name_has_tests(F.col("name")).alias("name_tests"),
                          "is_executable", "has_tests")


@query("P3_python_facts")
def p3(t: Tables) -> DataFrame:
    py = t.files.filter(F.col("extension") == ".py")
    return py.select("repo_id", "relative_path", _bar("imports").alias("imports"),
                     F.size("imports").cast("bigint").alias("n_imports"), "has_main",
                     "has_tests", "is_executable")


@query("P3_import_statements")
def p3s(t: Tables) -> DataFrame:
    s = FA.statements(t.files)
    return s.select("repo_id", "relative_path", F.col("stmt_no").cast("bigint").alias("stmt_no"),
                    "module", "is_relative", F.col("level").cast("bigint").alias("level"),
                    F.col("line_number").cast("bigint").alias("line_number"),
                    _bar("names").alias("names"))


def _py_pred(t: Tables, col: F.Column, name: str) -> DataFrame:
    return t.files.filter(F.col("extension") == ".py").select("repo_id", "relative_path",
                                                              col.alias(name))


@query("P4_classify")
def p4(t: Tables) -> DataFrame:
    return t.files.select("repo_id", "relative_path", "category")


@query("P5_is_experiment")
def p5(t: Tables) -> DataFrame:
    return _py_pred(t, R.is_experiment(), "is_experiment")


@query("P6_is_test")
def p6(t: Tables) -> DataFrame:
    return _py_pred(t, R.is_test(), "is_test")


@query("P7_is_config")
def p7(t: Tables) -> DataFrame:
    return _py_pred(t, R.is_config(), "is_config")


@query("P8_is_script")
def p8(t: Tables) -> DataFrame:
    return _py_pred(t, R.is_script(), "is_script")


@query("P9_is_source")
def p9(t: Tables) -> DataFrame:
    return _py_pred(t, R.is_source(), "is_source")


@query("P10_classify_non_python")
def p10(t: Tables) -> DataFrame:
    f = t.files.filter((F.col("extension") != ".py") & (F.col("extension") != ".md"))
    return f.select("repo_id", "relative_path", R.classify_non_python().alias("category"))


# --------------------------------------------------------------------- filters
@query("F1_not_ignored")
def f1(t: Tables) -> DataFrame:
    return t.raw.select("repo_id", "relative_path",
                        R.is_ignored(F.split("relative_path", "/")).alias("ignored"))


@query("F2_glob_match")
def f2(t: Tables) -> DataFrame:
    return FL.glob_hits(t.raw, t.paths, [*K.IGNORE_FILE_PATTERNS, *K.IGNORE_DIR_GLOBS])


# ------------------------------------------------------------------ aggregates
@query("A1_repo_summary")
def a1(t: Tables) -> DataFrame:
    return RP.repo_summary(t.files, RP.repo_ids(t.raw))


@query("A2_extension_histogram")
def a2(t: Tables) -> DataFrame:
    return RP.extension_histogram(t.files)


@query("A3_category_counts")
def a3(t: Tables) -> DataFrame:
    c = RP.category_counts(t.files, RP.repo_ids(t.raw))
    return c.select("repo_id", *[F.col(k).cast("bigint").alias(k) for k in K.CATEGORIES])


@query("A4_python_score")
def a4(t: Tables) -> DataFrame:
    return t.types.select("repo_id", "py_files", "python_score")


@query("A5_non_python_score")
def a5(t: Tables) -> DataFrame:
    return t.types.select("repo_id", "non_python_score")


@query("A6_repo_type")
def a6(t: Tables) -> DataFrame:
    return t.types


@query("A7_detection_summary")
def a7(t: Tables) -> DataFrame:
    return RP.detection_summary(t.files)


@query("L1_top_extensions")
def l1(t: Tables) -> DataFrame:
    return RP.top_extensions(t.files)


@query("U3_root_indicators")
def u3(t: Tables) -> DataFrame:
    return RP.root_indicators(t.files)


@query("J1_in_package")
def j1(t: Tables) -> DataFrame:
    return t.files.select("repo_id", "relative_path", "in_package")


# ------------------------------------------------------------------ proposals
def _typed(t: Tables) -> DataFrame:
    return PR.with_repo_type(t.files, t.types)


def _unplaced(t: Tables) -> DataFrame:
    c = PR.candidates(_typed(t)).filter(~R.correctly_placed())
    return c.withColumn("target", R.target_path())


@query("J2_with_repo_type")
def j2(t: Tables) -> DataFrame:
    return _typed(t).select("repo_id", "relative_path", "repo_type")


@query("F6_candidates_by_repo_type")
def f6(t: Tables) -> DataFrame:
    return PR.candidates(_typed(t)).select("repo_id", "relative_path", "category")


@query("P11_correctly_placed")
def p11(t: Tables) -> DataFrame:
    return PR.candidates(_typed(t)).select("repo_id", "relative_path", "category",
                                           R.correctly_placed().alias("correctly_placed"))


@query("P12_target_path")
def p12(t: Tables) -> DataFrame:
    return _unplaced(t).select("repo_id", "relative_path", "category", "target")


@query("F3_drop_noop_moves")
def f3(t: Tables) -> DataFrame:
    u = _unplaced(t)
    return u.filter(F.col("target") == F.col("relative_path")).select(
        "repo_id", "relative_path", "category")


def _phase1(t: Tables) -> DataFrame:
    return PR.per_file_proposals(_typed(t)).drop("_keep_move")


@query("P13_move_risk")
def p13(t: Tables) -> DataFrame:
    return _phase1(t).filter(F.col("action") == "move").select("repo_id", "source", "risk")


@query("P14_move_reason")
def p14(t: Tables) -> DataFrame:
    return _phase1(t).filter(F.col("action") == "move").select("repo_id", "source", "reason")


@query("F8_unclassified_flags")
def f8(t: Tables) -> DataFrame:
    return PR.flat(_phase1(t).filter(F.col("action") == "flag"))


@query("F7_gate_moves")
def f7(t: Tables) -> DataFrame:
    return PR.flat(PR.gate_moves(_phase1(t), t.types))


@query("A8_duplicate_groups")
def a8(t: Tables) -> DataFrame:
    return PR.flat(PR.duplicate_groups(t.files, t.types))


@query("A8_duplicate_members")
def a8m(t: Tables) -> DataFrame:
    m = PR.duplicate_members(t.files)
    sizes = m.groupBy("repo_id", "group_name").agg(F.count(F.lit(1)).alias("total_count")) \
             .filter(F.col("total_count") > 1)
    return m.join(sizes, ["repo_id", "group_name"], "left_semi").select(
        "repo_id", "group_name", "file_seq", "relative_path")


@query("A8_all_duplicates")
def a8a(t: Tables) -> DataFrame:
    return PR.all_duplicates(t.files, t.proposals)


@query("P15_duplicate_risk")
def p15(t: Tables) -> DataFrame:
    first = PR.duplicate_members(t.files).groupBy("repo_id", "group_name").agg(
        F.min_by("name", "file_seq").alias("first_name"), F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 1)
    return first.select("repo_id", "group_name", "first_name",
                        R.duplicate_risk(F.col("first_name")).alias("risk"))


@query("F10_duplicate_exempt")
def f10(t: Tables) -> DataFrame:
    return t.files.filter(F.col("name").isin(*K.DUPLICATE_EXEMPT)).select(
        "repo_id", "relative_path", "name")


@query("F11_suppress_expected_duplicates")
def f11(t: Tables) -> DataFrame:
    first = PR.duplicate_members(t.files).groupBy("repo_id", "group_name").agg(
        F.min_by("name", "file_seq").alias("first_name"), F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 1)
    g = first.join(t.types.select("repo_id", "repo_type"), "repo_id")
    g = g.withColumn("profile", PR.profile_name(F.col("repo_type")))
    low = F.lower(F.col("first_name"))
    return g.filter(F.exists(PR.profile_patterns(F.col("profile")), lambda p: low.contains(p))) \
            .select("repo_id", "group_name", "first_name", "profile")


@query("J3_with_profile")
def j3(t: Tables) -> DataFrame:
    prof = PR.profile_name(F.col("repo_type"))
    return t.types.select("repo_id", "repo_type", prof.alias("profile"),
                          _bar(PR.profile_patterns(prof)).alias("ignored_duplicate_patterns"))


@query("F9_root_python_flags")
def f9(t: Tables) -> DataFrame:
    return PR.flat(PR.root_python_flags(_typed(t)))


@query("J4_suppress_redundant_flags")
def j4(t: Tables) -> DataFrame:
    gated = PR.gate_moves(_phase1(t), t.types)
    both = gated.unionByName(PR.root_python_flags(_typed(t)))
    return PR.flat(PR.suppress_redundant_flags(both))


@query("U1_all_proposals")
def u1(t: Tables) -> DataFrame:
    return PR.flat(t.proposals)


@query("F4_by_action")
def f4(t: Tables) -> DataFrame:
    return PR.flat(t.proposals.filter(F.col("action") == "flag"))


@query("F5_by_risk")
def f5(t: Tables) -> DataFrame:
    return PR.flat(t.proposals.filter(F.col("risk") == "high"))


# -------------------------------------------------------------------- reports
from treeline.operators import reports as RE  # noqa: E402


@query("P16_display_group")
def p16(t: Tables) -> DataFrame:
    p = RE.with_display_group(t.proposals)
    return p.select("repo_id", "phase", F.col("ord").cast("bigint").alias("ord"), "source",
                    "display_group", F.col("group_rank").cast("bigint").alias("group_rank"))


@query("W1_proposal_numbers")
def w1(t: Tables) -> DataFrame:
    n = RE.proposal_numbers(t.proposals)
    return n.select("repo_id", "phase", F.col("ord").cast("bigint").alias("ord"), "display_group",
                    "number")


@query("A9_proposal_rollup")
def a9(t: Tables) -> DataFrame:
    return RE.proposal_rollup(t.proposals)


@query("A10_proposals_document")
def a10(t: Tables) -> DataFrame:
    return RE.proposals_document(t.proposals)


@query("A10_document_chunks")
def a10c(t: Tables) -> DataFrame:
    """Whole documents, proposals and all duplicates included, in chunks of a megabyte."""
    return RE.document_chunks(t.proposals, PR.all_duplicates(t.files, t.proposals), RP.repo_ids(t.raw))


@query("S3_write_proposals")
def s3(t: Tables) -> DataFrame:
    """Proposals written through the sink; the records of the files read back."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/proposals-{uuid.uuid4().hex}"
    INV.write_proposals(t.proposals, path, "parquet")
    return RE.proposal_records(t.spark.read.parquet(path)).withColumn("ord", F.col("ord").cast("bigint"))


@query("P19_proposal_text")
def p19(t: Tables) -> DataFrame:
    return RE.proposal_text(t.proposals).withColumn("ord", F.col("ord").cast("bigint"))


@query("U1_without_file_seq")
def u1w(t: Tables) -> DataFrame:
    """All proposals of the inventory without ``file_seq``; ord: their number in display order."""
    files = write_table(FL.build_files(INV.validate_inventory(t.raw.drop("file_seq"))), "files")
    numbered = RE.proposal_numbers(PR.all_proposals(files, t.types))
    return PR.flat(numbered.withColumn("ord", F.col("number")))


# -------------------------------------------------------------------- imports
from treeline.operators import imports as IM  # noqa: E402


def _warn_cols(w: DataFrame) -> DataFrame:
    return w.select("repo_id", F.col("move_ord").cast("bigint").alias("move_ord"), "source",
                    F.col("stmt_no").cast("bigint").alias("stmt_no"), "kind",
                    F.col("line_number").cast("bigint").alias("line_number"),
                    R.import_text(F.col("module"), F.col("is_relative"), F.col("level"),
                                  F.col("names")).alias("import_text"),
                    "reason", _bar("affected").alias("affected"))


def _moved_st(t: Tables) -> DataFrame:
    return IM.moved_statements(t.moves, t.files)


@query("J5_relative_import_risk")
def j5(t: Tables) -> DataFrame:
    return _warn_cols(IM.relative_import_risk(_moved_st(t), t.moves, t.paths))


@query("J6_sibling_import_risk")
def j6(t: Tables) -> DataFrame:
    return _warn_cols(IM.sibling_import_risk(_moved_st(t), t.moves, t.paths))


@query("J7_import_warnings")
def j7(t: Tables) -> DataFrame:
    return _warn_cols(IM.import_warnings(t.moves, t.files, t.paths))


@query("J12_affected_existing")
def j12(t: Tables) -> DataFrame:
    """Lookup behind J5: candidate file exists on disk or is a move source."""
    st = _moved_st(t).filter(F.col("is_relative") & (F.col("source_dir") != F.col("target_dir"))
                             & (F.col("module") != ""))
    cand = IM._join_dir(F.col("source_dir"),
                        F.concat(F.split(F.col("module"), r"\.")[0], F.lit(".py")))
    st = st.withColumn("candidate", cand)
    disk = MV.path_state(st.select("repo_id", F.col("candidate").alias("path")), t.paths).select(
        "repo_id", F.col("path").alias("candidate"), F.col("is_file").alias("on_disk"))
    mv = t.moves.select("repo_id", F.col("source").alias("candidate"), F.lit(True).alias("is_moving"))
    j = st.join(disk, ["repo_id", "candidate"], "left").join(mv, ["repo_id", "candidate"], "left")
    return j.select("repo_id", F.col("move_ord").cast("bigint").alias("move_ord"),
                    F.col("stmt_no").cast("bigint").alias("stmt_no"), "candidate",
                    F.coalesce("on_disk", F.lit(False)).alias("on_disk"),
                    F.coalesce("is_moving", F.lit(False)).alias("is_moving"))


@query("P17_import_text")
def p17(t: Tables) -> DataFrame:
    s = FA.statements(t.files)
    return s.select("repo_id", "relative_path", F.col("stmt_no").cast("bigint").alias("stmt_no"),
                    R.import_text(F.col("module"), F.col("is_relative"), F.col("level"),
                                  F.col("names")).alias("import_text"))


@query("P18_import_warning_text")
def p18(t: Tables) -> DataFrame:
    w = IM.warning_text(IM.import_warnings(t.moves, t.files, t.paths))
    return w.select("repo_id", F.col("move_ord").cast("bigint").alias("move_ord"),
                    F.col("stmt_no").cast("bigint").alias("stmt_no"), "source", "text")


@query("A18_warning_counts")
def a18(t: Tables) -> DataFrame:
    return IM.warning_counts(IM.import_warnings(t.moves, t.files, t.paths), RP.repo_ids(t.raw))


# ------------------------------------------------------------ git, confidence
from treeline.operators import confidence as CF  # noqa: E402
from treeline.operators import gitinfo as GI  # noqa: E402


@query("P20_parse_git_status")
def p20(t: Tables) -> DataFrame:
    return GI.parse_git_status(t.git_status, t.repos)


@query("J8_tracked_moves")
def j8(t: Tables) -> DataFrame:
    m = GI.tracked_moves(t.moves, t.git_tracked, t.repos)
    return m.select("repo_id", F.col("ord").cast("bigint").alias("ord"), "source", "target")


@query("A15_git_warnings")
def a15(t: Tables) -> DataFrame:
    g = GI.git_warnings(t.moves, t.git_status, t.git_tracked, t.repos)
    return g.withColumn("details", _bar("details"))


def _confidence(t: Tables) -> DataFrame:
    warn = IM.warning_counts(IM.import_warnings(t.moves, t.files, t.paths), RP.repo_ids(t.raw))
    return CF.confidence(t.types, RP.repo_summary(t.files), t.proposals, warn, is_dry_run=True)


@query("A13_confidence")
def a13(t: Tables) -> DataFrame:
    return _confidence(t).drop("positive_factors", "risk_factors", "interpretation")


@query("A14_confidence_factors")
def a14(t: Tables) -> DataFrame:
    c = _confidence(t)
    return c.select("repo_id", _bar("positive_factors").alias("positive_factors"),
                    _bar("risk_factors").alias("risk_factors"))


@query("P21_interpretation")
def p21(t: Tables) -> DataFrame:
    return _confidence(t).select("repo_id", "confidence_level", "interpretation")


# -------------------------------------------------------------------- preview
from treeline.operators import preview as PV  # noqa: E402


@query("U2_affected_files")
def u2(t: Tables) -> DataFrame:
    return PV.affected_files(t.proposals)


@query("J9_after_state")
def j9(t: Tables) -> DataFrame:
    return PV.after_state(t.proposals)


@query("L2_limit_affected")
def l2(t: Tables) -> DataFrame:
    return PV.limit_affected(t.proposals)


@query("T1_tree_nodes")
def t1(t: Tables) -> DataFrame:
    n = PV.tree_nodes(PV.affected_paths(t.proposals), ["repo_id", "side"])
    return n.select("repo_id", "side", "node", "parent", F.col("depth").cast("bigint").alias("depth"),
                    "is_file")


@query("T2_tree_lines")
def t2(t: Tables) -> DataFrame:
    keys = ["repo_id", "side"]
    return PV.tree_lines(PV.tree_nodes(PV.affected_paths(t.proposals), keys), keys).select(
        "repo_id", "side", "line_no", "node", "is_last", "text")


@query("W4_last_sibling")
def w4(t: Tables) -> DataFrame:
    keys = ["repo_id", "side"]
    nodes = PV.tree_nodes(PV.affected_paths(t.proposals), keys)
    return PV.last_siblings(nodes, keys).select("repo_id", "side", "node", "is_last")


@query("T3_tree_diff")
def t3(t: Tables) -> DataFrame:
    return PV.tree_diff(t.proposals)


@query("A11_impact_summary")
def a11(t: Tables) -> DataFrame:
    return PV.impact_summary(t.proposals, RP.repo_ids(t.raw))


@query("A12_new_directories")
def a12(t: Tables) -> DataFrame:
    return PV.new_directories(t.proposals)


@query("L3_first_k_lists")
def l3(t: Tables) -> DataFrame:
    return PV.new_directories_preview(t.proposals)


# ---------------------------------------------------------- apply / rollback
import uuid  # noqa: E402

from treeline.operators import history as HI  # noqa: E402
from treeline.operators import moves as MV  # noqa: E402
from treeline.session import checkpoint_dir, write_table  # noqa: E402

ROLLBACK_N = 10


def _approved(t: Tables) -> DataFrame:
    return MV.with_decisions(t.moves, t.decisions)


def _result_cols(r: DataFrame) -> DataFrame:
    return r.select("repo_id", F.col("ord").cast("bigint").alias("ord"), "action", "source", "target",
                    "success", "skipped", "message")


@query("J11_with_decisions")
def j11(t: Tables) -> DataFrame:
    return _approved(t).select("repo_id", F.col("ord").cast("bigint").alias("ord"), "source",
                               "decision", "approved")


@query("J10_validate_moves")
def j10(t: Tables) -> DataFrame:
    return _result_cols(MV.validate_moves(_approved(t), t.paths))


@query("P22_result_message")
def p22(t: Tables) -> DataFrame:
    dry = MV.validate_moves(_approved(t), t.paths)
    return _result_cols(dry.unionByName(MV.unsupported_results(t.proposals)))


@query("A16_execution_summary")
def a16(t: Tables) -> DataFrame:
    return MV.execution_summary(MV.validate_moves(_approved(t), t.paths), RP.repo_ids(t.raw))


@query("G1_apply_moves")
def g1(t: Tables) -> DataFrame:
    """Sequential real run (rows-only check; brute-force test in tests/)."""
    return _result_cols(MV.apply_moves(_approved(t), t.raw))


@query("G1_new_inventory")
def g1n(t: Tables) -> DataFrame:
    res = MV.apply_moves(_approved(t), t.raw)
    return MV.new_inventory(t.raw, res).select("repo_id", "file_seq", "relative_path")


def _scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("S4_append_history")
def s4(t: Tables) -> DataFrame:
    """Append the history, then append the rollback entries again; both stay. Each run is
    tried twice and counts once."""
    path = _scratch(t, "history")
    h = t.history.withColumn("message", F.lit(None).cast("string"))
    for _ in range(2):
        INV.append_history(h, path, run="apply")
    for _ in range(2):
        INV.append_history(h.filter(F.col("action") == "ROLLBACK"), path, run="rollback")
    return INV.read_history(t.spark, path).drop("message")


@query("S5_read_history")
def s5(t: Tables) -> DataFrame:
    path = _scratch(t, "history")
    INV.append_history(t.history.withColumn("message", F.lit(None).cast("string")), path)
    return INV.read_history(t.spark, path).drop("message")


@query("F12_undoable")
def f12(t: Tables) -> DataFrame:
    return HI.undoable(t.history).select("repo_id", "seq", "action", "source", "target")


@query("W2_last_moves")
def w2(t: Tables) -> DataFrame:
    return HI.last_moves(t.history, ROLLBACK_N).select("repo_id", "seq", "undo_rank", "source",
                                                        "target")


def _rb_cols(r: DataFrame) -> DataFrame:
    return r.select("repo_id", F.col("undone_seq").cast("bigint").alias("undone_seq"), "source",
                    "target", "success", "message", "risk")


@query("W3_fail_fast")
def w3(t: Tables) -> DataFrame:
    return _rb_cols(HI.rollback_dry_run(t.history, t.history_files, None))


@query("G2_rollback_dry_run")
def g2d(t: Tables) -> DataFrame:
    return _rb_cols(HI.rollback_dry_run(t.history, t.history_files, ROLLBACK_N))


@query("G2_rollback")
def g2(t: Tables) -> DataFrame:
    """Sequential real rollback (rows-only check; brute-force test in tests/)."""
    return _rb_cols(HI.rollback(t.history, t.history_files, ROLLBACK_N))


@query("G2_new_inventory")
def g2n(t: Tables) -> DataFrame:
    """The tree that the real rollback leaves (brute-force test in tests/)."""
    res = HI.rollback(t.history, t.history_files, ROLLBACK_N)
    return HI.rolled_back_inventory(t.history_files, res).select("repo_id", "relative_path")


@query("W5_recent_history")
def w5(t: Tables) -> DataFrame:
    return HI.recent_history(t.history).select("repo_id", "seq", "position", "action", "source",
                                               "total_entries")


@query("A17_rollback_summary")
def a17(t: Tables) -> DataFrame:
    return HI.rollback_summary(HI.rollback_dry_run(t.history, t.history_files, ROLLBACK_N))


# --------------------------------------------------------------- tree source
from treeline.sources import fixtures as FX  # noqa: E402
from treeline.sources import trees as TR  # noqa: E402


@query("S1_scan_trees")
def s1(t: Tables) -> DataFrame:
    """List real folders written from the fixture inventory (ignored paths pruned)."""
    folder = _scratch(t, "trees")
    FX.materialize_trees(t.raw, folder)
    s = TR.scan_trees(t.spark, folder)
    return s.select("repo_id", "relative_path", "size", "content")
