"""Version-control tables (P20, J8, A15) and history views."""

from pyspark.sql import functions as F

from treeline.operators import gitinfo as GI
from treeline.operators import history as HI
from treeline.operators import moves as MV


def _props(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, phase int, ord bigint, action string, "
                                       "source string, target string")


def test_parse_git_status_lines(spark):
    status = spark.createDataFrame(
        [("g", 1, " M mod.py"), ("g", 2, "?? uncommitted_file.py"), ("g", 3, "R  a.py -> b.py"),
         ("g", 4, "   clean.py"), ("g", 5, "M"), ("g", 6, "A  added.py  "), ("n", 1, "?? x.py")],
        "repo_id string, line_no bigint, line string")
    repos = spark.createDataFrame([("g", True), ("n", False)], "repo_id string, is_git boolean")
    got = [(r["line_no"], r["path"]) for r in GI.parse_git_status(status, repos).orderBy("line_no").collect()]
    assert got == [(1, "mod.py"), (2, "uncommitted_file.py"), (3, "a.py -> b.py"), (6, "added.py")]


def test_git_warnings_only_moves_and_first_five(spark):
    repos = spark.createDataFrame([("g", True), ("n", False)], "repo_id string, is_git boolean")
    props = _props(spark, [("g", 1, i, "move", f"f{i}.py", f"src/f{i}.py") for i in range(7)]
                   + [("g", 2, 100, "flag", "tracked_flag.py", None), ("n", 1, 1, "move", "a.py", "src/a.py")])
    tracked = spark.createDataFrame([("g", f"f{i}.py") for i in range(7)] + [("g", "tracked_flag.py"),
                                    ("n", "a.py")], "repo_id string, relative_path string")
    status = spark.createDataFrame([("g", i, f"?? u{i}.py") for i in range(8)],
                                   "repo_id string, line_no bigint, line string")
    w = {(r["repo_id"], r["warning_type"]): r for r in
         GI.git_warnings(props, status, tracked, repos).collect()}
    assert set(w) == {("g", "uncommitted"), ("g", "tracked_files")}      # nothing for the non-git repo
    assert w[("g", "tracked_files")]["message"] == "7 files to move are Git-tracked"
    assert w[("g", "tracked_files")]["details"] == [f"f{i}.py" for i in range(5)]
    assert w[("g", "uncommitted")]["details"] == [f"u{i}.py" for i in range(5)]
    assert w[("g", "uncommitted")]["total"] == 8


def test_history_view_and_summaries(spark):
    hist = spark.createDataFrame([("r", i, "move", i % 3 != 0, i % 5 == 0) for i in range(1, 31)],
                                 "repo_id string, seq bigint, action string, success boolean, skipped boolean")
    view = HI.recent_history(hist, 20).orderBy("position").collect()
    assert [r["seq"] for r in view] == list(range(30, 10, -1)) and view[0]["total_entries"] == 30
    results = spark.createDataFrame(
        [("r", True, False), ("r", False, False), ("r", False, True), ("r", True, False)],
        "repo_id string, success boolean, skipped boolean")
    s = MV.execution_summary(results).collect()[0]
    assert (s["total"], s["successful"], s["failed"], s["skipped"]) == (4, 2, 1, 1)
    rb = HI.rollback_summary(results.select("repo_id", "success")).collect()[0]
    assert (rb["total"], rb["successful"], rb["failed"]) == (4, 2, 2)


def test_fail_fast_keeps_through_first_failure(spark):
    res = spark.createDataFrame([("r", 9, True), ("r", 8, True), ("r", 7, False), ("r", 6, True),
                                 ("s", 3, True)], "repo_id string, seq bigint, success boolean")
    kept = sorted((r["repo_id"], r["seq"]) for r in HI.fail_fast(res).collect())
    assert kept == [("r", 7), ("r", 8), ("r", 9), ("s", 3)]
