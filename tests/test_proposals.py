"""Repository type, proposals, duplicates, gating (reference cases)."""

from pyspark.sql import functions as F

from helpers import files_df, raw_df
from treeline.operators import proposals as PR
from treeline.operators import repo as RP


def _type(spark, paths, repo_id="r1"):
    raw = raw_df(spark, paths, repo_id)
    files = files_df(spark, [(p, {}) for p in paths], repo_id)
    return RP.repo_types(files, raw).collect()[0]


def test_repo_type_reference_cases(spark):
    assert _type(spark, ["setup.py", "requirements.txt", "src/app.py", "src/utils.py", "src/models.py",
                         "tests/test_app.py", "tests/test_utils.py", "README.md"])["repo_type"] == "python_dominant"
    assert _type(spark, ["package.json", "angular.json", "tsconfig.json", "src/app/app.component.ts",
                         "src/app/app.component.html", "src/app/app.module.ts",
                         "src/environments/environment.ts", "README.md"])["repo_type"] == "non_python"
    assert _type(spark, ["requirements.txt", "backend/app.py", "backend/models.py", "backend/utils.py",
                         "package.json", "frontend/index.html", "frontend/app.js", "frontend/styles.css",
                         "README.md"])["repo_type"] == "mixed"
    assert _type(spark, ["pyproject.toml", "pkg/a.py", "pkg/b.py", "README.md"])["repo_type"] == "python_dominant"
    ts = [f"src/c{i}.ts" for i in range(25)] + ["tools/a.py", "tools/b.py"]
    row = _type(spark, ts)
    assert row["repo_type"] == "non_python" and row["non_python_score"] == 2


def test_empty_repository_is_non_python(spark):
    raw = raw_df(spark, ["node_modules/x.js"], "empty")
    files = files_df(spark, [], "empty") if False else files_df(spark, [("a.py", {})], "other")
    row = RP.repo_types(files.filter("repo_id = 'empty'"), raw).collect()[0]
    assert row["repo_type"] == "non_python" and row["total_files"] == 0


def _proposals(spark, specs, repo_type="python_dominant"):
    files = files_df(spark, specs)
    types = spark.createDataFrame([("r1", repo_type)], "repo_id string, repo_type string")
    return PR.all_proposals(files, types)


def test_duplicate_groups_by_risk(spark):
    specs = [("setup.py", {}), ("requirements.txt", {}), ("backup/requirements.txt", {}),
             ("README.md", {}), ("docs/README.md", {}), ("app.log", {}), ("logs/app.log", {}),
             ("utils.py", {}), ("backup/utils.py", {}), (".env", {}), ("backup/.env", {})]
    p = _proposals(spark, specs).filter(F.col("phase") == 2).collect()
    risk = {r["source"]: r["risk"] for r in p}
    assert risk == {"requirements.txt": "high", "README.md": "low", "app.log": "low",
                    "utils.py": "medium", ".env": "high"}
    for r in p:
        assert r["details"]["total_count"] == 2
        assert r["reason"].startswith("Duplicate filename: 2 files named")


def test_duplicate_exempt_and_grouping(spark):
    specs = [("a/__init__.py", {}), ("b/__init__.py", {}), ("a/conftest.py", {}), ("b/conftest.py", {}),
             ("x/Utils.py", {}), ("y/utils.py", {}), ("z/UTILS.py", {}), ("w/utils.py", {})]
    p = _proposals(spark, specs).filter(F.col("phase") == 2).collect()
    assert len(p) == 1
    r = p[0]
    assert r["source"] == "x/Utils.py" and r["reason"].endswith("files named 'Utils.py'")
    assert r["details"]["examples"] == ["x/Utils.py", "y/utils.py", "z/UTILS.py"]
    assert r["details"]["remaining"] == "+1 more"


def test_nextjs_suppression_and_mixed_gate(spark):
    specs = [("a/index.tsx", {}), ("b/index.tsx", {}), ("a/page.py", {}), ("b/page.py", {}),
             ("lib/x.py", {"imports": ["a", "b", "c"]})]
    p = _proposals(spark, specs, "mixed").collect()
    assert not [r for r in p if r["action"] == "move"]           # mixed loses every MOVE
    dup = [r for r in p if r["phase"] == 2]
    assert [r["source"] for r in dup] == ["a/page.py"]            # index.tsx suppressed


def test_many_imports_high_risk_and_root_flags(spark):
    specs = [("core.py", {"imports": [f"m{i}" for i in range(15)]}), ("helper.py", {}),
             ("manage.py", {"is_executable": True}), ("setup.py", {})]
    rows = _proposals(spark, specs).collect()
    p = {(r["action"], r["source"]): r for r in rows}
    assert p[("move", "core.py")]["risk"] == "high"
    assert p[("move", "core.py")]["target"] == "src/core.py"
    # a root .py with a MOVE loses its root flag; trash helper.py keeps both flags
    assert ("flag", "core.py") not in p
    helper = sorted(r["reason"] for r in rows if r["source"] == "helper.py")
    assert helper == ["Could not classify - needs manual review", "Python file at repository root"]
    assert [k for k in p if k[1] == "setup.py"] == []           # config at its root target: no-op
    assert [r["phase"] for r in rows if r["source"] == "manage.py"] == [1]   # script move, no root flag


def test_move_reason_texts(spark):
    specs = [("lib/test_a.py", {"has_tests": True, "imports": ["pytest", "os", "mock", "nose"]}),
             ("data.csv", {}), ("notes.rst", {}), ("a/b.yaml", {})]
    p = {r["source"]: r for r in _proposals(spark, specs).collect() if r["action"] == "move"}
    assert p["lib/test_a.py"]["reason"] == (
        "Contains test functions or test classes (pytest/unittest pattern detected). "
        "Imports testing frameworks: pytest, mock. Follows test file naming convention. "
        "Currently located in lib, should be in tests/ directory.")
    assert p["lib/test_a.py"]["target"] == "tests/lib/test_a.py"
    assert p["data.csv"]["reason"] == "Data file: CSV data. Data files should be organized in data/ directory."
    assert p["notes.rst"]["reason"] == "Classified as docs based on file analysis."
    assert p["a/b.yaml"]["reason"] == ("Configuration file: YAML configuration. "
                                       "Should be organized in configs/ directory.")
    assert p["a/b.yaml"]["risk"] == "medium"


def test_repositories_without_files_or_results_count_zero(spark):
    from treeline.operators import moves as MV
    from treeline.operators import repo as RP
    from treeline.plans import entrypoints as EP
    raw = spark.createDataFrame(
        [("a", 1, "src/x.py", 1, "import os"), ("empty", 1, "node_modules/y.js", 1, None)],
        "repo_id string, file_seq long, relative_path string, size long, content string")
    p = EP.propose(raw)
    assert {tuple(r) for r in p.summary.collect()} == {("a", 1, 1, 0, 0), ("empty", 0, 0, 0, 0)}
    counts = {r.repo_id: sum(list(r)[1:]) for r in RP.category_counts(p.files, RP.repo_ids(raw)).collect()}
    assert counts == {"a": 1, "empty": 0}
    done = EP.apply(p, None, approve_all=True)
    assert {r.repo_id for r in done.summary.collect()} == {"a", "empty"}
    assert [tuple(r)[1:] for r in done.summary.filter("repo_id = 'empty'").collect()] == [(0, 0, 0, 0)]
    assert MV.execution_summary(done.results).filter("repo_id = 'empty'").count() == 0
