"""Rule tests: the reference's own cases, as rows of small DataFrames."""

from pyspark.sql import functions as F

from helpers import categories, ignored_col
from treeline.functions import rules as R
from treeline.sources.trees import ignored as ignored_py

IGNORED = [
    "venv/script.py", "test.pyc", "venv_new/lib/script.py", "my_venv/script.py", ".venv/script.py",
    "venv_new/Lib/site-packages/torch/nn.py", "lib/site-packages/numpy/core.py",
    "node_modules/react/index.js", "frontend/node_modules/package.json", "build/output.js",
    "dist/bundle.js", ".env", ".gitignore", "environments/x.py", "builder/x.py",
    "distributed/a.py", ".github/workflows/ci.yml", "pkg.egg-info/x.py", "Thumbs.db",
    "a.txt~", "src/__pycache__/m.cpython.pyc", ".next/page.js", "out/index.html", "coverage/x.json",
    "lib.so/x.py", "environment",
]
KEPT = [
    "app.py", "environment.py", "convention.py", ".DS_Store", "src/app.py", "src/environment.py",
    "README.md", "foo~", "Build/x.py".lower().replace("build", "bld"), "public/x.js", "static/chunks.js",
    "PKG.EGG-INFO.txt",
]


def test_ignore_rule_cases(spark):
    got = ignored_col(spark, IGNORED + KEPT)
    for p in IGNORED:
        assert got[p], p
    for p in KEPT:
        assert not got[p], p


def test_ignore_rule_column_equals_python_form(spark):
    paths = IGNORED + KEPT + ["a/b.pyc/c.py", "x/.env/y.py", "x/ENV/y", "x/Env.py", "deep/a/b/c/d.txt"]
    got = ignored_col(spark, paths)
    for p in paths:
        assert got[p] == ignored_py(p.split("/")), p


def test_suffix_rule(spark):
    df = spark.createDataFrame([(n,) for n in [".env", "foo.", "a.b.c", "..foo", "x", "a.py"]], "n string")
    got = {r["n"]: r["e"] for r in df.select("n", R.path_columns(F.col("n"))["extension"].alias("e")).collect()}
    assert got == {".env": "", "foo.": "", "a.b.c": ".c", "..foo": ".foo", "x": "", "a.py": ".py"}


def test_classifier_reference_cases(spark):
    cats = categories(spark, [
        ("README.md", {}), ("setup.py", {}), ("requirements.txt", {}), ("pyproject.toml", {}),
        ("config.yaml", {}), ("data.csv", {}), ("data.json", {}), ("data.sqlite", {}), ("data.pkl", {}),
        ("test_something.py", {}), ("foo.py", {"has_tests": True}),
        ("test_runner.py", {"imports": ["pytest", "unittest"]}),
        ("run_app.py", {"is_executable": True}), ("main_script.py", {}),
        ("temp_test.py", {}), ("experiment_1.py", {}), ("playground.py", {}), ("scratch.py", {}),
        ("api.py", {"imports": ["fastapi", "pydantic", "sqlalchemy"]}),
        ("x/test_api.py", {"imports": ["fastapi", "pytest"], "has_tests": True}),
    ])
    assert cats["README.md"] == "markdown"
    for f in ["setup.py", "requirements.txt", "pyproject.toml", "config.yaml"]:
        assert cats[f] == "configs", f
    for f in ["data.csv", "data.json", "data.sqlite", "data.pkl"]:
        assert cats[f] == "data", f
    for f in ["test_something.py", "foo.py", "test_runner.py", "x/test_api.py"]:
        assert cats[f] == "tests", f
    assert cats["run_app.py"] == "scripts" and cats["main_script.py"] == "scripts"
    for f in ["temp_test.py", "experiment_1.py", "playground.py", "scratch.py"]:
        assert cats[f] == "experiments", f
    assert cats["api.py"] == "src"


def test_classifier_traps(spark):
    cats = categories(spark, [
        ("app/template.py", {}),          # 'temp' in a segment -> experiments
        ("latest.py", {}),                # 'test' in the name -> tests
        ("lib/mod.py", {"imports": ["unittest.mock"]}),   # not an exact test import
        ("lib/pkgmod.py", {"in_package": True}),
        ("lib/three.py", {"imports": ["a", "b", "c"]}),
        ("lib/two.py", {"imports": ["a", "b"]}),
        ("src/x.py", {}), ("scripts/job.py", {}), ("lib/my_settings.py", {}),
        ("notes.txt", {}), ("weird.bin", {}), ("Dockerfile", {}),
    ])
    assert cats["app/template.py"] == "experiments"
    assert cats["latest.py"] == "tests"
    assert cats["lib/mod.py"] == "trash"
    assert cats["lib/pkgmod.py"] == "src"
    assert cats["lib/three.py"] == "src"
    assert cats["lib/two.py"] == "trash"
    assert cats["src/x.py"] == "src"
    assert cats["scripts/job.py"] == "scripts"
    assert cats["lib/my_settings.py"] == "configs"
    assert cats["notes.txt"] == "docs"
    assert cats["weird.bin"] == "unknown"
    assert cats["Dockerfile"] == "configs"


def test_display_group(spark):
    cases = {"requirements.txt": "Dependencies", "a/description.md": "Documentation",
             "a/description.py": "Scripts", "src/x.py": "Other", "a/src/x.py": "Source Code",
             ".env": "Configuration", "x/app_settings.yaml": "Configuration", "app.log": "Logs & Artifacts",
             "tests/a.py": "Tests", "LICENSE": "Documentation", "x/y.csv": "Other"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["g"] for r in df.select("s", R.display_group(F.col("s")).alias("g")).collect()}
    assert got == cases


def test_ignore_rule_three_ways_on_random_paths(spark):
    """Column rule, DuckDB oracle rule and the tree source's Python rule agree."""
    import random

    import duckdb

    import duck_oracle as O
    segs = [".env", "build", "x.pyc", "foo~", "a.egg-info", "ENV", "out", "static", "chunks", ".DS_Store",
            "Thumbs.db", "src", "environment.py", "my_venv", "lib.so", "app.py", "README", ".github", "Out",
            "dist2", "node_modules", "_next", "a.b.c", "..x", "foo.", "coverage", "x.swp", "public"]
    rng = random.Random(3)
    paths = sorted({"/".join(rng.choice(segs) for _ in range(rng.randint(1, 4))) for _ in range(600)})
    col = ignored_col(spark, paths)
    con = duckdb.connect()
    con.execute("CREATE TABLE inv AS SELECT 'r' AS repo_id, CAST(i AS BIGINT) AS file_seq, p AS relative_path, "
                "CAST(0 AS BIGINT) AS size, '' AS content FROM (SELECT unnest(?) AS p, "
                "generate_subscripts(?, 1) AS i)", [paths, paths])
    kept_sql = O.layers("kept").replace("WITH inv AS (", "WITH inv_unused AS (", 1) + \
        "SELECT relative_path FROM kept"
    kept = {r[0] for r in con.execute(kept_sql).fetchall()}
    assert 50 < len(kept) < len(paths) - 50 and kept <= set(paths)     # both outcomes well covered
    for p in paths:
        assert col[p] == ignored_py(p.split("/")), p
        assert col[p] == (p not in kept), p


def test_classifier_spark_and_oracle_agree_on_random_trees(spark):
    import random

    import duckdb

    import duck_oracle as O
    from helpers import RAW_SCHEMA
    from treeline.operators import files as FL
    dirs = ["", "src/", "tests/", "lib/", "scripts/", "app/", "temp_x/", "pkg/", "docs/", "a/b/", "build/"]
    stems = ["app", "utils", "test_core", "core_test", "run_job", "config", "my_settings", "latest",
             "__init__", "demo_x", "setup", "models", "README", "index", "playground", "conftest"]
    exts = [".py", ".py", ".py", ".md", ".json", ".yaml", ".csv", ".txt", ".html", ".toml", ""]
    lines = ["import os", "from .utils import helper_a, helper_b", "import helpers", "import pytest",
             "from fastapi import FastAPI", "import numpy as np", "import a1, a2, a3",
             "def test_x():\n    pass", 'if __name__ == "__main__":\n    pass', "import unittest", "x = 1"]
    rng = random.Random(5)
    rows, seq = [], 0
    for repo in ("r1", "r2", "r3"):
        paths = {rng.choice(dirs) + rng.choice(stems) + rng.choice(exts) for _ in range(60)}
        for p in sorted(paths):
            text = "\n".join(rng.sample(lines, rng.randint(0, 4))) + "\n" if p.endswith(".py") else ""
            rows.append((repo, seq, p, len(text), text))
            seq += 1
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    got = {(r["repo_id"], r["relative_path"]): r["category"]
           for r in FL.build_files(raw).select("repo_id", "relative_path", "category").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE inv (repo_id VARCHAR, file_seq BIGINT, relative_path VARCHAR, size BIGINT, "
                "content VARCHAR)")
    con.executemany("INSERT INTO inv VALUES (?, ?, ?, ?, ?)", rows)
    sql = O.layers("classified").replace("WITH inv AS (", "WITH inv_unused AS (", 1) + \
        "SELECT repo_id, relative_path, category FROM classified"
    want = {(r[0], r[1]): r[2] for r in con.execute(sql).fetchall()}
    assert len(got) > 100 and len(set(got.values())) >= 8
    assert got == want


def test_proposals_spark_and_oracle_agree_on_random_trees(spark):
    import random

    import duckdb

    import duck_oracle as O
    from helpers import RAW_SCHEMA
    from treeline.operators import files as FL
    from treeline.operators import proposals as PR
    from treeline.operators import repo as RP
    dirs = ["", "src/", "tests/", "lib/", "scripts/", "app/", "docs/", "a/b/", "data/", "configs/", "x/"]
    stems = ["app", "utils", "test_core", "core_test", "run_job", "config", "my_settings", "latest",
             "__init__", "setup", "models", "README", "index", "notes", "requirements", "page"]
    lines = ["import os", "from .utils import helper_a", "import helpers", "import pytest",
             "from fastapi import FastAPI", "import a1, a2, a3, a4, a5, a6, a7, a8, a9, a10, a11",
             "def test_x():\n    pass", 'if __name__ == "__main__":\n    pass']
    rng = random.Random(9)
    rows, seq = [], 0
    for repo, py_share in (("r1", 0.8), ("r2", 0.7), ("r3", 0.4), ("r4", 0.1), ("r5", 0.9)):
        paths = set()
        for _ in range(70):
            ext = ".py" if rng.random() < py_share else rng.choice([".md", ".json", ".ts", ".txt", ".csv",
                                                                   ".log", ".yaml", ".tsx"])
            paths.add(rng.choice(dirs) + rng.choice(stems) + ext)
        if repo in ("r1", "r5"):
            paths |= {"setup.py", "requirements.txt"}
        for p in sorted(paths):
            text = "\n".join(rng.sample(lines, rng.randint(0, 3))) + "\n" if p.endswith(".py") else ""
            rows.append((repo, seq, p, len(text), text))
            seq += 1
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    files = FL.build_files(raw)
    types = RP.repo_types(files, raw)
    cols = ["repo_id", "phase", "ord", "action", "source", "target", "reason", "risk", "category",
            "current_location", "suggestion", "total_count", "examples", "remaining"]
    got = sorted(tuple(r) for r in PR.flat(PR.all_proposals(files, types)).select(*cols).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE inv (repo_id VARCHAR, file_seq BIGINT, relative_path VARCHAR, size BIGINT, "
                "content VARCHAR)")
    con.executemany("INSERT INTO inv VALUES (?, ?, ?, ?, ?)", rows)
    sql = O.ORACLE["U1_all_proposals"].replace("WITH inv AS (", "WITH inv_unused AS (", 1)
    want = sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    kinds = {(r[3], r[1]) for r in got}
    assert len(got) > 80 and {("move", 1), ("flag", 1), ("flag", 2), ("flag", 3)} <= kinds
    assert got == want
