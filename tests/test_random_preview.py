"""Randomized agreement of Spark and the SQL oracle on warnings and tree drawings."""

import random

import duckdb

import duck_oracle as O
from helpers import RAW_SCHEMA
from treeline.operators import files as FL
from treeline.operators import imports as IM
from treeline.operators import preview as PV
from treeline.operators import proposals as PR
from treeline.operators import repo as RP


def _random_repos(seed):
    dirs = ["", "src/", "lib/", "lib/sub/", "app/", "a/b/", "tools/", "pkg/", "pkg/inner/"]
    stems = ["app", "utils", "helpers", "core", "models", "main", "config", "api", "db", "views",
             "__init__", "run_job", "test_core", "records", "page"]
    lines = ["import os", "from .utils import helper_a", "from ..helpers import h", "from . import models",
             "import helpers", "import utils.sub", "from models import M", "import core",
             "from fastapi import FastAPI", "import a1, a2, a3", 'if __name__ == "__main__":\n    pass']
    rng = random.Random(seed)
    rows, seq = [], 0
    for repo in ("repo001", "repo002", "repo005"):
        paths = {rng.choice(dirs) + rng.choice(stems) + rng.choice([".py", ".py", ".py", ".md", ".csv"])
                 for _ in range(90)} | {"setup.py", "requirements.txt"}
        for p in sorted(paths):
            text = "\n".join(rng.sample(lines, rng.randint(0, 4))) + "\n" if p.endswith(".py") else ""
            rows.append((repo, seq, p, len(text), text))
            seq += 1
    return rows


def _duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE inv (repo_id VARCHAR, file_seq BIGINT, relative_path VARCHAR, size BIGINT, "
                "content VARCHAR)")
    con.executemany("INSERT INTO inv VALUES (?, ?, ?, ?, ?)", rows)
    return con


def _oracle(con, name):
    sql = O.ORACLE[name].replace("WITH inv AS (", "WITH inv_unused AS (", 1)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, sorted(tuple(r) for r in rel.fetchall())


def test_warnings_and_trees_agree_on_random_repos(spark):
    for seed in (1, 2):
        rows = _random_repos(seed)
        raw = spark.createDataFrame(rows, RAW_SCHEMA)
        files = FL.build_files(raw).checkpoint(eager=True)
        types = RP.repo_types(files, raw)
        props = PR.all_proposals(files, types).checkpoint(eager=True)
        moves = props.filter("action = 'move'")
        con = _duck(rows)

        cols, want = _oracle(con, "J7_import_warnings")
        w = IM.import_warnings(moves, files, raw)
        from pyspark.sql import functions as F
        got_df = w.select("repo_id", F.col("move_ord").cast("bigint").alias("move_ord"), "source",
                          F.col("stmt_no").cast("bigint").alias("stmt_no"), "kind",
                          F.col("line_number").cast("bigint").alias("line_number"), "import_text", "reason",
                          F.array_join("affected", "|").alias("affected"))
        got = sorted(tuple(r) for r in got_df.select(*cols).collect())
        assert len(got) > 10 and {r[cols.index("kind")] for r in got} == {"relative", "sibling"}
        assert got == want

        cols, want = _oracle(con, "T3_tree_diff")
        got = sorted(tuple(r) for r in PV.tree_diff(props).select(*cols).collect())
        assert len(got) > 50
        assert got == want


def test_confidence_and_git_agree_on_random_repos(spark):
    from pyspark.sql import functions as F

    from treeline.operators import confidence as CF
    from treeline.operators import gitinfo as GI
    from treeline.sources import fixtures as fx
    rows = _random_repos(3)
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    files = FL.build_files(raw).checkpoint(eager=True)
    types = RP.repo_types(files, raw)
    props = PR.all_proposals(files, types).checkpoint(eager=True)
    moves = props.filter("action = 'move'")
    con = _duck(rows)

    warn = IM.warning_counts(IM.import_warnings(moves, files, raw), RP.repo_ids(raw))
    conf = CF.confidence(types, RP.repo_summary(files), props, warn)
    cols, want = _oracle(con, "A14_confidence_factors")
    got = sorted(tuple(r) for r in conf.select(
        "repo_id", F.array_join("positive_factors", "|").alias("positive_factors"),
        F.array_join("risk_factors", "|").alias("risk_factors")).select(*cols).collect())
    assert got == want

    g = GI.git_warnings(moves, fx.git_status(spark, raw), fx.git_tracked(spark, raw), fx.repos(spark, raw))
    cols, want = _oracle(con, "A15_git_warnings")
    got = sorted(tuple(r) for r in g.withColumn("details", F.array_join("details", "|")).select(*cols).collect())
    assert got == want


def test_reports_agree_on_random_repos(spark):
    from pyspark.sql import functions as F

    from treeline.operators import reports as RE
    rows = _random_repos(4)
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    files = FL.build_files(raw)
    props = PR.all_proposals(files, RP.repo_types(files, raw)).checkpoint(eager=True)
    con = _duck(rows)
    checks = {
        "A9_proposal_rollup": RE.proposal_rollup(props),
        "A10_proposals_document": RE.proposals_document(props),
        "W1_proposal_numbers": RE.proposal_numbers(props).select(
            "repo_id", "phase", F.col("ord").cast("bigint").alias("ord"), "display_group", "number"),
        "P19_proposal_text": RE.proposal_text(props).withColumn("ord", F.col("ord").cast("bigint")),
    }
    for name, df in checks.items():
        cols, want = _oracle(con, name)
        got = sorted(tuple(r) for r in df.select(*cols).collect())
        assert len(got) >= 3 and got == want, name
