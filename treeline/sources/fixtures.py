"""Deterministic inventory fixtures derived from the driver's tables.

The driver's tables hold no file inventory, so one is derived from ``orders``
(and an execution history from ``events``) by SQL text that runs unchanged in
Spark and in DuckDB. The same text is the first CTE of every oracle query, so
both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed fixture text (shared verbatim with the DuckDB oracle).
RAW_FILES_SQL = """
WITH g AS (
  SELECT o_orderkey AS k, o_custkey % 97 AS repo_no,
         (o_orderkey * 7919) % 9973 AS h1, (o_orderkey * 104729) % 7907 AS h2
  FROM orders
), p AS (
  SELECT k, repo_no, h1, h2,
    CASE WHEN k % 11 = 0
      THEN split_part('setup.py|requirements.txt|pyproject.toml|package.json|tsconfig.json|README.md|LICENSE|Dockerfile|go.mod|pom.xml|.gitignore|.env', '|', CAST(1 + h1 % 12 AS INT))
      ELSE split_part('||src/|tests/|src/app/|backup/|docs/|scripts/|data/|lib/|build/|node_modules/x/|environments/|pkg.egg-info/|experiments/|app/templates/', '|', CAST(1 + h1 % 16 AS INT))
        || split_part('app|utils|helpers|test_core|core_test|main|run_job|config|README|index|temp_calc|models|latest|page|layout|__init__|conftest|settings|records|api', '|', CAST(1 + h2 % 20 AS INT))
        || split_part(CASE WHEN repo_no % 4 IN (0, 1) THEN '.py|.py|.py|.py|.md|.yaml|.csv|.py'
                           WHEN repo_no % 4 = 2 THEN '.py|.py|.js|.ts|.py|.md|.html|.log'
                           ELSE '.ts|.tsx|.js|.html|.css|.json|.md|.py' END, '|', CAST(1 + (h1 + h2) % 8 AS INT))
    END AS relative_path
  FROM g
), u AS (
  SELECT repo_no, relative_path, min(k) AS file_seq, min(h2) AS h
  FROM p GROUP BY repo_no, relative_path
)
SELECT 'repo' || lpad(CAST(repo_no AS STRING), 3, '0') AS repo_id, file_seq, relative_path,
  CASE WHEN relative_path LIKE '%.py' THEN
       CASE WHEN h % 2 = 0 THEN 'import os' || chr(10) ELSE '' END
    || CASE WHEN h % 3 = 0 THEN 'from .utils import helper_a, helper_b' || chr(10) ELSE '' END
    || CASE WHEN h % 5 = 0 THEN 'import helpers' || chr(10) ELSE '' END
    || CASE WHEN h % 7 = 0 THEN 'import pytest' || chr(10) ELSE '' END
    || CASE WHEN h % 4 = 1 THEN 'from fastapi import FastAPI' || chr(10) || 'import numpy as np' || chr(10) ELSE '' END
    || CASE WHEN h % 13 = 0 THEN 'import a1, a2, a3, a4, a5, a6, a7, a8, a9, a10, a11' || chr(10) ELSE '' END
    || CASE WHEN h % 6 = 1 THEN 'def test_x():' || chr(10) || '    pass' || chr(10) ELSE '' END
    || CASE WHEN h % 9 = 0 THEN 'if __name__ == "__main__":' || chr(10) || '    pass' || chr(10) ELSE '' END
    || CASE WHEN h % 31 = 0 THEN 'def broken(:' || chr(10) ELSE '' END
  ELSE '' END AS content
FROM u
"""

HISTORY_SQL = """
SELECT 'repo' || lpad(CAST(user_id % 97 AS STRING), 3, '0') AS repo_id, event_id AS seq, ts AS executed_at,
  CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'MOVE' WHEN 'purchase' THEN 'move' WHEN 'signup' THEN 'ROLLBACK' ELSE 'flag' END AS action,
  'f' || CAST(event_id % 50 AS STRING) || '.py' AS source,
  CASE WHEN event_type = 'error' THEN NULL ELSE 'src/f' || CAST(event_id % 50 AS STRING) || '.py' END AS target,
  value >= 5 AS success, event_id % 10 = 0 AS skipped,
  split_part('low|medium|high', '|', CAST(1 + event_id % 3 AS INT)) AS risk
FROM events
"""

HISTORY_FILES_SQL = """
SELECT DISTINCT repo_id, target AS relative_path FROM history WHERE target IS NOT NULL AND seq % 4 <> 0
UNION SELECT DISTINCT repo_id, source FROM history WHERE seq % 7 = 0
"""

GIT_STATUS_SQL = """
SELECT repo_id, file_seq AS line_no, CASE file_seq % 5 WHEN 0 THEN ' M ' || relative_path WHEN 1 THEN '?? ' || relative_path
  WHEN 2 THEN 'R  ' || relative_path || ' -> old/' || relative_path WHEN 3 THEN '   ' || relative_path ELSE 'M' END AS line
FROM inv WHERE file_seq % 9 = 0
"""

GIT_TRACKED_SQL = "SELECT repo_id, relative_path FROM inv WHERE file_seq % 3 <> 0"

REPOS_SQL = ("SELECT DISTINCT repo_id, CAST(substring(repo_id, 5) AS INT) % 5 <> 0 AS is_git "
             "FROM inv")

DECISIONS_SQL = ("SELECT repo_id, relative_path AS source, "
                 "split_part('y|n|yes|no', '|', CAST(1 + file_seq % 4 AS INT)) AS decision FROM inv")

# raw_files with the size column (size = length(content)).
INV_SQL = "SELECT repo_id, file_seq, relative_path, CAST(length(content) AS BIGINT) AS size, content FROM (" \
          + RAW_FILES_SQL + ") raw"

# CTE text for the oracle: name -> SELECT over previously defined names.
ORACLE_FIXTURE_CTES = [
    ("inv", INV_SQL),
    ("history", HISTORY_SQL),
    ("history_files", HISTORY_FILES_SQL),
    ("git_status", GIT_STATUS_SQL),
    ("git_tracked", GIT_TRACKED_SQL),
    ("repos", REPOS_SQL),
    ("decisions", DECISIONS_SQL),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of 97 repositories derived from ``orders``."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spark.sql(INV_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    df = spark.sql(HISTORY_SQL.replace("FROM events", "FROM {events}"), events=events)
    return df.withColumn("executed_at", df["executed_at"].cast("timestamp_ntz"))


def history_files(spark: SparkSession, sf_dir: str, hist: DataFrame | None = None) -> DataFrame:
    hist = hist if hist is not None else history(spark, sf_dir)
    return spark.sql(HISTORY_FILES_SQL.replace("FROM history", "FROM {history}"), history=hist)


def _from_inv(spark: SparkSession, sql: str, inv: DataFrame) -> DataFrame:
    return spark.sql(sql.replace("FROM inv", "FROM {inv}"), inv=inv)


def git_status(spark: SparkSession, inv: DataFrame) -> DataFrame:
    return _from_inv(spark, GIT_STATUS_SQL, inv)


def git_tracked(spark: SparkSession, inv: DataFrame) -> DataFrame:
    return _from_inv(spark, GIT_TRACKED_SQL, inv)


def repos(spark: SparkSession, inv: DataFrame) -> DataFrame:
    return _from_inv(spark, REPOS_SQL, inv)


def decisions(spark: SparkSession, inv: DataFrame) -> DataFrame:
    return _from_inv(spark, DECISIONS_SQL, inv)


def materialize_trees(raw: DataFrame, folder: str) -> None:
    """Write an inventory out as real folders (one per repo_id) for the tree source.

    A Spark job: every task writes its own rows; ``folder`` must be a shared
    POSIX mount on a cluster, as the tree source reads with the file system.
    """
    import os

    from treeline.session import ship_package
    ship_package(raw.sparkSession)

    def write(rows):
        for r in rows:
            full = os.path.join(folder, r["repo_id"], *r["relative_path"].split("/"))
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as fh:
                fh.write(r["content"] or "")

    raw.select("repo_id", "relative_path", "content").foreachPartition(write)
