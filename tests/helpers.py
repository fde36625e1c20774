"""Small hand-made inventories, the way the reference's tests build them."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import rules as R
from treeline.operators import files as FL

RAW_SCHEMA = "repo_id string, file_seq bigint, relative_path string, size bigint, content string"


def raw_df(spark, paths, repo_id="r1", contents=None):
    """Inventory rows in the given order (file_seq = position)."""
    contents = contents or {}
    rows = [(repo_id, i, p, len(contents.get(p, "")), contents.get(p, "")) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def files_df(spark, specs, repo_id="r1"):
    """``files`` rows with overridden facts, skipping the scan filter.

    specs: list of (relative_path, dict of overrides among imports, has_tests,
    is_executable, in_package).
    """
    rows = []
    for i, (path, kw) in enumerate(specs):
        rows.append((repo_id, i, path, 0, kw.get("imports", []), kw.get("has_tests", False),
                     kw.get("is_executable", False), kw.get("in_package", False),
                     kw.get("has_main", False)))
    df = spark.createDataFrame(rows, "repo_id string, file_seq bigint, relative_path string, size bigint, "
                                     "imports array<string>, has_tests boolean, is_executable boolean, "
                                     "in_package boolean, has_main boolean")
    df = FL.with_path_parts(df).withColumn("content_sample", F.lit(""))
    df = df.withColumn("stmts", F.array().cast(
        "array<struct<module:string,is_relative:boolean,level:int,line_number:int,names:array<string>>>"))
    return FL.classify(df)


def categories(spark, specs):
    return {r["relative_path"]: r["category"] for r in files_df(spark, specs).collect()}


def ignored_col(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return {r["p"]: r["i"] for r in df.select("p", R.is_ignored(F.split("p", "/")).alias("i")).collect()}
