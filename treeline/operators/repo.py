"""Per-repository aggregates: summary, extensions, scores, repository type.

All are ``groupBy(repo_id)`` with partial (map-side) aggregation, so a
monorepo holding a third of all rows costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K


def _ext_or_none() -> F.Column:
    return F.when(F.col("extension") == "", F.lit("no_extension")).otherwise(F.col("extension"))


def repo_ids(raw: DataFrame) -> DataFrame:
    """Every repository of the inventory, also those whose files are all ignored."""
    return raw.select("repo_id").distinct()


def with_all_repos(per_repo: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Counts per repository, with zeros for those of ``repos`` (repo_id) that have no row."""
    if repos is None:
        return per_repo
    return repos.select("repo_id").join(per_repo, "repo_id", "left").na.fill(0)


def repo_summary(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A1; with ``repos`` also for repositories whose files are all ignored."""
    return with_all_repos(files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("extension") == ".py").alias("python_files"),
        F.count_if(F.col("is_executable")).alias("executables"),
        F.count_if(F.col("has_tests")).alias("test_files"),
    ), repos)


def extension_histogram(files: DataFrame) -> DataFrame:
    """A2: (repo_id, extension, file_count); '' is reported as 'no_extension'."""
    return files.groupBy("repo_id", _ext_or_none().alias("extension")).agg(
        F.count(F.lit(1)).alias("file_count"))


def top_extensions(files: DataFrame) -> DataFrame:
    """L1: extensions by count desc (extension asc breaks ties), ranked per repo.

    Ranked with the distributed numbering: generated files with hash-like
    suffixes can give one repository a very long histogram.
    """
    from treeline.operators.ordering import number_within
    hist = extension_histogram(files)
    return number_within(hist, ["repo_id"], [F.col("file_count").desc(), F.col("extension")],
                         name="rank")


def _root_in(names) -> F.Column:
    return F.count_if((F.col("depth") == 1) & F.col("name").isin(*names))


def repo_types(files: DataFrame, raw: DataFrame) -> DataFrame:
    """A4 python_score, A5 non_python_score, A6 repo_type (+ U3 root indicators).

    Root names are unique per repository (paths are unique), so a conditional
    count equals the set intersection size of the reference.
    """
    agg = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("extension") == ".py").alias("py_files"),
        _root_in(K.PYTHON_ROOT_FILES).alias("python_root_count"),
        _root_in(K.FRONTEND_ROOT_FILES).alias("frontend_root_count"),
        _root_in(K.JAVA_ROOT_FILES).alias("java_root_count"),
        _root_in(K.GO_ROOT_FILES).alias("go_root_count"),
        _root_in(K.RUBY_ROOT_FILES).alias("ruby_root_count"),
        F.count_if(F.col("extension").isin(*K.DOTNET_EXTENSIONS)).alias("dotnet_files"),
        F.count_if(F.col("extension").isin(*K.TS_JS_EXTENSIONS)).alias("ts_js_files"),
    )
    # repositories without any kept file are empty trees -> non_python
    all_repos = repo_ids(raw)
    t = all_repos.join(agg, "repo_id", "left").na.fill(0)
    py = F.col("py_files")
    py_pct = F.col("py_files").cast("double") / F.greatest(F.col("total_files"), F.lit(1)).cast("double") * 100.0
    python_score = (F.col("python_root_count") * 2
                    + F.when(py > 10, 3).when(py > 5, 2).when(py > 0, 1).otherwise(0))
    ts = F.col("ts_js_files")
    non_python_score = (F.when(F.col("frontend_root_count") > 0, 3).otherwise(0)
                        + F.when(F.col("java_root_count") > 0, 3).otherwise(0)
                        + F.when(F.col("go_root_count") > 0, 3).otherwise(0)
                        + F.when(F.col("ruby_root_count") > 0, 3).otherwise(0)
                        + F.when(F.col("dotnet_files") > 0, 3).otherwise(0)
                        + F.when(ts > 20, 2).when(ts > 10, 1).otherwise(0))
    t = t.withColumns({
        "py_percentage": py_pct,
        "python_score": python_score.cast("bigint"),
        "non_python_score": non_python_score.cast("bigint"),
    })
    repo_type = (F.when((F.col("python_score") >= 3) & (F.col("py_percentage") >= 50), "python_dominant")
                 .when((F.col("non_python_score") >= 2) & (F.col("py_percentage") < 20), "non_python")
                 .when(F.col("py_percentage") >= 30, "mixed")
                 .otherwise("non_python"))
    return t.withColumn("repo_type", repo_type).select(
        "repo_id", F.col("total_files").cast("bigint").alias("total_files"),
        F.col("py_files").cast("bigint").alias("py_files"), "py_percentage",
        "python_score", "non_python_score", "repo_type")


def detection_summary(files: DataFrame) -> DataFrame:
    """A7 as a long table (repo_id, kind, value, n).

    kinds: ``extension`` (count per extension), ``root_file``,
    ``python_root_file`` and ``frontend_root_file`` (n = 1). Kept long so no
    repository's list is ever gathered into one row.
    """
    ext = extension_histogram(files).select(
        "repo_id", F.lit("extension").alias("kind"), F.col("extension").alias("value"),
        F.col("file_count").alias("n"))
    root = files.filter(F.col("depth") == 1).select("repo_id", "name")
    kinds = F.array(
        F.lit("root_file"),
        F.when(F.col("name").isin(*K.PYTHON_ROOT_FILES), F.lit("python_root_file")),
        F.when(F.col("name").isin(*K.FRONTEND_ROOT_FILES), F.lit("frontend_root_file")),
    )
    roots = (root.select("repo_id", F.explode(F.array_compact(kinds)).alias("kind"),
                         F.col("name").alias("value"))
             .distinct().withColumn("n", F.lit(1).cast("bigint")))
    return ext.unionByName(roots)


def category_counts(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A3: all ten categories per repository, zero included; ``repos`` as in A1."""
    return with_all_repos(files.groupBy("repo_id").pivot("category", K.CATEGORIES).count()
                          .na.fill(0, K.CATEGORIES), repos)


def root_indicators(files: DataFrame) -> DataFrame:
    """Root names that are in the fixed indicator lists (bounded by the lists)."""
    root = files.filter(F.col("depth") == 1)

    def names_in(lst):
        return F.array_join(F.array_sort(F.collect_set(
            F.when(F.col("name").isin(*lst), F.col("name")))), "|")
    return root.groupBy("repo_id").agg(
        names_in(K.PYTHON_ROOT_FILES).alias("python_root_files"),
        names_in(K.FRONTEND_ROOT_FILES).alias("frontend_root_files"),
        names_in(K.JAVA_ROOT_FILES + K.GO_ROOT_FILES + K.RUBY_ROOT_FILES).alias("other_root_files"))
