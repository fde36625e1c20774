"""Table ``files``: what survives the scan filter, with path and Python facts.

raw_files(repo_id, file_seq, relative_path, size, content)
  -> F1 not_ignored -> P1 path_parts -> P3 python_facts -> P2 name_flags
  -> J1 in_package -> P4 classify
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import rules as R
from treeline.operators.facts import python_facts

FILE_RECORD_COLUMNS = ["repo_id", "relative_path", "name", "extension", "size", "imports",
                       "is_executable", "has_main", "has_tests"]


def with_path_parts(df: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """P1."""
    return df.withColumns(R.path_columns(F.col(path_col)))


def not_ignored(raw: DataFrame) -> DataFrame:
    """drop vendored, build and cache paths (relative path only)."""
    return raw.filter(~R.is_ignored(F.split(F.col("relative_path"), "/")))


def glob_hits(raw: DataFrame, paths: DataFrame, patterns: list[str]) -> DataFrame:
    """(repo_id, relative_path, segment, pattern) of every path segment that a pattern fits.

    The patterns are tested on a dictionary, the distinct names of the path index (each file and
    directory stands there once), all in one row; only the names that fit meet the segments
    of the paths, which are exploded once.
    """
    name = F.element_at(F.split("path", "/"), -1)
    fits = F.array_compact(F.array(*[F.when(R.glob_match(F.col("segment"), p), F.lit(p)) for p in patterns]))
    known = paths.select(name.alias("segment")).distinct().select("segment", F.explode(fits).alias("pattern"))
    segments = raw.select("repo_id", "relative_path", F.explode(
        F.array_distinct(F.split("relative_path", "/"))).alias("segment"))
    return segments.join(known, "segment").select("repo_id", "relative_path", "segment", "pattern")


def describe(raw: DataFrame) -> DataFrame:
    """F1 + P1 + P3 + P2 over an inventory. ``content`` is dropped here.

    Only ``.py`` text goes through the Python parse; every other row crosses
    with a null content, and the 500-character sample is cut JVM-side.
    """
    kept = not_ignored(raw)
    is_py = R.path_columns(F.col("relative_path"))["extension"] == ".py"
    text_ok = F.col("text_ok") if "text_ok" in raw.columns else F.lit(None).cast("boolean")
    pre = kept.select(
        "repo_id", "file_seq", "relative_path", "size",
        F.when(is_py, F.substring("content", 1, 500)).otherwise(F.lit("")).alias("content_sample"),
        F.when(is_py, F.col("content")).alias("content"),
        F.coalesce(text_ok, F.lit(True)).alias("text_ok"),
    )
    facts = python_facts(pre)
    out = with_path_parts(facts)
    return (out
            .withColumn("has_main", F.col("ast_main"))
            .withColumn("is_executable", F.col("ast_main") | R.name_is_executable(F.col("name")))
            .withColumn("has_tests", F.col("ast_tests") | R.name_has_tests(F.col("name")))
            .drop("ast_main", "ast_tests"))


def package_dirs(tree: DataFrame) -> DataFrame:
    """Directories that hold an ``__init__.py`` in ``tree`` (repo_id, relative_path)."""
    p = R.path_columns(F.col("relative_path"))
    return (tree.filter(p["name"] == "__init__.py")
            .select("repo_id", p["parent"].alias("parent"))
            .distinct())


def with_in_package(files: DataFrame, tree: DataFrame) -> DataFrame:
    """The file's directory (depth > 1) holds ``__init__.py`` on disk.

    ``tree`` is the inventory (Parquet-backed; only ``relative_path`` is read),
    not the parsed files: reading the parse output twice would run it twice.
    """
    pk = package_dirs(tree).withColumn("pkg", F.lit(True))
    joined = files.join(pk, ["repo_id", "parent"], "left")
    return joined.withColumn(
        "in_package", (F.col("depth") > 1) & F.coalesce(F.col("pkg"), F.lit(False))).drop("pkg")


def classify(files: DataFrame) -> DataFrame:
    """P4 (needs J1's ``in_package``)."""
    return files.withColumn("category", R.classify())


def build_files(raw: DataFrame) -> DataFrame:
    """The analysed, classified inventory (E1 stages scan + describe + classify).

    ``raw`` should be file-backed: it is read twice (the parse, and the paths
    alone for the package directories).
    """
    return classify(with_in_package(describe(raw), raw))


def file_records(files: DataFrame) -> DataFrame:
    """The nine public fields of a file (no content sample)."""
    return files.select(*FILE_RECORD_COLUMNS)
