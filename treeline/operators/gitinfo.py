"""E2 version-control warnings from tables.

The reference runs ``git status`` / ``git ls-files`` per file; here the
version-control state arrives as tables (``repos``, ``git_status`` lines,
``git_tracked`` paths) and the checks become a parse, two semi joins and a
grouped count with a first-5 list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions.text import fmt
from treeline.operators.ordering import first_k

_WS = r"^\s+|\s+$"


def parse_git_status(git_status: DataFrame, repos: DataFrame) -> DataFrame:
    """P20: porcelain line -> path; short lines and blank status are dropped.

    Only repositories with a version-control folder count.
    """
    git = repos.filter(F.col("is_git")).select("repo_id")
    s = git_status.join(git, "repo_id", "left_semi")
    status = F.substring("line", 1, 2)
    return (s.filter(F.length("line") >= 4)
            .filter(F.regexp_replace(status, _WS, "") != "")
            .select("repo_id", "line_no", status.alias("status"),
                    F.regexp_replace(F.expr("substring(line, 4)"), _WS, "").alias("path")))


def tracked_moves(moves: DataFrame, git_tracked: DataFrame, repos: DataFrame) -> DataFrame:
    """MOVE sources that are tracked, in version-controlled repositories."""
    git = repos.filter(F.col("is_git")).select("repo_id")
    tracked = git_tracked.select("repo_id", F.col("relative_path").alias("source"))
    return (moves.filter(F.col("action") == "move")
            .join(git, "repo_id", "left_semi")
            .join(tracked, ["repo_id", "source"], "left_semi"))


def git_warnings(moves: DataFrame, git_status: DataFrame, git_tracked: DataFrame,
                 repos: DataFrame) -> DataFrame:
    """``uncommitted`` and ``tracked_files`` rows (only non-empty lists).

    Columns: repo_id, warning_type, message, details (first 5), total.
    """
    unc = parse_git_status(git_status, repos)
    unc_total = unc.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    unc_first = first_k(unc, ["repo_id"], [F.col("line_no")], 5).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "path"))).alias("d"))
    uncommitted = unc_total.join(unc_first, "repo_id").select(
        "repo_id", F.lit("uncommitted").alias("warning_type"),
        F.lit(K.GIT_UNCOMMITTED).alias("message"),
        F.transform("d", lambda x: x["path"]).alias("details"), "total")

    tm = tracked_moves(moves, git_tracked, repos)
    tm_total = tm.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    tm_first = first_k(tm, ["repo_id"], [F.col("phase"), F.col("ord")], 5).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "source"))).alias("d"))
    tracked = tm_total.join(tm_first, "repo_id").select(
        "repo_id", F.lit("tracked_files").alias("warning_type"),
        fmt(K.GIT_TRACKED, n=F.col("total").cast("string")).alias("message"),
        F.transform("d", lambda x: x["source"]).alias("details"), "total")
    return uncommitted.unionByName(tracked)
