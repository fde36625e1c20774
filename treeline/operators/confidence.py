"""The confidence scorecard of a reorganisation, per repository.

Inputs are per-repository aggregates only (repository type, whether any file
carries the test flag, MOVE counts by risk, import warning count), so the
scorecard is a join of small tables and a handful of ``when`` expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.functions.text import fmt


def move_counts(proposals: DataFrame) -> DataFrame:
    m = proposals.filter(F.col("action") == "move")
    return m.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("move_count"),
        F.count_if(F.col("risk") == "high").alias("high_risk_count"),
        F.count_if(F.col("risk") == "medium").alias("medium_risk_count"),
        F.count_if(F.col("risk") == "low").alias("low_risk_count"))


def confidence(types: DataFrame, summary: DataFrame, proposals: DataFrame,
               warning_counts: DataFrame, is_dry_run: bool = True) -> DataFrame:
    """Verdict, score and the ten summary fields (A13), factors (A14), P21."""
    t = (types.select("repo_id", "repo_type")
         .join(summary.select("repo_id", (F.col("test_files") > 0).alias("has_tests")), "repo_id", "left")
         .join(move_counts(proposals), "repo_id", "left")
         .join(warning_counts, "repo_id", "left")
         .na.fill(0, ["move_count", "high_risk_count", "medium_risk_count", "low_risk_count",
                      "import_warnings_count"])
         .na.fill(False, ["has_tests"])
         .withColumn("is_dry_run", F.lit(is_dry_run)))
    mv, hi, me, lo = (F.col(c) for c in ("move_count", "high_risk_count", "medium_risk_count",
                                         "low_risk_count"))
    w, tests, rt = F.col("import_warnings_count"), F.col("has_tests"), F.col("repo_type")
    score = (F.lit(100)
             - F.when(rt == "non_python", 30).otherwise(0)
             - F.least(hi, F.lit(3)) * 20
             - F.when(me > 5, 15).otherwise(0)
             - F.least(w, F.lit(3)) * 10
             - F.when(~tests & (mv > 0), 10).otherwise(0)
             + F.when(F.col("is_dry_run"), 5).otherwise(0)
             - F.when(mv > 20, 15).otherwise(0))
    t = t.withColumn("score", score.cast("bigint"))
    level = F.when(F.col("score") >= 70, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW")
    n = lambda c: c.cast("string")
    positives = F.array_compact(F.array(
        F.when(rt == "python_dominant", F.lit(K.FACTOR_PYTHON))
         .when(rt != "non_python", fmt(K.FACTOR_OTHER_TYPE, repo_type=rt)),
        F.when(tests, F.lit(K.FACTOR_TESTS)),
        F.when(mv == 0, F.lit(K.FACTOR_NO_MOVES))
         .when(mv <= 5, fmt(K.FACTOR_FEW_MOVES, n=n(mv))),
        F.when((lo > 0) & (hi == 0) & (me == 0), fmt(K.FACTOR_ALL_LOW, n=n(lo))),
        F.when((w == 0) & (mv > 0), F.lit(K.FACTOR_NO_WARNINGS)),
        F.when(F.col("is_dry_run"), F.lit(K.FACTOR_DRY_RUN)),
    ))
    risks = F.array_compact(F.array(
        F.when(rt == "non_python", F.lit(K.FACTOR_NON_PYTHON)),
        F.when(~tests & (mv > 0), F.lit(K.FACTOR_NO_TESTS)),
        F.when((mv > 5) & (mv <= 15), fmt(K.FACTOR_SOME_MOVES, n=n(mv)))
         .when(mv > 15, fmt(K.FACTOR_MANY_MOVES, n=n(mv))),
        F.when(hi > 0, fmt(K.FACTOR_HIGH, n=n(hi))),
        F.when(me > 0, fmt(K.FACTOR_MEDIUM, n=n(me))),
        F.when(w > 0, fmt(K.FACTOR_WARNINGS, n=n(w))),
    ))
    return t.select(
        "repo_id", level.alias("confidence_level"), "score",
        positives.alias("positive_factors"), risks.alias("risk_factors"),
        F.col("move_count").cast("bigint").alias("move_count"),
        F.col("high_risk_count").cast("bigint").alias("high_risk_count"),
        F.col("medium_risk_count").cast("bigint").alias("medium_risk_count"),
        F.col("low_risk_count").cast("bigint").alias("low_risk_count"),
        F.col("import_warnings_count").cast("bigint").alias("import_warnings_count"),
        "has_tests", "is_dry_run",
        R.interpretation(level).alias("interpretation"))
