"""Scores of the technical audit and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions.text import js_round
from geovis.operators.checks.registry import CATEGORIES, CATEGORY_POINTS

STATUSES = ["pass", "warn", "fail", "skipped"]
TECHNICAL_WEIGHT, VISIBILITY_WEIGHT = 0.4, 0.6


def _score(counted: Column) -> Column:
    earned = F.sum(F.when(counted, F.col("points_earned")))
    possible = F.sum(F.when(counted, F.col("points_max")))
    return F.coalesce(js_round(F.try_divide(earned, possible) * CATEGORY_POINTS), F.lit(0))


def category_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, category, score, pass, warn, fail, skipped). Skipped checks do not count. One
    shuffle of partial sums."""
    return checks.groupBy(key, "category").agg(
        _score(F.col("status") != "skipped").alias("score"),
        *[F.count_if(F.col("status") == s).cast("int").alias(s) for s in STATUSES],
    )


def technical_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, technical_score, one score per category, total and passed checks). One shuffle:
    all five categories are summed in the same aggregation."""
    per_category = [
        _score((F.col("status") != "skipped") & (F.col("category") == name)).alias(name)
        for name in CATEGORIES
    ]
    scored = checks.groupBy(key).agg(
        *per_category,
        F.count("*").cast("int").alias("total_checks"),
        F.count_if(F.col("status") == "pass").cast("int").alias("passed_checks"),
    )
    total = sum((F.col(name) for name in CATEGORIES), F.lit(0))
    return scored.withColumn("technical_score", total)


def global_score(technical: Column, visibility: Column) -> Column:
    return js_round(technical * TECHNICAL_WEIGHT + visibility * VISIBILITY_WEIGHT)


def global_scores(technical: DataFrame, visibility: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, technical_score, visibility_score, global_score) of every technical audit; one
    without answers has visibility zero."""
    joined = technical.select(key, "technical_score").join(
        visibility.select(key, "visibility_score"), key, "left"
    ).fillna(0, subset=["visibility_score"])
    return joined.withColumn(
        "global_score", global_score(F.col("technical_score"), F.col("visibility_score"))
    )
