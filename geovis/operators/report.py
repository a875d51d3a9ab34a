"""Report rows: the synthesis input and the full audit record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.functions.money import PROVIDERS
from geovis.functions.text import excerpt
from geovis.operators.visibility import for_every_audit, top_competitors

FAILED_SHOWN = 10
COMPETITORS_SHOWN = 5
ADVICE_LENGTH = 100


def check_lists(checks: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, failed_checks, checks) with the first ten failed or warned checks in report order.
    An audit has 51 checks, so its list is bounded."""
    shown = F.col("status").isin("fail", "warn")
    failed = F.struct(
        "check_no", "label", excerpt(F.col("recommendation"), ADVICE_LENGTH).alias("recommendation")
    )
    grouped = checks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(shown, failed))).alias("_failed"),
        F.array_sort(
            F.collect_list(
                F.struct("check_no", "category", "check_id", "status", "points_earned", "points_max", "evidence")
            )
        ).alias("checks"),
    )
    short = F.transform(
        F.slice("_failed", 1, FAILED_SHOWN), lambda f: F.struct(f.label.alias("label"), f.recommendation.alias("recommendation"))
    )
    return grouped.select(key, short.alias("failed_checks"), "checks")


def synthesis_input(
    business: DataFrame, technical: DataFrame, checks: DataFrame, visibility: DataFrame,
    responses: DataFrame, key: str = "audit_id",
) -> DataFrame:
    """One row per audit with what the closing report is written from. Scores of an audit without
    answers are zero."""
    rivals = (
        top_competitors(responses, COMPETITORS_SHOWN, key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_rivals"))
        .select(key, F.transform("_rivals", lambda r: r["name"]).alias("top_competitors"))
    )
    scores = F.create_map(*[x for p in PROVIDERS for x in (F.lit(p), F.col(p))])
    audits = (
        business.select(key, "brand_name", "industry")
        .join(technical.select(key, "technical_score", "passed_checks", "total_checks"), key)
        .join(check_lists(checks, key).select(key, "failed_checks"), key)
    )
    wanted = visibility.select(key, "visibility_score", "mention_rate", "citation_rate", *PROVIDERS)
    return (
        for_every_audit(audits, wanted, key)
        .withColumn("visibility_per_provider", scores)
        .drop(*PROVIDERS)
        .join(rivals, key, "left")
        .withColumn("top_competitors", F.coalesce("top_competitors", F.array().cast("array<string>")))
    )


def audit_record(
    audits: DataFrame, technical: DataFrame, checks: DataFrame, visibility: DataFrame,
    questions: DataFrame, synthesis: DataFrame, key: str = "audit_id",
) -> DataFrame:
    """The full nested record per audit. Lists are bounded by the audit itself: 51 checks,
    30 questions, at most 15 recommendations."""
    asked = questions.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("position", "category", "text"))).alias("queries")
    )
    return (
        audits.join(technical, key)
        .join(check_lists(checks, key).select(key, "checks"), key)
        .join(visibility, key, "left")
        .join(asked, key, "left")
        .join(synthesis.drop("rejected"), key, "left")
    )
