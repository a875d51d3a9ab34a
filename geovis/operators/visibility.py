"""Visibility scores from analysed answers.

`responses` rows: audit_id, position, provider, analysed, brand_mentioned, mention_position,
sentiment, brand_citation_present, competitors_cited, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geovis.functions.core import unfold
from geovis.functions.money import PROVIDERS, VISIBILITY_MODELS
from geovis.functions.text import geo_suffix, js_round, js_trim
from geovis.operators.scoring import global_score

TOP_COMPETITORS = 10


def question_tasks(queries: DataFrame, geo: Column | None = None, providers=None) -> DataFrame:
    """One row per question and provider with the model to ask and the text to send."""
    asked = F.array(
        *[
            F.struct(F.lit(p).alias("provider"), F.lit(VISIBILITY_MODELS[p]).alias("model"))
            for p in (providers or PROVIDERS)
        ]
    )
    place = F.lit(None).cast("string") if geo is None else geo
    return queries.withColumn("prompt", geo_suffix(F.col("text"), place)).select("*", F.inline(asked))


def provider_rank(provider: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), provider)


def answer_points() -> Column:
    """0 to 100 points of one answer. The order of the rules matters; place 0 counts as top 3, and
    a mention without a sentiment as neutral."""
    good = F.col("sentiment").isin("positive", "neutral")
    place = F.col("mention_position")
    return (
        F.when(~F.coalesce(F.col("analysed") & F.col("brand_mentioned"), F.lit(False)), 0)
        .when((place == 1) & (F.col("sentiment") == "positive"), 100)
        .when((place <= 3) & good, 75)
        .when(good, 50)
        .when(F.col("sentiment") == "negative", 25)
        .otherwise(50)
    )


def visibility_parts(responses: DataFrame, *keys: str) -> DataFrame:
    """Sums that add up over any split of the answers: per provider points and answers, and the
    counts behind the rates."""
    scored = responses.withColumn("_points", answer_points())
    sums = []
    for p in PROVIDERS:
        own = F.col("provider") == p
        sums += [
            F.coalesce(F.sum(F.when(own, F.col("_points"))), F.lit(0)).alias(f"{p}_points"),
            F.count_if(own).alias(f"{p}_answers"),
        ]
    return scored.groupBy(*keys).agg(
        *sums,
        F.count_if("analysed").alias("analysed"),
        F.count_if(F.col("analysed") & F.col("brand_mentioned")).alias("mentions"),
        F.count_if(F.col("analysed") & F.col("brand_citation_present")).alias("citations"),
    )


PART_COLUMNS = [f"{p}_{kind}" for p in PROVIDERS for kind in ("points", "answers")] + [
    "analysed", "mentions", "citations",
]


def scores_from_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Provider scores, visibility score and rates. Failed answers lower a provider's average but
    do not enter the rates; a provider without answers scores 0 and still counts."""
    per_provider = [
        F.coalesce(js_round(F.try_divide(F.col(f"{p}_points"), F.col(f"{p}_answers"))), F.lit(0)).alias(p)
        for p in PROVIDERS
    ]

    def rate(part):
        return F.coalesce(F.try_divide(F.col(part), F.col("analysed")) * 100, F.lit(0.0))

    scored = parts.select(
        *keys, *per_provider, rate("mentions").alias("mention_rate"), rate("citations").alias("citation_rate")
    )
    total = sum((F.col(p) for p in PROVIDERS), F.lit(0))
    return scored.withColumn("visibility_score", js_round(total / len(PROVIDERS)))


def visibility_scores(responses: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, one score per provider, visibility_score, mention_rate, citation_rate). One shuffle
    of partial sums."""
    return scores_from_parts(visibility_parts(responses, key), key)


def competitor_counts(responses: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, name, count, first_seen): every occurrence counts, names are trimmed and compared
    with case. first_seen orders by question, provider, place in the list."""
    ranked = responses.filter("analysed").withColumn("rank", provider_rank(F.col("provider")))
    long = unfold(ranked, [key, "position", "rank"], F.col("competitors_cited"), "raw")
    named = long.withColumn("name", js_trim(F.col("raw"))).filter(F.col("name") != "")
    return named.groupBy(key, "name").agg(
        F.count("*").alias("count"),
        F.min(F.struct("position", "rank", "ord")).alias("first_seen"),
    )


def top_competitors(responses: DataFrame, k: int = TOP_COMPETITORS, key: str = "audit_id") -> DataFrame:
    """(key, place, name, count): most named first, earlier seen first among equals. The limit is
    applied per partition before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("count"), F.asc("first_seen"))
    return (
        competitor_counts(responses, key)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .select(key, "place", "name", "count")
    )


def top_competitor(responses: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, top_competitor): a plain aggregate, no ranking needed."""
    best = F.max_by("name", F.struct("count", _reversed("first_seen")))
    return competitor_counts(responses, key).groupBy(key).agg(best.alias("top_competitor"))


def _reversed(column: str) -> Column:
    """Orders earlier places higher."""
    return F.struct(*[(-F.col(f"{column}.{f}")).alias(f) for f in ("position", "rank", "ord")])


def for_every_audit(audits: DataFrame, visibility: DataFrame, key: str = "audit_id") -> DataFrame:
    """`audits` with the columns of `visibility`; an audit without answers scores zero."""
    scores = [c for c in visibility.columns if c != key]
    return audits.join(visibility, key, "left").fillna(0, subset=scores)


def audit_scores(technical: DataFrame, responses: DataFrame, key: str = "audit_id") -> DataFrame:
    """The score row per audit: technical, visibility, global, rates, providers, top competitor.
    An audit without answers has visibility zero."""
    return (
        for_every_audit(technical.select(key, "technical_score"), visibility_scores(responses, key), key)
        .join(top_competitor(responses, key), key, "left")
        .withColumn("global_score", global_score(F.col("technical_score"), F.col("visibility_score")))
    )
