"""Brand mentions in answers: exact, tolerant of typos, and as analysed.

`answers` rows: response_id, audit_id, text, ... `brands` rows: audit_id, brand_name, aliases.
The dictionary join is an equi-join on audit_id; the search itself runs within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import text as T
from geovis.functions import urls as U
from geovis.functions.core import let
from geovis.session import bucketed

EXACT_MIN_LENGTH = 3
FUZZY_MIN_LENGTH = 5
CONTEXT_LENGTH = 200
URL_IN_TEXT = r"""(https?://[^\s<>"')\]]+)"""


def candidates(name: Column, aliases: Column, min_length: int) -> Column:
    """Name, then aliases, without those too short to search for."""
    every = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(every, lambda n: n.isNotNull() & (T.js_length(n) >= min_length))


def exact_match(text: Column, name: Column, aliases: Column) -> Column:
    """struct(at, ord, matched) of the earliest candidate in the text, null for none; at equal
    places the first candidate wins. `at` counts from 1."""

    def search(low):
        hits = F.transform(
            candidates(name, aliases, EXACT_MIN_LENGTH),
            lambda n, i: F.struct(F.instr(low, F.lower(n)).alias("at"), i.alias("ord"), n.alias("matched")),
        )
        return F.array_min(F.filter(hits, lambda h: h.at > 0))

    return let(F.lower(text), search)


def fuzzy_match(text: Column, name: Column, aliases: Column) -> Column:
    """struct(matched, original) of the first candidate that a word, or for names with a space a
    pair of neighbouring words, matches within the tolerated edits; null for none.

    Names and words carry their length, so that the cheap length gap is tested before the edit
    distance.
    """

    def sized(value):
        return F.struct(value.alias("text"), T.js_length(value).alias("size"))

    def search(words):
        following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        pairs = F.filter(
            F.zip_with(words, following, lambda a, b: sized(F.concat(a.text, F.lit(" "), b.text))),
            lambda p: p.text.isNotNull(),
        )

        def near(pool, n):
            return F.get(
                F.filter(
                    pool,
                    lambda w: F.when(F.abs(w.size - n.size) > n.limit, F.lit(False)).otherwise(
                        T.edit_distance(w.text, n.text).between(0, n.limit)
                    ),
                ),
                F.lit(0),
            )

        def first_hit(n):
            by_pair = F.when(F.contains(n.text, F.lit(" ")), near(pairs, n)["text"])
            return F.struct(n.text.alias("matched"), F.coalesce(near(words, n)["text"], by_pair).alias("original"))

        names = F.transform(
            candidates(name, aliases, FUZZY_MIN_LENGTH),
            lambda n: F.struct(
                n.alias("text"), T.js_length(n).alias("size"), T.fuzzy_threshold(T.js_length(n)).alias("limit")
            ),
        )
        hits = F.transform(names, first_hit)
        return F.get(F.filter(hits, lambda h: h.original.isNotNull()), F.lit(0))

    return let(F.transform(T.tokens(text), sized), search)


def stored_for_search(answers: DataFrame, brands: DataFrame, buckets: int = 200) -> tuple[DataFrame, DataFrame]:
    """Both sides as tables dealt by audit_id, for dictionaries too large to send to every task: the
    texts are moved once, when they are stored, and no search moves them again."""
    return bucketed(answers, "answers", "audit_id", buckets), bucketed(brands, "brands", "audit_id", buckets)


def exact_mentions(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """answers plus `exact` (struct, null for none). An answer whose audit has no dictionary row stays,
    without a mention."""
    return answers.join(brands, "audit_id", "left").withColumn(
        "exact", exact_match(F.col("text"), F.col("brand_name"), F.col("aliases"))
    )


def fuzzy_mentions(exact: DataFrame) -> DataFrame:
    """The result of `exact_mentions` plus `fuzzy`, searched only where the exact search missed."""
    missed = F.col("exact").isNull() & (F.coalesce("text", F.lit("")) != "")
    return exact.withColumn(
        "fuzzy", F.when(missed, fuzzy_match(F.col("text"), F.col("brand_name"), F.col("aliases")))
    )


def mention_results(answers: DataFrame, brands: DataFrame, analyses: DataFrame) -> DataFrame:
    """The full mention row per answer. The analysis decides; the text search names the method
    and flags where the two disagree. An answer with an error, without text or without analysis
    has none."""
    searched = fuzzy_mentions(exact_mentions(answers, brands))
    usable = (F.coalesce("text", F.lit("")) != "") & F.col("error").isNull()
    in_text = F.col("exact").isNotNull() | F.col("fuzzy").isNotNull()
    joined = searched.join(
        analyses.withColumnRenamed("response_id", "_rid"), F.col("response_id") == F.col("_rid"), "left"
    )
    method = (
        F.when(~F.coalesce("brand_mentioned", F.lit(False)), "none")
        .when(F.col("exact").isNotNull(), "exact")
        .when(F.col("fuzzy").isNotNull(), "fuzzy")
        .otherwise("llm")
    )
    return joined.withColumns(
        {
            "analysed": usable & F.col("_rid").isNotNull(),
            "in_text": in_text,
            "detection_method": method,
            "disagrees": F.col("brand_mentioned") != in_text,
        }
    ).drop("_rid")


def disagreement_report(mentions: DataFrame) -> DataFrame:
    """(audit_id, detection_method, answers, disagreements) over analysed answers."""
    return (
        mentions.filter("analysed")
        .groupBy("audit_id", "detection_method")
        .agg(
            F.count("*").alias("answers"), F.count_if(F.col("disagrees")).alias("disagreements")
        )
    )


def rule_analysis(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """Analysis fields that rules can tell without a model: the brand's place among the known
    businesses by first appearance, a snippet, the competitors and addresses named, and whether
    the brand's own site is cited. `brands` also holds competitors ARRAY and domain."""
    joined = answers.join(brands, "audit_id").withColumn(
        "exact", exact_match(F.col("text"), F.col("brand_name"), F.col("aliases"))
    )
    known = F.filter(F.array_distinct("competitors"), lambda c: F.length(c) >= EXACT_MIN_LENGTH)
    named = let(
        F.lower("text"),
        lambda low: F.transform(
            known,
            lambda c, i: F.struct(F.instr(low, F.lower(c)).alias("at"), i.alias("ord"), c.alias("name")),
        ),
    )
    found = F.array_sort(F.filter(named, lambda c: c.at > 0))
    sources = F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit(URL_IN_TEXT), 1), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    )
    at = F.col("exact.at")
    before = F.size(F.filter(F.col("_found"), lambda c: c.at < at))
    own = F.regexp_replace(F.lower("domain"), r"^www\.", "")
    return joined.withColumn("_found", found).withColumn("_sources", sources).select(
        "response_id", "audit_id",
        F.col("exact").isNotNull().alias("brand_mentioned"),
        F.when(at.isNotNull(), before + 1).alias("mention_position"),
        F.when(
            at.isNotNull(),
            F.substring("text", F.greatest(at - 80, F.lit(1)), F.lit(CONTEXT_LENGTH)),
        ).alias("mention_context"),
        F.exists("_sources", lambda u: F.regexp_replace(U.hostname(u), r"^www\.", "") == own).alias("brand_citation_present"),
        F.transform("_found", lambda c: c["name"]).alias("competitors_cited"),
        F.col("_sources").alias("sources_cited"),
    )
