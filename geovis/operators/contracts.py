"""Loaders for the JSON that models return. Each checks the contract row by row, keeps a reason
for what it rejects, and falls back to the documented default. `payload_breaches` lists every broken
rule of a payload with the path of the value that breaks it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions.core import let, unfold, whole_json
from geovis.functions.text import js_trim, strip_fences

# Allowed names in the contracts.
SENTIMENTS = ["positive", "neutral", "negative"]
LANGUAGES = ["fr", "en", "es", "de", "it", "other"]
QUERY_CATEGORIES = ["branded", "service", "comparative"]
PRIORITIES = ["quick_win", "medium", "long_term"]
QUERIES_PER_CATEGORY = 10
RECOMMENDATIONS = (5, 15)


def kind_of(value: Column, path: str = "$") -> Column:
    """JSON type of a field: OBJECT, ARRAY, STRING, BOOLEAN, NUMBER, NULL, or null if absent."""
    schema = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return let(
        F.regexp_extract(schema, "^[A-Z]+", 0),
        lambda name: F.when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), name).when(name == "VOID", "NULL").when(name.isNotNull(), "NUMBER"),
    )


# How the schema of a value of a kind begins.
_SCHEMAS = {"NULL": "VOID", "NUMBER": "BIGINT|DECIMAL|DOUBLE|FLOAT"}


def _is(value: Column, path: str, *kinds: str) -> Column:
    schema = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(schema.rlike(f"^(?:{'|'.join(_SCHEMAS.get(kind, kind) for kind in kinds)})"), F.lit(False))


def _strings(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<string>")


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


class Rule(NamedTuple):
    """What a value must be, in words and as a test of (payload, path). A rule about the items of
    a list names the rules that each of them has to keep, by path below the item."""

    says: str
    holds: Callable[[Column, str], Column]
    items: tuple[tuple[str, Rule], ...] = ()

    def or_null(self) -> Rule:
        return Rule(f"{self.says} or null", lambda v, path: _is(v, path, "NULL") | self.holds(v, path))

    def or_absent(self) -> Rule:
        return Rule(f"{self.says} or absent", lambda v, path: kind_of(v, path).isNull() | self.holds(v, path), self.items)


def of_kind(kind: str) -> Rule:
    return Rule(kind.lower(), lambda v, path: _is(v, path, kind))


TEXT, FLAG, NUMBER, OBJECT = (of_kind(kind) for kind in ("STRING", "BOOLEAN", "NUMBER", "OBJECT"))


def whole(low: int, high: int | None = None) -> Rule:
    def holds(v, path):
        number = F.try_variant_get(v, path, "double")
        fits = _is(v, path, "NUMBER") & (number == F.floor(number)) & (number >= low)
        return F.coalesce(fits if high is None else fits & (number <= high), F.lit(False))

    return Rule(f"whole number from {low}" + ("" if high is None else f" to {high}"), holds)


def one_of(names: list[str]) -> Rule:
    return Rule(
        "one of " + ", ".join(names),
        lambda v, path: _is(v, path, "STRING") & F.coalesce(_text(v, path).isin(*names), F.lit(False)),
    )


def list_of(low: int = 0, high: int | None = None) -> Rule:
    def holds(v, path):
        n = F.size(_items(v, path))
        return F.coalesce(n >= low if high is None else n.between(low, high), F.lit(False))

    return Rule("list" if not low and high is None else f"list of {low}" + ("" if high == low else " or more" if high is None else f" to {high}"), holds)


def each(*items: tuple[str, Rule]) -> Rule:
    """A list whose items keep `items`."""

    def fits(item):
        return functools.reduce(lambda a, b: a & b, [rule.holds(item, "$" + below) for below, rule in items])

    return Rule("list", lambda v, path: F.coalesce(F.forall(_items(v, path), fits), F.lit(False)), items)


TEXTS = each(("", TEXT))

# Contracts: (name of the reason, path, rule), in the order in which reasons are given.
Contract = list[tuple[str, str, Rule]]
ANALYSIS: Contract = [
    ("brand_mentioned", "$.brand_mentioned", FLAG),
    ("mention_position", "$.mention_position", whole(0).or_null()),
    ("mention_context", "$.mention_context", TEXT.or_null()),
    ("brand_citation_present", "$.brand_citation_present", FLAG),
    ("sentiment", "$.sentiment", one_of(SENTIMENTS).or_null()),
    ("competitors_cited", "$.competitors_cited", TEXTS),
    ("sources_cited", "$.sources_cited", TEXTS),
]
BUSINESS: Contract = [
    ("brand_name", "$.brand_name", TEXT),
    ("brand_aliases", "$.brand_aliases", TEXTS),
    ("industry", "$.industry", TEXT.or_null()),
    ("services", "$.services", TEXTS),
    ("geo_zone", "$.geo_zone", TEXT.or_null()),
    ("detected_competitors", "$.detected_competitors", TEXTS),
    ("language", "$.language", one_of(LANGUAGES)),
]
QUESTIONS: Contract = [
    (name, f"$.{name}", rule)
    for name in QUERY_CATEGORIES
    for rule in (TEXTS, list_of(QUERIES_PER_CATEGORY, QUERIES_PER_CATEGORY))
]
SYNTHESIS: Contract = [
    ("verdict", "$.verdict", TEXT),
    ("top_competitor", "$.top_competitor", TEXT.or_null()),
    ("number of recommendations", "$.recommendations", list_of(*RECOMMENDATIONS)),
    (
        "recommendation",
        "$.recommendations",
        each(
            (".priority", one_of(PRIORITIES)), (".category", TEXT), (".title", TEXT), (".description", TEXT),
            (".impact_score", whole(1, 10)),
        ).or_absent(),
    ),
]


def _reason(v: Column, contract: Contract) -> Column:
    """Name of the first broken rule, null when all hold."""
    broken = [F.when(~rule.holds(v, path), F.lit(name)) for name, path, rule in contract]
    return F.coalesce(F.when(~_is(v, "$", "OBJECT"), "not a JSON object"), *broken)


def _loaded(raw: DataFrame, text: str) -> DataFrame:
    return raw.withColumn("_json", whole_json(strip_fences(F.col(text))))


_JSON = "_json"


def breaches(v: Column, contract: Contract) -> Column:
    """array(path, rule, found) of all broken rules of a payload, `found` being the type that
    stands there. A broken rule about items gives a row for each value in them that breaks it."""

    def breach(at, rule, value, path):
        found = F.coalesce(kind_of(value, path), F.lit("ABSENT"))
        return F.struct(at.alias("path"), F.lit(rule.says).alias("rule"), found.alias("found"))

    def within(path, rule):
        def of_item(item, i):
            at = lambda below: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit(f"]{below}"))
            return F.array_compact(
                F.array(*[F.when(~r.holds(item, "$" + below), breach(at(below), r, item, "$" + below)) for below, r in rule.items])
            )

        return F.flatten(F.transform(_items(v, path), of_item))

    def of_field(path, rule):
        whole_field = F.array(breach(F.lit(path), rule, v, path))
        told = F.when(_is(v, path, "ARRAY"), within(path, rule)).otherwise(whole_field) if rule.items else whole_field
        return F.when(rule.holds(v, path), F.array().cast(BREACHES)).otherwise(told)

    unreadable = F.struct(
        F.lit("$").alias("path"), F.lit(OBJECT.says).alias("rule"), F.coalesce(kind_of(v), F.lit("NO JSON")).alias("found")
    )
    fields = F.flatten(F.array(*[of_field(path, rule) for _, path, rule in contract]))
    return F.when(_is(v, "$", "OBJECT"), fields).otherwise(F.array(unreadable))


BREACHES = "array<struct<path:string,rule:string,found:string>>"


def payload_breaches(raw: DataFrame, contract: Contract, keys: list[str], text: str = "completion") -> DataFrame:
    """(keys, path, rule, found): one row for each broken rule of each payload in `raw`; none for
    a payload that keeps the contract."""
    rows = unfold(_loaded(raw, text), keys, breaches(F.col(_JSON), contract), "b")
    return rows.select(*keys, "b.*")


def load_analyses(raw: DataFrame, text: str = "completion") -> DataFrame:
    """`raw` without its text, plus the seven analysis fields and `rejected` (reason or null).
    A broken row counts as not mentioned."""
    v = F.col(_JSON)
    loaded = _loaded(raw, text).withColumn("rejected", _reason(v, ANALYSIS))
    ok = F.col("rejected").isNull()
    none = F.array().cast("array<string>")

    def flag(path):
        return F.coalesce(F.when(ok, F.try_variant_get(v, path, "boolean")), F.lit(False))

    kept = [c for c in raw.columns if c != text]
    return loaded.select(
        *kept,
        flag("$.brand_mentioned").alias("brand_mentioned"),
        F.when(ok, F.try_variant_get(v, "$.mention_position", "int")).alias("mention_position"),
        F.when(ok, _text(v, "$.mention_context")).alias("mention_context"),
        flag("$.brand_citation_present").alias("brand_citation_present"),
        F.when(ok, _text(v, "$.sentiment")).alias("sentiment"),
        F.when(ok, _strings(v, "$.competitors_cited")).otherwise(none).alias("competitors_cited"),
        F.when(ok, _strings(v, "$.sources_cited")).otherwise(none).alias("sources_cited"),
        "rejected",
    )


def load_business(raw: DataFrame, text: str = "completion", domain: str = "domain") -> DataFrame:
    """`raw` without its text, plus the seven business fields and `rejected`. A broken row falls
    back to the domain as brand and French as language."""
    v = F.col(_JSON)
    loaded = _loaded(raw, text).withColumn("rejected", _reason(v, BUSINESS))
    ok = F.col("rejected").isNull()
    none = F.array().cast("array<string>")
    kept = [c for c in raw.columns if c != text]
    return loaded.select(
        *kept,
        F.when(ok, _text(v, "$.brand_name")).otherwise(F.col(domain)).alias("brand_name"),
        F.when(ok, _strings(v, "$.brand_aliases")).otherwise(none).alias("brand_aliases"),
        F.when(ok, _text(v, "$.industry")).alias("industry"),
        F.when(ok, _strings(v, "$.services")).otherwise(none).alias("services"),
        F.when(ok, _text(v, "$.geo_zone")).alias("geo_zone"),
        F.when(ok, _strings(v, "$.detected_competitors")).otherwise(none).alias("detected_competitors"),
        F.when(ok, _text(v, "$.language")).otherwise("fr").alias("language"),
        "rejected",
    )


def load_queries(raw: DataFrame, text: str = "completion", key: str = "audit_id") -> tuple[DataFrame, DataFrame]:
    """(questions, rejected). Questions: (key, position, category, text), numbered through the
    three categories in order. Each category must hold exactly ten."""
    v = F.col(_JSON)
    loaded = _loaded(raw, text).withColumn("rejected", _reason(v, QUESTIONS))

    def labelled(name):
        return F.transform(
            _strings(v, f"$.{name}"), lambda t: F.struct(F.lit(name).alias("category"), t.alias("text"))
        )

    lists = [labelled(name) for name in QUERY_CATEGORIES]
    good = unfold(loaded.filter(F.col("rejected").isNull()), key, F.concat(*lists), "q")
    questions = good.select(key, (F.col("ord") + 1).alias("position"), "q.category", "q.text")
    return questions, loaded.filter(F.col("rejected").isNotNull()).select(key, "rejected")


_RECOMMENDATION = (
    "array<struct<priority:string,category:string,title:string,description:string,impact_score:int>>"
)


def load_synthesis(raw: DataFrame, text: str = "completion", key: str = "audit_id") -> DataFrame:
    """(key, verdict, top_competitor, recommendations, rejected). A broken row has no
    recommendations."""
    v = F.col(_JSON)
    loaded = _loaded(raw, text).withColumn("rejected", _reason(v, SYNTHESIS))
    ok = F.col("rejected").isNull()
    return loaded.select(
        key,
        F.when(ok, _text(v, "$.verdict")).alias("verdict"),
        F.when(ok, _text(v, "$.top_competitor")).alias("top_competitor"),
        F.when(ok, F.try_variant_get(v, "$.recommendations", _RECOMMENDATION))
        .otherwise(F.array().cast(_RECOMMENDATION))
        .alias("recommendations"),
        "rejected",
    )


def recommendation_rows(synthesis: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, position, priority, category, title, description, impact_score), numbered from 1."""
    long = unfold(synthesis, key, F.col("recommendations"), "r")
    return long.select(key, (F.col("ord") + 1).alias("position"), "r.*")


def attach_query_ids(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """Local questions with the id they were stored under, matched by audit and position."""
    ids = stored.select("audit_id", "position", F.col("id").alias("query_id"))
    return questions.join(ids, ["audit_id", "position"])


def attach_response_ids(analyses: DataFrame, responses: DataFrame) -> DataFrame:
    """Analyses with the id of their stored answer, matched by question and provider; analyses
    without an answer are dropped."""
    ids = responses.select("query_id", "provider", F.col("id").alias("response_id"))
    return analyses.join(ids, ["query_id", "provider"])


def clean_names(names: Column) -> Column:
    return F.filter(F.transform(names, js_trim), lambda n: n != "")
