"""Raw provider replies as one answer table: text, tokens, cost, sources, error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.functions import money as M
from geovis.functions.core import unfold, whole_json
from geovis.functions.text import strip_fences
from geovis.operators.contracts import BREACHES, NUMBER, OBJECT, TEXT, TEXTS, Contract, breaches, each, list_of, whole

CHAT_REPLY = """struct<
  choices: array<struct<message: struct<content: string, annotations: array<struct<
    type: string, url: string, title: string, url_citation: struct<url: string, title: string>>>>>>,
  usage: struct<prompt_tokens: int, completion_tokens: int, cost: double>,
  citations: array<string>>"""

PARTS_REPLY = """struct<
  candidates: array<struct<
    content: struct<parts: array<struct<text: string>>>,
    groundingMetadata: struct<groundingChunks: array<struct<web: struct<uri: string, title: string>>>>>>,
  usageMetadata: struct<promptTokenCount: int, candidatesTokenCount: int>>"""

# What a reply is expected to hold. A reply that departs from it is still read as far as it goes;
# `reply_breaches` tells where it departs.
_OPTIONAL_TEXT, _OPTIONAL_COUNT = TEXT.or_null().or_absent(), whole(0).or_null().or_absent()
CHAT: Contract = [
    ("choices", "$.choices", list_of(1)),
    ("choice", "$.choices", each((".message", OBJECT), (".message.content", _OPTIONAL_TEXT)).or_absent()),
    ("tokens in", "$.usage.prompt_tokens", _OPTIONAL_COUNT),
    ("tokens out", "$.usage.completion_tokens", _OPTIONAL_COUNT),
    ("cost", "$.usage.cost", NUMBER.or_null().or_absent()),
    ("citations", "$.citations", TEXTS.or_absent()),
]
PARTS: Contract = [
    ("candidates", "$.candidates", list_of(1)),
    ("parts", "$.candidates[0].content.parts", each(("", OBJECT), (".text", _OPTIONAL_TEXT)).or_absent()),
    ("tokens in", "$.usageMetadata.promptTokenCount", _OPTIONAL_COUNT),
    ("tokens out", "$.usageMetadata.candidatesTokenCount", _OPTIONAL_COUNT),
]

_SOURCES = "array<struct<url:string,title:string>>"


def _finish(df: DataFrame, kept: list[str]) -> DataFrame:
    ok = F.col("error").isNull()
    return df.select(
        *kept,
        F.when(ok, F.col("_text")).alias("text"),
        F.when(ok, F.coalesce("_in", F.lit(0))).otherwise(0).alias("tokens_in"),
        F.when(ok, F.coalesce("_out", F.lit(0))).otherwise(0).alias("tokens_out"),
        F.when(ok, F.col("_usd")).otherwise(F.lit(0).cast("decimal(28,14)")).alias("cost_usd"),
        F.when(ok, F.col("_sources")).otherwise(F.array().cast(_SOURCES)).alias("sources"),
        "error",
    ).withColumn("cost_eur", M.to_eur(F.col("cost_usd")).cast("decimal(28,14)"))


def _failure():
    """Message of a failed call or an unreadable reply from (status, reply)."""
    return F.when(
        ~F.coalesce(F.col("status").between(200, 299), F.lit(False)),
        F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("0")), F.lit(": "),
                 F.coalesce("reply", F.lit(""))),
    ).when(whole_json(F.col("reply")).isNull(), "reply is not JSON")


def normalize_chat_replies(raw: DataFrame, json_mode: bool = False) -> DataFrame:
    """Replies with `choices` from `raw` (..., model, status, reply). The reported cost counts, 0
    when absent. Sources are the citations, then the annotations with an address."""
    kept = [c for c in raw.columns if c not in ("status", "reply")]
    message = F.get(F.col("_r.choices"), F.lit(0))["message"]
    content = F.coalesce(message["content"], F.lit(""))
    blank = F.lit(None).cast("string")
    cited = F.transform(
        F.coalesce("_r.citations", F.array().cast("array<string>")),
        lambda u: F.struct(u.alias("url"), blank.alias("title")),
    )
    notes = F.filter(
        F.transform(
            F.coalesce(message["annotations"], F.array().cast(
                "array<struct<type:string,url:string,title:string,url_citation:struct<url:string,title:string>>>")),
            lambda a: F.when(
                a.url_citation.isNotNull(),
                F.struct(a.url_citation.url.alias("url"), a.url_citation.title.alias("title")),
            ).when(F.coalesce(a.url, F.lit("")) != "", F.struct(a.url.alias("url"), a.title.alias("title"))),
        ),
        lambda s: s.isNotNull(),
    )
    parsed = raw.withColumn("_r", F.from_json("reply", CHAT_REPLY)).withColumn(
        "error",
        F.coalesce(
            _failure(),
            F.when(F.coalesce(F.size("_r.choices"), F.lit(0)) <= 0, "reply without choices"),
        ),
    )
    return _finish(
        parsed.withColumns(
            {
                "_text": strip_fences(content) if json_mode else content,
                "_in": F.col("_r.usage.prompt_tokens"),
                "_out": F.col("_r.usage.completion_tokens"),
                "_usd": F.coalesce(F.col("_r.usage.cost").cast("decimal(28,14)"), F.lit(0).cast("decimal(28,14)")),
                "_sources": F.concat(cited, notes),
            }
        ),
        kept,
    )


def normalize_parts_replies(raw: DataFrame, prices: DataFrame, json_mode: bool = False) -> DataFrame:
    """Replies with `candidates` of text parts from `raw` (..., model, status, reply). Cost comes
    from the price list, 0 for a model not on it; sources are grounding chunks with an address."""
    kept = [c for c in raw.columns if c not in ("status", "reply")]
    first = F.get(F.col("_r.candidates"), F.lit(0))
    content = F.coalesce(
        F.array_join(F.filter(F.transform(first["content"]["parts"], lambda p: p.text), lambda t: t != ""), ""),
        F.lit(""),
    )
    chunks = F.coalesce(
        first["groundingMetadata"]["groundingChunks"],
        F.array().cast("array<struct<web:struct<uri:string,title:string>>>"),
    )
    sources = F.transform(
        F.filter(chunks, lambda c: F.coalesce(c.web.uri, F.lit("")) != ""),
        lambda c: F.struct(c.web.uri.alias("url"), c.web.title.alias("title")),
    )
    listed = prices.filter(F.col("provider") == "gemini").select(
        F.col("model").alias("_native"), "price_in", "price_out", "fee"
    )
    parsed = (
        raw.withColumn("_r", F.from_json("reply", PARTS_REPLY))
        .withColumn("_native", M.native_model(F.col("model")))
        .join(listed, "_native", "left")
        .withColumn("error", _failure())
        .withColumn("_in", F.coalesce("_r.usageMetadata.promptTokenCount", F.lit(0)))
        .withColumn("_out", F.coalesce("_r.usageMetadata.candidatesTokenCount", F.lit(0)))
    )
    cost = M.token_cost(F.col("_in"), F.col("_out"), F.col("price_in"), F.col("price_out"), F.col("fee"))
    return _finish(
        parsed.withColumns(
            {
                "_text": strip_fences(content) if json_mode else content,
                "_usd": F.coalesce(cost, F.lit(0)).cast("decimal(28,14)"),
                "_sources": sources,
            }
        ),
        kept,
    )


def reply_breaches(raw: DataFrame, contract: Contract, keys: list[str]) -> DataFrame:
    """(keys, path, rule, found): one row for each broken rule of each reply in `raw` (..., status,
    reply); a failed call has one row, with its status."""
    called = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    status = F.coalesce(F.col("status").cast("string"), F.lit("ABSENT"))
    failed = F.struct(F.lit("status").alias("path"), F.lit("200 to 299").alias("rule"), status.alias("found"))
    read = raw.withColumn("_json", F.when(called, whole_json(F.col("reply"))))
    broken = F.when(called, breaches(F.col("_json"), contract)).otherwise(F.array(failed).cast(BREACHES))
    return unfold(read, keys, broken, "b").select(*keys, "b.*")


def all_answers(*per_provider: DataFrame) -> DataFrame:
    """Answer tables of several providers as one."""
    out = per_provider[0]
    for other in per_provider[1:]:
        out = out.unionByName(other)
    return out
