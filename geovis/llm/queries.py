"""One query per operator, over its whole table with production parameters, and reference SQL
where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.llm import (
    audit_sql, byte_bpe, chat_format, conversation_repair, embeddings, filter_audit, language, packing, pii, quality, simhash, suffix_dedup,
    token_files, warc,
)
from geovis.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """Where the public vocabulary file lies on this machine; asked on the driver and, as the
    files are installed everywhere, valid on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


# Recursive reachability from every vector over its links, smallest id first.
SQL["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), fine AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS there FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.there = l.a
), smallest AS (SELECT vec_id, min(there) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN smallest USING (vec_id)
"""

EXTRA = "</s>[INST] ok [/INST]"


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.canonical(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(
        F.to_json(F.struct(F.lit(-7).alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(EXTRA).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record")
    )
    turns = turns.unionByName(chat_format.canonical_json(extra, "record"))
    return chat_format.digests(chat_format.read_back(chat_format.format_turns(turns)))


SQL["op8_chat_formatting"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || role || '|>' || chr(10) || '<|end|>' || chr(10))
      + length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|\|)', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder)


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.histories(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place", "url_key")


SQL["op11_warc"] = audit_sql.WARC


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = audit_sql.FILTER_AUDIT


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired_digests(conversation_repair.damaged(conversations), conversations)


SQL["op13_conversation_repair"] = audit_sql.CONVERSATION_REPAIR
