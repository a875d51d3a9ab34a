"""Corpus preparation: five stages over the documents table, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Extra
columns of docs are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.llm import packing, pii, quality, queries, simhash, suffix_dedup
from geovis.llm.common import stored, table


def counted(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars of the text it has now, if it has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go. Rows stay whole: statistics
    and verdict are further columns of the row."""
    rules = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("_row"), "text"), rules)
    return judged.filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Of rows
    that repeat both that id and its text one stays. Documents without an id have no group and
    stay."""
    groups = simhash.near_duplicates(docs)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(first, "id", "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that stand in several places go from the texts; documents stay."""
    return counted(suffix_dedup.trimmed(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return counted(pii.masked(docs, pii.fit(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix dedup", suffix_dedup_stage),
    ("personal data", personal_data),
    ("packing", packed),
]

#: The learned stages and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
