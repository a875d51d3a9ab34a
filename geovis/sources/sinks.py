"""Writers: one table per kind, the audit state log, and the exported records."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.functions import urls as U
from geovis.sources.files import Files

# Tables of an audit and the states it passes through.
TABLES = [
    "audits", "audit_business_info", "audit_technical", "queries", "ai_responses",
    "ai_response_analysis", "audit_scores", "audit_recommendations", "api_usage",
]
AUDIT_STATES = ["queued", "scraping", "extracting", "querying", "analyzing", "scoring", "done", "failed"]


def write_tables(frames: dict[str, DataFrame], path: str, run_id: str | None = None) -> None:
    """Load tables below `path` as one run. A run that is loaded again replaces its own rows and no
    others: each attempt writes folders of its own, and the run's commit file, which names them for
    all tables at once, is replaced when the last one is written. Without a `run_id` the rows are a
    run of their own. The usage ledger is partitioned by `usage_month`, so that month-to-date reads
    touch one folder per run."""
    unknown = set(frames) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if not frames:
        return
    run_id, attempt = run_id or uuid.uuid4().hex, uuid.uuid4().hex[:12]
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError("a run id has letters, digits and _.- only")
    files = Files(next(iter(frames.values())).sparkSession, path)
    commit, name_of = f"_commits/{run_id}.json", f"run={run_id}.{attempt}"
    before = json.loads(files.read(commit)) if f"{run_id}.json" in files.names("_commits") else {}
    for name, df in frames.items():
        if name == "api_usage":
            dated = df.withColumn("usage_month", F.date_format("created_at", "yyyy-MM"))
            dated.write.partitionBy("usage_month").parquet(f"{path}/{name}/{name_of}")
        else:
            df.write.parquet(f"{path}/{name}/{name_of}")
    files.replace(commit, json.dumps(before | dict.fromkeys(frames, name_of)))
    for name in before.keys() & frames.keys():
        files.delete(f"{name}/{before[name]}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a stored table of all committed runs, with the folder of each as `run`."""
    files = Files(spark, path)
    commits = [json.loads(files.read(f"_commits/{c}")) for c in files.names("_commits") if c.endswith(".json")]
    folders = sorted(f"{path}/{name}/{c[name]}" for c in commits if name in c)
    if not folders:
        raise FileNotFoundError(f"no run has loaded {name}")
    return spark.read.option("basePath", f"{path}/{name}").parquet(*folders)


def technical_rows(checks: DataFrame, scores: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, category, score, checks): five rows per audit with their check lists."""
    lists = checks.groupBy(key, "category").agg(
        F.array_sort(
            F.collect_list(
                F.struct("check_no", "check_id", "label", "status", "points_earned", "points_max", "evidence", "recommendation")
            )
        ).alias("checks")
    )
    return scores.select(key, "category", "score").join(lists, [key, "category"])


def current_state(events: DataFrame) -> DataFrame:
    """Latest state per audit from the append-only log (audit_id, event_ts, seq, status, progress,
    current_step, error_message, language). A finished audit is at 100 with a completion time; a
    failed one keeps its progress and gets its message and a completion time."""
    latest = events.groupBy("audit_id").agg(
        F.max_by(
            F.struct("event_ts", "status", "progress", "current_step", "error_message", "language"),
            F.struct("event_ts", "seq"),
        ).alias("s")
    )
    ended = F.col("s.status").isin("done", "failed")
    return latest.select(
        "audit_id", "s.status",
        F.when(F.col("s.status") == "done", 100).otherwise(F.col("s.progress")).alias("progress"),
        "s.current_step",
        F.when(F.col("s.status") == "failed", F.col("s.error_message")).alias("error_message"),
        "s.language",
        F.when(ended, F.col("s.event_ts")).alias("completed_at"),
        F.col("s.event_ts").alias("updated_at"),
    )


MOST_RECORDS = 10_000


def write_records(
    records: DataFrame, path: str, fetched_at: str = "fetched_at", url: str = "url", most: int = MOST_RECORDS
) -> None:
    """Export nested records as JSON, one folder per day; the domain is a field of the record. Rows
    are dealt by ranges of day, domain and address, so a file holds neighbouring domains, a day or a
    domain with very many records is spread over many tasks, and no file has more than `most`."""
    labelled = records.withColumn("day", F.date_format(F.col(fetched_at), "yyyy-MM-dd")).withColumn(
        "domain", F.regexp_replace(U.domain(F.col(url)), r"\.", "_")
    )
    dealt = labelled.repartitionByRange("day", "domain", F.substring(url, 1, 200)).sortWithinPartitions("day", "domain")
    dealt.write.mode("append").option("maxRecordsPerFile", most).partitionBy("day").json(path)
