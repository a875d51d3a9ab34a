"""The streaming jobs over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.operators import costs
from geovis.plans import inputs as I
from geovis.session import configure, work_dir
from geovis.streaming.jobs import (
    alerts_so_far, file_stream, rate_windows, rate_windows_so_far, request_admission, requests_so_far, running_visibility,
    spend_alerts, spend_totals, visibility_so_far,
)


def _view_stream(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The input expression of a job on a stream of a given table."""
    configure(spark)
    return I.over_views(spark, sql, {name: file_stream(spark, f"{sf_dir}/{name}.parquet*")})


CAPS = costs.Caps(cap=60.0, warning=20.0, critical=40.0)


def _run_spend(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the spend job after all usage."""
    folder = work_dir(spark, "spend")
    raw = _view_stream(spark, sf_dir, "events", I.USAGE_SQL).withColumn("created_at", F.col("created_at").cast("timestamp"))
    spend_alerts(costs.price_calls(raw, costs.price_table(spark)), folder, CAPS).awaitTermination()
    return folder


def spend_alerts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = alerts_so_far(spark, _run_spend(spark, sf_dir))
    return alerts.select(
        "event_id", F.round(F.col("before_eur").cast("double"), 6).alias("before_eur"),
        F.round(F.col("after_eur").cast("double"), 6).alias("after_eur"), "level",
    )


def rate_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "rate")
    sql = "SELECT user_id AS ip, event_type AS action, CAST(ts AS TIMESTAMP) AS created_at FROM events"
    rate_windows(_view_stream(spark, sf_dir, "events", sql), folder, 60, 30).awaitTermination()
    return rate_windows_so_far(spark, folder).withColumn("window_end", F.unix_seconds("window_end"))


def visibility_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "visibility")
    answers = I.ANSWER_SQL.strip().replace("SELECT ", "SELECT conv_id, turn, ", 1)
    analysis = I.ANALYSIS_SQL.strip().replace("SELECT ", "SELECT conv_id, turn, ", 1)
    completion = analysis.split(" AS response_id,", 1)[1].split(" AS completion", 1)[0]
    sql = answers.replace("SELECT conv_id, turn, ", f"SELECT {completion} AS completion, timestamp_seconds(1704067200 + turn * 86400 - conv_id) AS created_at, ", 1)
    stream = _view_stream(spark, sf_dir, "conversations", sql)
    running_visibility(stream, I.brands(spark, sf_dir), folder).awaitTermination()
    scores = visibility_so_far(spark, folder)
    return scores.withColumns({c: F.round(c, 6) for c in ("mention_rate", "citation_rate")})


def admission_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against the month totals that the spend job left."""
    spent = spend_totals(spark, _run_spend(spark, sf_dir))
    folder = work_dir(spark, "admission")
    sql = I.REQUEST_SQL.strip().replace(
        "SELECT ", "SELECT timestamp_seconds(1704067200 + page_id * 3600) AS requested_at, ", 1
    )
    stream = _view_stream(spark, sf_dir, "pages", sql)
    request_admission(stream, spent, folder, CAPS).awaitTermination()
    return requests_so_far(spark, folder).select("request_id", "geo_target", "url_normalized", "admitted")
