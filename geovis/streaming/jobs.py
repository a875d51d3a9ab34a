"""Structured Streaming jobs over the growing feeds: usage, requests, answers.

Each job keeps its results in stores of merged batch parts (`state.Store`), so a batch that is run
again after a failure replaces its own output, and the number of folders stays small however long
the job runs. No job has a watermark: rows count however late they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.functions import money as M
from geovis.operators import contracts, costs, mentions, visibility
from geovis.sources import requests as R
from geovis.streaming.state import Store

FILES_PER_BATCH = 256


def file_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A Parquet folder (or file pattern) as a stream, with the schema of what is there. A
    micro-batch takes a bounded number of files, so a backlog is worked off in steps."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, step, folder: str, available_now: bool = True):
    """Run `step(batch, batch_id)` on every micro-batch; returns the query handle."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def summed(*keys: str, **columns: str):
    """Merge of parts whose `columns` (with their types) add up per key."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in columns.items()])

    return merge


def as_they_are(rows: DataFrame) -> DataFrame:
    """Merge of parts whose rows are final: a few files in place of many."""
    return rows.coalesce(4)


def spend_totals(spark: SparkSession, folder: str) -> Store:
    """Spend per month: what each batch adds."""
    return Store(spark, f"{folder}/totals", "month timestamp, total_eur decimal(28,6)", summed("month", total_eur="decimal(28,6)"))


def alerts_store(spark: SparkSession, folder: str) -> Store:
    schema = "month timestamp, event_id long, created_at timestamp, before_eur decimal(28,6), after_eur decimal(28,6), level string"
    return Store(spark, f"{folder}/alerts", schema, as_they_are)


def spend_alerts(usage: DataFrame, folder: str, caps: costs.Caps = costs.Caps(), available_now: bool = True):
    """Month totals and one alert per month and limit, from a stream of priced usage rows.

    A batch reads the totals of the batches before, finds its own crossings on top of them, and adds
    its spend and its alerts. The totals come last: whoever sees them sees their alerts.
    """
    totals, alerts = spend_totals(usage.sparkSession, folder), alerts_store(usage.sparkSession, folder)
    money = lambda name: F.col(name).cast("decimal(28,6)").alias(name)

    def step(batch: DataFrame, batch_id: int) -> None:
        crossed = costs.threshold_crossings(batch, caps, totals.before(batch_id))
        alerts.add(batch_id, crossed.select("month", "event_id", "created_at", money("before_eur"), money("after_eur"), "level"))
        totals.add(batch_id, costs.monthly_totals(batch).select("month", money("total_eur")))

    return run_batches(usage, step, folder, available_now)


def alerts_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return alerts_store(spark, folder).read()


def window_hits(events: DataFrame, minutes: int = 10, slide_minutes: int = 1) -> DataFrame:
    """Hits per key in sliding windows: (ip, action, window_end, hits). The exact trailing form is
    the batch operator `rate_history`."""
    window = F.window("created_at", f"{minutes} minutes", f"{slide_minutes} minutes")
    counted = events.groupBy("ip", "action", window.alias("w")).agg(F.count("*").alias("hits"))
    return counted.select("ip", "action", F.col("w.end").alias("window_end"), "hits")


def windows_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, f"{folder}/windows", None, summed("ip", "action", "window_end", hits="long"))


def rate_windows(
    events: DataFrame, folder: str, minutes: int = 10, slide_minutes: int = 1, available_now: bool = True
):
    """Window hits of every batch, from a stream of events. They add up over the batches, so an
    event counts however late it comes."""
    store = windows_store(events.sparkSession, folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        store.add(batch_id, window_hits(batch, minutes, slide_minutes))

    return run_batches(events, step, folder, available_now)


def rate_windows_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per key and window over all batches so far."""
    return windows_store(spark, folder).read()


QUESTION = ["audit_id", "position", "provider"]


def first_answers(rows: DataFrame) -> DataFrame:
    """Of the answers to a question (audit_id, position) by a provider the earliest one, by time and
    id, in whatever order they came."""
    others = [c for c in rows.columns if c not in QUESTION]
    first = F.min_by(F.struct(*others), F.struct("created_at", "response_id"))
    return rows.groupBy(*QUESTION).agg(first.alias("_first")).select(*QUESTION, "_first.*").select(*rows.columns)


def answers_store(spark: SparkSession, folder: str, key: str) -> Store:
    schema = (
        f"audit_id {key}, position int, provider string, created_at timestamp, response_id long, detection_method string, "
        "disagrees boolean, analysed boolean, brand_mentioned boolean, brand_citation_present boolean, mention_position int, sentiment string"
    )
    return Store(spark, f"{folder}/answers", schema, first_answers)


def running_visibility(
    answers: DataFrame, brands: DataFrame, folder: str, available_now: bool = True
):
    """Mention rows of a stream of analysed answers (with completion and created_at).

    A repeated answer of a question and provider counts once, the earliest one. The store is keyed by
    question and provider: each batch adds its own first answers, and merging parts keeps the first
    of all, so an answer that comes days late, or before one that was there already, repairs the
    result instead of being dropped.
    """
    store = answers_store(answers.sparkSession, folder, answers.schema["audit_id"].dataType.simpleString())

    def step(batch: DataFrame, batch_id: int) -> None:
        loaded = contracts.load_analyses(batch.select("response_id", "completion"))
        rows = mentions.mention_results(batch.drop("completion"), brands, loaded)
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in store.rows([]).schema]
        store.add(batch_id, first_answers(rows.select(*typed)))

    return run_batches(answers, step, folder, available_now)


def answers_so_far(spark: SparkSession, folder: str, key: str = "long") -> DataFrame:
    """One mention row per question and provider over all batches so far; `key` is the type of audit_id."""
    return answers_store(spark, folder, key).read()


def visibility_so_far(spark: SparkSession, folder: str, key: str = "long") -> DataFrame:
    """Scores over all batches so far."""
    return visibility.visibility_scores(answers_so_far(spark, folder, key), "audit_id")


def spend_version(store: Store, reserved: Store, batch: int) -> int | None:
    """The version of another job's totals that a batch decides by: the newest one when the batch
    first ran. It is written down, so that the batch decides alike when it is run again."""
    pin = Store(store.spark, f"{reserved.folder}-pins", store.schema, as_they_are)
    if batch not in pin.versions():
        newest = store.latest()
        pin.write_manifest(batch, [] if newest is None else [(newest, newest, 0)])
        for old in pin.versions()[: -pin.keep]:
            pin.files.delete(f"manifests/{old}.json")
    found = [p[0] for p in pin.parts(batch)]
    # A version so old that its writer has deleted it gives way to the newest one.
    return found[0] if found and found[0] in store.versions() else store.latest() if found else None


def admission_stores(spark: SparkSession, folder: str) -> tuple[Store, Store]:
    """Decided requests, and the reserve of the admitted ones per month."""
    decided = "request_id long, requested_at timestamp, url string, url_normalized string, domain string, geo_target string, month timestamp, admitted boolean"
    reserve = summed("month", reserved="decimal(28,6)")
    return Store(spark, f"{folder}/requests", decided, as_they_are), Store(spark, f"{folder}/reserved", "month timestamp, reserved decimal(28,6)", reserve)


def request_admission(
    requests: DataFrame, spend: Store | None, folder: str, caps: costs.Caps = costs.Caps(), available_now: bool = True
):
    """Validated requests with `admitted`, from a stream of bodies (request_id, requested_at, body).

    `spend` is the store of month totals that `spend_alerts` keeps (None: nothing is spent). A batch
    reads one version of it whole; requests admitted by earlier batches keep their reserve.
    """
    spark = requests.sparkSession
    decided, reserved = admission_stores(spark, folder)
    money = lambda name: F.col(name).cast("decimal(28,6)").alias("total_eur")

    def step(batch: DataFrame, batch_id: int) -> None:
        valid = R.accepted(R.read_requests(batch)).withColumn("month", M.month_start(F.col("requested_at")))
        opening = reserved.before(batch_id).select("month", money("reserved"))
        if spend is not None:
            version = spend_version(spend, reserved, batch_id)
            spent = spend.merge(spend.rows(spend.parts(version)))
            opening = opening.unionByName(spent.select("month", money("total_eur")))
        opening = opening.groupBy("month").agg(F.sum("total_eur").cast("decimal(28,6)").alias("total_eur"))
        rows = costs.admit_requests(valid, opening, caps).persist()
        decided.add(batch_id, rows)
        price = F.lit(str(caps.audit_cost)).cast("decimal(28,6)")
        reserve = (F.count("*").cast("decimal(20,0)") * price).cast("decimal(28,6)").alias("reserved")
        reserved.add(batch_id, rows.filter("admitted").groupBy("month").agg(reserve))
        rows.unpersist()

    return run_batches(requests, step, folder, available_now)


def requests_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return admission_stores(spark, folder)[0].read()
