"""Stores of merged parts, and jobs whose rows come late, out of order or again."""

import random

import pytest
from pyspark.sql import functions as F

from geovis.operators import contracts, costs, mentions, visibility
from geovis.plans import streams
from geovis.streaming import jobs
from geovis.streaming.state import Store

DAY = 86_400
START = 1_704_067_200


def add_up(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def store(spark, folder, **options):
    return Store(spark, str(folder), "k long, v long", add_up, **options)


def test_many_batches_leave_few_folders(spark, tmp_path):
    kept, want = store(spark, tmp_path), {}
    most = 0
    for batch in range(41):
        rows = [(batch % 7, batch), (7, 1)]
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        kept.add(batch, spark.createDataFrame(rows, "k long, v long").coalesce(1))
        most = max(most, len(kept.files.names("parts")))
    assert {r["k"]: r["v"] for r in kept.read().collect()} == want
    parts = kept.parts(kept.latest())
    # 41 = 221 in base 4: one part of generation 0, two of 1, two of 2.
    assert [p[2] for p in parts] == [2, 2, 1, 1, 0] and [p[0] for p in parts][1:] == [p[1] + 1 for p in parts][:-1]
    assert most <= 3 * 4 + 3 * 3 and len(kept.versions()) == 3


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    kept = store(spark, tmp_path, fan=2)
    one = lambda v: spark.createDataFrame([(1, v)], "k long, v long")
    for batch in range(4):
        kept.add(batch, one(10**batch))
    assert kept.read().first()["v"] == 1111
    kept.add(3, one(5000))
    assert kept.read().first()["v"] == 5111
    assert kept.before(3).first()["v"] == 111


def test_a_reader_keeps_its_version(spark, tmp_path):
    kept = store(spark, tmp_path, fan=2)
    one = spark.createDataFrame([(1, 1)], "k long, v long")
    for batch in range(4):
        kept.add(batch, one)
    early = kept.read(kept.latest())
    for batch in (4, 5):
        kept.add(batch, one)
    assert early.first()["v"] == 4 and kept.read().first()["v"] == 6


def test_a_broken_batch_changes_nothing(spark, tmp_path, monkeypatch):
    kept = store(spark, tmp_path)
    one = spark.createDataFrame([(1, 1)], "k long, v long")
    kept.add(0, one)
    with monkeypatch.context() as broken:
        broken.setattr(Store, "write_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.add(1, one)
    assert kept.read().first()["v"] == 1
    kept.add(1, one)
    assert kept.read().first()["v"] == 2


def answer_rows(rng, n):
    rows = []
    for k in range(n):
        audit, position, provider = rng.randint(0, 5), rng.randint(1, 4), rng.choice(["openai", "anthropic", "gemini"])
        body = f'{{"brand_mentioned": {rng.choice(["true", "false"])}, "mention_position": {rng.randint(0, 4)}, "mention_context": null, ' \
            f'"brand_citation_present": {rng.choice(["true", "false"])}, "sentiment": "{rng.choice(["positive", "negative"])}", "competitors_cited": [], "sources_cited": []}}'
        text = rng.choice(["Acme is here", "nothing", "Acmee", ""])
        rows.append((k, audit, position, provider, text, rng.choice([None, None, "HTTP 503"]), body, START + rng.randint(0, 30) * DAY))
    return rows


def test_late_answers_repair_the_scores(spark, tmp_path):
    """Files out of order by weeks, one a batch, with repeated answers: as the batch job on the first
    answer of each question."""
    rows = answer_rows(random.Random(5), 100)
    schema = "response_id long, audit_id long, position int, provider string, text string, error string, completion string, s long"
    source = str(tmp_path / "feed")
    for at in range(0, len(rows), 20):
        part = spark.createDataFrame(rows[at : at + 20], schema).withColumn("created_at", F.timestamp_seconds("s")).drop("s")
        part.coalesce(1).write.mode("append").parquet(source)
    brands = spark.createDataFrame([(a, "Acme", ["Acme Inc"]) for a in range(6)], "audit_id long, brand_name string, aliases array<string>")
    folder = str(tmp_path / "state")
    jobs.running_visibility(jobs.file_stream(spark, source, 1), brands, folder).awaitTermination()
    first = {}
    for r in rows:
        key = r[1:4]
        first[key] = min(first.get(key, r), r, key=lambda x: (x[7], x[0]))
    assert len(first) < len(rows)
    chosen = spark.createDataFrame(list(first.values()), schema)
    analyses = contracts.load_analyses(chosen.select("response_id", "completion"))
    want = visibility.visibility_scores(mentions.mention_results(chosen.drop("completion"), brands, analyses), "audit_id")
    got = jobs.visibility_so_far(spark, folder).orderBy("audit_id")
    assert got.collect() == want.select(*got.columns).orderBy("audit_id").collect()
    assert {r["response_id"] for r in jobs.answers_so_far(spark, folder).collect()} == {r[0] for r in first.values()}


def bodies(spark, folder, days):
    for d in days:
        rows = [(d * 10 + k, START + d * DAY + k, '{"url": "https://e%d.example/"}' % k) for k in range(3)]
        df = spark.createDataFrame(rows, "request_id long, s long, body string")
        df.select("request_id", F.timestamp_seconds("s").alias("requested_at"), "body").coalesce(1).write.mode("append").parquet(folder)


def admitted(spark, folder):
    return {r["request_id"]: r["admitted"] for r in jobs.requests_so_far(spark, folder).collect()}


def test_admission_reads_the_spend_that_another_job_keeps(spark, tmp_path):
    """The cap counts what the spend job has seen by then, and every batch's own reserve."""
    caps = costs.Caps(cap=10.0, warning=7.0, critical=8.0)
    usage, spend, feed, folder = (str(tmp_path / n) for n in ("usage", "spend", "feed", "state"))

    def spend_more(event, eur):
        df = spark.createDataFrame([(event, START + event, eur)], "event_id long, s long, eur string")
        df.select("event_id", F.timestamp_seconds("s").alias("created_at"), F.col("eur").cast("decimal(10,6)").alias("cost_eur")).write.mode("append").parquet(usage)
        jobs.spend_alerts(jobs.file_stream(spark, usage, 1), spend, caps).awaitTermination()

    def admit(day):
        bodies(spark, feed, [day])
        jobs.request_admission(jobs.file_stream(spark, feed, 1), jobs.spend_totals(spark, spend), folder, caps).awaitTermination()

    admit(0)  # nothing is spent: 3 x 1.30
    assert admitted(spark, folder) == {0: True, 1: True, 2: True}
    spend_more(1, "4.000000")
    admit(1)  # 4 + 3.9 reserved: one more fits
    assert [admitted(spark, folder)[10 + k] for k in range(3)] == [True, False, False]
    spend_more(2, "2.000000")
    admit(2)
    assert [admitted(spark, folder)[20 + k] for k in range(3)] == [False] * 3
    assert [r["level"] for r in jobs.alerts_so_far(spark, spend).collect()] == []
    spend_more(3, "2.500000")
    assert [r["level"] for r in jobs.alerts_so_far(spark, spend).collect()] == ["critical"]


def test_a_batch_decides_by_the_version_it_has_written_down(spark, tmp_path):
    totals = jobs.spend_totals(spark, str(tmp_path / "spend"))
    reserved = jobs.admission_stores(spark, str(tmp_path / "state"))[1]
    month = lambda eur: spark.createDataFrame([(START, eur)], "s long, e string").select(F.timestamp_seconds("s").alias("month"), F.col("e").cast("decimal(28,6)").alias("total_eur"))
    assert jobs.spend_version(totals, reserved, 0) is None
    totals.add(0, month("1"))
    assert jobs.spend_version(totals, reserved, 0) is None  # as when it first ran
    assert jobs.spend_version(totals, reserved, 1) == 0
    totals.add(1, month("2"))
    assert jobs.spend_version(totals, reserved, 1) == 0
    assert jobs.spend_version(totals, reserved, 2) == 1


def test_views_of_the_user_stay(spark, sf):
    spark.range(1).createOrReplaceTempView("events")
    streams._view_stream(spark, sf, "events", "SELECT user_id FROM events")
    assert spark.table("events").columns == ["id"]
    spark.catalog.dropTempView("events")
