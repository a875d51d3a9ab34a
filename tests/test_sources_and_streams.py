"""Captures, resources, writers and the streaming jobs."""

import pytest
from pyspark.sql import functions as F

from geovis.operators import costs, sitemaps
from geovis.plans import catalog
from geovis.plans import streams
from geovis.sources import captures, sinks
from geovis.streaming import jobs

LONG = "<html lang='x'><head><title>t</title></head><body>" + "mot " * 200 + "</body></html>"
SHELL = "<html lang='fr'><head><title>d</title></head><body><div id=\"root\"></div></body></html>"
D, R, H = "fetch", "jina", "browserless"

CHOICES = [
    ([(D, True, LONG), (R, True, LONG)], D), ([(D, True, SHELL), (R, True, LONG)], R), ([(D, False, ""), (R, True, LONG)], R),
    ([(D, True, SHELL), (R, True, "<body>x</body>"), (H, True, LONG)], H), ([(D, True, SHELL), (R, False, ""), (H, False, "")], D),
    ([(D, False, ""), (R, True, "short"), (H, False, "")], R), ([(D, False, ""), (R, False, ""), (H, False, "")], H),
]


@pytest.mark.parametrize("rows, want", CHOICES)
def test_capture_choice(spark, rows, want):
    data = [("u", m, ok, 200 if ok else 0, html, {"h": m, m: "1"}) for m, ok, html in rows]
    df = spark.createDataFrame(data, "url string, method string, ok boolean, status int, html string, headers map<string,string>")
    assert captures.choose_capture(df).first()["method"] == want
    assert captures.choose_capture(df, allow_rendered=False).first()["method"] == D


def test_merged_capture(spark):
    data = [("u", D, True, 201, SHELL, {"a": "d", "b": "d"}), ("u", R, True, 200, LONG, {"b": "r"})]
    df = spark.createDataFrame(data, "url string, method string, ok boolean, status int, html string, headers map<string,string>")
    row = captures.choose_capture(df).first()
    assert row["status"] == 201 and row["headers"] == {"a": "d", "b": "r"}
    assert row["html"].startswith("<!DOCTYPE html><html lang='fr'><head><title>d</title></head><body>mot ")


def test_resources(spark):
    rows = [(1, "robots", 404, "x"), (1, "sitemap", 500, "body"), (1, "llms", None, None), (2, "robots", 410, "x"), (2, "llms", 200, "")]
    df = spark.createDataFrame(rows, "site_id int, kind string, status int, content string")
    got = {r["site_id"]: r for r in captures.site_resources(df).collect()}
    assert (got[1]["robots_txt"], got[1]["robots_status"], got[1]["sitemap_xml"], got[1]["llms_txt"]) == (None, 404, "body", None)
    assert (got[2]["robots_txt"], got[2]["llms_txt"]) == (None, "")


def test_sitemaps(spark, value):
    xml = "<urlset><url><loc> http://h/a </loc><lastmod>2024-05-01</lastmod></url><URL><loc>http://h/a/b/c/d</loc><lastmod>soon</lastmod></URL><url></url></urlset>"
    e = sitemaps.entries(F.lit(xml))
    assert [tuple(x) for x in value(e)] == [("http://h/a", "2024-05-01"), ("http://h/a/b/c/d", "soon")]
    assert tuple(value(sitemaps.depth_stats(e))) == (4, 2.5)
    assert value(sitemaps.recent_count(e, F.lit("2024-06-01").cast("timestamp"))) == 1
    index = "<sitemapindex><sitemap><loc>http://h/1.xml</loc></sitemap></sitemapindex>"
    assert value(sitemaps.children(F.lit(index))) == ["http://h/1.xml"] and value(sitemaps.entries(F.lit(index))) == []


def test_tables_round_trip(spark, sf, tmp_path):
    ledger = catalog._usage(spark, sf)
    sinks.write_tables({"api_usage": ledger}, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/api_usage")
    assert back.count() == ledger.count()
    assert costs.month_to_date(back, "2024-01-20T00:00:00").first() == costs.month_to_date(ledger, "2024-01-20T00:00:00").first()
    with pytest.raises(ValueError):
        sinks.write_tables({"other": ledger}, str(tmp_path))


def test_records_are_foldered_by_day_and_domain(spark, tmp_path):
    df = spark.createDataFrame([("https://a.b.fr/x", "2024-05-01 10:00:00", [1, 2])], "url string, fetched_at string, list array<int>")
    sinks.write_records(df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (str(row["day"]), row["domain"], row["list"]) == ("2024-05-01", "a_b_fr", [1, 2])


def test_spend_alerts_over_many_batches_equal_one_batch_job(spark, sf, tmp_path):
    """Totals are carried from batch to batch, and each crossing is reported once."""
    caps = costs.Caps(cap=6.0, warning=1.0, critical=2.0)
    usage = catalog._usage(spark, sf).select("event_id", "created_at", "cost_eur")
    source = str(tmp_path / "feed")
    for part in range(4):
        usage.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(source)
    folder = str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        jobs.spend_alerts(jobs.file_stream(spark, source, 1), folder, caps).awaitTermination()
    columns = ["event_id", "level", "before_eur", "after_eur"]
    got = jobs.alerts_so_far(spark, folder).select(*columns).orderBy("event_id").collect()
    want = costs.threshold_crossings(usage, caps).select(*columns).orderBy("event_id").collect()
    assert got == want and len(got) == 2


def test_rate_windows_count_events_of_late_files(spark, tmp_path, monkeypatch):
    """Files out of time order, one per batch, give the windows of the whole table."""
    start = 1_704_067_200
    rows = [(k, f"u{k % 3}", "click", start + 86_400 * day + 1_700 * k) for day in (9, 0, 5, 1) for k in range(20)]
    for at in range(0, len(rows), 20):
        part = spark.createDataFrame(rows[at : at + 20], "event_id long, user_id string, event_type string, s long")
        part.select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "file_stream", lambda spark, path: jobs.file_stream(spark, path, 1))
    want = {}
    for _, user, _, s in rows:
        for end in (s // 1800 * 1800 + 1800, s // 1800 * 1800 + 3600):
            want[user, "click", end] = want.get((user, "click", end), 0) + 1
    got = [tuple(r) for r in streams.rate_windows_query(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want


def test_running_visibility_equals_batch(spark, sf):
    got = streams.visibility_query(spark, sf).orderBy("audit_id")
    assert got.collect() == catalog.visibility_scores(spark, sf).select(*got.columns).orderBy("audit_id").collect()


def test_plans_keep_filters_at_the_scan_and_avoid_pair_joins(spark, sf, tmp_path):
    sinks.write_tables({"api_usage": catalog._usage(spark, sf)}, str(tmp_path))
    plan = costs.month_to_date(spark.read.parquet(f"{tmp_path}/api_usage"), "2024-01-20T00:00:00")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in text and "usage_month" in text.split("PartitionFilters: [")[1].split("]")[0]
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "cost_eur" in schema and "created_at" in schema and "model" not in schema
    for name in ("technical_scores", "mention_report", "threshold_crossings", "question_tasks", "owned_analyses"):
        text = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    top = catalog.top_competitors(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top and top.count("WindowGroupLimit") == 2
