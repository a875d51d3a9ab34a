from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from geovis.functions import money as M
from geovis.operators import costs

def ledger(spark, amounts, start=datetime(2024, 3, 1), step=timedelta(hours=1)):
    rows = [(i, start + i * step, Decimal(str(a))) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, "event_id bigint, created_at timestamp, cost_eur decimal(10,6)")


@pytest.mark.parametrize(
    "tin, tout, price, want",
    [(1000, 500, ("1.0", "5.0", None), 0.0035), (500, 500, ("1.0", "1.0", "0.005"), 0.006)],
)
def test_token_cost(value, tin, tout, price, want):
    p = [F.lit(x).cast("decimal(8,4)") for x in price]
    assert float(value(M.token_cost(F.lit(tin), F.lit(tout), *p))) == pytest.approx(want)


def test_euro_rate(value):
    assert float(value(M.to_eur(F.lit("1").cast("decimal(10,6)")))) == pytest.approx(0.92)
    assert float(value(M.to_eur(F.lit("0.5").cast("decimal(10,6)")))) == pytest.approx(0.46)


def test_call_cost_sources(spark):
    usage = spark.createDataFrame(
        [
            ("openai", "gpt-4.1", 1000, 1000, 0.0, 1),
            ("openai", "openai/gpt-4o", 1000, 1000, 0.0, 2),
            ("openai", "openai/gpt-4o", 1000, 1000, 0.5, 3),
        ],
        "provider string, model string, tokens_in bigint, tokens_out bigint, actual_cost_usd double, n int",
    )
    prices = costs.price_table(spark)
    rows = {r["n"]: r for r in costs.price_calls(usage, prices).collect()}
    assert float(rows[1]["cost_usd"]) == pytest.approx(0.01) and rows[1]["priced"]
    assert float(rows[2]["cost_usd"]) == 0 and not rows[2]["priced"]
    assert float(rows[3]["cost_eur"]) == pytest.approx(0.46) and rows[3]["priced"]
    assert [tuple(r) for r in costs.unpriced_models(usage, prices).collect()] == [("openai", "openai/gpt-4o", 1)]


def test_month_to_date(spark):
    march = ledger(spark, [0.3, 0.5, 0.4, 0.1])
    assert float(costs.month_to_date(march, "2024-03-20T00:00:00").first()["total_eur"]) == pytest.approx(1.3)
    assert float(costs.month_to_date(march, "2024-04-02T00:00:00").first()["total_eur"]) == 0


@pytest.mark.parametrize(
    "total, level, can_run",
    [
        (50, "ok", True), (69.99, "ok", True), (70, "warning", True), (70.5, "warning", True), (85, "critical", True),
        (85.5, "critical", True), (88.7, "critical", True), (89, "critical", False), (90, "blocked", False), (90.5, "blocked", False),
    ],
)
def test_budget_ladder(spark, total, level, can_run):
    row = costs.budget_status(ledger(spark, [total]), "2024-03-20T00:00:00").first()
    assert (row["alert_level"], row["can_run_audit"]) == (level, can_run)
    assert float(row["remaining_eur"]) == pytest.approx(max(0, 90 - total))


def test_custom_cap(spark):
    row = costs.budget_status(ledger(spark, [49]), "2024-03-20T00:00:00", costs.Caps(cap=50)).first()
    assert not row["can_run_audit"]


@pytest.mark.parametrize(
    "before, after, want",
    [(69, 71, "warning"), (84, 86, "critical"), (69, 86, "critical"), (50, 51, None), (71, 72, None), (69, 70, "warning")],
)
def test_crossing(spark, before, after, want):
    rows = costs.threshold_crossings(ledger(spark, [before, after - before])).filter("event_id = 1").collect()
    assert [r["level"] for r in rows] == ([want] if want else [])


def brute_crossings(rows, caps):
    out, totals = set(), {}
    for event_id, ts, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        month = ts.strftime("%Y-%m")
        before = totals.get(month, 0)
        after = totals[month] = before + cost
        if before < caps.critical <= after:
            out.add((month, event_id, "critical"))
        elif before < caps.warning <= after:
            out.add((month, event_id, "warning"))
    return out


def test_crossings_in_hot_months_minutes_and_instants(spark, monkeypatch):
    """Most rows share one minute, many one instant; small id chunks force every step."""
    monkeypatch.setattr(costs, "ID_CHUNK", 8)
    caps = costs.Caps(cap=100, warning=30, critical=60)
    base = datetime(2024, 5, 10, 12, 0)
    rows = [(i, base if i % 3 else base + timedelta(microseconds=i), 1) for i in range(100)]
    rows += [(1000 + i, datetime(2024, 6, 1) + timedelta(days=i), 7) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id bigint, created_at timestamp, cost_eur int").withColumn(
        "cost_eur", F.col("cost_eur").cast("decimal(10,6)")
    )
    got = costs.threshold_crossings(df, caps).select(F.date_format("month", "yyyy-MM"), "event_id", "level").collect()
    assert {tuple(r) for r in got} == brute_crossings(rows, caps)


def test_crossing_on_top_of_an_opening_balance(spark):
    opening = spark.createDataFrame([(datetime(2024, 3, 1), 69.5)], "month timestamp, total_eur double").withColumn(
        "total_eur", F.col("total_eur").cast("decimal(28,6)")
    )
    rows = costs.threshold_crossings(ledger(spark, [0.2, 0.4]), opening=opening).collect()
    assert [(r["event_id"], r["level"]) for r in rows] == [(1, "warning")]


def test_admission_reserves_in_time_order(spark):
    start = datetime(2024, 3, 5)
    asked = spark.createDataFrame(
        [(i, start + timedelta(minutes=i), datetime(2024, 3, 1)) for i in range(6)],
        "request_id bigint, requested_at timestamp, month timestamp",
    )
    spent = spark.createDataFrame([(datetime(2024, 3, 1), "86.0")], "month timestamp, t string").select(
        "month", F.col("t").cast("decimal(20,6)").alias("total_eur")
    )
    rows = costs.admit_requests(asked, spent).orderBy("request_id").collect()
    assert [r["admitted"] for r in rows] == [True, True, True, False, False, False]


def test_display(value):
    assert value(M.euro_text(F.lit("1234.5").cast("decimal(10,2)"))) == "1 234,50 €"
    assert value(M.date_text(F.lit("2026-04-30").cast("timestamp"))) == "30 avril 2026"


@pytest.mark.parametrize(
    "model, provider", [("openai/x", "openai"), ("google/y", "gemini"), ("perplexity/s", "perplexity"), ("odd", "openai")]
)
def test_model_provider(value, model, provider):
    assert value(M.model_provider(F.lit(model))) == provider


def asked_at(spark, minutes):
    start = datetime(2024, 3, 5)
    rows = [(i, start + timedelta(minutes=m), datetime(2024, 3, 1)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "request_id bigint, requested_at timestamp, month timestamp")


def spent_at(spark, rows):
    start = datetime(2024, 3, 5)
    df = spark.createDataFrame([(start + timedelta(minutes=m), c) for m, c in rows], "created_at timestamp, cost_eur string")
    return df.withColumn("cost_eur", F.col("cost_eur").cast("decimal(10,6)"))


@pytest.mark.parametrize("cap", [3.9, 6.5, 7.8, 9.1, 11.7, 13.0, 15.6])
def test_admission_counts_in_exact_decimals(spark, cap):
    none = spark.createDataFrame([], "month timestamp, total_eur decimal(20,6)")
    rows = costs.admit_requests(asked_at(spark, range(20)), none, costs.Caps(cap=cap)).filter("admitted").count()
    assert rows == round(cap / 1.3)


def test_admission_sees_the_spend_before_a_request(spark):
    none = spark.createDataFrame([], "month timestamp, total_eur decimal(20,6)")
    spent = spent_at(spark, [(-100, "1.0"), (2, "5.0"), (500, "80.0")])
    rows = costs.admit_requests(asked_at(spark, [0, 1, 2, 3, 4, 600]), none, costs.Caps(cap=10.0), spent).orderBy("request_id").collect()
    # 1 + 1.3 k up to the third request, whose instant is not before the spend of 5; then 6 + 1.3 k.
    assert [r["admitted"] for r in rows] == [True, True, True, False, False, False]


def test_month_to_date_stops_at_now(spark):
    january = spark.createDataFrame([(datetime(2024, 1, 10), "1.0"), (datetime(2024, 2, 10), "5.0"), (datetime(2024, 1, 21), "2.0")], "created_at timestamp, cost_eur string")
    rows = january.withColumn("cost_eur", F.col("cost_eur").cast("decimal(10,6)"))
    assert float(costs.month_to_date(rows, "2024-01-20T00:00:00").first()["total_eur"]) == 1.0
