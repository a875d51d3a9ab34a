"""Usage ledger: call costs, month totals, budget ladder, threshold crossings, admission.

`usage` rows: event_id BIGINT (unique), user_id, audit_id, provider, model, tokens_in,
tokens_out, actual_cost_usd, request_type, created_at TIMESTAMP.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geovis.functions import money as M

LEDGER_TYPE = "decimal(10,6)"

# Rows with the same instant are told apart by chunks of their id when a crossing is located.
ID_CHUNK = 1 << 20


@dataclass(frozen=True)
class Caps:
    """Monthly limits in euro and the expected cost of one audit."""

    cap: float = 90.0
    warning: float = 70.0
    critical: float = 85.0
    audit_cost: float = 1.30
    anomaly_factor: float = 3.0


def _money(value: float) -> Column:
    return F.lit(str(value)).cast("decimal(12,6)")


def price_table(spark: SparkSession, rows=None) -> DataFrame:
    """(provider, model, price_in, price_out, fee) in USD; ten rows from the price list."""
    texts = spark.createDataFrame(
        rows or M.PRICES, "provider string, model string, price_in string, price_out string, fee string"
    )
    return texts.select(
        "provider", "model", *[F.col(c).cast("decimal(8,4)").alias(c) for c in ("price_in", "price_out", "fee")]
    )


def price_calls(usage: DataFrame, prices: DataFrame, rate: str = M.USD_TO_EUR) -> DataFrame:
    """Add cost_usd, cost_eur and `priced`: a reported cost above zero stands, else the price
    list, else zero. Costs are exact decimals until they are stored with six places."""
    joined = usage.join(prices, ["provider", "model"], "left")
    listed = M.token_cost(
        F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"), F.col("fee")
    )
    reported = F.when(F.col("actual_cost_usd") > 0, F.col("actual_cost_usd").cast("decimal(18,9)"))
    usd = F.coalesce(reported, listed, F.lit("0").cast("decimal(18,9)")).cast("decimal(28,14)")
    return (
        joined.withColumn("_usd", usd)
        .withColumn("priced", reported.isNotNull() | F.col("price_in").isNotNull())
        .withColumn("cost_usd", F.col("_usd").cast(LEDGER_TYPE))
        .withColumn("cost_eur", M.to_eur(F.col("_usd"), rate).cast(LEDGER_TYPE))
        .drop("_usd", "price_in", "price_out", "fee")
    )


def unpriced_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(provider, model, calls) of calls without reported cost whose model is not in the list."""
    silent = usage.filter(F.coalesce(F.col("actual_cost_usd"), F.lit(0.0)) <= 0)
    calls = silent.groupBy("provider", "model").agg(F.count("*").alias("calls"))
    return calls.join(prices, ["provider", "model"], "left_anti")


def month_to_date(ledger: DataFrame, now: str) -> DataFrame:
    """One row (month, total_eur): spend from the first instant of the month of `now` up to `now`,
    in UTC. Both bounds reach the Parquet scan as filters, and a ledger stored by month is read
    from that month's folder alone."""
    end = F.lit(now).cast("timestamp")
    start = F.date_trunc("month", end)
    if "usage_month" in ledger.columns:
        ledger = ledger.filter(F.col("usage_month") == F.date_format(start, "yyyy-MM"))
    rows = ledger.select("created_at", "cost_eur").filter(F.col("created_at").between(start, end))
    total = F.coalesce(F.sum("cost_eur"), F.lit("0").cast("decimal(20,6)"))
    return rows.agg(total.alias("total_eur")).select(start.alias("month"), "total_eur")


def budget_columns(total: Column, caps: Caps = Caps()) -> dict[str, Column]:
    return {
        "remaining_eur": F.greatest(F.lit(0).cast("decimal(20,6)"), _money(caps.cap) - total),
        "alert_level": F.when(total >= _money(caps.cap), "blocked")
        .when(total >= _money(caps.critical), "critical")
        .when(total >= _money(caps.warning), "warning")
        .otherwise("ok"),
        "can_run_audit": total + _money(caps.audit_cost) <= _money(caps.cap),
    }


def budget_status(ledger: DataFrame, now: str, caps: Caps = Caps()) -> DataFrame:
    """One row: month, total_eur, remaining_eur, alert_level, can_run_audit."""
    return month_to_date(ledger, now).withColumns(budget_columns(F.col("total_eur"), caps))


def monthly_totals(ledger: DataFrame) -> DataFrame:
    """(month, total_eur) over all months."""
    return ledger.groupBy(M.month_start(F.col("created_at")).alias("month")).agg(
        F.sum("cost_eur").alias("total_eur")
    )


def monthly_rollup(ledger: DataFrame) -> DataFrame:
    """Per user and month: calls, tokens and costs. Rows without a user are left out."""
    return (
        ledger.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", M.month_start(F.col("created_at")).alias("month"))
        .agg(
            F.count("*").alias("call_count"),
            F.sum("tokens_in").alias("total_tokens_in"),
            F.sum("tokens_out").alias("total_tokens_out"),
            F.sum("cost_usd").alias("total_cost_usd"),
            F.sum("cost_eur").alias("total_cost_eur"),
        )
    )


# What a call can be made for.
REQUEST_TYPES = [
    "brand_extraction", "queries_generation", "visibility_query", "mention_analysis", "synthesis",
]


def audit_costs(ledger: DataFrame) -> DataFrame:
    """(audit_id, one cost column per request type, total_eur, calls). One shuffle of partial
    sums instead of a pivot."""
    zero = F.lit("0").cast("decimal(20,6)")
    phases = [
        F.coalesce(F.sum(F.when(F.col("request_type") == t, F.col("cost_eur"))), zero).alias(f"{t}_eur")
        for t in REQUEST_TYPES
    ]
    return ledger.groupBy("audit_id").agg(
        *phases, F.sum("cost_eur").alias("total_eur"), F.count("*").alias("calls")
    )


def cost_anomalies(ledger: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Audits that cost more than three times the estimate."""
    limit = _money(caps.audit_cost) * _money(caps.anomaly_factor)
    return audit_costs(ledger).select("audit_id", "total_eur").filter(F.col("total_eur") > limit)


def _levels(caps: Caps) -> Column:
    return F.array(
        F.struct(F.lit("warning").alias("level"), _money(caps.warning).alias("limit")),
        F.struct(F.lit("critical").alias("level"), _money(caps.critical).alias("limit")),
    )


def _on_driver(few: DataFrame) -> DataFrame:
    """A few rows without their lineage. Instants travel as numbers, so that no time zone of the
    driver touches them."""
    times = [f.name for f in few.schema.fields if f.dataType.typeName() == "timestamp"]
    plain = few.withColumns({t: F.unix_micros(t) for t in times})
    back = few.sparkSession.createDataFrame(plain.collect(), plain.schema)
    return back.withColumns({t: F.timestamp_micros(t) for t in times})


def _of_minutes(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """The ledger rows of a few minutes: outer bounds and months for the scan to prune by, and a
    set of minutes."""
    minute = F.floor(F.unix_micros("minute") / 60_000_000)
    rows = found.select(minute.alias("at"), F.date_format("minute", "yyyy-MM").alias("month")).distinct().collect()
    if not rows:
        return ledger.filter(F.lit(False))
    at = sorted({r["at"] for r in rows})
    first, behind = (F.timestamp_seconds(F.lit(60 * m)) for m in (at[0], at[-1] + 1))
    if "usage_month" in ledger.columns:
        ledger = ledger.filter(F.col("usage_month").isin(sorted({r["month"] for r in rows})))
    own = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 60_000_000)
    return ledger.filter((F.col("created_at") >= first) & (F.col("created_at") < behind) & own.isin(at))


def threshold_crossings(
    ledger: DataFrame, caps: Caps = Caps(), opening: DataFrame | None = None
) -> DataFrame:
    """The ledger rows that push a month's running total over a limit:
    (month, event_id, created_at, before_eur, after_eur, level). A row that crosses both limits
    counts as critical only. `opening` (month, total_eur) holds totals from before `ledger`.

    A month may hold most of the ledger, so no window ever covers a month's rows. The crossing
    is located top down: sums per minute, then per instant inside the crossing minute, then per
    id chunk inside the crossing instant, then rows. Each step sums map-side and keeps one group
    per (month, limit), so a window sees at most the minutes of a month, the instants of a
    minute, or one chunk of ids. Costs are not negative, so each limit is crossed once.

    The ledger is read in full once, for the sums per minute. What a step has located, at most
    two rows per calendar month, comes to the driver, and the later steps read the crossing
    minutes alone: their outer bounds and months reach the scan as filters.
    """

    def within(part: DataFrame) -> DataFrame:
        return part.filter(F.col("cost_eur") > 0).select(
            M.month_start(F.col("created_at")).alias("month"),
            F.date_trunc("minute", "created_at").alias("minute"),
            "created_at",
            F.floor(F.col("event_id") / F.lit(ID_CHUNK)).alias("chunk"),
            "event_id",
            "cost_eur",
        )

    rows = within(ledger)
    steps = ["minute", "created_at", "chunk", "event_id"]
    start = F.lit("0").cast("decimal(28,6)")
    found = None
    for depth, step in enumerate(steps):
        parents = ["month", *steps[:depth]]
        if found is None:
            sums = rows.groupBy("month", step).agg(F.sum("cost_eur").alias("part"))
            if opening is not None:
                sums = sums.join(opening.withColumnRenamed("total_eur", "base"), "month", "left")
            else:
                sums = sums.withColumn("base", start)
            sums = sums.select(
                "month", step, "part", F.coalesce("base", start).cast("decimal(28,6)").alias("base"),
                F.explode(_levels(caps)).alias("l"),
            ).select("month", step, "part", "base", "l.level", "l.limit")
        else:
            # at most two rows per calendar month
            sums = (
                rows.join(F.broadcast(found), parents)
                .groupBy(*parents, "level", "limit", "base", step)
                .agg(F.sum("cost_eur").alias("part"))
            )
        # one group per month and limit: the parents are the same for all of its rows
        order = Window.partitionBy("month", "level").orderBy(step)
        running = F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0))
        after = (F.col("base") + running).cast("decimal(28,6)")
        located = (
            sums.withColumn("after", after)
            .withColumn("before", (F.col("after") - F.col("part")).cast("decimal(28,6)"))
            .filter((F.col("before") < F.col("limit")) & (F.col("after") >= F.col("limit")))
        )
        if step == steps[-1]:
            found = located.select(*parents, step, "level", "before", "after")
        else:
            kept = located.select(*parents, step, "level", "limit", F.col("before").alias("base"))
            found = _on_driver(kept)
            if step == "minute":
                rows = within(_of_minutes(ledger, found))
    return (
        found.groupBy("month", "event_id", "created_at")
        .agg(
            F.first("before").cast("decimal(20,6)").alias("before_eur"),
            F.first("after").cast("decimal(20,6)").alias("after_eur"),
            F.min("level").alias("level"),  # "critical" sorts before "warning"
        )
    )


def admit_requests(
    requests: DataFrame, opening: DataFrame, caps: Caps = Caps(), ledger: DataFrame | None = None
) -> DataFrame:
    """Requests (request_id, requested_at, month) with `admitted`: in time order, each admitted
    request reserves the expected cost, and a request whose projection exceeds the cap is refused.
    The projection is the spend so far: `opening` (month, total_eur), and of `ledger` (created_at,
    cost_eur) what was spent in the month before the request.

    Neither spend nor reserves shrink, so after the first refusal a month refuses all. A month
    without spend admits the first n requests, with n known from the caps in exact decimals, so
    ranks are needed only up to n, which Spark applies as a limit per month before the shuffle;
    the other rows never reach a window. The ledger is summed between the instants of those
    requests, in one pass with partial sums.
    """
    most = int(Decimal(str(caps.cap)) // Decimal(str(caps.audit_cost)))
    order = Window.partitionBy("month").orderBy("requested_at", "request_id")
    ranked = requests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    zero = F.lit("0").cast("decimal(28,6)")
    base = opening.select("month", F.col("total_eur").cast("decimal(28,6)").alias("base"))
    spent = ranked.select("month", "requested_at", "request_id", "rank").join(base, "month", "left")
    if ledger is None:
        spent = spent.withColumn("spent", F.coalesce("base", zero))
    else:
        # one row per calendar day, which hold at most n instants of a month between them
        of_day = F.date_trunc("day", "requested_at").alias("day")
        days = ranked.groupBy("month", of_day).agg(F.array_sort(F.collect_list("requested_at")).alias("instants"))
        whole = ranked.select("month").distinct().select(
            "month", F.explode(F.sequence("month", F.date_trunc("day", F.last_day("month").cast("timestamp")), F.expr("INTERVAL 1 DAY"))).alias("day")
        )
        none = F.array().cast("array<timestamp>")
        earlier = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        calendar = whole.join(days, ["month", "day"], "left").withColumn("instants", F.coalesce("instants", none))
        calendar = calendar.withColumn("earlier", F.coalesce(F.sum(F.size("instants")).over(earlier), F.lit(0)))
        dated = ledger.select(
            M.month_start(F.col("created_at")).alias("month"), F.date_trunc("day", "created_at").alias("day"), "created_at", "cost_eur"
        )
        slotted = dated.join(F.broadcast(calendar), ["month", "day"]).select(
            "month", "cost_eur", (F.col("earlier") + F.size(F.filter("instants", lambda t: t <= F.col("created_at")))).alias("slot")
        )
        parts = slotted.groupBy("month", "slot").agg(F.sum("cost_eur").alias("part")).withColumnRenamed("month", "part_month")
        before = (F.col("month") == F.col("part_month")) & (F.col("slot") < F.col("rank"))
        spent = (
            spent.join(parts, before, "left").groupBy("month", "requested_at", "request_id", "rank")
            .agg((F.coalesce(F.first("base"), zero) + F.coalesce(F.sum("part"), zero)).alias("spent"))
        )
    last = (
        spent.filter(F.col("spent") + F.col("rank") * _money(caps.audit_cost) <= _money(caps.cap))
        .groupBy("month")
        .agg(F.max(F.struct("requested_at", "request_id")).alias("last"))
    )
    key = F.struct("requested_at", "request_id")
    return (  # one row per calendar month
        requests.join(F.broadcast(last), "month", "left")
        .withColumn("admitted", F.coalesce(key <= F.col("last"), F.lit(False)))
        .drop("last")
    )
