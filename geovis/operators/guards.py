"""Rate limits, row ownership and integrity rules over the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geovis import schemas

MICROS = 1_000_000
BUCKET_SECONDS = 60


def rate_limited(events: DataFrame, maximum: int, minutes: int, now: str) -> DataFrame:
    """State at one instant: (ip, action, hits, limited) of the keys with events in the window.
    Events after `now` do not exist yet and are left out."""
    instant = F.lit(now).cast("timestamp")
    recent = events.filter(
        (F.col("created_at") > instant - F.expr(f"INTERVAL {minutes} MINUTES"))
        & (F.col("created_at") <= instant)
    )
    return (
        recent.groupBy("ip", "action")
        .agg(F.count("*").alias("hits"))
        .withColumn("limited", F.col("hits") >= maximum)
    )


def rate_history(events: DataFrame, maximum: int, minutes: int) -> DataFrame:
    """State after every event: (ip, action, created_at, new_hits, hits, limited), where `hits`
    counts the key's events newer than `created_at` minus the window, that instant included.

    An event adds one at its instant and takes one away when it leaves the window, so the count
    is a running sum of changes. One key may hold most events: changes are summed per instant
    map-side, the running sum is cut into one-minute buckets, and a bucket starts from the sum
    of the buckets before it. A window over a key sees buckets, a window over a bucket sees
    instants; neither sees a key's events.
    """
    width = minutes * 60 * MICROS
    per_instant = events.groupBy("ip", "action", F.unix_micros("created_at").alias("us")).agg(
        F.count("*").alias("n")
    )
    changes = per_instant.select(
        "ip", "action",
        F.inline(
            F.array(
                F.struct(F.col("us").alias("us"), F.col("n").alias("delta"), F.col("n").alias("new_hits")),
                F.struct((F.col("us") + F.lit(width)).alias("us"), (-F.col("n")).alias("delta"), F.lit(0).cast("bigint").alias("new_hits")),
            )
        ),
    ).withColumn("bucket", F.floor(F.col("us") / F.lit(BUCKET_SECONDS * MICROS)))
    # an instant where one event enters as another leaves is a single change
    changes = changes.groupBy("ip", "action", "bucket", "us").agg(
        F.sum("delta").alias("delta"), F.sum("new_hits").alias("new_hits")
    )
    by_bucket = Window.partitionBy("ip", "action").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        changes.groupBy("ip", "action", "bucket")
        .agg(F.sum("delta").alias("part"))
        .select("ip", "action", "bucket", F.coalesce(F.sum("part").over(by_bucket), F.lit(0)).alias("opening"))
    )
    inside = Window.partitionBy("ip", "action", "bucket").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.withColumn("running", F.sum("delta").over(inside))
        .join(opening, ["ip", "action", "bucket"])
        .filter(F.col("new_hits") > 0)
        .select(
            "ip", "action", F.timestamp_micros("us").alias("created_at"), "new_hits",
            (F.col("opening") + F.col("running")).alias("hits"),
        )
        .withColumn("limited", F.col("hits") >= maximum)
    )


def owned_audits(audits: DataFrame, user) -> DataFrame:
    """Ids of the audits of one user."""
    return audits.filter(F.col("user_id") == user).select(F.col("id").alias("audit_id"))


def scoped(rows: DataFrame, audits: DataFrame, user) -> DataFrame:
    """Rows of a table with audit_id that the user may see."""
    return rows.join(owned_audits(audits, user), "audit_id", "left_semi")


def scoped_responses(responses: DataFrame, queries: DataFrame, audits: DataFrame, user) -> DataFrame:
    """Answers the user may see, through their question."""
    own = scoped(queries, audits, user).select(F.col("id").alias("query_id"))
    return responses.join(own, "query_id", "left_semi")


def scoped_analyses(
    analyses: DataFrame, responses: DataFrame, queries: DataFrame, audits: DataFrame, user
) -> DataFrame:
    """Analyses the user may see, through answer and question."""
    own = scoped_responses(responses, queries, audits, user).select(F.col("id").alias("response_id"))
    return analyses.join(own, "response_id", "left_semi")


def own_rows(rows: DataFrame, user, column: str = "user_id") -> DataFrame:
    """Rows that carry the user's own id."""
    return rows.filter(F.col(column) == user)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def out_of_range(rows: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value is missing or outside [low, high]."""
    return rows.filter(F.col(column).isNull() | ~F.col(column).between(low, high))


def not_in(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is set but not one of the allowed names."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def orphans(children: DataFrame, parents: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    return children.join(
        parents.select(F.col(parent_key).alias(column)), column, "left_anti"
    )


def table_violations(rows: DataFrame, table: str) -> DataFrame:
    """(rule, violations) of one stored table against its allowed values, ranges and unique keys,
    counted in one pass plus one aggregation for the keys."""
    counts = {}
    for (name, column), allowed in schemas.ALLOWED.items():
        if name == table:
            counts[f"{column} not allowed"] = F.count_if(~F.col(column).isin(*allowed))
    for (name, column), (low, high) in schemas.RANGES.items():
        if name == table:
            counts[f"{column} out of range"] = F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(False)))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("violations")) for r, c in counts.items()])
    out = rows.agg(listed.alias("r")).select(F.inline("r")) if counts else None
    if table in schemas.UNIQUE:
        keys = schemas.UNIQUE[table]
        doubled = duplicate_keys(rows, *keys).agg(F.count("*").alias("violations"))
        doubled = doubled.select(F.lit(f"{', '.join(keys)} not unique").alias("rule"), "violations")
        out = doubled if out is None else out.unionByName(doubled)
    if out is None:
        raise ValueError(f"no rules for {table}")
    return out


def rules_of(table: str, columns: list[str]) -> dict[str, tuple[str, str]]:
    """rule name: (kind, column) for the rules of schemas.py that a table with these columns has."""
    kinds = (("not allowed", schemas.ALLOWED), ("out of range", schemas.RANGES), ("without parent", schemas.PARENTS))
    return {f"{column} {kind}": (kind, column) for kind, rules in kinds for name, column in rules if name == table and column in columns}


def broken(table: str, kind: str, column: str) -> Column:
    """Whether a row breaks a rule. Only a range forbids a missing value."""
    value = F.col(column)
    if kind == "not allowed":
        return value.isNotNull() & ~value.isin(*schemas.ALLOWED[table, column])
    if kind == "out of range":
        return ~F.coalesce(value.between(*schemas.RANGES[table, column]), F.lit(False))
    return value.isNotNull() & F.col(f"_{column}_parent").isNull()


# A task of this many rows holds their keys in some hundred megabytes.
ROWS_PER_TASK = 1_000_000


def by_key(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The rows dealt by key over exactly as many tasks. Partitions of any other shuffle would be merged
    by their compressed bytes, until one task holds many millions of keys."""
    return rows.repartition(tasks, *keys)


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations) of the stored tables against all rules of schemas.py.

    Each table is read once for all its rules: parent keys are met by left joins on distinct keys, the
    broken rules of a row become numbers, and one aggregate adds them up. Where keys have to be
    unique the same aggregate is grouped by them first; a key that is there more than once is one
    violation. A rule is left out where the table lacks its column or its parent table is not given.

    Joins and groups run in tasks of a bounded number of rows. Only the parents' distinct keys are held,
    the rows stream past them, so that many rows with one key or none take no more memory.
    """
    sizes = {table: rows.count() for table, rows in tables.items()}
    tasks = lambda *names: max(-(-sum(sizes[n] for n in names) // ROWS_PER_TASK), tables[names[0]].sparkSession.sparkContext.defaultParallelism)
    out = None
    for table, rows in tables.items():
        rules = {r: k for r, k in rules_of(table, rows.columns).items() if k[0] != "without parent" or schemas.PARENTS[table, k[1]][0] in tables}
        keys = [k for k in schemas.UNIQUE.get(table, []) if k in rows.columns]
        dealt = None
        for kind, column in rules.values():
            if kind == "without parent":
                parent, key = schemas.PARENTS[table, column]
                held = tables[parent].select(F.col(key).alias(f"_{column}_parent")).filter(F.col(f"_{column}_parent").isNotNull())
                known = by_key(held, [f"_{column}_parent"], tasks(table, parent)).distinct().hint("shuffle_hash")
                rows = by_key(rows, [column], tasks(table, parent)).join(known, F.col(column) == F.col(f"_{column}_parent"), "left")
                dealt = column
        counts = [F.count_if(broken(table, *rule)).alias(f"_r{n}") for n, rule in enumerate(rules.values())]
        names = list(rules)
        if keys and len(keys) == len(schemas.UNIQUE[table]):
            # Rows that were dealt by one of the keys already lie together.
            rows = rows if dealt in keys else by_key(rows, keys, tasks(table))
            grouped = rows.groupBy(*keys).agg(F.count("*").alias("_copies"), *counts)
            counts = [F.coalesce(F.sum(f"_r{n}"), F.lit(0)) for n in range(len(names))] + [F.count_if((F.col("_copies") > 1) & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))]
            names.append(f"{', '.join(keys)} not unique")
            rows = grouped
        if not names:
            continue
        listed = [F.struct(F.lit(name).alias("rule"), c.alias("violations")) for name, c in zip(names, counts, strict=True)]
        one = rows.agg(F.array(*listed).alias("r")).select(F.lit(table).alias("table_name"), F.inline("r"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table has a rule")
    return out
