"""The check registry: one declarative entry per check, exploded to long rows in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories in report order, each worth 20 points.
CATEGORIES = ["foundations", "geo_triptych", "structured_data", "content", "authority"]
CATEGORY_POINTS = 20


@dataclass(frozen=True)
class Check:
    """`status` and `points` are expressions over the columns of a site fact row; `evidence`
    says in one line what was seen, `advice` what to do about it."""

    id: str
    category: str
    points_max: int
    label: str
    status: Column
    points: Column
    evidence: Column
    advice: str


def graded(points: Column, pass_at: int, warn_at: int = 1) -> Column:
    """Status by points: pass from `pass_at`, warn from `warn_at`, else fail."""
    return F.when(points >= pass_at, "pass").when(points >= warn_at, "warn").otherwise("fail")


def yes_no(condition: Column, points: int, otherwise: str = "fail") -> tuple[Column, Column]:
    """Status and points of a check that is simply met or not."""
    met = F.coalesce(condition, F.lit(False))
    return F.when(met, "pass").otherwise(otherwise), F.when(met, points).otherwise(0)


def describe(**values) -> Column:
    """Evidence text: `name=value` pairs, nulls shown as none."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("none")))
        for name, value in values.items()
    ]
    return F.concat_ws(", ", *parts)


def run_checks(
    facts: DataFrame, checks: Iterable[Check], key: str = "site_id", detail: bool = True
) -> DataFrame:
    """Long table (key, check_no, category, check_id, status, points_earned, points_max), with
    `detail` also label, evidence and recommendation. Narrow: no shuffle, the facts are read once
    for all checks.

    Only what depends on the site is computed per check before the rows are unfolded; names and
    texts are looked up by number afterwards. Scores need no detail.
    """
    listed = list(checks)

    def one(number, check):
        fields = [
            F.lit(number).alias("check_no"),
            check.status.alias("status"),
            check.points.cast("int").alias("points_earned"),
        ]
        return F.struct(*fields, check.evidence.alias("evidence")) if detail else F.struct(*fields)

    rows = F.array(*[one(i, c) for i, c in enumerate(listed, 1)])

    def constant(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("check_no"))

    # 51 checks exceed the size of one generated Java method; a lambda keeps them out of it.
    rows = F.filter(rows, lambda r: r.status.isNotNull())
    long = facts.select(key, rows.alias("_rows")).select(key, F.inline_outer("_rows"))
    scored = [
        key, "check_no",
        constant([c.category for c in listed]).alias("category"),
        constant([c.id for c in listed]).alias("check_id"),
        "status", "points_earned",
        constant([c.points_max for c in listed]).alias("points_max"),
    ]
    if not detail:
        return long.select(*scored)
    return long.select(
        *scored,
        constant([c.label for c in listed]).alias("label"),
        "evidence",
        F.when(F.col("status").isin("fail", "warn"), constant([c.advice for c in listed])).alias("recommendation"),
    )
