"""Audit requests as they come in: JSON bodies, accepted or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.functions import urls as U
from geovis.functions.core import whole_json


def read_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """`raw` without its body, plus url, geo_target and `rejected` (reason or null): the body must
    be JSON with a valid `url`; `geo_target` may be missing or null but else is a text."""
    value = whole_json(F.col(body))

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(F.col("_json"), path, "variant"))

    url = F.when(kind("$.url") == "STRING", F.try_variant_get("_json", "$.url", "string"))
    geo_kind = F.coalesce(kind("$.geo_target"), F.lit("VOID"))
    reason = F.coalesce(
        F.when(F.col("_json").isNull(), "invalid JSON body"),
        F.when(~F.coalesce(U.is_url(F.col("url")), F.lit(False)), "url"),
        F.when(~geo_kind.isin("VOID", "STRING"), "geo_target"),
    )
    kept = [c for c in raw.columns if c != body]
    return (
        raw.withColumn("_json", value)
        .withColumn("url", url)
        .withColumn("rejected", reason)
        .select(*kept, "url", F.try_variant_get("_json", "$.geo_target", "string").alias("geo_target"), "rejected")
    )


def accepted(requests: DataFrame) -> DataFrame:
    """Rows ready to become audits, with the normal form of their address."""
    return (
        requests.filter(F.col("rejected").isNull())
        .withColumn("url_normalized", U.site_url(F.col("url")))
        .withColumn("domain", U.domain(F.col("url")))
        .drop("rejected")
    )


def rejected(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("rejected").isNotNull())
