"""Page captures, text resources and sampled pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import html as H

# How a page can have been fetched - direct, rendered, headless browser.
DIRECT, RENDERED, HEADLESS = "fetch", "jina", "browserless"
RENDERED_MIN_LENGTH = 500
GONE = [404, 410]
RESOURCE_KINDS = ["robots", "sitemap", "llms", "llms_full"]


def choose_capture(captures: DataFrame, allow_rendered: bool = True) -> DataFrame:
    """One capture per address from `captures` (url, method, ok, status, html, headers).

    The direct capture stands when it holds content. Otherwise a rendered one of more than 500
    characters lends its body to the direct head, or stands alone if the direct one failed; then
    a headless one; then whatever worked. One shuffle: the three captures of an address meet in
    a single aggregation. Of several captures by one method the last counts, by `fetched_at` if
    there is one; equal times are told apart by success, status and content.
    """
    fields = ["ok", "status", "html", "method", "headers"]
    row = F.struct(*fields)
    times = ["fetched_at"] if "fetched_at" in captures.columns else []
    order = F.struct(*times, "ok", "status", F.xxhash64("html"))
    picked = captures.groupBy("url").agg(
        *[
            F.max_by(row, F.when(F.col("method") == m, order)).alias(name)
            for m, name in ((DIRECT, "d"), (RENDERED, "r"), (HEADLESS, "h"))
        ]
    )
    worked = {n: F.coalesce(F.col(f"{n}.ok"), F.lit(False)) for n in "drh"}
    if not allow_rendered:
        return picked.select("url", "d.*")
    rich = worked["r"] & (F.length("r.html") > RENDERED_MIN_LENGTH)
    no_headers = F.create_map().cast("map<string,string>")
    overlaid = F.map_from_entries(
        F.concat(
            F.map_entries(
                F.map_filter(
                    F.coalesce("d.headers", no_headers),
                    lambda k, _: ~F.map_contains_key(F.coalesce("r.headers", no_headers), k),
                )
            ),
            F.map_entries(F.coalesce("r.headers", no_headers)),
        )
    )
    merged = F.struct(
        F.lit(True).alias("ok"), F.col("d.status").alias("status"),
        H.merge_head_body(F.col("d.html"), F.col("r.html")).alias("html"),
        F.lit(RENDERED).alias("method"), overlaid.alias("headers"),
    )
    chosen = (
        F.when(worked["d"] & ~H.is_shell(F.col("d.html")), F.col("d"))
        .when(rich & worked["d"], merged)
        .when(rich, F.col("r"))
        .when(worked["h"], F.col("h"))
        .when(worked["d"], F.col("d"))
        .when(worked["r"], F.col("r"))
        .otherwise(F.coalesce("h", "d", "r"))
    )
    return picked.select("url", chosen.alias("c")).select("url", "c.*")


def resource_text(status: Column, content: Column) -> Column:
    """Text of a fetched resource: none when it is gone or the network failed; any other status
    keeps the body."""
    return F.when(status.isNotNull() & ~status.isin(*GONE), content)


def site_resources(resources: DataFrame) -> DataFrame:
    """One row per site from `resources` (site_id, kind, status, content), with a text and a
    status column per kind."""
    text = resource_text(F.col("status"), F.col("content"))
    columns = []
    for kind in RESOURCE_KINDS:
        own = F.col("kind") == kind
        name = {"robots": "robots_txt", "sitemap": "sitemap_xml"}.get(kind, f"{kind}_txt")
        columns += [
            F.max(F.when(own, text)).alias(name), F.max(F.when(own, F.col("status"))).alias(f"{kind}_status")
        ]
    return resources.groupBy("site_id").agg(*columns)


def sampled_pages(samples: DataFrame, captures: DataFrame, twins: DataFrame) -> DataFrame:
    """Sampled addresses (site_id, ord, url) with their direct capture and the Markdown twin from
    `twins` (url, status, content). HTML is kept only of pages that worked; a page without a twin
    row was not tested for one."""
    direct = captures.filter(F.col("method") == DIRECT).select(
        "url", "status", F.when(F.col("ok"), F.col("html")).alias("html"), "method"
    )
    text = resource_text(F.col("status"), F.col("content"))
    markdown = twins.select(
        "url", F.lit(True).alias("md_tested"), F.col("status").alias("md_status"), text.alias("md_content")
    )
    return (
        samples.join(direct, "url", "left")
        .join(markdown, "url", "left")
        .withColumn("md_tested", F.coalesce("md_tested", F.lit(False)))
    )
