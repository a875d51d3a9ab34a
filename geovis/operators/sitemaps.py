"""Sitemaps and llms.txt files, read within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import urls as U
from geovis.functions.core import let, unfold
from geovis.functions.text import js_round, js_trim

RECENT_DAYS = 180
PROBE_SAMPLE = 3

# Paths of pages that belong at the top of a sitemap.
PRIORITY_PATHS = ["/", "/about", "/a-propos", "/contact", "/services", "/faq", "/home", "/accueil"]


def is_index(xml: Column) -> Column:
    return F.coalesce(xml.rlike(r"(?i)<sitemapindex"), F.lit(False))


def entries(xml: Column) -> Column:
    """array(struct(loc, lastmod)) in file order; empty for an index."""
    found = F.filter(
        F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), 1),
        lambda block: block.rlike(r"(?is)<loc>.*?</loc>"),
    )
    rows = F.transform(
        found,
        lambda block: F.struct(
            js_trim(F.regexp_extract(block, r"(?is)<loc>(.*?)</loc>", 1)).alias("loc"),
            F.nullif(
                js_trim(F.regexp_extract(block, r"(?is)<lastmod>(.*?)</lastmod>", 1)), F.lit("")
            ).alias("lastmod"),
        ),
    )
    return F.when(
        xml.isNull() | is_index(xml), F.array().cast("array<struct<loc:string,lastmod:string>>")
    ).otherwise(rows)


def children(xml: Column) -> Column:
    """Child sitemaps of an index."""
    found = F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap>.*?<loc>(.*?)</loc>"), 1), js_trim
    )
    return F.when(is_index(xml), found).otherwise(F.array().cast("array<string>"))


def parse_error(xml: Column, entry_list: Column) -> Column:
    """Why a sitemap yields nothing, null when it is usable."""
    return F.when(
        (F.coalesce(xml, F.lit("")) == "") | ~F.contains(xml, F.lit("<")), "empty or not XML"
    ).when(~is_index(xml) & (F.size(entry_list) == 0), "no URL and no child sitemap")


def depth_stats(entry_list: Column) -> Column:
    """struct(max, avg) of the path depths; 0 for an empty list."""
    return let(
        F.transform(entry_list, lambda e: U.path_depth(e.loc)),
        lambda depths: F.struct(
            F.coalesce(F.array_max(depths), F.lit(0)).alias("max"),
            F.coalesce(
                F.try_divide(F.aggregate(depths, F.lit(0), lambda a, d: a + d), F.size(depths)), F.lit(0.0)
            ).alias("avg"),
        ),
    )


def recent_count(entry_list: Column, now: Column) -> Column:
    """Entries whose date is readable and younger than 180 days."""
    limit = now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    return F.size(F.filter(entry_list, lambda e: F.coalesce(F.try_to_timestamp(e.lastmod) > limit, F.lit(False))))


def has_priority_first(entry_list: Column, top: int = 10) -> Column:
    accepted = PRIORITY_PATHS + [p + "/" for p in PRIORITY_PATHS]
    return F.exists(
        F.slice(entry_list, 1, top),
        lambda e: U.is_url(F.lower(e.loc)) & U.path(F.lower(e.loc)).isin(*accepted),
    )


def probe_sample(entry_list: Column, seed: str = "0", size: int = PROBE_SAMPLE) -> Column:
    """A repeatable sample of addresses to probe: hash order instead of chance."""
    keyed = F.transform(
        entry_list, lambda e: F.struct(F.md5(F.concat(F.lit(seed + "|"), e.loc)).alias("k"), e.loc.alias("loc"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, size), lambda s: s.loc)


def sitemap_entries(resources: DataFrame, key: str = "site_id", text: str = "sitemap_xml") -> DataFrame:
    """Long table (key, ord, loc, lastmod)."""
    return unfold(resources, key, entries(F.col(text)), "e").select(key, "ord", "e.*")


def probe_results(samples: DataFrame, url_status: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, probed, probed_ok) from (key, sample array) and the probe table (url, status, ok).
    The rows that are shuffled hold one address each; a popular address is split by AQE."""
    long = unfold(samples, key, F.col("probe_urls"), "url")
    joined = long.join(url_status.select("url", "ok"), "url", "left")
    return joined.groupBy(key).agg(
        F.count("*").cast("int").alias("probed"), F.count_if(F.col("ok")).cast("int").alias("probed_ok")
    )


def llms_structure(text: Column) -> Column:
    """Counts of the parts of an llms.txt file and its 0-3 points. Its patterns, and those of
    `entries` and `children`, are fixed values."""

    def grade(p):
        points = (
            F.when(p.h1, 1.0).otherwise(0.0)
            + F.when(p.quote, 0.5).otherwise(0.0)
            + F.when(p.sections >= 1, 0.5).otherwise(0.0)
            + F.when(p.links >= 5, 1.0).when(p.links >= 1, 0.5).otherwise(0.0)
        )
        return F.struct(p.h1, p.quote, p.sections, p.links, js_round(points).alias("points"))

    parts = F.struct(
        text.rlike(r"(?m)^#\s+\w").alias("h1"),
        text.rlike(r"(?m)^>\s+\w").alias("quote"),
        F.regexp_count(text, F.lit(r"(?m)^##\s+\w")).alias("sections"),
        F.regexp_count(text, F.lit(r"\[.+?\]\(.+?\)")).alias("links"),
    )
    return let(parts, grade)


def _cut_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def llms_links(text: Column) -> Column:
    """Absolute link targets, trailing slash cut."""
    found = F.regexp_extract_all(text, F.lit(r"\[.+?\]\((https?://[^)]+)\)"), 1)
    return F.transform(found, _cut_slash)


def covered_links(link_list: Column, entry_list: Column) -> Column:
    """How many links equal or extend a sitemap address of the same site.

    Addresses and links are walked in one sorted order. All strings that extend an address stand
    right behind it, so the addresses that the present one extends are kept as a short list; an
    address drops out of it for good at the first string that does not extend it.
    """
    kind = lambda items, is_link: F.transform(items, lambda x: F.struct(x.alias("text"), F.lit(is_link).alias("is_link")))
    locs = F.array_distinct(F.transform(entry_list, lambda e: _cut_slash(e.loc)))
    known = F.filter(locs, lambda x: x.isNotNull())
    start = F.struct(F.array().cast("array<string>").alias("above"), F.lit(0).alias("n"))

    def step(seen, item):
        above = F.filter(seen["above"], lambda x: F.startswith(item["text"], x))
        return F.struct(
            F.when(item["is_link"], above).otherwise(F.concat(above, F.array(item["text"]))).alias("above"),
            (seen["n"] + F.when(item["is_link"] & (F.size(above) > 0), 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(F.array_sort(F.concat(kind(known, False), kind(link_list, True))), start, step, lambda seen: seen["n"])
