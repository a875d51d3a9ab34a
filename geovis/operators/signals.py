"""Page signals: one pass over `pages(page_id, url, html)` that yields everything the checks
and reports read from a page. No shuffle; every signal is a JVM expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions import text as T
from geovis.functions import urls as U
from geovis.functions.core import built_once, let, unfold

def prefixed_map(metas: Column, key: str, prefix: str) -> Column:
    """Map of prefixed meta tags without the prefix; the last value wins, empties are dropped."""
    named = F.filter(metas, lambda m: m[key].startswith(prefix) & (m[key] != prefix) & (m.content != ""))
    pairs = F.transform(
        named, lambda m: F.struct(m[key].substr(F.lit(len(prefix) + 1), F.length(m[key])).alias("key"), m.content.alias("value"))
    )
    return F.map_from_entries(pairs)


def image_stats(images: Column) -> Column:
    """struct(total, with_alt, with_meaningful_alt); an alt of more than 3 characters is
    meaningful."""
    lengths = F.transform(
        images,
        lambda t: F.when(H.has_attr(t, "alt"), T.js_length(T.js_trim(H.attr(t, "alt")))),
    )
    return let(
        lengths,
        lambda sizes: F.struct(
            F.size(sizes).alias("total"),
            F.size(F.filter(sizes, lambda n: n.isNotNull())).alias("with_alt"),
            F.size(F.filter(sizes, lambda n: n > 3)).alias("with_meaningful_alt"),
        ),
    )


def internal_links(anchors: Column, base_origin: Column) -> Column:
    """Distinct links of a page to its own site, in page order."""

    def of_site(base):
        hrefs = F.filter(
            F.array_distinct(F.transform(anchors, lambda t: H.attr(t, "href"))), lambda h: h != ""
        )
        links = F.array_distinct(F.transform(hrefs, lambda h: U.resolve_link(h, base["origin"])))
        return F.filter(links, lambda u: u.isNotNull() & (U.host(u) == base["host"]))

    return let(F.struct(base_origin.alias("origin"), U.host(base_origin).alias("host")), of_site)


def _meta_fields(tag: Column) -> Column:
    return F.struct(
        H.raw_attr(tag, "name").alias("name"),
        H.raw_attr(tag, "property").alias("property"),
        F.when(H.has_attr(tag, "content"), H.attr(tag, "content")).alias("content"),
    )


def _link_fields(tag: Column) -> Column:
    return F.struct(
        H.raw_attr(tag, "rel").alias("rel"),
        H.raw_attr(tag, "hreflang").alias("lang"),
        F.when(H.has_attr(tag, "href"), H.attr(tag, "href")).alias("href"),
    )


@built_once
def _markup_columns() -> list[dict[str, Column]]:
    markup = F.col("_markup")
    quiet = H.drop_elements(markup, "noscript")
    return [
        {"_markup": H.drop_elements(F.col("_plain"), "script", "style")},
        {
            "_head": H.head_part(markup),
            "_visible": H.body_part(H.drop_elements(markup, "noscript", "svg")),
            "_main": H.body_part(H.drop_elements(quiet, "nav", "header", "footer")),
            "_tags": H.tags(markup, "html", "meta", "link", "a", "img"),
            "_headings": H.headings(markup),
        },
        {
            "_metas": F.transform(H.named(F.col("_tags"), "meta"), _meta_fields),
            "_links": F.transform(H.named(F.col("_tags"), "link"), _link_fields),
            "_html": F.get(H.named(F.col("_tags"), "html"), F.lit(0)),
        },
    ]


def with_markup(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the cleaned forms of a page that the signals read, each computed once."""
    out = pages.withColumn("_plain", H.strip_comments(F.coalesce(F.col(html), F.lit(""))))
    for columns in _markup_columns():
        out = out.withColumns(columns)
    return out


@built_once
def _signal_columns(url: str, html: str) -> list[Column]:
    metas, links = F.col("_metas"), F.col("_links")

    def text(column):
        return T.collapse_space(H.decode_entities(H.strip_tags(F.col(column))))

    def first(items, test):
        return F.get(F.filter(items, test), F.lit(0))

    def level(number):
        return F.transform(F.filter(F.col("_headings"), lambda h: h.level == number), lambda h: h.text)

    alternates = F.filter(
        links, lambda t: (t.rel == "alternate") & (t.lang != "") & (F.coalesce(t.href, F.lit("")) != "")
    )
    signals = {
        "title": H.first_title(F.col("_head")),
        "description": T.js_trim(first(metas, lambda m: m["name"] == "description")["content"]),
        "canonical": first(links, lambda t: t.rel == "canonical")["href"],
        "viewport": first(metas, lambda m: m["name"] == "viewport")["content"],
        "lang": F.when(H.has_attr(F.col("_html"), "lang"), H.raw_attr(F.col("_html"), "lang")),
        "og": prefixed_map(metas, "property", "og:"),
        "twitter": prefixed_map(metas, "name", "twitter:"),
        "hreflang": F.transform(alternates, lambda t: F.struct(t.lang.alias("lang"), t.href.alias("href"))),
        **{f"h{n}": level(n) for n in (1, 2, 3, 4)},
        "answers": H.heading_blocks(F.col("_markup")),
        "images": image_stats(H.named(F.col("_tags"), "img")),
        "links": internal_links(H.named(F.col("_tags"), "a"), U.origin(F.col(url))),
        "text": text("_visible"),
        "words": H.count_words(F.col("_main")),
        "is_shell": H.is_shell(F.col(html)),
    }
    return [column.alias(name) for name, column in signals.items()]


def page_signals(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` without its HTML, plus one column per signal."""
    kept = [c for c in pages.columns if c != html]
    return with_markup(pages, html).select(*kept, *_signal_columns(url, html))


def page_language(lang: Column, og: Column) -> Column:
    return F.coalesce(lang, F.try_element_at(og, F.lit("locale")))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Long table (key, ord, link) of distinct internal links."""
    staged = with_markup(pages.select(key, url, html), html)
    links = internal_links(H.named(F.col("_tags"), "a"), U.origin(F.col(url)))
    return unfold(staged, key, links, "link")
