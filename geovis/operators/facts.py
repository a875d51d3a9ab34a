"""Site facts: one narrow row per site with everything the 51 checks read.

The HTML and the resource texts are read once, within the row, and dropped; only narrow rows
are shuffled afterwards, for the three lookups (address probes, sampled pages, outside
mentions).

Input `sites`: site_id, url, home_html, home_status, home_method, robots_txt, robots_status,
sitemap_xml, sitemap_status, llms_txt, llms_full_txt, http_probe_ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions import text as T
from geovis.functions import urls as U
from geovis.functions.core import built_once, let, unfold
from geovis.operators import jsonld as J
from geovis.operators import robots as R
from geovis.operators import sitemaps as S
from geovis.operators.links import sample_links
from geovis.operators.signals import page_language, page_signals, with_markup
from geovis.session import saved

# Link patterns of social profiles, and a part that each cannot match without.
SOCIAL_PATTERNS = [
    r"instagram\.com/[a-zA-Z0-9._]+",
    r"linkedin\.com/(company|in)/[a-zA-Z0-9-]+",
    r"facebook\.com/[a-zA-Z0-9.]+",
    r"(twitter|x)\.com/[a-zA-Z0-9_]+",
    r"youtube\.com/(c|channel|@)/?[a-zA-Z0-9_-]+",
]
SOCIAL_PARTS = [["instagram.com/"], ["linkedin.com/"], ["facebook.com/"], ["twitter.com/", "x.com/"], ["youtube.com/"]]

# Words and shapes looked for in the home page source.
ADDRESS_WORDS = ["adresse", "address", "rue", "avenue", "boulevard", "street"]
PHONE = r"\+?[\d\s().-]{8,}"
TRAVEL_WORDS = [
    "hotel", "restaurant", "chambre", "reservation", "sejour", "booking", "spa", "villa", "yacht",
    "charter",
]
BLOG_WORDS = ["blog", "news", "actualit", "article"]
FAQ_PARTS = ["faq", "f.aq", "fa.q", "f.a.q", "frequentes", "asked"]
FAQ = rf"(?i){T.EDGE_L}(?:f\.?a\.?q|questions?\s*frequentes|frequently\s*asked){T.EDGE_R}"
LANGUAGE_LINK = r"""href=["']/(en|fr|es|de|it)/"""
LANGUAGE_SWITCH = r"""class=["'][^"']*(language|lang-switcher|locale)[^"']*["']"""
MAP_EMBED = r"google\.com/maps/embed|maps\.google\.com/maps"
MAP_LINK = r"maps\.google\.com|goo\.gl/maps|maps\.app\.goo\.gl"
# The same as plain texts.
EMBED_PARTS = ["google.com/maps/embed", "maps.google.com/maps"]
LINK_PARTS = ["maps.google.com", "goo.gl/maps", "maps.app.goo.gl"]
TITLE_SEPARATOR = r"(?s)\A(.*?)\s*[|·•—-]"

SOURCE_FACTS = [
    "language_hint", "travel_site", "has_blog", "has_faq_words", "social_profiles", "map_embed",
    "map_link", "bot_wall",
]

# Kinds of outside sources a brand is looked up in.
SEARCH_KINDS = ["press", "reddit", "reviews", "sectoral"]


def source_facts(html: Column, low: Column) -> dict[str, Column]:
    """Facts read from the raw page source, markup included. `low` is the source in lower case."""
    social = F.lit(0)
    for pattern, parts in zip(SOCIAL_PATTERNS, SOCIAL_PARTS, strict=True):
        social = social + (T.holds_any(html, parts) & html.rlike(pattern)).cast("int")

    def hinted(low):
        return low.rlike(LANGUAGE_LINK) | (T.holds_any(low, ["language", "lang-switcher", "locale"]) & low.rlike(LANGUAGE_SWITCH))

    def travels(low):
        named = lambda words: T.holds_any(low, words) & low.rlike(T.words_pattern(words, ""))
        return (named(ADDRESS_WORDS) & low.rlike(PHONE)) | named(TRAVEL_WORDS)

    return {
        "language_hint": hinted(low),
        "travel_site": travels(low),
        "has_blog": T.holds_any(low, BLOG_WORDS) & html.rlike(T.words_pattern(BLOG_WORDS)),
        "has_faq_words": T.holds_any(low, FAQ_PARTS) & html.rlike(FAQ.replace("(?i)", "(?i)(?=[fq])")),
        "social_profiles": social,
        "map_embed": T.holds_any(html, EMBED_PARTS),
        "map_link": T.holds_any(html, LINK_PARTS),
        "bot_wall": H.bot_wall(html, F.lit(None).cast("string"), low),
    }


def schema_facts(objs: Column) -> dict[str, Column]:
    """Facts of the flattened JSON-LD objects."""

    def of(types):
        return F.filter(objs, lambda o: J.has_type(o.types, types))

    org = F.get(of(J.ORGANIZATION), F.lit(0))
    local = F.get(of(J.LOCAL_BUSINESS), F.lit(0))

    def filled(obj, *names):
        total = F.lit(0)
        for name in names:
            total = total + F.coalesce(obj[name].cast("int"), F.lit(0))
        return total

    return {
        "org_count": F.size(of(J.ORGANIZATION)),
        "org_filled": filled(org, "has_name", "has_url", "has_logo"),
        "local_count": F.size(of(J.LOCAL_BUSINESS)),
        "local_filled": filled(local, "has_address", "has_phone", "has_hours"),
        "offering_count": F.size(of(J.OFFERINGS)),
        "faq_schema_count": F.size(of(J.QUESTION_PAGES)),
        "review_count": F.size(of(J.REVIEWS)),
        "embedded_ratings": F.size(F.filter(objs, lambda o: o.has_rating)),
        "breadcrumb_count": F.size(of(J.BREADCRUMBS)),
        "article_count": F.size(of(J.ARTICLES)),
        "best_rating": F.array_max(F.transform(objs, lambda o: o.rating)),
        "rating_total": F.aggregate(
            objs, F.lit(0).cast("bigint"), lambda a, o: F.coalesce(F.try_add(a, o.reviews), a)
        ),
        "brand_in_schema": F.get(
            F.filter(
                F.transform(of(J.BRAND_OWNERS), lambda o: o["name"]), lambda n: n.isNotNull()
            ),
            F.lit(0),
        ),
    }


def brand_name(schema_name: Column, og: Column, title: Column, url: Column) -> Column:
    """Name of the brand a page speaks for, "" when none can be told."""
    site_name = F.nullif(F.try_element_at(og, F.lit("site_name")), F.lit(""))
    by_title = F.when(
        title.rlike(TITLE_SEPARATOR), T.js_trim(F.regexp_extract(title, TITLE_SEPARATOR, 1))
    ).otherwise(T.js_trim(title))
    label = F.regexp_extract(F.regexp_replace(U.hostname(url), r"^www\.", ""), r"^([^.]*)", 1)
    by_host = F.when(U.is_url(url), F.initcap(F.regexp_replace(label, "[-_]", " "))).otherwise("")
    return F.coalesce(schema_name, site_name, by_title, by_host)


@built_once
def _resource_columns() -> list[dict[str, Column]]:
    html = F.coalesce(F.col("home_html"), F.lit(""))
    sitemap, llms = F.col("sitemap_xml"), F.col("llms_txt")
    every_bot = [bot for bots in R.AI_BOTS.values() for bot in bots]
    return [
        {"_low": F.lower(html)},
        {
            **source_facts(html, F.col("_low")),
            "_blocks": J.raw_blocks(H.strip_comments(html)),
            "_rules": R.rules(F.col("robots_txt")),
            "_entries": S.entries(sitemap),
            "_children": S.children(sitemap),
            "_llms": S.llms_structure(llms),
            "_llms_links": S.llms_links(llms),
        },
        {
            "_parsed": J.parsed(F.col("_blocks")),
            "_bots": R.bot_states(F.col("_rules"), every_bot),
            "_depth": S.depth_stats(F.col("_entries")),
        },
        {"_objects": J.summary(J.objects(F.col("_parsed")))},
    ]


@built_once
def _fact_columns(now: str) -> list[Column]:
    sitemap, entries = F.col("sitemap_xml"), F.col("_entries")
    has_text = {
        name: F.coalesce(F.col(column), F.lit("")) != ""
        for name, column in {
            "robots": "robots_txt", "sitemap": "sitemap_xml", "llms": "llms_txt", "llms_full": "llms_full_txt"
        }.items()
    }
    questions = F.filter(F.col("answers"), lambda a: T.is_question(a.heading))
    counted = {
        "answer_questions": F.size(questions),
        "direct_answers": F.size(F.filter(questions, lambda a: T.opens_like_answer(a.answer))),
    }
    facts = {
        # resources
        "has_sitemap_text": has_text["sitemap"],
        "sitemap_ok": (F.coalesce(F.col("sitemap_status"), F.lit(0)) == 200) & has_text["sitemap"],
        "sitemap_status": F.col("sitemap_status"),
        "sitemap_error": S.parse_error(sitemap, entries),
        "sitemap_is_index": S.is_index(sitemap),
        "sitemap_children": F.size("_children"),
        "sitemap_entries": F.size(entries),
        "sitemap_dated": F.size(F.filter(entries, lambda e: e.lastmod.isNotNull())),
        "sitemap_recent": S.recent_count(entries, F.lit(now).cast("timestamp")),
        "sitemap_depth_max": F.col("_depth.max"),
        "sitemap_depth_avg": F.col("_depth.avg"),
        "sitemap_priority": S.has_priority_first(entries),
        "probe_urls": S.probe_sample(entries),
        "robots_ok": (F.coalesce(F.col("robots_status"), F.lit(0)) == 200) & has_text["robots"],
        "robots_status": F.col("robots_status"),
        "has_robots_text": has_text["robots"],
        "has_llms": has_text["llms"],
        "has_llms_full": has_text["llms_full"],
        "llms_points": F.col("_llms.points"),
        "llms_h1": F.col("_llms.h1"),
        "llms_quote": F.col("_llms.quote"),
        "llms_sections": F.col("_llms.sections"),
        "llms_link_count": F.size("_llms_links"),
        "llms_covered": S.covered_links(F.col("_llms_links"), entries),
        # the home page
        "protocol": U.protocol(F.col("url_normalized")),
        "h1_count": F.size("h1"),
        "h2_count": F.size("h2"),
        "h3_count": F.size("h3"),
        "title_length": T.js_length(F.coalesce("title", F.lit(""))),
        "description_length": T.js_length(F.coalesce("description", F.lit(""))),
        "hreflang_count": F.size("hreflang"),
        "heading_questions": F.size(F.filter(F.concat("h2", "h3"), T.is_question)),
        "h2_questions": F.size(F.filter(F.col("h2"), T.is_question)),
        **counted,
        "image_count": F.col("images.total"),
        "image_alt_count": F.col("images.with_meaningful_alt"),
        "home_words": F.col("words"),
        "reading": T.readability(F.col("text")),
        "language": page_language(F.col("lang"), F.col("og")),
        "sample_urls": sample_links(F.col("links"), F.col("url_normalized")),
        # JSON-LD
        "block_count": F.size("_blocks"),
        "block_errors": F.size(F.filter(F.col("_parsed"), lambda v: v.isNull())),
        **schema_facts(F.col("_objects")),
    }
    for check_id, bots in R.AI_BOTS.items():
        facts[f"{check_id}_allowed"] = R.any_bot(F.col("_bots"), "allowed", bots)
        facts[f"{check_id}_named"] = R.any_bot(F.col("_bots"), "explicit", bots)
    return [column.alias(name) for name, column in facts.items()]


def page_facts(sites: DataFrame, now: str) -> DataFrame:
    """Everything that can be read within a site's own row. `now` is an ISO timestamp."""
    cells = sites
    for columns in _resource_columns():
        cells = cells.withColumns(columns)
    paged = page_signals(cells, url="url", html="home_html").withColumn(
        "url_normalized", U.site_url(F.col("url"))
    )
    kept = [
        "site_id", "url", "url_normalized", "home_status", "home_method", "http_probe_ok", "title",
        "viewport", "og", "is_shell", *SOURCE_FACTS,
    ]
    named = paged.select(*kept, *_fact_columns(now))
    brand = brand_name(F.col("brand_in_schema"), F.col("og"), F.col("title"), F.col("url"))
    return named.withColumn("brand", brand).drop("og")


def page_measures(pages: DataFrame, keep: tuple | list = ()) -> DataFrame:
    """(url, status, ok, words, method, md_tested, md_ok) of fetched pages: what the site checks
    need of a sampled page, without its HTML. Input: url, status, ok, html, method, md_tested,
    md_status, md_content."""
    staged = with_markup(pages.withColumn("html", F.when(F.col("ok"), F.col("html"))))
    return staged.select(
        *keep, "url", "status", "ok", "method",
        F.when(F.coalesce("html", F.lit("")) != "", H.count_words(F.col("_main"))).alias("words"),
        "md_tested",
        ((F.col("md_status") == 200) & (F.coalesce("md_content", F.lit("")) != "")).alias("md_ok"),
    )


def sampled_facts(facts: DataFrame, measures: DataFrame, key: str = "site_id") -> DataFrame:
    """Facts of the sampled pages per site. `measures` holds one row per address.

    The sampled addresses (at most five per site) meet their measures in one equi-join on narrow
    rows; an address that many sites link to is split by AQE, because its other side is one row.
    """
    long = unfold(facts, key, F.col("sample_urls"), "url")
    joined = long.join(measures, "url", "left")
    service = F.col("url").rlike(r"(?i)service|prestation|offre") & F.col("words").isNotNull()
    return joined.groupBy(key).agg(
        F.count("*").cast("int").alias("sampled"),
        F.count_if(F.col("status") >= 400).cast("int").alias("sampled_errors"),
        F.count_if(F.col("md_tested")).cast("int").alias("md_tested"),
        F.count_if(F.col("md_tested") & F.col("md_ok")).cast("int").alias("md_found"),
        F.count_if(service).cast("int").alias("service_pages"),
        F.avg(F.when(service, F.col("words"))).alias("service_words"),
        F.sort_array(F.collect_set("method")).alias("sampled_methods"),
    )


def mention_counts(search_results: DataFrame) -> DataFrame:
    """(brand, press, reddit, reviews, sectoral) from result texts (brand, kind, text). Texts are
    reduced to counts before the shuffle."""
    counted = search_results.select(
        "brand", "kind", T.count_mentions(F.col("text"), F.col("brand")).alias("n")
    )
    return counted.groupBy("brand").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"mentions_{k}") for k in SEARCH_KINDS]
    )


def encyclopedia_presence(articles: DataFrame) -> DataFrame:
    """(brand, wiki_fr, wiki_en) from article lookups (brand, lang, type, extract). A
    disambiguation page or an empty extract does not count."""
    real = (F.coalesce(F.col("type"), F.lit("")) != "disambiguation") & (
        F.coalesce(F.col("extract"), F.lit("")) != ""
    )
    return articles.groupBy("brand").agg(
        F.max(real & (F.col("lang") == "fr")).alias("wiki_fr"),
        F.max(real & (F.col("lang") == "en")).alias("wiki_en"),
    )


PROBED = ["probed", "probed_ok"]
SAMPLED = ["sampled", "sampled_errors", "md_tested", "md_found", "service_pages", "service_words", "sampled_methods"]
OUTSIDE = [*[f"mentions_{k}" for k in SEARCH_KINDS], "wiki_fr", "wiki_en"]
UNKNOWN = {
    "probed": 0, "probed_ok": 0, "sampled": 0, "sampled_errors": 0, "md_tested": 0, "md_found": 0, "service_pages": 0,
    "wiki_fr": False, "wiki_en": False, **{f"mentions_{k}": 0 for k in SEARCH_KINDS},
}


def site_facts(
    sites: DataFrame, now: str, url_status: DataFrame, measures: DataFrame,
    search_results: DataFrame, articles: DataFrame, needed: list[str] | None = None,
) -> DataFrame:
    """The full fact row per site. The narrow facts of the pages are written once to the shared
    folder: the three lookups and the result read them there, and HTML is read a single time. Where
    the `needed` facts are named, only these and site_id are worked out; a lookup adds no row and
    loses none, so one that gives none of them is left out."""
    every = page_facts(sites, now)
    wants = lambda names: needed is None or not set(names).isdisjoint(needed)
    if needed is not None:
        keys = {"probe_urls": PROBED, "sample_urls": SAMPLED, "brand": OUTSIDE}
        own_facts = {"site_id", *needed, *[key for key, given in keys.items() if wants(given)]}
        every = every.select(*[c for c in every.columns if c in own_facts])
    own = saved(every, "page-facts")
    found = own
    if wants(PROBED):
        found = found.join(S.probe_results(own, url_status), "site_id", "left")
    if wants(SAMPLED):
        found = found.join(sampled_facts(own, measures), "site_id", "left")
    if wants(OUTSIDE):
        brands = mention_counts(search_results).join(encyclopedia_presence(articles), "brand", "full")
        found = found.join(brands, "brand", "left")
    return found.fillna({c: value for c, value in UNKNOWN.items() if c in found.columns})
