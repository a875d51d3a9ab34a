"""Boundaries of all 51 checks: a fact row, a change to it, the expected status and points."""

import pytest
from pyspark.sql import functions as F

from geovis.operators import checks as C
from geovis.operators import scoring
from geovis.plans import catalog

NONE = {
    "has_sitemap_text": False, "sitemap_ok": False, "sitemap_status": None, "sitemap_error": "empty or not XML",
    "sitemap_is_index": False, "sitemap_children": 0, "sitemap_entries": 0, "sitemap_dated": 0, "sitemap_recent": 0,
    "sitemap_depth_max": 0, "sitemap_depth_avg": 0.0, "sitemap_priority": False, "robots_ok": False, "robots_status": None,
    "has_robots_text": False, "has_llms": False, "has_llms_full": False, "llms_points": None, "llms_h1": None,
    "llms_quote": None, "llms_sections": None, "llms_link_count": None, "llms_covered": None, "protocol": "http",
    "home_status": 200, "http_probe_ok": False, "viewport": None, "h1_count": 0, "h2_count": 0, "h3_count": 0, "title": None,
    "title_length": 0, "description_length": 0, "hreflang_count": 0, "heading_questions": 0, "h2_questions": 0,
    "answer_questions": 0, "direct_answers": 0, "image_count": 0, "image_alt_count": 0, "home_words": 0,
    "reading": (0, 0, 0), "block_count": 0, "block_errors": 0, "org_count": 0, "org_filled": 0, "local_count": 0,
    "local_filled": 0, "offering_count": 0, "faq_schema_count": 0, "review_count": 0, "embedded_ratings": 0,
    "breadcrumb_count": 0, "article_count": 0, "best_rating": None, "rating_total": 0, "language_hint": False,
    "travel_site": False, "has_blog": False, "has_faq_words": False, "social_profiles": 0, "map_embed": False,
    "map_link": False, "probed": 0, "probed_ok": 0, "sampled": 0, "sampled_errors": 0, "md_tested": 0, "md_found": 0,
    "service_pages": 0, "service_words": None, "brand": "Maison", "wiki_fr": False, "wiki_en": False,
    "mentions_press": 0, "mentions_reddit": 0, "mentions_reviews": 0, "mentions_sectoral": 0,
}
for _bot in ("robots_gptbot", "robots_claudebot", "robots_perplexitybot", "robots_google_extended"):
    NONE |= {f"{_bot}_allowed": True, f"{_bot}_named": False}

MAP = {"has_sitemap_text": True, "sitemap_ok": True, "sitemap_status": 200, "sitemap_error": None, "sitemap_entries": 5}
LLMS = {"has_llms": True, "llms_link_count": 0, "llms_covered": 0, "llms_points": 0}

CASES = [
    ("sitemap_accessible", {}, "fail", 0), ("sitemap_accessible", MAP, "pass", 3),
    ("sitemap_valid_resolvable", {}, "fail", 0),
    ("sitemap_valid_resolvable", MAP | {"sitemap_error": "x"}, "fail", 0),
    ("sitemap_valid_resolvable", MAP | {"sitemap_is_index": True, "sitemap_children": 1, "sitemap_entries": 0}, "pass", 2),
    ("sitemap_valid_resolvable", MAP | {"sitemap_is_index": True, "sitemap_entries": 0}, "fail", 0),
    ("sitemap_valid_resolvable", MAP | {"probed": 3, "probed_ok": 3}, "pass", 2),
    ("sitemap_valid_resolvable", MAP | {"probed": 3, "probed_ok": 2}, "warn", 1),
    ("sitemap_valid_resolvable", MAP | {"probed": 3, "probed_ok": 1}, "fail", 0),
    ("sitemap_valid_resolvable", MAP | {"probed": 1, "probed_ok": 0}, "warn", 1),
    ("sitemap_uptodate", {}, "fail", 0), ("sitemap_uptodate", MAP, "warn", 0),
    ("sitemap_uptodate", MAP | {"sitemap_dated": 2, "sitemap_recent": 1}, "warn", 0),
    ("sitemap_uptodate", MAP | {"sitemap_dated": 3, "sitemap_recent": 2}, "pass", 1),
    ("robots_present", {}, "fail", 0), ("robots_present", {"robots_ok": True}, "pass", 1),
    *[case for b in ("robots_gptbot", "robots_claudebot", "robots_perplexitybot", "robots_google_extended") for case in (
        (b, {}, "warn", 1), (b, {f"{b}_allowed": False}, "warn", 1), (b, {"robots_ok": True}, "warn", 1),
        (b, {"robots_ok": True, f"{b}_named": True}, "pass", 1),
        (b, {"robots_ok": True, f"{b}_named": True, f"{b}_allowed": False}, "fail", 0))],
    ("https_active", {}, "fail", 0), ("https_active", {"protocol": "https"}, "pass", 2),
    ("https_active", {"protocol": "https", "home_status": 301}, "fail", 0),
    ("http_to_https_redirect", {"http_probe_ok": True}, "fail", 0),
    ("http_to_https_redirect", {"protocol": "https"}, "warn", 0),
    ("http_to_https_redirect", {"protocol": "https", "http_probe_ok": True}, "pass", 1),
    ("cwv_lcp", {}, "skipped", 0), ("cwv_cls", {}, "skipped", 0), ("cwv_inp", {}, "skipped", 0),
    ("mobile_responsive", {}, "fail", 0), ("mobile_responsive", {"viewport": "initial-scale=1"}, "fail", 0),
    ("mobile_responsive", {"viewport": "width=device-width"}, "pass", 1),
    ("sample_pages_ok", {}, "skipped", 0), ("sample_pages_ok", {"sampled": 5}, "pass", 1),
    ("sample_pages_ok", {"sampled": 5, "sampled_errors": 1}, "fail", 0),
    ("llms_txt_present", {}, "fail", 0), ("llms_txt_present", LLMS, "pass", 4),
    ("llms_txt_structure", {}, "fail", 0), ("llms_txt_structure", LLMS, "fail", 0),
    ("llms_txt_structure", LLMS | {"llms_points": 1}, "warn", 1), ("llms_txt_structure", LLMS | {"llms_points": 2}, "warn", 2),
    ("llms_txt_structure", LLMS | {"llms_points": 3}, "pass", 3),
    ("llms_txt_coverage", {}, "fail", 0), ("llms_txt_coverage", LLMS, "skipped", 0),
    ("llms_txt_coverage", LLMS | MAP, "warn", 0), ("llms_txt_coverage", LLMS | MAP | {"llms_link_count": 4}, "warn", 1),
    ("llms_txt_coverage", LLMS | MAP | {"llms_link_count": 5}, "pass", 2),
    ("llms_txt_coverage", LLMS | MAP | {"sitemap_entries": 40, "llms_link_count": 3, "llms_covered": 3}, "pass", 2),
    ("llms_txt_coverage", LLMS | MAP | {"sitemap_entries": 40, "llms_link_count": 3, "llms_covered": 2}, "warn", 1),
    ("llms_full_txt_present", {}, "warn", 0), ("llms_full_txt_present", {"has_llms_full": True}, "pass", 2),
    ("md_versions_pages", {}, "skipped", 0), ("md_versions_pages", {"md_tested": 5}, "fail", 0),
    ("md_versions_pages", {"md_tested": 6, "md_found": 1}, "warn", 1), ("md_versions_pages", {"md_tested": 5, "md_found": 1}, "warn", 2),
    ("md_versions_pages", {"md_tested": 4, "md_found": 2}, "pass", 3), ("md_versions_pages", {"md_tested": 5, "md_found": 4}, "pass", 4),
    ("sitemap_logical_structure", {}, "fail", 0), ("sitemap_logical_structure", MAP | {"sitemap_entries": 0}, "fail", 0),
    ("sitemap_logical_structure", MAP | {"sitemap_entries": 0, "sitemap_children": 2}, "pass", 2),
    ("sitemap_logical_structure", MAP | {"sitemap_depth_max": 3, "sitemap_depth_avg": 2.0}, "pass", 2),
    ("sitemap_logical_structure", MAP | {"sitemap_depth_max": 3, "sitemap_depth_avg": 2.1}, "warn", 1),
    ("sitemap_logical_structure", MAP | {"sitemap_depth_max": 4}, "warn", 1), ("sitemap_logical_structure", MAP | {"sitemap_depth_max": 5}, "fail", 0),
    ("sitemap_priority_first", {}, "fail", 0), ("sitemap_priority_first", MAP, "warn", 0), ("sitemap_priority_first", MAP | {"sitemap_priority": True}, "pass", 1),
    ("sitemap_segmented", {}, "fail", 0), ("sitemap_segmented", MAP | {"sitemap_entries": 100}, "pass", 1), ("sitemap_segmented", MAP | {"sitemap_entries": 101}, "warn", 0),
    ("hreflang_multilingual", {}, "pass", 1), ("hreflang_multilingual", {"language_hint": True}, "fail", 0),
    ("hreflang_multilingual", {"hreflang_count": 1}, "fail", 0), ("hreflang_multilingual", {"hreflang_count": 2}, "pass", 1),
    *[("schema_organization", {"org_count": 1, "org_filled": n}, s, n) for n, s in ((0, "fail"), (1, "warn"), (2, "warn"), (3, "pass"))],
    ("schema_local_business", {}, "skipped", 0), ("schema_local_business", {"travel_site": True}, "fail", 0), ("schema_local_business", {"local_count": 1}, "pass", 3),
    ("schema_local_complete", {}, "skipped", 0), ("schema_local_complete", {"travel_site": True}, "fail", 0),
    *[("schema_local_complete", {"local_count": 1, "local_filled": n}, s, p) for n, s, p in ((1, "fail", 0), (2, "warn", 1), (3, "pass", 2))],
    ("schema_product_service", {}, "warn", 0), ("schema_product_service", {"offering_count": 1}, "pass", 3),
    ("schema_faq", {}, "warn", 0), ("schema_faq", {"faq_schema_count": 1}, "pass", 3),
    ("schema_review_rating", {}, "warn", 0), ("schema_review_rating", {"embedded_ratings": 1}, "pass", 2), ("schema_review_rating", {"review_count": 1}, "pass", 2),
    ("schema_breadcrumb", {}, "warn", 0), ("schema_breadcrumb", {"breadcrumb_count": 1}, "pass", 1),
    ("schema_article", {"article_count": 1}, "skipped", 0), ("schema_article", {"has_blog": True}, "warn", 0), ("schema_article", {"has_blog": True, "article_count": 1}, "pass", 2),
    ("schema_no_errors", {}, "skipped", 0), ("schema_no_errors", {"block_count": 2, "block_errors": 1}, "fail", 0), ("schema_no_errors", {"block_count": 2}, "pass", 1),
    *[("content_h1_unique", {"h1_count": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "pass", 2), (2, "warn", 1))],
    ("content_heading_hierarchy", {"h3_count": 3}, "fail", 0), ("content_heading_hierarchy", {"h2_count": 1}, "pass", 2),
    *[("content_title_tag", {"title_length": n}, s, p) for n, s, p in ((0, "fail", 0), (29, "warn", 1), (30, "pass", 2), (65, "pass", 2), (66, "warn", 1))],
    *[("content_meta_description", {"description_length": n}, s, p) for n, s, p in ((0, "fail", 0), (109, "warn", 1), (110, "pass", 2), (165, "pass", 2), (166, "warn", 1))],
    *[("content_faq_structured", {"heading_questions": n, "has_faq_words": w}, s, p) for n, w, s, p in (
        (0, False, "fail", 0), (1, False, "warn", 1), (0, True, "warn", 2), (2, True, "warn", 2), (3, False, "warn", 2), (3, True, "pass", 3))],
    *[("content_conversational_density", {"h2_count": 20, "h2_questions": n}, s, p) for n, s, p in ((0, "fail", 0), (2, "warn", 1), (3, "warn", 2), (5, "warn", 2), (6, "pass", 3))],
    ("content_answer_first", {}, "skipped", 0),
    *[("content_answer_first", {"answer_questions": 10, "direct_answers": n}, s, p) for n, s, p in ((2, "fail", 0), (3, "warn", 1), (5, "warn", 1), (6, "pass", 2))],
    ("content_alt_text", {}, "skipped", 0),
    *[("content_alt_text", {"image_count": 10, "image_alt_count": n}, s, p) for n, s, p in ((4, "fail", 0), (5, "warn", 1), (7, "warn", 1), (8, "pass", 2))],
    ("content_word_count", {"home_words": 499}, "warn", 0), ("content_word_count", {"home_words": 500}, "pass", 1),
    ("content_word_count", {"home_words": 900, "service_pages": 1, "service_words": 499.5}, "warn", 0), ("content_word_count", {"service_pages": 1, "service_words": 500.0}, "pass", 1),
    ("content_readability", {}, "skipped", 0), ("content_readability", {"reading": (2, 50, 325)}, "pass", 1),
    ("content_readability", {"reading": (2, 51, 100)}, "warn", 0), ("content_readability", {"reading": (2, 50, 326)}, "warn", 0),
    ("auth_wikipedia", {"brand": "", "wiki_fr": True}, "skipped", 0), ("auth_wikipedia", {}, "fail", 0),
    ("auth_wikipedia", {"wiki_fr": True}, "warn", 3), ("auth_wikipedia", {"wiki_fr": True, "wiki_en": True}, "pass", 4),
    ("auth_press_mentions", {"brand": "", "mentions_press": 9}, "skipped", 0),
    *[("auth_press_mentions", {"mentions_press": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "warn", 1), (2, "warn", 1), (3, "warn", 2), (5, "warn", 2), (6, "pass", 3))],
    *[("auth_aggregate_rating", {"best_rating": r}, s, p) for r, s, p in ((None, "fail", 0), (2.9, "fail", 0), (3.0, "warn", 1), (3.9, "warn", 1), (4.0, "pass", 2))],
    *[("auth_reddit", {"mentions_reddit": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "warn", 1), (3, "warn", 1), (4, "pass", 2))],
    *[("auth_social_profiles", {"social_profiles": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "warn", 1), (2, "warn", 1), (3, "pass", 2))],
    *[("auth_review_platforms", {"mentions_reviews": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "warn", 1), (2, "warn", 2), (3, "warn", 2), (4, "pass", 3))],
    ("auth_google_business", {}, "fail", 0), ("auth_google_business", {"map_link": True}, "warn", 1), ("auth_google_business", {"map_embed": True, "map_link": True}, "pass", 2),
    *[("auth_sectoral", {"mentions_sectoral": n}, s, p) for n, s, p in ((0, "fail", 0), (1, "warn", 1), (2, "warn", 1), (3, "pass", 2))],
]


@pytest.fixture(scope="module")
def results(spark, sf):
    schema = catalog.site_facts(spark, sf).schema
    fields = [f for f in schema.fields if f.name in NONE]
    from pyspark.sql.types import LongType, StructField, StructType

    shape = StructType([StructField("site_id", LongType())] + [StructField(f.name, f.dataType) for f in fields])
    rows = [tuple([i] + [(NONE | change)[f.name] for f in fields]) for i, (_, change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, shape)
    wanted = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "site_id bigint, check_id string")
    got = C.run_checks(df, C.all_checks()).join(F.broadcast(wanted), ["site_id", "check_id"])
    return {r["site_id"]: r for r in got.collect()}


def test_51_checks_worth_20_points_a_category(spark):
    listed = C.all_checks()
    assert len(listed) == len({c.id for c in listed}) == 51
    for name in C.CATEGORIES:
        assert sum(c.points_max for c in listed if c.category == name) in (20,)


def test_every_check_has_a_case():
    assert {c[0] for c in CASES} == set(NONE and {c[0] for c in CASES}) and len({c[0] for c in CASES}) == 51


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{n}" for n, c in enumerate(CASES)])
def test_boundary(results, i):
    _, _, status, points = CASES[i]
    row = results[i]
    assert (row["status"], row["points_earned"]) == (status, points)
    assert (row["recommendation"] is not None) == (status in ("fail", "warn"))


def test_scores_leave_skipped_checks_out(spark):
    rows = [
        (1, "content", "pass", 2, 2), (1, "content", "skipped", 0, 3), (1, "content", "warn", 1, 2),
        (1, "authority", "skipped", 0, 4), (1, "foundations", "fail", 0, 3),
    ]
    df = spark.createDataFrame(rows, "site_id int, category string, status string, points_earned int, points_max int")
    scores = {r["category"]: r["score"] for r in scoring.category_scores(df).collect()}
    assert scores == {"content": 15, "authority": 0, "foundations": 0}
    total = scoring.technical_scores(df).first()
    assert (total["technical_score"], total["total_checks"], total["passed_checks"]) == (15, 5, 1)


def test_covered_links_and_robots_stay_linear(spark):
    """Tens of thousands of addresses and rules are read in seconds."""
    import time

    from pyspark.sql import functions as F

    from geovis.operators import robots, sitemaps

    known, n = [f"https://e.com/{k}/" for k in range(50_000)], 50_000
    links = [f"https://e.com/{k}" for k in range(0, 100_000, 50)] + ["https://e.com/7/deep/er", "https://other.com/1", "https://e.co"]
    df = spark.createDataFrame([(links, known)], "links array<string>, known array<string>")
    df = df.select("links", F.transform("known", lambda x: F.struct(x.alias("loc"))).alias("entries"))
    start = time.time()
    got = df.select(sitemaps.covered_links(F.col("links"), F.col("entries")).alias("n")).first()["n"]
    cut = {k.removesuffix("/") for k in known}
    prefixes = lambda x: any(x[:e] in cut for e in range(len(x) + 1))
    assert got == sum(prefixes(x) for x in links)
    text = "User-agent: a\nUser-agent: b\n" + "\n".join(f"Disallow: /{k}" for k in range(n))
    rows = spark.createDataFrame([(1, text)], "site_id long, robots_txt string")
    assert robots.robots_rules(rows).count() == 2 + 2 * n
    assert time.time() - start < 60
