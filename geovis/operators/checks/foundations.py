"""Technical foundations: sitemap, robots, transport, mobile, sampled pages."""

from pyspark.sql import functions as F

from geovis.functions.core import built_once
from geovis.operators.checks.registry import Check, describe, graded, yes_no
from geovis.operators.robots import AI_BOTS

C = "foundations"
c = F.col

# Speed checks without a data source; they are listed and always skipped.
UNMEASURED = [
    ("cwv_lcp", 2, "Largest contentful paint below 2.5 s"),
    ("cwv_cls", 1, "Cumulative layout shift below 0.1"),
    ("cwv_inp", 1, "Interaction to next paint below 200 ms"),
]

BOT_LABELS = {
    "robots_gptbot": "OpenAI crawler allowed",
    "robots_claudebot": "Anthropic crawlers allowed",
    "robots_perplexitybot": "Perplexity crawlers allowed",
    "robots_google_extended": "Google AI crawler allowed",
}

# The site facts that these checks read.
FACTS = [
    "protocol", "home_status", "sitemap_ok", "sitemap_error", "sitemap_is_index", "sitemap_children",
    "sitemap_entries", "probed_ok", "probed", "sitemap_dated", "sitemap_recent", "robots_ok",
    "sitemap_status", "robots_status", "http_probe_ok", "viewport", "sampled", "sampled_errors",
    *[f"{check_id}_{fact}" for check_id in AI_BOTS for fact in ("allowed", "named")],
]


@built_once
def checks() -> list[Check]:
    """The foundation checks."""
    https = (c("protocol") == "https") & (F.coalesce(c("home_status"), F.lit(0)) == 200)

    validity = (
        F.when(~c("sitemap_ok") | c("sitemap_error").isNotNull(), 0)
        .when(c("sitemap_is_index") & (c("sitemap_children") > 0), 2)
        .when(c("sitemap_entries") == 0, 0)
        .when(c("probed_ok") == c("probed"), 2)
        .when(c("probed_ok") >= c("probed") - 1, 1)
        .otherwise(0)
    )

    fresh = c("sitemap_ok") & (c("sitemap_dated") > 0) & (c("sitemap_recent") > c("sitemap_dated") * 0.5)

    def bot(check_id: str) -> Check:
        allowed, named = c(f"{check_id}_allowed"), c(f"{check_id}_named")
        return Check(
            check_id, C, 1, BOT_LABELS[check_id],
            F.when(~c("robots_ok"), "warn")
            .when(~allowed, "fail")
            .when(named, "pass")
            .otherwise("warn"),
            F.when(~c("robots_ok") | allowed, 1).otherwise(0),
            describe(robots=c("robots_ok"), named=named, allowed=allowed),
            f"Name {AI_BOTS[check_id][0]} in robots.txt with an explicit Allow rule.",
        )

    return [
        Check(
            "sitemap_accessible", C, 3, "Sitemap reachable", *yes_no(c("sitemap_ok"), 3),
            describe(status=c("sitemap_status")), "Publish a sitemap.xml at the site root.",
        ),
        Check(
            "sitemap_valid_resolvable", C, 2, "Sitemap valid, sampled addresses respond",
            graded(validity, 2), validity,
            describe(error=c("sitemap_error"), entries=c("sitemap_entries"), children=c("sitemap_children"),
                     probed=c("probed"), responding=c("probed_ok")),
            "Rebuild the sitemap from the list of live pages.",
        ),
        Check(
            "sitemap_uptodate", C, 1, "Most dated sitemap entries are recent",
            F.when(~c("sitemap_ok"), "fail").when(fresh, "pass").otherwise("warn"),
            F.when(fresh, 1).otherwise(0),
            describe(dated=c("sitemap_dated"), recent=c("sitemap_recent")),
            "Write a lastmod date for every entry and keep it current.",
        ),
        Check(
            "robots_present", C, 1, "robots.txt present", *yes_no(c("robots_ok"), 1),
            describe(status=c("robots_status")), "Publish a robots.txt at the site root.",
        ),
        *[bot(check_id) for check_id in AI_BOTS],
        Check(
            "https_active", C, 2, "Encrypted transport", *yes_no(https, 2),
            describe(protocol=c("protocol"), status=c("home_status")), "Serve the site over HTTPS.",
        ),
        Check(
            "http_to_https_redirect", C, 1, "Plain address leads to the encrypted one",
            F.when(~https, "fail").when(F.coalesce(c("http_probe_ok"), F.lit(False)), "pass").otherwise("warn"),
            F.when(https & F.coalesce(c("http_probe_ok"), F.lit(False)), 1).otherwise(0),
            describe(probe_ok=c("http_probe_ok")), "Redirect every http address permanently to https.",
        ),
        *[
            Check(i, C, points, label, F.lit("skipped"), F.lit(0), F.lit("not measured"), "")
            for i, points, label in UNMEASURED
        ],
        Check(
            "mobile_responsive", C, 1, "Viewport set for mobile",
            *yes_no(F.contains(c("viewport"), F.lit("width=")), 1),
            describe(viewport=c("viewport")), "Add a viewport meta tag with width=device-width.",
        ),
        Check(
            "sample_pages_ok", C, 1, "Sampled pages answer without errors",
            F.when(c("sampled") == 0, "skipped").when(c("sampled_errors") == 0, "pass").otherwise("fail"),
            F.when((c("sampled") > 0) & (c("sampled_errors") == 0), 1).otherwise(0),
            describe(sampled=c("sampled"), errors=c("sampled_errors")),
            "Repair or remove internal links to failing pages.",
        ),
    ]
