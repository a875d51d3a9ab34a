"""Files made for answer engines: llms.txt, Markdown twins, sitemap shape, languages."""

from pyspark.sql import functions as F

from geovis.functions.core import built_once
from geovis.operators.checks.registry import Check, describe, graded, yes_no

C = "geo_triptych"
c = F.col

# The site facts that these checks read.
FACTS = [
    "has_llms", "llms_points", "llms_covered", "sitemap_entries", "llms_link_count", "md_found",
    "md_tested", "sitemap_children", "has_sitemap_text", "sitemap_depth_max", "sitemap_depth_avg",
    "sitemap_is_index", "language_hint", "hreflang_count", "llms_h1", "llms_quote", "llms_sections",
    "has_llms_full", "sitemap_priority",
]


@built_once
def checks() -> list[Check]:
    """The answer-engine file checks."""
    structure = F.when(c("has_llms"), c("llms_points")).otherwise(0)

    overlap = F.coalesce(
        F.try_divide(c("llms_covered"), F.least(c("sitemap_entries"), F.lit(10))), F.lit(0.0)
    )
    covers = (overlap >= 0.3) | (c("llms_link_count") >= 5)

    md_share = F.try_divide(c("md_found"), c("md_tested"))
    md = (
        F.when(c("md_tested") == 0, 0)
        .when(md_share >= 0.8, 4)
        .when(md_share >= 0.5, 3)
        .when(md_share >= 0.2, 2)
        .when(c("md_found") >= 1, 1)
        .otherwise(0)
    )

    empty_map = (c("sitemap_entries") == 0) & (c("sitemap_children") == 0)
    shape = (
        F.when(~c("has_sitemap_text") | empty_map, 0)
        .when((c("sitemap_depth_max") <= 3) & (c("sitemap_depth_avg") <= 2), 2)
        .when(c("sitemap_depth_max") <= 4, 1)
        .otherwise(0)
    )
    segmented = (c("sitemap_entries") <= 100) | c("sitemap_is_index") | (c("sitemap_children") > 0)
    multilingual = c("language_hint") | (c("hreflang_count") > 0)

    def needs_sitemap(condition):
        """Fails without a sitemap, else pass or warn."""
        met = c("has_sitemap_text") & condition
        return (
            F.when(~c("has_sitemap_text"), "fail").when(met, "pass").otherwise("warn"),
            F.when(met, 1).otherwise(0),
        )

    return [
        Check(
            "llms_txt_present", C, 4, "llms.txt present", *yes_no(c("has_llms"), 4),
            describe(present=c("has_llms")), "Publish an llms.txt with title, summary and link sections.",
        ),
        Check(
            "llms_txt_structure", C, 3, "llms.txt well structured", graded(structure, 3), structure,
            describe(title=c("llms_h1"), summary=c("llms_quote"), sections=c("llms_sections"), links=c("llms_link_count")),
            "Give llms.txt a title, a quoted summary, sections and at least five links.",
        ),
        Check(
            "llms_txt_coverage", C, 2, "llms.txt covers the main pages",
            F.when(~c("has_llms"), "fail").when(~c("has_sitemap_text"), "skipped").when(covers, "pass").otherwise("warn"),
            F.when(~c("has_llms") | ~c("has_sitemap_text"), 0).when(covers, 2).when(c("llms_link_count") >= 1, 1).otherwise(0),
            describe(links=c("llms_link_count"), in_sitemap=c("llms_covered")),
            "List the main pages of the sitemap in llms.txt.",
        ),
        Check(
            "llms_full_txt_present", C, 2, "llms-full.txt present", *yes_no(c("has_llms_full"), 2, "warn"),
            describe(present=c("has_llms_full")), "Publish the full site text as llms-full.txt.",
        ),
        Check(
            "md_versions_pages", C, 4, "Markdown twins of the main pages",
            F.when(c("md_tested") == 0, "skipped").otherwise(graded(md, 3)), md,
            describe(tested=c("md_tested"), found=c("md_found")),
            "Offer every main page as Markdown under its address plus .md.",
        ),
        Check(
            "sitemap_logical_structure", C, 2, "Flat sitemap", graded(shape, 2), shape,
            describe(deepest=c("sitemap_depth_max"), entries=c("sitemap_entries")),
            "Keep pages within three path levels.",
        ),
        Check(
            "sitemap_priority_first", C, 1, "Key pages first in the sitemap",
            *needs_sitemap(c("sitemap_priority")), describe(found=c("sitemap_priority")),
            "Put home, services, contact and FAQ at the top of the sitemap.",
        ),
        Check(
            "sitemap_segmented", C, 1, "Large sitemap split up", *needs_sitemap(segmented),
            describe(entries=c("sitemap_entries")), "Split more than 100 addresses into child sitemaps.",
        ),
        Check(
            "hreflang_multilingual", C, 1, "Language versions declared",
            *yes_no(~multilingual | (c("hreflang_count") >= 2), 1),
            describe(multilingual=multilingual, declared=c("hreflang_count")),
            "Declare each language version with an hreflang link.",
        ),
    ]
