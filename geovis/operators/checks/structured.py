"""Structured data in JSON-LD."""

from pyspark.sql import functions as F

from geovis.functions.core import built_once
from geovis.operators.checks.registry import Check, describe, graded, yes_no

C = "structured_data"
c = F.col

# The site facts that these checks read.
FACTS = [
    "local_count", "travel_site", "local_filled", "review_count", "embedded_ratings", "org_filled",
    "org_count", "has_blog", "article_count", "block_count", "block_errors",
    "offering_count", "faq_schema_count", "breadcrumb_count",
]


@built_once
def checks() -> list[Check]:
    """The structured data checks."""
    local = (c("local_count") > 0) | c("travel_site")
    complete = F.when(c("local_filled") == 3, 2).when(c("local_filled") == 2, 1).otherwise(0)
    rated = (c("review_count") > 0) | (c("embedded_ratings") > 0)

    def has(check_id, points, label, count, advice):
        return Check(check_id, C, points, label, *yes_no(c(count) > 0, points, "warn"),
                     describe(found=c(count)), advice)

    return [
        Check(
            "schema_organization", C, 3, "Complete Organization entry", graded(c("org_filled"), 3), c("org_filled"),
            describe(entries=c("org_count"), fields=c("org_filled")),
            "Describe the organisation with name, url and logo.",
        ),
        Check(
            "schema_local_business", C, 3, "Local business entry",
            F.when(~local, "skipped").when(c("local_count") > 0, "pass").otherwise("fail"),
            F.when(c("local_count") > 0, 3).otherwise(0),
            describe(local=local, entries=c("local_count")),
            "Add an entry of the fitting local type, such as Hotel or Restaurant.",
        ),
        Check(
            "schema_local_complete", C, 2, "Local business with address, phone and hours",
            F.when(~local, "skipped").otherwise(graded(complete, 2)), F.when(local, complete).otherwise(0),
            describe(fields=c("local_filled")), "Fill in address, telephone and opening hours.",
        ),
        has("schema_product_service", 3, "Product, Service or Offer entry", "offering_count",
             "Describe what is on offer as Product, Service or Offer."),
        has("schema_faq", 3, "FAQ entry", "faq_schema_count", "Mark questions and answers up as FAQPage."),
        Check(
            "schema_review_rating", C, 2, "Review or rating entry", *yes_no(rated, 2, "warn"),
            describe(entries=c("review_count"), embedded=c("embedded_ratings")),
            "Mark customer reviews up as Review or AggregateRating.",
        ),
        has("schema_breadcrumb", 1, "Breadcrumb entry", "breadcrumb_count", "Add a BreadcrumbList."),
        Check(
            "schema_article", C, 2, "Article entry where there is a blog",
            F.when(~c("has_blog"), "skipped").when(c("article_count") > 0, "pass").otherwise("warn"),
            F.when(c("has_blog") & (c("article_count") > 0), 2).otherwise(0),
            describe(blog=c("has_blog"), entries=c("article_count")), "Mark blog posts up as Article.",
        ),
        Check(
            "schema_no_errors", C, 1, "JSON-LD without errors",
            F.when(c("block_count") == 0, "skipped").when(c("block_errors") > 0, "fail").otherwise("pass"),
            F.when((c("block_count") > 0) & (c("block_errors") == 0), 1).otherwise(0),
            describe(blocks=c("block_count"), errors=c("block_errors")), "Correct the blocks that are no valid JSON.",
        ),
    ]
