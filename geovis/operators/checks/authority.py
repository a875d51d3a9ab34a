"""What others say about the brand."""

from pyspark.sql import functions as F

from geovis.functions.core import built_once
from geovis.operators.checks.registry import Check, describe, graded

C = "authority"
c = F.col

# The site facts that these checks read.
FACTS = [
    "brand", "wiki_fr", "wiki_en", "best_rating", "social_profiles", "map_embed", "map_link",
    "rating_total", "mentions_press", "mentions_reddit", "mentions_reviews", "mentions_sectoral",
]


@built_once
def checks() -> list[Check]:
    """The authority checks."""
    no_brand = c("brand") == ""

    def steps(value, *limits):
        """Points by the first limit a count reaches; `limits` are (at least, points)."""
        out = F.lit(0)
        for least, points in sorted(limits):
            out = F.when(value >= least, points).otherwise(out)
        return out

    def mentions(check_id, points_max, label, kind, limits, advice):
        points = steps(c(f"mentions_{kind}"), *limits)
        return Check(
            check_id, C, points_max, label,
            F.when(no_brand, "skipped").otherwise(graded(points, points_max)),
            F.when(no_brand, 0).otherwise(points), describe(mentions=c(f"mentions_{kind}")), advice,
        )

    wiki = F.when(c("wiki_fr") & c("wiki_en"), 4).when(c("wiki_fr") | c("wiki_en"), 3).otherwise(0)
    rating = F.when(c("best_rating") >= 4.0, 2).when(c("best_rating") >= 3.0, 1).otherwise(0)
    social = steps(c("social_profiles"), (3, 2), (1, 1))
    map_points = F.when(c("map_embed"), 2).when(c("map_link"), 1).otherwise(0)

    return [
        Check(
            "auth_wikipedia", C, 4, "Encyclopedia article in French and English",
            F.when(no_brand, "skipped").otherwise(graded(wiki, 4, 3)), F.when(no_brand, 0).otherwise(wiki),
            describe(fr=c("wiki_fr"), en=c("wiki_en")), "Earn an encyclopedia article in both languages.",
        ),
        mentions("auth_press_mentions", 3, "Press mentions", "press", [(6, 3), (3, 2), (1, 1)],
                  "Get mentioned by well-known media."),
        Check(
            "auth_aggregate_rating", C, 2, "Rating of at least 4", graded(rating, 2), rating,
            describe(best=c("best_rating"), reviews=c("rating_total")), "Publish verified ratings as AggregateRating.",
        ),
        mentions("auth_reddit", 2, "Forum mentions", "reddit", [(4, 2), (1, 1)],
                  "Take part in the forums of your trade."),
        Check(
            "auth_social_profiles", C, 2, "Three linked social profiles", graded(social, 2), social,
            describe(profiles=c("social_profiles")), "Link the main social profiles from the home page.",
        ),
        mentions("auth_review_platforms", 3, "Review platforms", "reviews", [(4, 3), (2, 2), (1, 1)],
                  "Keep profiles on the main review platforms."),
        Check(
            "auth_google_business", C, 2, "Map on the home page", graded(map_points, 2), map_points,
            describe(embed=c("map_embed"), link=c("map_link")), "Embed the map of the business profile.",
        ),
        mentions("auth_sectoral", 2, "Trade platforms", "sectoral", [(3, 2), (1, 1)],
                  "Get listed on the trade's reference platforms."),
    ]
