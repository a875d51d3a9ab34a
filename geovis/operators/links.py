"""Which internal pages of a site to look at: a small sample, the likely key pages first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geovis.functions import urls as U
from geovis.functions.text import EDGE_R

SAMPLE_SIZE = 5

# Link patterns of key pages, in order of preference.
PRIORITY_PATTERNS = [
    r"/(services?|prestations?|offres?)/",
    rf"/(a-propos|about|qui-sommes-nous){EDGE_R}",
    rf"/(faq|questions?){EDGE_R}",
    rf"/(contact){EDGE_R}",
    r"/(blog|news|actualit)",
]


def sample_links(links: Column, home: Column, size: int = SAMPLE_SIZE) -> Column:
    """The first link of each priority pattern, then page order, up to `size` distinct links.

    Works within the row: a site's links never leave it, so a huge site moves nothing.
    """
    pages = F.filter(links, lambda u: U.is_page_link(u) & (u != home))

    def first(pattern):
        return F.get(F.filter(pages, lambda u: u.rlike(pattern)), F.lit(0))

    first_of_each = F.array_compact(F.array(*[first(p) for p in PRIORITY_PATTERNS]))
    return F.slice(F.array_distinct(F.concat(first_of_each, pages)), 1, size)
