"""All 51 checks, in report order. Add entries to a category to extend them."""

from geovis.operators.checks import authority, content, foundations, geo, structured
from geovis.operators.checks.registry import CATEGORIES, Check, run_checks

BY_CATEGORY = {
    "foundations": foundations.checks,
    "geo_triptych": geo.checks,
    "structured_data": structured.checks,
    "content": content.checks,
    "authority": authority.checks,
}

FACTS = {
    "foundations": foundations.FACTS,
    "geo_triptych": geo.FACTS,
    "structured_data": structured.FACTS,
    "content": content.FACTS,
    "authority": authority.FACTS,
}
ALL_FACTS = [fact for name in CATEGORIES for fact in FACTS[name]]


def all_checks() -> list[Check]:
    return [check for name in CATEGORIES for check in BY_CATEGORY[name]()]


__all__ = ["ALL_FACTS", "BY_CATEGORY", "CATEGORIES", "Check", "FACTS", "all_checks", "run_checks"]
