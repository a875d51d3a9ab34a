"""Prices, models and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer providers in report order, and the model asked at each.
PROVIDERS = ["openai", "anthropic", "perplexity", "gemini"]
VISIBILITY_MODELS = {
    "openai": "openai/gpt-4o",
    "anthropic": "anthropic/claude-sonnet-4-5",
    "perplexity": "perplexity/sonar",
    "gemini": "google/gemini-2.5-flash",
}

# Model name prefix -> provider.
MODEL_PREFIXES = {
    "openai/": "openai", "anthropic/": "anthropic", "perplexity/": "perplexity", "google/": "gemini",
}

# Provider, model, USD per 1M tokens in and out, USD per request.
PRICES = [
    ("openai", "gpt-4o-2024-08-06", "2.5", "10.0", None),
    ("openai", "gpt-4o-mini-2024-07-18", "0.15", "0.6", None),
    ("openai", "gpt-4.1", "2.0", "8.0", None),
    ("anthropic", "claude-sonnet-4-5", "3.0", "15.0", None),
    ("anthropic", "claude-sonnet-4-6", "3.0", "15.0", None),
    ("anthropic", "claude-haiku-4-5-20251001", "1.0", "5.0", None),
    ("perplexity", "sonar", "1.0", "1.0", "0.005"),
    ("perplexity", "sonar-pro", "3.0", "15.0", "0.006"),
    ("gemini", "gemini-2.5-flash", "0.3", "2.5", None),
    ("gemini", "gemini-2.5-pro", "1.25", "10.0", None),
]
USD_TO_EUR = "0.92"

MONTHS_FR = [
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
]


def model_provider(model: Column) -> Column:
    """Provider by model name prefix; unknown names count as the first provider."""
    out = F.lit(PROVIDERS[0])
    for prefix, provider in MODEL_PREFIXES.items():
        out = F.when(model.startswith(prefix), provider).otherwise(out)
    return out


def is_known_model(model: Column) -> Column:
    known = F.lit(False)
    for prefix in MODEL_PREFIXES:
        known = known | model.startswith(prefix)
    return known


def native_model(model: Column) -> Column:
    return F.regexp_replace(model, r"^google/", "")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, fee: Column) -> Column:
    """USD of one call as an exact decimal; prices are decimals per million tokens."""
    million = F.lit("0.000001").cast("decimal(7,6)")
    return (
        (tokens_in.cast("decimal(12,0)") * price_in + tokens_out.cast("decimal(12,0)") * price_out)
        * million
    ) + F.coalesce(fee, F.lit("0").cast("decimal(8,4)"))


def to_eur(usd: Column, rate: str = USD_TO_EUR) -> Column:
    return usd * F.lit(rate).cast("decimal(8,4)")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def euro_text(amount: Column) -> Column:
    """French display of an amount: narrow no-break space, decimal comma, euro sign."""
    grouped = F.format_number(amount.cast("decimal(18,2)"), 2)
    french = F.translate(grouped, ",.", "\u202f,")
    return F.concat(french, F.lit("\u00a0€"))


def date_text(ts: Column) -> Column:
    """French display of a date, e.g. 30 avril 2026."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS_FR]), F.month(ts))
    return F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), name, F.lit(" "), F.year(ts).cast("string"))
