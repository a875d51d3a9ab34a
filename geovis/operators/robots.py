"""Crawler rules. A robots file is one cell, so its rules are read within the row: text ->
blocks -> (agent, kind, value). No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.functions.core import let, unfold
from geovis.functions.text import js_trim

# Crawlers of the four answer providers, by check.
AI_BOTS = {
    "robots_gptbot": ["GPTBot"],
    "robots_claudebot": ["ClaudeBot", "Claude-Web", "anthropic-ai"],
    "robots_perplexitybot": ["PerplexityBot", "Perplexity-User"],
    "robots_google_extended": ["Google-Extended"],
}

_RULE_TYPE = "array<struct<agent:string,kind:string,value:string>>"


def _lines(text: Column) -> Column:
    """Lines without comments and outer white space."""
    return F.transform(
        F.split(text, r"\r?\n"), lambda line: js_trim(F.regexp_replace(line, r"(?s)#.*\z", ""))
    )


def _fields(line: Column) -> Column:
    return F.struct(
        F.lower(js_trim(F.regexp_extract(line, r"(?s)\A([^:]*):", 1))).alias("key"),
        js_trim(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"),
    )


def blocks(text: Column) -> Column:
    """array(array(struct(key, value))): an empty or comment-only line ends a block."""
    parts = F.split(F.array_join(_lines(text), "\n"), r"\n{2,}")
    return F.transform(
        parts,
        lambda part: F.transform(
            F.filter(F.split(part, "\n"), lambda line: F.contains(line, F.lit(":"))), _fields
        ),
    )


def rules(text: Column) -> Column:
    """array(struct(agent, kind, value)) with kind agent, allow or disallow. A rule belongs to
    every agent named above it in its block; rules before any agent are dropped."""

    def of_block(fields):
        numbered = F.transform(fields, lambda f, i: F.struct(f.key.alias("key"), f.value.alias("value"), i.alias("line")))
        return let(F.filter(numbered, lambda f: f.key == "user-agent"), lambda agents: of_lines(fields, agents))

    def of_lines(fields, agents):
        def of_line(field, i):
            return (
                F.when(
                    field.key == "user-agent",
                    F.array(F.struct(field.value.alias("agent"), F.lit("agent").alias("kind"), F.lit("").alias("value"))),
                )
                .when(
                    field.key.isin("allow", "disallow"),
                    F.transform(
                        F.filter(agents, lambda a: a.line < i),
                        lambda a: F.struct(a.value.alias("agent"), field.key.alias("kind"), field.value.alias("value")),
                    ),
                )
                .otherwise(F.array().cast(_RULE_TYPE))
            )

        return F.flatten(F.transform(fields, of_line))

    return F.flatten(F.transform(blocks(F.coalesce(text, F.lit(""))), of_block))


def sitemap_lines(text: Column) -> Column:
    """Addresses the file names as sitemaps."""
    every = F.flatten(blocks(text))
    return F.transform(F.filter(every, lambda f: f.key == "sitemap"), lambda f: f.value)


def bot_states(rule_list: Column, bots: list[str], rfc_empty_disallow: bool = False) -> Column:
    """array(struct(bot, explicit, allowed)): the bot's own block decides; else the block for all
    agents; else it is allowed. A block that closes the whole site counts unless it also opens it.
    An empty Disallow closes the site unless `rfc_empty_disallow` is set."""
    closing = ["/"] if rfc_empty_disallow else ["/", ""]

    def state(bot):
        def decide(own):
            agent = F.when(own, bot).otherwise("*")

            def any_rule(kind, values):
                return F.exists(
                    rule_list, lambda r: (r.agent == agent) & (r.kind == kind) & r.value.isin(*values)
                )

            return F.struct(
                bot.alias("bot"), own.alias("explicit"),
                (~any_rule("disallow", closing) | any_rule("allow", ["/", ""])).alias("allowed"),
            )

        return let(F.exists(rule_list, lambda r: r.agent == bot), decide)

    return F.transform(F.array(*[F.lit(b) for b in bots]), state)


def any_bot(states: Column, field: str, bots: list[str]) -> Column:
    """Whether `field` (explicit or allowed) holds for any of the bots."""
    return F.exists(states, lambda s: s.bot.isin(*bots) & s[field])


def robots_rules(resources: DataFrame, key: str = "site_id", text: str = "robots_txt") -> DataFrame:
    """Long table (key, ord, agent, kind, value)."""
    return unfold(resources, key, rules(F.col(text)), "r").select(key, "ord", "r.*")


def bot_access(
    resources: DataFrame, bots: list[str], key: str = "site_id", text: str = "robots_txt",
    rfc_empty_disallow: bool = False,
) -> DataFrame:
    """Long table (key, bot, explicit, allowed)."""
    staged = resources.select(key, rules(F.col(text)).alias("_rules"))
    return staged.select(key, F.inline_outer(bot_states(F.col("_rules"), bots, rfc_empty_disallow)))
