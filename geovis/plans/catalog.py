"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions import money as M
from geovis.functions import text as T
from geovis.functions import urls as U
from geovis.functions.core import unfold
from geovis.operators import checks as C
from geovis.operators import contracts, costs, facts, guards, jsonld, mentions, report, robots
from geovis.operators import scoring, signals, sitemaps, visibility
from geovis.operators.links import sample_links
from geovis.plans import inputs as I
from geovis.plans import streams
from geovis.session import saved, work_dir
from geovis.sources import captures, replies, requests, sinks

NOW_EVENTS = "2024-01-20T12:00:00"
CAPS_EVENTS = costs.Caps(cap=60.0, warning=20.0, critical=40.0)
CAPS_ORDERS = costs.Caps(cap=300.0, warning=100.0, critical=200.0)
USER = 7


def _text(column: str):
    return F.array_join(column, "|")


# -- pages ---------------------------------------------------------------------------------


def url_forms(spark, sf) -> DataFrame:
    u = F.col("url")
    return I.read(spark, sf, "pages").select(
        "page_id", U.site_url(u).alias("site_url"), U.page_url(u).alias("page_url"),
        U.domain(u).alias("domain"), U.origin(u).alias("origin"), U.path_depth(u).alias("depth"),
        U.protocol(u).alias("protocol"), U.is_page_link(u).alias("is_page"),
    )


def _signals(spark, sf) -> DataFrame:
    return signals.page_signals(I.sites(spark, sf).select("site_id", "url", "home_html"), html="home_html")


def page_meta(spark, sf) -> DataFrame:
    s = _signals(spark, sf)
    return s.select(
        "site_id", "title", "description", "canonical", "viewport",
        signals.page_language(F.col("lang"), F.col("og")).alias("language"),
        F.col("og")["site_name"].alias("og_site_name"), F.col("og")["title"].alias("og_title"),
        F.size("og").alias("og_count"), F.col("twitter")["card"].alias("twitter_card"),
        F.array_join(F.array_sort(F.transform(F.map_entries("og"), lambda e: F.concat(e.key, F.lit("="), e.value))), "|").alias("og_pairs"),
    )


def page_headings(spark, sf) -> DataFrame:
    s = _signals(spark, sf)
    return s.select(
        "site_id", _text("h1").alias("h1"), F.size("h2").alias("h2_count"), F.size("h4").alias("h4_count"),
        _text(F.concat("h2", "h3")).alias("h2_h3"),
    )


def question_headings(spark, sf) -> DataFrame:
    s = _signals(spark, sf).select("site_id", F.concat("h1", "h2", "h3").alias("headings"))
    long = unfold(s, "site_id", F.col("headings"), "heading")
    return long.withColumn("is_question", T.is_question(F.col("heading")))


def heading_answers(spark, sf) -> DataFrame:
    long = unfold(_signals(spark, sf), "site_id", F.col("answers"), "a")
    return long.select(
        "site_id", "ord", "a.heading", "a.answer",
        T.opens_like_answer(F.col("a.answer")).alias("direct"),
    )


def image_stats(spark, sf) -> DataFrame:
    return _signals(spark, sf).select("site_id", "images.*")


def hreflang_pairs(spark, sf) -> DataFrame:
    return unfold(_signals(spark, sf), "site_id", F.col("hreflang"), "p").select("site_id", "ord", "p.*")


def page_links(spark, sf) -> DataFrame:
    return signals.page_links(I.sites(spark, sf), "site_id", "url", "home_html")


def link_sample(spark, sf) -> DataFrame:
    s = _signals(spark, sf)
    return unfold(s, "site_id", sample_links(F.col("links"), U.site_url(F.col("url"))), "link")


def visible_text(spark, sf) -> DataFrame:
    h = F.col("home_html")
    return I.sites(spark, sf).select(
        "site_id", F.md5(H.visible_text(h)).alias("text_md5"), T.count_words(H.main_text(h)).alias("words")
    )


def document_readability(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents")
    r = T.readability(T.collapse_space(F.col("text")))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.*")


def shell_and_wall(spark, sf) -> DataFrame:
    h = F.col("home_html")
    return I.sites(spark, sf).select(
        "site_id", H.is_shell(h).alias("is_shell"), H.bot_wall(h, F.lit("")).alias("bot_wall")
    )


def brand_names(spark, sf) -> DataFrame:
    return facts.page_facts(I.sites(spark, sf), I.NOW).select("site_id", "brand")


# -- JSON-LD and resources -----------------------------------------------------------------


def jsonld_blocks(spark, sf) -> DataFrame:
    return jsonld.jsonld_blocks(I.sites(spark, sf), "site_id", "home_html")


def jsonld_objects(spark, sf) -> DataFrame:
    o = jsonld.jsonld_objects(I.sites(spark, sf), "site_id", "home_html")
    return o.select(
        "site_id", "ord", _text("types").alias("types"), "name", "has_name", "has_url", "has_logo",
        "has_address", "has_phone", "has_hours", "has_rating", "rating", "reviews",
    )


def local_businesses(spark, sf) -> DataFrame:
    o = jsonld.jsonld_objects(I.sites(spark, sf), "site_id", "home_html")
    return jsonld.with_type(o, jsonld.LOCAL_BUSINESS).select("site_id", "ord", "name")


def site_ratings(spark, sf) -> DataFrame:
    f = facts.page_facts(I.sites(spark, sf), I.NOW)
    return f.select("site_id", "best_rating", "rating_total")


def robots_rules(spark, sf) -> DataFrame:
    return robots.robots_rules(I.sites(spark, sf)).select("site_id", "agent", "kind", "value")


def bot_access(spark, sf) -> DataFrame:
    bots = [b for names in robots.AI_BOTS.values() for b in names]
    return robots.bot_access(I.sites(spark, sf), bots)


def sitemap_entries(spark, sf) -> DataFrame:
    return sitemaps.sitemap_entries(I.sites(spark, sf))


def sitemap_stats(spark, sf) -> DataFrame:
    return facts.page_facts(I.sites(spark, sf), I.NOW).select(
        "site_id", "sitemap_error", "sitemap_is_index", "sitemap_children", "sitemap_entries",
        "sitemap_dated", "sitemap_recent", "sitemap_depth_max",
        F.round("sitemap_depth_avg", 6).alias("sitemap_depth_avg"), "sitemap_priority",
    )


def sitemap_probes(spark, sf) -> DataFrame:
    own = I.sites(spark, sf).select("site_id", sitemaps.probe_sample(sitemaps.entries(F.col("sitemap_xml"))).alias("probe_urls"))
    return sitemaps.probe_results(own, I.url_status(spark, sf))


def llms_files(spark, sf) -> DataFrame:
    s = I.sites(spark, sf).filter(F.col("llms_txt").isNotNull())
    entries, links = sitemaps.entries(F.col("sitemap_xml")), sitemaps.llms_links(F.col("llms_txt"))
    return s.select(
        "site_id", sitemaps.llms_structure(F.col("llms_txt")).alias("s"), F.size(links).alias("absolute_links"),
        sitemaps.covered_links(links, entries).alias("covered"),
    ).select("site_id", "s.*", "absolute_links", "covered")


# -- sources -------------------------------------------------------------------------------


def capture_choice(spark, sf) -> DataFrame:
    caps = I.derive(spark, sf, I.CAPTURE_SQL, "pages").withColumn(
        "headers", F.create_map(F.lit("via"), F.col("method"))
    )
    chosen = captures.choose_capture(caps)
    return chosen.select(
        "url", "ok", "status", "method", F.md5("html").alias("html_md5"), F.col("headers")["via"].alias("via")
    )


def site_resource_rows(spark, sf) -> DataFrame:
    return captures.site_resources(I.derive(spark, sf, I.RESOURCE_SQL, "pages")).select(
        "site_id", "robots_txt", "robots_status", "sitemap_xml", "sitemap_status", "llms_txt", "llms_status"
    )


def sampled_page_rows(spark, sf) -> DataFrame:
    p = I.derive(spark, sf, I.PAGE_FETCH_SQL, "pages").withColumn(
        "url", F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    )
    twins = p.filter("md_tested").select("url", F.col("md_status").alias("status"), F.col("md_content").alias("content"))
    rows = captures.sampled_pages(p.select(F.col("page_id").alias("site_id"), F.lit(0).alias("ord"), "url"), p, twins)
    return rows.select(
        "site_id", "status", F.md5("html").alias("html_md5"), "md_tested", "md_status", "md_content"
    )


def sampled_page_facts(spark, sf) -> DataFrame:
    own = _signals(spark, sf).select(
        "site_id", sample_links(F.col("links"), U.site_url(F.col("url"))).alias("sample_urls")
    )
    f = facts.sampled_facts(own, I.measures(spark, sf))
    return f.withColumn("service_words", F.round("service_words", 6)).withColumn("sampled_methods", _text("sampled_methods"))


def request_intake(spark, sf) -> DataFrame:
    return requests.read_requests(I.derive(spark, sf, I.REQUEST_SQL, "pages"))


def accepted_requests(spark, sf) -> DataFrame:
    return requests.accepted(request_intake(spark, sf))


def _sources(column="sources"):
    return F.array_join(
        F.transform(column, lambda s: F.concat(s["url"], F.lit("="), F.coalesce(s["title"], F.lit("")))), "|"
    )


def _reply_columns(df):
    return df.select(
        "response_id", "model", "text", "tokens_in", "tokens_out", F.round(F.col("cost_usd").cast("double"), 9).alias("cost_usd"),
        F.round(F.col("cost_eur").cast("double"), 9).alias("cost_eur"), _sources().alias("sources"), "error",
    )


def chat_replies(spark, sf) -> DataFrame:
    return _reply_columns(replies.normalize_chat_replies(I.derive(spark, sf, I.CHAT_SQL, "conversations")))


def parts_replies(spark, sf) -> DataFrame:
    raw = I.derive(spark, sf, I.PARTS_SQL, "conversations")
    return _reply_columns(replies.normalize_parts_replies(raw, costs.price_table(spark)))


def answers_by_model(spark, sf) -> DataFrame:
    chat = replies.normalize_chat_replies(I.derive(spark, sf, I.CHAT_SQL, "conversations"))
    parts = replies.normalize_parts_replies(I.derive(spark, sf, I.PARTS_SQL, "conversations"), costs.price_table(spark))
    every = replies.all_answers(chat, parts)
    return every.groupBy(M.model_provider(F.col("model")).alias("provider")).agg(
        F.count("*").alias("answers"), F.count("error").alias("errors"), F.sum("tokens_in").alias("tokens_in"),
        F.count_if(M.is_known_model(F.col("model"))).alias("known"),
    )


# -- checks --------------------------------------------------------------------------------


def site_facts(spark, sf, needed=None) -> DataFrame:
    return facts.site_facts(
        I.sites(spark, sf), I.NOW, I.url_status(spark, sf), I.measures(spark, sf),
        I.derive(spark, sf, I.SEARCH_SQL, "documents"), I.derive(spark, sf, I.ARTICLE_SQL, "documents"), needed,
    )


def _checks(category):
    def run(spark, sf) -> DataFrame:
        return C.run_checks(site_facts(spark, sf, C.FACTS[category]), C.BY_CATEGORY[category](), detail=False).drop("check_no")

    return run


def all_checks(spark, sf) -> DataFrame:
    return C.run_checks(site_facts(spark, sf, C.ALL_FACTS), C.all_checks())


def _scored_checks(spark, sf) -> DataFrame:
    return C.run_checks(site_facts(spark, sf, C.ALL_FACTS), C.all_checks(), detail=False)


def category_scores(spark, sf) -> DataFrame:
    return scoring.category_scores(_scored_checks(spark, sf))


def technical_scores(spark, sf) -> DataFrame:
    return scoring.technical_scores(_scored_checks(spark, sf))


def failed_checks(spark, sf) -> DataFrame:
    rows = report.check_lists(all_checks(spark, sf), "site_id")
    said = F.transform(F.array_sort(F.transform("checks", lambda c: F.struct(c.check_id, c.status, c.points_earned))), lambda c: F.concat_ws(":", c.check_id, c.status, c.points_earned.cast("int")))
    return rows.select(
        "site_id", F.size("failed_checks").alias("shown"), F.size("checks").alias("listed"), F.array_join(said, ",").alias("outcomes")
    )


def brand_mention_counts(spark, sf) -> DataFrame:
    return facts.mention_counts(I.derive(spark, sf, I.SEARCH_SQL, "documents"))


def encyclopedia_articles(spark, sf) -> DataFrame:
    return facts.encyclopedia_presence(I.derive(spark, sf, I.ARTICLE_SQL, "documents"))


def site_overview(spark, sf) -> DataFrame:
    facts_shown = [
        "url", "home_method", "sampled_methods", "language", "sampled", "has_sitemap_text", "has_robots_text", "has_llms",
        "is_shell", "bot_wall",
    ]
    f = site_facts(spark, sf, facts_shown)
    methods = F.array_sort(F.array_distinct(F.concat(F.array("home_method"), F.coalesce("sampled_methods", F.array().cast("array<string>")))))
    return f.select(
        "site_id", U.domain(F.col("url")).alias("domain"), "language", "sampled",
        F.array_join(methods, "|").alias("fetch_methods"), F.col("has_sitemap_text").alias("has_sitemap"),
        F.col("has_robots_text").alias("has_robots"), "has_llms", "is_shell", "bot_wall",
    )


# -- answers -------------------------------------------------------------------------------


def _answers(spark, sf) -> DataFrame:
    return I.derive(spark, sf, I.ANSWER_SQL, "conversations")


def _analyses(spark, sf) -> DataFrame:
    return contracts.load_analyses(I.derive(spark, sf, I.ANALYSIS_SQL, "conversations"))


def _responses(spark, sf) -> DataFrame:
    joined = _answers(spark, sf).join(_analyses(spark, sf), "response_id", "left")
    usable = (F.col("text") != "") & F.col("error").isNull()
    return joined.withColumn("analysed", F.coalesce(usable & F.col("brand_mentioned").isNotNull(), F.lit(False)))


def exact_mentions(spark, sf) -> DataFrame:
    found = mentions.exact_mentions(_answers(spark, sf), I.brands(spark, sf))
    return found.select("response_id", F.col("exact.at").alias("at"), F.col("exact.matched").alias("matched"))


def fuzzy_mentions(spark, sf) -> DataFrame:
    found = mentions.fuzzy_mentions(mentions.exact_mentions(_answers(spark, sf), I.brands(spark, sf)))
    return found.filter(F.col("exact").isNull()).select("response_id", "fuzzy.matched", "fuzzy.original")


def mention_report(spark, sf) -> DataFrame:
    rows = mentions.mention_results(_answers(spark, sf), I.brands(spark, sf), _analyses(spark, sf))
    return mentions.disagreement_report(rows)


def rule_analysis(spark, sf) -> DataFrame:
    dictionary = I.brands(spark, sf).withColumn(
        "competitors", F.array(*[F.lit(f"Supplier#00000000{i}") for i in (1, 7, 9)])
    )
    rows = mentions.rule_analysis(_answers(spark, sf), dictionary)
    return rows.select(
        "response_id", "brand_mentioned", "mention_position", "mention_context", "brand_citation_present",
        _text("competitors_cited").alias("competitors_cited"), _text("sources_cited").alias("sources_cited"),
    )


def loaded_analyses(spark, sf) -> DataFrame:
    rows = _analyses(spark, sf).withColumn("competitors_cited", _text("competitors_cited"))
    return rows.withColumn("context_md5", F.md5("mention_context")).drop("sources_cited", "mention_context")


def answer_points(spark, sf) -> DataFrame:
    return _responses(spark, sf).select("response_id", visibility.answer_points().alias("points"))


def visibility_scores(spark, sf) -> DataFrame:
    v = visibility.visibility_scores(_responses(spark, sf))
    return v.withColumns({c: F.round(c, 6) for c in ("mention_rate", "citation_rate")})


def top_competitors(spark, sf) -> DataFrame:
    return visibility.top_competitors(_responses(spark, sf))


def _technical(spark, sf) -> DataFrame:
    return technical_scores(spark, sf).withColumnRenamed("site_id", "audit_id")


def audit_scores(spark, sf) -> DataFrame:
    scores = visibility.audit_scores(_technical(spark, sf), _responses(spark, sf))
    return scores.select(
        "audit_id", "technical_score", "visibility_score", "global_score", "top_competitor",
        F.round("mention_rate", 2).alias("mention_rate"), F.round("citation_rate", 2).alias("citation_rate"),
    )


def global_scores(spark, sf) -> DataFrame:
    return scoring.global_scores(_technical(spark, sf), visibility.visibility_scores(_responses(spark, sf)))


def _questions(spark, sf):
    return contracts.load_queries(I.derive(spark, sf, I.QUESTION_JSON_SQL, "conversations"))


def question_list(spark, sf) -> DataFrame:
    return _questions(spark, sf)[0]


def rejected_question_lists(spark, sf) -> DataFrame:
    return _questions(spark, sf)[1]


def question_tasks(spark, sf) -> DataFrame:
    place = F.when(F.col("audit_id") % 2 == 0, "Lyon")
    return visibility.question_tasks(_questions(spark, sf)[0], place).drop("text")


def stored_question_ids(spark, sf) -> DataFrame:
    stored = I.derive(spark, sf, I.CHILD_SQL, "lineitem").select("audit_id", "position", "id")
    return contracts.attach_query_ids(_questions(spark, sf)[0], stored).drop("text")


def stored_answer_ids(spark, sf) -> DataFrame:
    local = I.derive(spark, sf, I.CHILD_SQL, "lineitem").select(
        F.col("id").alias("query_id"), F.when(F.col("position") % 2 == 0, "openai").otherwise("gemini").alias("provider")
    )
    stored = I.derive(spark, sf, I.RESPONSE_SQL, "lineitem").select("id", "query_id", F.lit("openai").alias("provider"))
    return contracts.attach_response_ids(local, stored)


def loaded_business(spark, sf) -> DataFrame:
    b = contracts.load_business(I.derive(spark, sf, I.BUSINESS_JSON_SQL, "conversations"))
    return b.withColumns({c: _text(c) for c in ("brand_aliases", "services", "detected_competitors")})


def _synthesis(spark, sf) -> DataFrame:
    return contracts.load_synthesis(I.derive(spark, sf, I.SYNTHESIS_JSON_SQL, "conversations"))


def loaded_synthesis(spark, sf) -> DataFrame:
    listed = F.transform("recommendations", lambda r: F.concat_ws(":", r.priority, r.category, r.title, r.description, r.impact_score))
    return _synthesis(spark, sf).withColumn("recommendations", F.array_join(listed, "|"))


def recommendation_rows(spark, sf) -> DataFrame:
    return contracts.recommendation_rows(_synthesis(spark, sf))


def payload_breaches(spark, sf) -> DataFrame:
    """Every broken rule of every payload that a model returned, of all six kinds."""
    from_json = [
        ("analysis", I.ANALYSIS_SQL, contracts.ANALYSIS, "response_id"),
        ("business", I.BUSINESS_JSON_SQL, contracts.BUSINESS, "audit_id"),
        ("questions", I.QUESTION_JSON_SQL, contracts.QUESTIONS, "audit_id"),
        ("synthesis", I.SYNTHESIS_JSON_SQL, contracts.SYNTHESIS, "audit_id"),
    ]
    found = [
        contracts.payload_breaches(I.derive(spark, sf, sql, "conversations").withColumnRenamed(key, "id"), contract, ["id"])
        .withColumn("payload", F.lit(name))
        for name, sql, contract, key in from_json
    ]
    for name, sql, contract in (("chat", I.CHAT_SQL, replies.CHAT), ("parts", I.PARTS_SQL, replies.PARTS)):
        raw = I.derive(spark, sf, sql, "conversations").withColumnRenamed("response_id", "id")
        found.append(replies.reply_breaches(raw, contract, ["id"]).withColumn("payload", F.lit(name)))
    return functools.reduce(DataFrame.unionByName, found)


def synthesis_input(spark, sf) -> DataFrame:
    business = contracts.load_business(I.derive(spark, sf, I.BUSINESS_JSON_SQL, "conversations"))
    checks = saved(all_checks(spark, sf).withColumnRenamed("site_id", "audit_id"), "checks")
    responses = _responses(spark, sf)
    rows = report.synthesis_input(
        business, scoring.technical_scores(checks, "audit_id"), checks, visibility.visibility_scores(responses), responses
    )
    return rows.select(
        "audit_id", "brand_name", "industry", "technical_score", "passed_checks", "total_checks", "visibility_score",
        F.col("visibility_per_provider")["gemini"].alias("gemini"), F.round("mention_rate", 6).alias("mention_rate"),
        _text("top_competitors").alias("top_competitors"), F.size("failed_checks").alias("failed_shown"),
    )


def _audit_record(spark, sf) -> DataFrame:
    checks = saved(all_checks(spark, sf).withColumnRenamed("site_id", "audit_id"), "checks")
    audits = I.read(spark, sf, "pages").select(F.col("page_id").alias("audit_id"), "url")
    return report.audit_record(
        audits, scoring.technical_scores(checks, "audit_id"), checks,
        visibility.visibility_scores(_responses(spark, sf)), _questions(spark, sf)[0], _synthesis(spark, sf),
    )


def audit_records(spark, sf) -> DataFrame:
    record = _audit_record(spark, sf)
    return record.select(
        "audit_id", "url", "technical_score", "visibility_score", F.size("checks").alias("checks"),
        F.coalesce(F.size("queries"), F.lit(0)).alias("queries"),
        F.coalesce(F.size("recommendations"), F.lit(0)).alias("recommendations"), "verdict",
    )


# -- ledgers -------------------------------------------------------------------------------


def _double(*names):
    return {n: F.round(F.col(n).cast("double"), 6) for n in names}


def _usage(spark, sf) -> DataFrame:
    usage = I.derive(spark, sf, I.USAGE_SQL, "events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return costs.price_calls(usage, costs.price_table(spark))


def _ledger(spark, sf) -> DataFrame:
    return I.derive(spark, sf, I.LEDGER_SQL, "orders").withColumn("created_at", F.col("created_at").cast("timestamp"))


def call_costs(spark, sf) -> DataFrame:
    return _usage(spark, sf).select("event_id", "cost_usd", "cost_eur", "priced").withColumns(_double("cost_usd", "cost_eur"))


def unpriced_models(spark, sf) -> DataFrame:
    return costs.unpriced_models(I.derive(spark, sf, I.USAGE_SQL, "events"), costs.price_table(spark))


def month_to_date(spark, sf) -> DataFrame:
    rows = costs.month_to_date(_usage(spark, sf), NOW_EVENTS)
    return rows.select(F.date_format("month", "yyyy-MM").alias("month"), F.round(F.col("total_eur").cast("double"), 6).alias("total_eur"))


def budget_status(spark, sf) -> DataFrame:
    """The status each month ended with."""
    totals = costs.monthly_totals(_ledger(spark, sf))
    rows = totals.withColumns(costs.budget_columns(F.col("total_eur"), CAPS_ORDERS))
    return rows.withColumn("month", F.date_format("month", "yyyy-MM")).withColumns(_double("total_eur", "remaining_eur"))


def request_admission(spark, sf) -> DataFrame:
    ledger = _ledger(spark, sf)
    opening = costs.monthly_totals(ledger.filter(F.lit(False)))
    asked = I.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("requested_at")
    ).withColumn("month", M.month_start(F.col("requested_at")))
    return costs.admit_requests(asked, opening, CAPS_ORDERS, ledger).select("request_id", "admitted")


def threshold_crossings(spark, sf) -> DataFrame:
    rows = costs.threshold_crossings(_ledger(spark, sf), CAPS_ORDERS)
    return rows.select(
        F.date_format("month", "yyyy-MM").alias("month"), "event_id", "before_eur", "after_eur", "level"
    ).withColumns(_double("before_eur", "after_eur"))


def usage_crossings(spark, sf) -> DataFrame:
    rows = costs.threshold_crossings(_usage(spark, sf), CAPS_EVENTS)
    return rows.select("event_id", "before_eur", "after_eur", "level").withColumns(_double("before_eur", "after_eur"))


def audit_costs(spark, sf) -> DataFrame:
    rows = costs.audit_costs(_usage(spark, sf))
    return rows.withColumns(_double(*[c for c in rows.columns if c.endswith("_eur")]))


def cost_anomalies(spark, sf) -> DataFrame:
    return costs.cost_anomalies(_usage(spark, sf)).withColumns(_double("total_eur"))


def monthly_rollup(spark, sf) -> DataFrame:
    rows = costs.monthly_rollup(_ledger(spark, sf))
    return rows.withColumn("month", F.date_format("month", "yyyy-MM")).withColumns(_double("total_cost_usd", "total_cost_eur"))


def ledger_display(spark, sf) -> DataFrame:
    return _ledger(spark, sf).select(
        "event_id", M.euro_text(F.col("cost_eur") * 1000).alias("amount"), M.date_text(F.col("created_at")).alias("day")
    )


# -- guards --------------------------------------------------------------------------------


def _hits(spark, sf) -> DataFrame:
    return I.read(spark, sf, "events").select(
        F.col("user_id").alias("ip"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at")
    )


def rate_limit_now(spark, sf) -> DataFrame:
    return guards.rate_limited(_hits(spark, sf), 2, 24 * 60, NOW_EVENTS)


def rate_limit_history(spark, sf) -> DataFrame:
    rows = guards.rate_history(_hits(spark, sf), 2, 6 * 60)
    return rows.withColumn("created_at", F.unix_micros("created_at"))


def _audits(spark, sf) -> DataFrame:
    return I.derive(spark, sf, I.AUDIT_SQL, "orders")


def owned_questions(spark, sf) -> DataFrame:
    return guards.scoped(I.derive(spark, sf, I.CHILD_SQL, "lineitem"), _audits(spark, sf), USER)


def owned_answers(spark, sf) -> DataFrame:
    return guards.scoped_responses(
        I.derive(spark, sf, I.RESPONSE_SQL, "lineitem"), I.derive(spark, sf, I.CHILD_SQL, "lineitem"), _audits(spark, sf), USER
    )


def owned_analyses(spark, sf) -> DataFrame:
    return guards.scoped_analyses(
        I.derive(spark, sf, I.ANALYSIS_ROW_SQL, "lineitem"), I.derive(spark, sf, I.RESPONSE_SQL, "lineitem"),
        I.derive(spark, sf, I.CHILD_SQL, "lineitem"), _audits(spark, sf), USER,
    )


def integrity_report(spark, sf) -> DataFrame:
    """Violations per rule."""
    child = I.derive(spark, sf, I.CHILD_SQL, "lineitem")
    answers = I.derive(spark, sf, I.RESPONSE_SQL, "lineitem")
    audits = _audits(spark, sf)
    customers = I.read(spark, sf, "customer")
    found = {
        "duplicate question position": guards.duplicate_keys(child, "audit_id", "position"),
        "score out of range": guards.out_of_range(answers, "score", 1, 45),
        "unknown status": guards.not_in(audits, "status", ["O", "F"]),
        "audit without owner": guards.orphans(audits, customers, "user_id", "c_custkey"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def table_rules(spark, sf) -> DataFrame:
    """Violations of the stored tables' own rules."""
    audits = I.derive(spark, sf, "SELECT event_type AS status, CAST(floor(value) AS INT) AS progress FROM events", "events")
    answers = I.derive(spark, sf, "SELECT l_orderkey AS query_id, CASE WHEN l_linenumber < 3 THEN 'openai' ELSE lower(l_returnflag) END AS provider FROM lineitem", "lineitem")
    out = None
    for table, rows in (("audits", audits), ("ai_responses", answers)):
        one = guards.table_violations(rows, table).select(F.lit(table).alias("table_name"), "rule", "violations")
        out = one if out is None else out.unionByName(one)
    return out


def stored_integrity(spark, sf) -> DataFrame:
    """Broken rules of all twelve stored tables."""
    return guards.integrity({name: I.derive(spark, sf, sql, given) for name, (given, sql) in I.STORED_SQL.items()})


def written_tables(spark, sf) -> DataFrame:
    """Rows and ids of all nine tables of an audit, read back from where the writer put them: an
    earlier run, and one that is loaded again after it had loaded something else."""
    folder = work_dir(spark, "tables")
    frames = {name: I.derive(spark, sf, sql, given) for name, (given, sql) in I.STORED_SQL.items() if name in sinks.TABLES}
    frames["api_usage"] = _usage(spark, sf).withColumnRenamed("event_id", "id")
    key = {name: "id" if "id" in df.columns else "response_id" if "response_id" in df.columns else "audit_id" for name, df in frames.items()}
    sinks.write_tables({"audits": frames["audits"]}, folder, "earlier")
    sinks.write_tables({name: df.union(df) for name, df in frames.items()}, folder, "load")
    sinks.write_tables(frames, folder, "load")
    out = None
    for name in frames:
        rows = sinks.read_table(spark, folder, name)
        part = F.col("usage_month").cast("string") if name == "api_usage" else F.split_part("run", F.lit("."), F.lit(1))
        one = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), F.sum(key[name]).alias("ids"))
        one = one.select(F.lit(name).alias("table_name"), "part", "n_rows", "ids")
        out = one if out is None else out.unionByName(one)
    return out


def exported_records(spark, sf) -> DataFrame:
    """Exported records per day and domain, read back from the JSON files."""
    folder = work_dir(spark, "export")
    records = I.derive(spark, sf, "SELECT page_id, url, html FROM pages", "pages")
    records = records.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7200))
    sinks.write_records(records, folder)
    rows = spark.read.schema("page_id long, url string, html string, domain string, day string").json(folder)
    return rows.groupBy("day", "domain").agg(F.count("*").alias("n_records"), F.sum(F.length("html")).alias("html_chars"))


def exported_audits(spark, sf) -> DataFrame:
    """Whole audits as nested records, exported and read back: what their lists say."""
    folder = work_dir(spark, "audits")
    record = _audit_record(spark, sf).withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("audit_id") * 7200))
    sinks.write_records(record, folder, most=500)
    rows = spark.read.schema(record.schema.add("domain", "string").add("day", "string")).json(folder)

    def said(items, *fields, order="position"):
        ordered = F.array_sort(F.transform(items, lambda x: F.struct(x[order].alias("o"), F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]).alias("s"))))
        return F.coalesce(F.array_join(F.transform(ordered, lambda x: x.s), "|"), F.lit(""))

    placed = F.transform("recommendations", lambda r, i: F.struct(i.alias("position"), r["priority"].alias("priority"), r["title"].alias("title"), r["impact_score"].alias("impact_score")))
    checks = F.transform("checks", lambda c: F.struct(c.check_id.alias("check_id"), c.status.alias("status"), c.points_earned.cast("int").alias("points")))
    return rows.select(
        "audit_id", "url", F.col("day").cast("string").alias("day"), "domain", "technical_score", "visibility_score",
        said(checks, "check_id", "status", "points", order="check_id").alias("checks"),
        F.md5(said(F.col("queries"), "position", "category", "text")).alias("queries_md5"),
        said(placed, "priority", "title", "impact_score").alias("recommendations"),
    )


def audit_states(spark, sf) -> DataFrame:
    events = I.derive(spark, sf, I.STATE_SQL, "events")
    s = sinks.current_state(events)
    return s.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("completed_at", "updated_at")})


QUERIES = {
    "url_forms": url_forms,
    "page_meta": page_meta,
    "page_headings": page_headings,
    "question_headings": question_headings,
    "heading_answers": heading_answers,
    "image_stats": image_stats,
    "hreflang_pairs": hreflang_pairs,
    "page_links": page_links,
    "link_sample": link_sample,
    "visible_text": visible_text,
    "document_readability": document_readability,
    "shell_and_wall": shell_and_wall,
    "brand_names": brand_names,
    "jsonld_blocks": jsonld_blocks,
    "jsonld_objects": jsonld_objects,
    "local_businesses": local_businesses,
    "site_ratings": site_ratings,
    "robots_rules": robots_rules,
    "bot_access": bot_access,
    "sitemap_entries": sitemap_entries,
    "sitemap_stats": sitemap_stats,
    "sitemap_probes": sitemap_probes,
    "llms_files": llms_files,
    "capture_choice": capture_choice,
    "site_resources": site_resource_rows,
    "sampled_pages": sampled_page_rows,
    "sampled_page_facts": sampled_page_facts,
    "request_intake": request_intake,
    "accepted_requests": accepted_requests,
    "chat_replies": chat_replies,
    "parts_replies": parts_replies,
    "answers_by_model": answers_by_model,
    "foundations_checks": _checks("foundations"),
    "geo_checks": _checks("geo_triptych"),
    "structured_checks": _checks("structured_data"),
    "content_checks": _checks("content"),
    "authority_checks": _checks("authority"),
    "category_scores": category_scores,
    "technical_scores": technical_scores,
    "failed_checks": failed_checks,
    "brand_mention_counts": brand_mention_counts,
    "encyclopedia_articles": encyclopedia_articles,
    "site_overview": site_overview,
    "exact_mentions": exact_mentions,
    "fuzzy_mentions": fuzzy_mentions,
    "mention_report": mention_report,
    "rule_analysis": rule_analysis,
    "loaded_analyses": loaded_analyses,
    "answer_points": answer_points,
    "visibility_scores": visibility_scores,
    "top_competitors": top_competitors,
    "audit_scores": audit_scores,
    "global_scores": global_scores,
    "question_list": question_list,
    "rejected_question_lists": rejected_question_lists,
    "question_tasks": question_tasks,
    "stored_question_ids": stored_question_ids,
    "stored_answer_ids": stored_answer_ids,
    "loaded_business": loaded_business,
    "loaded_synthesis": loaded_synthesis,
    "payload_breaches": payload_breaches,
    "recommendation_rows": recommendation_rows,
    "synthesis_input": synthesis_input,
    "audit_records": audit_records,
    "call_costs": call_costs,
    "unpriced_models": unpriced_models,
    "month_to_date": month_to_date,
    "budget_status": budget_status,
    "request_admission": request_admission,
    "threshold_crossings": threshold_crossings,
    "usage_crossings": usage_crossings,
    "audit_costs": audit_costs,
    "cost_anomalies": cost_anomalies,
    "monthly_rollup": monthly_rollup,
    "ledger_display": ledger_display,
    "rate_limit_now": rate_limit_now,
    "rate_limit_history": rate_limit_history,
    "owned_questions": owned_questions,
    "owned_answers": owned_answers,
    "owned_analyses": owned_analyses,
    "integrity_report": integrity_report,
    "stored_integrity": stored_integrity,
    "table_rules": table_rules,
    "written_tables": written_tables,
    "exported_records": exported_records,
    "exported_audits": exported_audits,
    "audit_states": audit_states,
    "stream_spend_alerts": streams.spend_alerts_query,
    "stream_rate_windows": streams.rate_windows_query,
    "stream_visibility": streams.visibility_query,
    "stream_admission": streams.admission_query,
}
