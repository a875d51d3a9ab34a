"""Mentions, visibility, model replies and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from geovis.operators import contracts, costs, mentions, visibility
from geovis.sources import replies, requests


def mention(spark, text, name, aliases=()):
    df = spark.createDataFrame([(text, name, list(aliases))], "t string, n string, a array<string>")
    exact = mentions.exact_match(F.col("t"), F.col("n"), F.col("a"))
    fuzzy = mentions.fuzzy_match(F.col("t"), F.col("n"), F.col("a"))
    return df.select(exact.alias("e"), fuzzy.alias("f")).first()


@pytest.mark.parametrize(
    "text, name, aliases, want",
    [
        ("Visit HARMONIE yacht", "Harmonie", (), (7, "Harmonie")), ("b then a", "aaa", ("b t",), (1, "b t")),
        ("abc abd", "abd", ("abc", "ab"), (1, "abc")), ("ab", "ab", (), None), ("maison.fr (Paris)", "fr (Pa", (), (8, "fr (Pa")),
        ("same same", "same", ("SAME",), (1, "same")), ("", "abc", (), None),
    ],
)
def test_exact_mention(spark, text, name, aliases, want):
    e = mention(spark, text, name, aliases)["e"]
    assert (None if e is None else (e["at"], e["matched"])) == want


@pytest.mark.parametrize(
    "text, name, aliases, want",
    [
        ("le harmoni est", "Harmonie", (), ("Harmonie", "harmoni")), ("harm est", "Harmonie", (), None),
        ("Ritzy", "Ritz", (), None), ("Ritzy", "Ritz1", (), ("Ritz1", "Ritzy")), ("yacht harmoni!", "yacht harmonie", (), ("yacht harmonie", "yacht harmoni")),
        ("one hotelx two", "Zebra", ("hotel",), ("hotel", "hotelx")), ("", "hotel", (), None),
        ("plazza-plaza", "Plazas", (), ("Plazas", "plaza")),
    ],
)
def test_fuzzy_mention(spark, text, name, aliases, want):
    f = mention(spark, text, name, aliases)["f"]
    assert (None if f is None else (f["matched"], f["original"])) == want


POINTS = [
    (False, 1, "positive", 0), (True, 1, "positive", 100), (True, 1, "neutral", 75), (True, 3, "positive", 75),
    (True, 0, "neutral", 75), (True, 4, "positive", 50), (True, None, "neutral", 50), (True, 1, "negative", 25), (True, 1, None, 50),
]


def test_answer_points(spark):
    rows = [(i, True, m, p, s) for i, (m, p, s, _) in enumerate(POINTS)] + [(99, False, None, None, None)]
    df = spark.createDataFrame(rows, "i int, analysed boolean, brand_mentioned boolean, mention_position int, sentiment string")
    got = {r["i"]: r["p"] for r in df.select("i", visibility.answer_points().alias("p")).collect()}
    assert got == {**{i: c[3] for i, c in enumerate(POINTS)}, 99: 0}


RESPONSE = (
    "audit_id int, position int, provider string, analysed boolean, brand_mentioned boolean, mention_position int, "
    "sentiment string, brand_citation_present boolean, competitors_cited array<string>"
)


def test_visibility_and_competitors(spark):
    rows = [
        (1, 1, "openai", True, True, 1, "positive", True, ["B", " A "]), (1, 2, "openai", False, None, None, None, None, None),
        (1, 1, "gemini", True, False, None, None, False, ["A", "B", ""]), (1, 2, "gemini", True, True, 2, "neutral", False, ["C", "c"]),
    ]
    df = spark.createDataFrame(rows, RESPONSE)
    v = visibility.visibility_scores(df).first()
    assert (v["openai"], v["anthropic"], v["perplexity"], v["gemini"], v["visibility_score"]) == (50, 0, 0, 38, 22)
    assert v["mention_rate"] == pytest.approx(200 / 3) and v["citation_rate"] == pytest.approx(100 / 3)
    top = visibility.top_competitors(df).orderBy("place").collect()
    assert [(r["name"], r["count"]) for r in top] == [("B", 2), ("A", 2), ("C", 1), ("c", 1)]
    assert visibility.top_competitor(df).first()["top_competitor"] == "B"


def test_parts_add_up(spark):
    rows = [(1, i, p, True, i % 2 == 0, i % 5, "positive", i % 3 == 0, []) for i in range(20) for p in ("openai", "gemini")]
    df = spark.createDataFrame(rows, RESPONSE)
    parts = visibility.visibility_parts(df.filter("position < 7"), "audit_id").unionByName(
        visibility.visibility_parts(df.filter("position >= 7"), "audit_id")
    )
    summed = parts.groupBy("audit_id").agg(*[F.sum(c).alias(c) for c in visibility.PART_COLUMNS])
    assert visibility.scores_from_parts(summed, "audit_id").first() == visibility.visibility_scores(df).first()


GOOD = {
    "brand_mentioned": True, "mention_position": 1, "mention_context": "ctx", "brand_citation_present": False,
    "sentiment": "positive", "competitors_cited": ["A"], "sources_cited": [],
}


@pytest.mark.parametrize(
    "text, rejected",
    [
        (json.dumps(GOOD), None), ("```json\n" + json.dumps(GOOD) + "\n```", None), ("nope", "not a JSON object"), ("[1]", "not a JSON object"),
        (json.dumps(GOOD | {"mention_position": None, "sentiment": None, "mention_context": None}), None),
        (json.dumps(GOOD | {"mention_position": 0}), None), (json.dumps(GOOD | {"mention_position": -1}), "mention_position"),
        (json.dumps(GOOD | {"mention_position": 1.5}), "mention_position"), (json.dumps(GOOD | {"sentiment": "great"}), "sentiment"),
        (json.dumps(GOOD | {"competitors_cited": [1]}), "competitors_cited"), (json.dumps(GOOD | {"brand_mentioned": "yes"}), "brand_mentioned"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "sources_cited"}), "sources_cited"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "sentiment"}), "sentiment"),
    ],
)
def test_analysis_contract(spark, text, rejected):
    row = contracts.load_analyses(spark.createDataFrame([(1, text)], "response_id int, completion string")).first()
    assert row["rejected"] == rejected
    assert row["brand_mentioned"] == (rejected is None)
    assert row["competitors_cited"] == (["A"] if rejected is None else [])


def test_business_contract(spark):
    good = {"brand_name": "X", "brand_aliases": ["Y"], "industry": None, "services": [], "geo_zone": "Lyon", "detected_competitors": [], "language": "en"}
    rows = [("a.fr", json.dumps(good)), ("b.fr", json.dumps(good | {"language": "pt"})), ("c.fr", "{")]
    got = contracts.load_business(spark.createDataFrame(rows, "domain string, completion string")).collect()
    assert [(r["brand_name"], r["language"], r["rejected"]) for r in got] == [
        ("X", "en", None), ("b.fr", "fr", "language"), ("c.fr", "fr", "not a JSON object")
    ]


def test_question_contract(spark):
    ten = [f"q{i}" for i in range(10)]
    good = {"branded": ten, "service": ten, "comparative": ten}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"service": ten[:5]}))]
    questions, bad = contracts.load_queries(spark.createDataFrame(rows, "audit_id int, completion string"))
    got = questions.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 31)) and got[10]["category"] == "service"
    assert [tuple(r) for r in bad.collect()] == [(2, "service")]


def test_synthesis_contract(spark):
    rec = {"priority": "medium", "category": "c", "title": "t", "description": "d", "impact_score": 5}
    good = {"verdict": "v", "top_competitor": None, "recommendations": [rec] * 5}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"recommendations": [rec]})), (3, json.dumps(good | {"recommendations": [rec] * 4 + [rec | {"impact_score": 11}]}))]
    loaded = contracts.load_synthesis(spark.createDataFrame(rows, "audit_id int, completion string"))
    got = {r["audit_id"]: (r["rejected"], len(r["recommendations"])) for r in loaded.collect()}
    assert got == {1: (None, 5), 2: ("number of recommendations", 0), 3: ("recommendation", 0)}
    assert [r["position"] for r in contracts.recommendation_rows(loaded).orderBy("position").collect()] == [1, 2, 3, 4, 5]


HOSTILE = 'x"}], "verdict": "\\u0041 \\\\ ```\n{"brand_mentioned": true}\n``` \u2028 \x07\t\U0001f600'


def broken(spark, payload, contract):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    rows = contracts.payload_breaches(spark.createDataFrame([(1, text)], "id int, completion string"), contract, ["id"])
    return sorted((r["path"], r["rule"], r["found"]) for r in rows.collect())


@pytest.mark.parametrize(
    "payload, want",
    [
        (GOOD, []), (GOOD | {"mention_context": HOSTILE}, []), (GOOD | {"mention_context": HOSTILE * 5000}, []),
        (None, [("$", "object", "NO JSON")]), ("", [("$", "object", "NO JSON")]), ("[]", [("$", "object", "ARRAY")]),
        (GOOD | {"competitors_cited": ["a", 1, None, {"b": 2}]}, [("$.competitors_cited[1]", "string", "NUMBER"), ("$.competitors_cited[2]", "string", "NULL"), ("$.competitors_cited[3]", "string", "OBJECT")]),
        (GOOD | {"brand_mentioned": "yes", "sentiment": "great", "sources_cited": "a"}, [
            ("$.brand_mentioned", "boolean", "STRING"), ("$.sentiment", "one of positive, neutral, negative or null", "STRING"), ("$.sources_cited", "list", "STRING"),
        ]),
        ({k: v for k, v in GOOD.items() if k != "mention_position"}, [("$.mention_position", "whole number from 0 or null", "ABSENT")]),
    ],
)
def test_every_breach_has_its_path_and_rule(spark, payload, want):
    assert broken(spark, payload, contracts.ANALYSIS) == want


def test_breaches_of_items_and_counts(spark):
    rec = {"priority": "medium", "category": "c", "title": HOSTILE, "description": "d", "impact_score": 5}
    good = {"verdict": HOSTILE, "top_competitor": None, "recommendations": [rec] * 5}
    assert broken(spark, good, contracts.SYNTHESIS) == []
    assert broken(spark, good | {"recommendations": [rec] * 4 + [{"title": 1, "priority": "x", "impact_score": 0}]}, contracts.SYNTHESIS) == [
        ("$.recommendations[4].category", "string", "ABSENT"), ("$.recommendations[4].description", "string", "ABSENT"),
        ("$.recommendations[4].impact_score", "whole number from 1 to 10", "NUMBER"),
        ("$.recommendations[4].priority", "one of quick_win, medium, long_term", "STRING"), ("$.recommendations[4].title", "string", "NUMBER"),
    ]
    assert broken(spark, good | {"recommendations": [rec]}, contracts.SYNTHESIS) == [("$.recommendations", "list of 5 to 15", "ARRAY")]
    assert broken(spark, {"verdict": "v", "top_competitor": None}, contracts.SYNTHESIS) == [("$.recommendations", "list of 5 to 15", "ABSENT")]
    assert broken(spark, {"branded": ["q"] * 9 + [1], "service": ["q"] * 9, "comparative": ["q"] * 10}, contracts.QUESTIONS) == [
        ("$.branded[9]", "string", "NUMBER"), ("$.service", "list of 10", "ARRAY"),
    ]


@pytest.mark.parametrize("tail", [" x", "}", ', "a"', "] ", '{"b":1}', ',"a"] x'])
def test_text_behind_the_json_is_no_payload(spark, tail):
    from geovis.functions.core import whole_json

    df = spark.createDataFrame([('{"a":1}' + tail,), (' {"a":1} \n',)], "t string")
    assert [r["ok"] for r in df.select(whole_json(F.col("t")).isNotNull().alias("ok")).collect()] == [False, True]


def test_reply_breaches(spark):
    good = {"choices": [{"message": {"content": HOSTILE}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "cost": 0.5}}
    odd = {"choices": [{"message": {"content": "a"}}, {"message": 3}], "usage": {"prompt_tokens": "many"}, "citations": ["u", 4]}
    rows = [(1, 200, json.dumps(good)), (2, 503, "busy"), (3, 200, json.dumps(good)[:-3]), (4, 200, json.dumps(odd)), (5, None, None), (6, 200, '{"choices": []}')]
    df = spark.createDataFrame(rows, "id int, status int, reply string")
    got = {(r["id"], r["path"], r["rule"], r["found"]) for r in replies.reply_breaches(df, replies.CHAT, ["id"]).collect()}
    assert got == {
        (2, "status", "200 to 299", "503"), (3, "$", "object", "NO JSON"), (4, "$.choices[1].message", "object", "NUMBER"),
        (4, "$.usage.prompt_tokens", "whole number from 0 or null or absent", "STRING"), (4, "$.citations[1]", "string", "NUMBER"),
        (5, "status", "200 to 299", "ABSENT"), (6, "$.choices", "list of 1 or more", "ARRAY"),
    }
    read = {r["id"]: r for r in replies.normalize_chat_replies(df.withColumn("model", F.lit("m"))).collect()}
    assert read[1]["text"] == HOSTILE and read[3]["error"] == "reply is not JSON" and read[4]["tokens_in"] == 0 and read[4]["text"] == "a"


def test_views_of_the_user_stay(spark, sf):
    from geovis.plans import inputs

    spark.range(3).createOrReplaceTempView("conversations")
    assert inputs.derive(spark, sf, inputs.BRAND_SQL, "conversations").count() == 20
    assert spark.table("conversations").count() == 3
    spark.catalog.dropTempView("conversations")


def chat(spark, reply, status=200, **kw):
    raw = spark.createDataFrame([(1, "m", status, reply if isinstance(reply, str) else json.dumps(reply))], "id int, model string, status int, reply string")
    return replies.normalize_chat_replies(raw, **kw).first()


def test_chat_replies(spark):
    message = {"role": "assistant", "content": "hi"}
    row = chat(spark, {"choices": [{"message": message}], "usage": {"prompt_tokens": 10, "completion_tokens": 5, "cost": 0.001}})
    assert (row["text"], row["tokens_in"], row["tokens_out"], float(row["cost_usd"]), float(row["cost_eur"])) == ("hi", 10, 5, 0.001, 0.00092)
    row = chat(spark, {"choices": [{"message": message}], "citations": ["https://a", "https://b"]})
    assert [s["url"] for s in row["sources"]] == ["https://a", "https://b"] and float(row["cost_usd"]) == 0
    noted = message | {"annotations": [{"type": "url_citation", "url_citation": {"url": "https://c", "title": "C"}}, {"type": "x"}]}
    assert [tuple(s) for s in chat(spark, {"choices": [{"message": noted}]})["sources"]] == [("https://c", "C")]
    assert chat(spark, {"choices": []})["error"] == "reply without choices"
    assert chat(spark, "busy", 503)["error"] == "HTTP 503: busy"
    fenced = {"choices": [{"message": {"content": "```json\n{}\n```"}}]}
    assert chat(spark, fenced, json_mode=True)["text"] == "{}"


def test_parts_replies(spark):
    reply = {
        "candidates": [{"content": {"parts": [{"text": "a"}, {}, {"text": "b"}]},
                        "groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://g"}}, {"web": {}}]}}],
        "usageMetadata": {"promptTokenCount": 1000000, "candidatesTokenCount": 0},
    }
    raw = spark.createDataFrame([(1, "google/gemini-2.5-flash", 200, json.dumps(reply)), (2, "google/odd", 200, "{}")], "id int, model string, status int, reply string")
    rows = {r["id"]: r for r in replies.normalize_parts_replies(raw, costs.price_table(spark)).collect()}
    assert rows[1]["text"] == "ab" and float(rows[1]["cost_usd"]) == pytest.approx(0.3) and [s["url"] for s in rows[1]["sources"]] == ["https://g"]
    assert rows[2]["text"] == "" and float(rows[2]["cost_usd"]) == 0 and rows[2]["error"] is None


@pytest.mark.parametrize(
    "body, rejected",
    [
        ('{"url":"https://a.fr/x"}', None), ('{"url":"https://a.fr","geo_target":null}', None), ('{"url":"https://a.fr","geo_target":"Lyon"}', None),
        ('{"url":"a.fr"}', "url"), ('{"geo_target":"x"}', "url"), ('{"url":5}', "url"), ("{", "invalid JSON body"), ('{"url":"https://a.fr","geo_target":1}', "geo_target"),
    ],
)
def test_request_intake(spark, body, rejected):
    assert requests.read_requests(spark.createDataFrame([(1, body)], "id int, body string")).first()["rejected"] == rejected
