"""Page signals against the standard library's HTML parser, and on awkward markup."""

import html
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.operators import jsonld, robots, signals

VOID = {"br", "img", "meta", "link", "input", "hr"}


class Walk(HTMLParser):
    """Title, first level headings and main text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.title, self.h1, self.text, self.in_body = [], [], "", [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.in_body = True
        if tag in ("script", "style", "nav", "header", "footer", "noscript"):
            self.skip.append(tag)
        if tag in ("title", "h1"):
            self.inside.append(tag)
            if tag == "h1":
                self.h1.append("")

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        if "h1" in self.inside:
            self.h1[-1] += data
        if self.in_body and not self.skip:
            self.text.append(data)


def test_signals_match_an_html_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in signals.page_signals(pages).select("page_id", "title", "h1", "words").collect()}
    for row in pages.collect():
        walk = Walk()
        walk.feed(row["html"])
        walk.close()
        seen = got[row["page_id"]]
        assert seen["title"] == walk.title.strip()
        assert seen["h1"] == [h.strip() for h in walk.h1 if h.strip()]
        assert seen["words"] == len("".join(walk.text).split())


HTML = """<html lang=fr><head><!-- <title>no</title> --><title> A &amp; B
</title><meta name="description" content=" d > e "><meta property="og:title" content="x"><meta property="og:title" content="y">
<link rel="alternate" hreflang="en" href="/en"></head><body><header>Top</header><h1>One <b>two</b></h1><h1> </h1>
<h2>Pourquoi pas ?</h2><p>Oui, <i>bien</i> sûr.</p><h3>Why?</h3><span>x</span><p>No</p><h2>Que faire ?</h2><div>Le mieux</div>
<img alt="A garden"><img alt="ab"><img><img alt><a href="/a#x">1</a><a href='/a/'>2</a><a href="https://other.com/">3</a>
<script>var a = "<h1>no</h1>";</script><p>Body text</p>"""


def test_signals_of_awkward_markup(spark):
    page = spark.createDataFrame([(1, "https://h.fr/x", HTML)], "page_id int, url string, html string")
    s = signals.page_signals(page).first()
    assert s["title"] == "A & B" and s["description"] == "d > e" and s["lang"] == "fr"
    assert s["og"] == {"title": "y"} and [tuple(p) for p in s["hreflang"]] == [("en", "/en")]
    assert s["h1"] == ["One two"] and s["h2"] == ["Pourquoi pas ?", "Que faire ?"] and s["h3"] == ["Why?"]
    assert [tuple(a) for a in s["answers"]] == [
        ("Pourquoi pas ?", "Oui, bien sûr."), ("Why?", ""), ("Que faire ?", "Le mieux")
    ]
    assert tuple(s["images"]) == (4, 3, 1)
    assert s["links"] == ["https://h.fr/a"]
    assert "Top" in s["text"] and "var" not in s["text"]


def test_jsonld_flattening(spark):
    block = '<script type="application/ld+json">{}</script>'
    html = "".join(
        block.format(b)
        for b in (
            '[{"@type":"A"},3,null]', '{"@graph":[{"@type":["B","C"],"name":" N "},7]}', "{oops", "   ", '"text"',
            '{"@type":"AggregateRating","ratingValue":"4.5/5","reviewCount":"12 avis"}',
            '{"@type":"Hotel","name":"a","name":"b","telephone":0,"address":{},"openingHours":[]}',
        )
    )
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    blocks = jsonld.jsonld_blocks(page).orderBy("ord").collect()
    assert [b["is_valid"] for b in blocks] == [True, True, False, True, True, True]
    objs = jsonld.jsonld_objects(page).orderBy("ord").collect()
    assert [o["types"] for o in objs] == [["a"], ["b", "c"], ["aggregaterating"], ["hotel"]]
    assert objs[1]["name"] == "N" and objs[3]["name"] == "b"
    assert (objs[2]["rating"], objs[2]["reviews"]) == (4.5, 12)
    assert (objs[3]["has_address"], objs[3]["has_phone"], objs[3]["has_hours"]) == (True, False, True)


def brute_rules(text):
    """Line by line reading of a robots file."""
    agents, seen = [], {}
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.split("#")[0].strip()
        if not line:
            agents = []
        elif ":" in line:
            key, _, val = line.partition(":")
            key, val = key.strip().lower(), val.strip()
            if key == "user-agent":
                agents.append(val)
                seen.setdefault(val, []).append(("agent", ""))
            elif key in ("allow", "disallow"):
                for a in agents:
                    seen[a].append((key, val))
    return sorted((a, k, v) for a, pairs in seen.items() for k, v in pairs)


def brute_allowed(text, bot, closing=("/", "")):
    by_agent = {}
    for agent, kind, val in brute_rules(text):
        by_agent.setdefault(agent, []).append((kind, val))
    rules = by_agent.get(bot, by_agent.get("*"))
    if rules is None or not any(k == "disallow" and v in closing for k, v in rules):
        return True
    return any(k == "allow" and v in ("/", "") for k, v in rules)


def test_robots_rules_match_line_by_line_reading(spark):
    import random

    random.seed(3)
    pool = [
        "User-agent: *", "User-agent: GPTBot", "user-AGENT : gptbot", "Disallow: /", "Disallow:", "Allow: /", "ALLOW: /x", "",
        "# note", "Disallow: / # all", "no colon", "Sitemap: http://h/s.xml", ": odd", "  ", "Disallow: /a:b",
    ]
    texts = ["\n".join(random.choices(pool, k=random.randrange(1, 14))) for _ in range(150)]
    texts += ["\r\n".join(["User-agent: GPTBot", "Disallow: /", "", "User-agent: *", "Allow: /"]), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "site_id int, robots_txt string")
    got = {}
    for r in robots.robots_rules(df).collect():
        got.setdefault(r["site_id"], []).append((r["agent"], r["kind"], r["value"]))
    access = {(r["site_id"], r["bot"]): r["allowed"] for r in robots.bot_access(df, ["GPTBot", "Other"]).collect()}
    strict = {(r["site_id"], r["bot"]): r["allowed"] for r in robots.bot_access(df, ["GPTBot"], rfc_empty_disallow=True).collect()}
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_rules(text), text
        for bot in ("GPTBot", "Other"):
            assert access[i, bot] == brute_allowed(text, bot), (text, bot)
        assert strict[i, "GPTBot"] == brute_allowed(text, "GPTBot", ("/",)), text


REFERENCES = [
    "&#x27;", "&uuml;", "&ntilde;", "&frac12;", "&#9;", "&#55357;&#56832;", "&#9999999;", "&#99999999999999999999;", "&#x110000;",
    "&#0;", "&#128;", "&#x9f;", "&amp;lt;", "&#38;lt;", "&AMP;copy;", "a & b &nope; &amp;#38;", "&#39", "x&#x1F600;y",
    "&Tab;&NewLine;&equals;", "&NotEqualTilde;", "", "&", "&;", "&#;", "&#x;",
]


def test_references_match_the_standard_library(spark):
    rows = spark.createDataFrame([(t,) for t in REFERENCES], "t string").select("t", H.decode_entities(F.col("t")).alias("got")).collect()
    assert {r["t"]: r["got"] for r in rows} == {t: html.unescape(t) for t in REFERENCES}


def signals_of(spark, page, *columns):
    df = spark.createDataFrame([(1, "http://e.com/", page)], "page_id long, url string, html string")
    return signals.page_signals(df).select(*columns).first()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p " + " ".join(f'a{k}="v>{k}"' for k in range(10_000)) + ">Hello</p>", "Hello"),
        ("<p title=it's>Hello</p><p> it's me</p>", "Hello it's me"),
        ("<img alt='a > b' src=x>after", "after"),
        ('<a "' * 20_000 + ">x", "x"),
        ('<a "' * 20_000, ('<a "' * 20_000).strip()),
        ("&#9999999;&uuml;", "\ufffdü"),
    ],
    ids=["many attributes", "stray apostrophe", "bracket in a value", "open quotes", "open quotes without end", "references"],
)
def test_hostile_markup(spark, page, text):
    assert signals_of(spark, page, "text")["text"] == text


@pytest.mark.parametrize("between, answer", [("", "Oui."), (" some text ", "Oui."), ("<ul></ul>", ""), (" text <br>", "")])
def test_answer_is_the_next_element(spark, between, answer):
    rows = signals_of(spark, f"<h2>Pourquoi ?</h2>{between}<p>Oui.</p>", "answers")["answers"]
    assert [(r["heading"], r["answer"]) for r in rows] == [("Pourquoi ?", answer)]


def test_long_meta_key(spark):
    assert list(signals_of(spark, f'<meta property="og:{"k" * 1200}" content="x">', "og")["og"]) == ["k" * 1200]


def test_huge_review_count(spark):
    page = '<script type="application/ld+json">{"@type":"Product","aggregateRating":{"ratingValue":4,"reviewCount":"%s"}}</script>' % ("9" * 23)
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert jsonld.jsonld_objects(df).first()["reviews"] == int(jsonld.MOST_REVIEWS)


class Answers(HTMLParser):
    """Second and third level headings with the text of the element behind each, from open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.heading, self.open, self.waiting = [], None, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3"):
            self.found.append(["", ""])
            self.heading = self.found[-1]
        self.open = [(t, a) for t, a in self.open if t != "p" or tag == "b"]
        waiting, self.waiting = self.waiting, None
        if tag in ("div", "p"):
            self.open.append((tag, waiting))

    def handle_endtag(self, tag):
        self.waiting = None
        if tag in ("h2", "h3"):
            self.waiting, self.heading = self.heading, None
        if tag != "b":
            self.open = [(t, a) for t, a in self.open if t != "p"]
        if tag == "div" and any(t == "div" for t, _ in self.open):
            while self.open.pop()[0] != "div":
                pass

    def handle_data(self, data):
        if self.heading:
            self.heading[0] += data
        for _, answer in self.open:
            if answer:
                answer[1] += data


def test_nested_answers_match_an_html_parser(spark):
    import random

    rng = random.Random(8)

    def block(depth):
        kind = rng.choice(["text", "text", "p", "div", "div", "question", "ul"]) if depth < 6 else "text"
        word = f"w{rng.randint(0, 99)} "
        if kind in ("text", "p", "ul"):
            return {"text": word, "p": f"<p>{word}<b>x</b></p>", "ul": f"<ul><li>{word}</li></ul>"}[kind]
        inside = "".join(block(depth + 1) for _ in range(rng.randint(0, 3)))
        if kind == "div":
            return f"<div class='<div>'>{inside}</div>"
        level = rng.choice("23")
        return f"<h{level}>Q {word}</h{level}>{rng.choice(['', ' loose '])}{rng.choice(['<div>', '<DIV id=a>'])}{inside}</div>"

    pages = ["".join(block(0) for _ in range(6)) for _ in range(120)]
    pages += ["<h2>a</h2><div>" * 30 + "x" + "</div>" * 30, "<div>" * 5 + "<h2>q</h2><div>a<div>b</div></div>c"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", H.heading_blocks(F.col("html")).alias("a"))
    for row in df.collect():
        walk = Answers()
        walk.feed(pages[row["i"]])
        walk.close()
        assert [(a["heading"], a["answer"]) for a in row["a"]] == [(h.strip(), a.strip()) for h, a in walk.found], pages[row["i"]]


@pytest.mark.parametrize(
    "page",
    ["<script " * 100_000, "<h1 " * 100_000, "<h1>" * 100_000, "<title " * 100_000, "<body " * 100_000 + ">", "<div>" * 50_000, "<script>" * 100_000,
     "<head <html " * 50_000, "<a " * 100_000 + 'x=">"', "<style" * 100_000 + ">", "<h2>q</h2><div>a</div>" * 20_000],
    ids=["script", "h1", "h1 closed", "title", "body", "div", "script closed", "head", "quoted bracket", "style", "questions"],
)
def test_unclosed_tags_take_linear_time(spark, page):
    """Half a megabyte and more; with quadratic patterns each of these took minutes."""
    import time

    df = spark.createDataFrame([(1, "http://e.com/", page)], "page_id long, url string, html string")
    merged = F.length(H.merge_head_body(F.col("html"), F.col("html")))
    start = time.time()
    signals.page_signals(df).first()
    df.select(merged, F.length(H.main_text(F.col("html")))).first()
    assert time.time() - start < 40


def test_headings_end_where_another_begins(spark):
    row = signals_of(spark, "<h1>a<h2>b</h2><h3>c</h5><h4 x", "h1", "h2", "h3", "h4")
    assert tuple(row) == (["a"], ["b"], ["c"], [])
