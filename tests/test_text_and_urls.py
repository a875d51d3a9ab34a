import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions import text as T
from geovis.functions import urls as U
from geovis.operators.links import sample_links


@pytest.mark.parametrize(
    "text, want",
    [
        ("Prêt ?", True), ("Nos offres", False), ("Voici comment choisir sa maison", True), ("comment", False),
        ("Un équi vaut mieux que rien ici", True), ("équi équi équi équi équi", True), ("aquió aqui aqui aqui aqui", False), ("", False),
        ("what is it exactly 20", True), ("what is exactly 20cc", False), ("WHY this title is long", True),
    ],
)
def test_is_question(value, text, want):
    assert value(T.is_question(F.lit(text))) is want


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (2.4, 2), (0.5, 1)])
def test_js_round(value, x, want):
    assert value(T.js_round(F.lit(x))) == want


def test_lengths_and_space(value):
    assert value(T.js_length(F.lit("a😀é"))) == 4
    assert value(T.collapse_space(F.lit("  a \t\n b c "))) == "a b c"
    assert value(T.count_words(F.lit("a b c"))) == 3 and value(T.count_words(F.lit(""))) == 0


@pytest.mark.parametrize(
    "text, needle, want",
    [("Abc abc ABC", "abc", 3), ("aaaa", "aa", 2), ("a.b axb", "a.b", 1), ("", "x", 0), ("x", "", 0)],
)
def test_count_mentions(value, text, needle, want):
    assert value(T.count_mentions(F.lit(text), F.lit(needle))) == want


@pytest.mark.parametrize(
    "text, want",
    [('```json\n{"a":1}\n```', '{"a":1}'), ('```\n{}\n```  ', "{}"), ("{}", "{}"), ("```python\nx\n```", "python\nx")],
)
def test_strip_fences(value, text, want):
    assert value(T.strip_fences(F.lit(text))) == want


@pytest.mark.parametrize("size, want", [(4, 0), (5, 1), (7, 1), (8, 2)])
def test_fuzzy_threshold(value, size, want):
    assert value(T.fuzzy_threshold(F.lit(size))) == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x.lower() != y.lower()))
    return row[-1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abAB", max_size=6), st.text("abAB", max_size=6)), min_size=1, max_size=30))
def test_edit_distance(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r["d"] for r in rows.select(T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    want = [d if d <= 2 else -1 for d in (_distance(a, b) for a, b in pairs)]
    assert got == want


@pytest.mark.parametrize(
    "url, site, page, domain, depth",
    [
        ("https://A.Example.com:443/x/?q=1#f", "https://a.example.com/x/", "https://a.example.com/x/?q=1", "a.example.com", 1),
        ("http://h", "http://h/", "http://h/", "h", 0),
        ("http://h:8080/a/b/", "http://h:8080/a/b/", "http://h:8080/a/b", "h", 2),
        ("http://h/é b", "http://h/%C3%A9%20b", "http://h/%C3%A9%20b", "h", 1),
        ("http://h/a/../b/./c", "http://h/b/c", "http://h/b/c", "h", 2),
        ("not a url", "not a url", "not a url", "not a url", 0),
    ],
)
def test_url_forms(value, url, site, page, domain, depth):
    u = F.lit(url)
    assert value(U.site_url(u)) == site
    assert value(U.page_url(u)) == page
    assert value(U.domain(u)) == domain
    assert value(U.path_depth(u)) == depth


@pytest.mark.parametrize(
    "href, want",
    [
        ("/a/", "http://h/a"), ("b", "http://h/b"), ("#top", "http://h"), ("?q=1", "http://h/?q=1"), ("mailto:a@b.c", None),
        ("javascript:void(0)", None), ("//o.com/x", "http://o.com/x"), ("https://H/x#y", "https://h/x"), ("../up", "http://h/up"),
    ],
)
def test_resolve_link(value, href, want):
    assert value(U.resolve_link(F.lit(href), F.lit("http://h"))) == want


def test_link_sample_prefers_key_pages(value):
    links = ["http://h/z", "http://h/logo.PNG", "http://h/contact", "http://h/blog/a", "http://h/y", "http://h/about", "http://h/x", "http://h/w"]
    got = value(sample_links(F.array(*[F.lit(x) for x in links]), F.lit("http://h/")))
    assert got == ["http://h/about", "http://h/contact", "http://h/blog/a", "http://h/z", "http://h/y"]


@pytest.mark.parametrize(
    "raw, want",
    [("a &amp;lt; b", "a &lt; b"), ("&eacute;&#233;&#8364;", "éé€"), ("&unknown; &", "&unknown; &"), ("x", "x"), (None, None)],
)
def test_decode_entities(value, raw, want):
    assert value(H.decode_entities(F.lit(raw).cast("string"))) == want


LONG = "mot " * 200


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<p>{LONG}</p>", False), ("", True), ("<p>short</p>", True), (f"<p>{LONG}</p><script id='__NEXT_DATA__'></script>", True),
        (f'<div id="root"> </div>{LONG}', True), (f'<div id="__nuxt"></div>{LONG}', True), (f"<script>{LONG}</script>", True),
    ],
)
def test_is_shell(value, html, want):
    assert value(H.is_shell(F.lit(html))) is want


@pytest.mark.parametrize(
    "html, want",
    [("Just a moment...", "Cloudflare challenge"), ("Access Denied by Akamai", "Akamai access denied"), ("hello", None),
     ("Vercel Security Checkpoint just a moment...", "Vercel Security Checkpoint")],
)
def test_bot_wall(value, html, want):
    assert value(H.bot_wall(F.lit(html), F.lit(""))) == want
