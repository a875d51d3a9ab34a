"""Work on pages: dealt evenly, only the facts that are asked for, cheap tests that change no result."""

import random
import re

from pyspark.sql import functions as F

from geovis.functions import html as H
from geovis.functions import text as T
from geovis.operators import facts
from geovis.plans import catalog
from geovis.plans import inputs as I

PIECES = [
    "<script>", "</script>", "</SCRIPT>", "<script src='a>b'>", "<style>", "</style>", "</Style>", "<b>", "<", ">", "<>", "<a ",
    "mot " * 60, "x" * 130, "  \n", "İ", "<div id=\"root\"> </div>", "<DIV ID=\"__nuxt\"></div>", "<p>" * 300, "mot<br>" * 400,
    "Just a Moment...", "access DENIED by", " akamai", "just a moment",
]


def _pages(count):
    chance = random.Random(7)
    return ["".join(chance.choices(PIECES, k=chance.randint(0, 14))) for _ in range(count)]


def _shell(page):
    low = page.lower()
    if page == "" or "__next_data__" in low or re.search(r'(?ia)<div id="(root|__nuxt)"\s*>\s*</div>', page):
        return True
    text = re.sub(r"(?is)<style.*?</style>", "", re.sub(r"(?is)<script.*?</script>", "", page))
    return len(re.sub(r"<[^>]+>", " ", text).strip(T.WS_CHARS)) < 500


def test_shell_by_a_first_look_is_the_shell_by_the_whole_page(spark):
    pages = _pages(400)
    got = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1).select(H.is_shell(F.col("h")).alias("s")).collect()
    want = [_shell(p) for p in pages]
    assert [r["s"] for r in got] == want and {True, False} == set(want)


def test_bot_walls_are_those_of_the_patterns_alone(spark):
    pages = _pages(200)
    rows = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    got = rows.select(H.bot_wall(F.col("h"), F.lit("")).alias("w")).collect()
    want = [next((n for n, p, _ in H.BOT_WALLS if re.search(p, page)), None) for page in pages]
    assert [r["w"] for r in got] == want and len(set(want)) > 2


def test_pages_of_one_split_are_dealt_over_many_tasks(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").coalesce(1)
    dealt = I.dealt(rows, "page_id", rows_per_task=2)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert dealt.rdd.getNumPartitions() == rows.count() // 2
    assert max(r["count"] for r in sizes) <= 10 and sum(r["count"] for r in sizes) == rows.count()


def test_checks_read_only_what_they_need(spark, sf):
    every = {(r["site_id"], r["check_id"]): (r["status"], r["points_earned"]) for r in catalog.all_checks(spark, sf).collect()}
    for name in ("foundations_checks", "structured_checks"):
        found = catalog.QUERIES[name](spark, sf)
        assert not [f for f in found.inputFiles() if "documents" in f]
        assert {every[r["site_id"], r["check_id"]] == (r["status"], r["points_earned"]) for r in found.collect()} == {True}


def test_words_and_references_need_no_second_look(spark):
    chance = random.Random(3)
    parts = ["&amp;", "&nbsp;", "&#32;", "&#x3000;", "&emsp;", "&ThickSpace;", "&eacute;", "&", "&&lt;", "&bad;", "&#0;", "&amp", " ", "mot", "é", "<p>", "</p>", "\u00a0", ";"]
    pages = ["".join(chance.choices(parts, k=chance.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    whole = T.count_words(T.collapse_space(H.decode_entities(H.strip_tags(F.col("h")))))
    got = rows.select(H.count_words(F.col("h")).alias("n"), whole.alias("w"), H.decode_entities(F.col("h")).alias("d")).collect()
    assert [r["n"] for r in got] == [r["w"] for r in got]
    numbers = {"&#32;": " ", "&#x3000;": "\u3000", "&#0;": H.UNKNOWN_CHARACTER}
    assert [r["d"] for r in got] == [re.sub(H.REFERENCE, lambda m: numbers.get(m[0], H.ENTITIES.get(m[0], m[0])), p) for p in pages]


def test_source_facts_by_plain_texts_are_those_of_the_patterns(spark):
    chance = random.Random(5)
    parts = ["google.com/maps", "/embed", "maps.", "goo.gl/maps", "maps.app.goo.gl", "x.com/", "twitter.com/", "TWITTER.com/", "a", " ", "F.A.Q", "faq", "Questions  frequentes", "é", "frequently asked"]
    pages = ["".join(chance.choices(parts, k=chance.randint(0, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    h = F.col("h")
    found = facts.source_facts(h, F.lower(h))
    social = sum((h.rlike(p).cast("int") for p in facts.SOCIAL_PATTERNS), F.lit(0))
    want = {"map_embed": h.rlike(facts.MAP_EMBED), "map_link": h.rlike(facts.MAP_LINK), "has_faq_words": h.rlike(facts.FAQ), "social_profiles": social}
    got = rows.select(*[found[n].alias(n) for n in want], *[c.alias(f"want_{n}") for n, c in want.items()]).collect()
    assert all(r[n] == r[f"want_{n}"] for r in got for n in want) and all(len({r[n] for r in got}) > 1 for n in want)
    plan = rows.select(*found.values())._jdf.queryExecution().optimizedPlan().toString()
    assert not [p for p in (facts.MAP_EMBED, facts.MAP_LINK) if p in plan]
