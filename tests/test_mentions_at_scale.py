"""The join of answers to their dictionary: nothing is lost, and stored tables are not moved."""

from geovis.operators import mentions

ANSWERS = [(1, 1, "Acme is good"), (2, 1, "nothing"), (3, 2, "Acme"), (4, None, "Acme"), (5, 3, None), (6, 1, "we like Acmee")]
BRANDS = [(1, "Acme", ["Ac"]), (3, "Zeta", None)]


def tables(spark):
    answers = spark.createDataFrame(ANSWERS, "response_id long, audit_id long, text string")
    return answers, spark.createDataFrame(BRANDS, "audit_id long, brand_name string, aliases array<string>")


def found(answers, brands):
    rows = mentions.fuzzy_mentions(mentions.exact_mentions(answers, brands)).collect()
    return sorted((r["response_id"], r["exact"] and r["exact"]["matched"], r["fuzzy"] and r["fuzzy"]["original"]) for r in rows)


def test_answers_without_a_dictionary_stay(spark):
    got = found(*tables(spark))
    assert got == [(1, "Acme", None), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (6, "Acme", None)]


def test_stored_tables_are_joined_without_an_exchange(spark, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        answers, brands = mentions.stored_for_search(*tables(spark), buckets=4)
        plan = mentions.exact_mentions(answers, brands)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert found(answers, brands) == found(*tables(spark))
    finally:
        spark.conf.set(key, before)
