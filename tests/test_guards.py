import random
from datetime import datetime, timedelta

from geovis.operators import guards


def test_rate_history_matches_brute_force_with_a_hot_key(spark):
    random.seed(5)
    start = datetime(2024, 1, 1)
    rows = [("hot", "a", start + timedelta(seconds=random.randrange(1800))) for _ in range(300)]
    rows += [(f"k{i % 7}", "b", start + timedelta(minutes=random.randrange(600))) for i in range(60)]
    rows += [("edge", "a", start), ("edge", "a", start + timedelta(minutes=10))]
    df = spark.createDataFrame(rows, "ip string, action string, created_at timestamp")
    window = timedelta(minutes=10)
    want = {
        (ip, action, ts, sum(1 for r in rows if r[:2] == (ip, action) and ts - window < r[2] <= ts))
        for ip, action, ts in rows
    }
    got = guards.rate_history(df, 3, 10)
    assert {(r["ip"], r["action"], r["created_at"], r["hits"]) for r in got.collect()} == want
    assert all(r["limited"] == (r["hits"] >= 3) for r in got.collect())


def test_rate_limit_at_an_instant(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [("x", "a", now - timedelta(minutes=m)) for m in (0, 5, 9, 10, 11)] + [("y", "a", now + timedelta(minutes=1))]
    df = spark.createDataFrame(rows, "ip string, action string, created_at timestamp")
    got = guards.rate_limited(df, 3, 10, "2024-01-01T12:00:00").collect()
    assert [(r["ip"], r["hits"], r["limited"]) for r in got] == [("x", 3, True)]


def test_ownership_chain(spark):
    audits = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, user_id bigint")
    queries = spark.createDataFrame([(11, 1), (21, 2)], "id bigint, audit_id bigint")
    responses = spark.createDataFrame([(111, 11), (211, 21)], "id bigint, query_id bigint")
    analyses = spark.createDataFrame([(111, "x"), (211, "y")], "response_id bigint, note string")
    assert [r["id"] for r in guards.scoped(queries, audits, 10).collect()] == [11]
    assert [r["id"] for r in guards.scoped_responses(responses, queries, audits, 20).collect()] == [211]
    assert [r["note"] for r in guards.scoped_analyses(analyses, responses, queries, audits, 10).collect()] == ["x"]
    assert guards.scoped(queries, audits, 30).count() == 0


def test_integrity_rules(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 200), (2, "b", None)], "q bigint, p string, score int")
    assert [(r["q"], r["copies"]) for r in guards.duplicate_keys(rows, "q", "p").collect()] == [(1, 2)]
    assert guards.out_of_range(rows, "score", 0, 100).count() == 2
    assert guards.not_in(rows, "p", ["a"]).count() == 1
    parents = spark.createDataFrame([(1,)], "id bigint")
    assert [r["q"] for r in guards.orphans(rows, parents, "q", "id").collect()] == [2]


def test_stored_tables_against_their_rules(spark):
    from geovis import schemas

    for ddl in schemas.TABLES.values():
        spark.createDataFrame([], ddl)
    rows = spark.createDataFrame([("a", "content", 20), ("a", "content", 21), ("b", "odd", 0)], "audit_id string, category string, score int")
    got = {r["rule"]: r["violations"] for r in guards.table_violations(rows, "audit_technical").collect()}
    assert got == {"category not allowed": 1, "score out of range": 1, "audit_id, category not unique": 1}
