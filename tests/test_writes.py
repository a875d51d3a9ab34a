"""Loads keyed by a run, committed reads, exports, and the rules of the stored tables."""

import pytest
from pyspark.sql import functions as F

from geovis import schemas
from geovis.operators import guards
from geovis.sources import sinks
from geovis.sources.files import Files


def audits(spark, *ids):
    return spark.createDataFrame([(i, i * 10) for i in ids], "id long, user_id long")


def usage(spark, *rows):
    df = spark.createDataFrame(list(rows), "id long, at string")
    return df.select("id", F.col("at").cast("timestamp").alias("created_at"))


def ids(spark, path, name):
    return sorted(r["id"] for r in sinks.read_table(spark, path, name).collect())


def test_a_run_loaded_again_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path)
    sinks.write_tables({"audits": audits(spark, 1, 2), "api_usage": usage(spark, (1, "2024-01-05"), (2, "2024-02-05"))}, path, "a")
    sinks.write_tables({"audits": audits(spark, 7)}, path, "b")
    assert ids(spark, path, "audits") == [1, 2, 7]
    sinks.write_tables({"audits": audits(spark, 1, 3), "api_usage": usage(spark, (1, "2024-01-05"))}, path, "a")
    assert ids(spark, path, "audits") == [1, 3, 7]
    assert ids(spark, path, "api_usage") == [1]  # the month that is gone left nothing behind
    sinks.write_tables({"audits": audits(spark, 9)}, path)
    sinks.write_tables({"audits": audits(spark, 9)}, path)
    assert ids(spark, path, "audits") == [1, 3, 7, 9, 9]
    assert len(Files(spark, path).names("audits")) == 4


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sinks.write_tables({"audits": audits(spark, 1)}, path, "a")
    with monkeypatch.context() as broken:
        broken.setattr(Files, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.write_tables({"audits": audits(spark, 2)}, path, "a")
    assert ids(spark, path, "audits") == [1]
    sinks.write_tables({"audits": audits(spark, 2)}, path, "a")
    assert ids(spark, path, "audits") == [2]


def test_reads_and_names(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, str(tmp_path), "audits")
    with pytest.raises(ValueError, match="run id"):
        sinks.write_tables({"audits": audits(spark, 1)}, str(tmp_path), "../x")
    sinks.write_tables({"api_usage": usage(spark, (1, "2024-01-05"), (2, "2024-02-05"))}, str(tmp_path), "a")
    plan = sinks.read_table(spark, str(tmp_path), "api_usage").filter("usage_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "usage_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def violations(tables):
    return {(r["table_name"], r["rule"]): r["violations"] for r in guards.integrity(tables).collect()}


def test_every_rule_finds_its_rows(spark):
    profiles = spark.createDataFrame([(1, "a", "admin"), (2, "a", "x"), (3, None, None), (4, None, "client")], "id long, email string, role string")
    runs = spark.createDataFrame([(1, 1, "done", 100), (2, 9, "odd", 101), (3, None, None, None), (3, 9, "done", -1)], "id long, user_id long, status string, progress int")
    answers = spark.createDataFrame([(1, 5, "openai"), (2, 5, "openai"), (3, 6, "openai"), (4, 5, "other")], "id long, query_id long, provider string")
    got = violations({"profiles": profiles, "audits": runs, "ai_responses": answers})
    assert got == {
        ("profiles", "role not allowed"): 1, ("profiles", "email not unique"): 1, ("audits", "status not allowed"): 1,
        ("audits", "progress out of range"): 3, ("audits", "user_id without parent"): 2, ("ai_responses", "provider not allowed"): 1,
        ("ai_responses", "query_id, provider not unique"): 1,
    }
    empty = {"profiles": profiles.limit(0), "audits": runs.limit(0)}
    assert set(violations(empty).values()) == {0}
    with pytest.raises(ValueError, match="no table"):
        guards.integrity({"audits": runs.select("id")})


def test_rules_name_stored_columns():
    for rules in (schemas.ALLOWED, schemas.RANGES, schemas.PARENTS):
        for table, column in rules:
            assert f"{column} " in schemas.TABLES[table]
    for parent, key in schemas.PARENTS.values():
        assert f"{key} " in schemas.TABLES[parent]


def test_each_table_is_scanned_once(spark, tmp_path):
    path = f"{tmp_path}/audits"
    spark.createDataFrame([(1, 1, "done", 5)], "id long, user_id long, status string, progress int").write.parquet(path)
    spark.createDataFrame([(1, "a", "admin")], "id long, email string, role string").write.parquet(f"{tmp_path}/profiles")
    tables = {"audits": spark.read.parquet(path), "profiles": spark.read.parquet(f"{tmp_path}/profiles")}
    plan = guards.integrity(tables)._jdf.queryExecution().optimizedPlan().toString()
    # Profiles once for their own rules and once as the parents' keys.
    assert plan.count("Relation [id") == 3


def test_no_task_holds_more_keys_than_it_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(guards, "ROWS_PER_TASK", 100)
    runs = spark.range(3000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS user_id", "'done' AS status", "5 AS progress")
    profiles = spark.range(0, 6000, 2).selectExpr("id", "CAST(id % 5000 AS STRING) AS email", "'admin' AS role")
    found = guards.integrity({"profiles": profiles, "audits": runs})
    got = {(r["table_name"], r["rule"]): r["violations"] for r in found.collect()}
    assert got["audits", "user_id without parent"] == 1500 and got["profiles", "email not unique"] == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Spark may merge the partitions of its own shuffles, and sorts hold all rows of one; neither is left.
    assert plan.count("REPARTITION_BY_NUM") >= 3 and "SortMergeJoin" not in plan
    assert "hashpartitioning(user_id" in plan and ", 60), REPARTITION_BY_NUM" in plan
