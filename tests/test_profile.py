from collections import Counter
from datetime import date, datetime

import pytest

from hindcast.operators import profile, profile_store
from hindcast.sources import tables as sources
from hindcast.tasks import STAR_RULE, IdRule, candidate_tables_of, expected_evidence_of


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_small_table(spark):
    df = spark.createDataFrame(
        [(1, "A", date(2024, 1, 1)), (2, "B", date(2024, 1, 3))], "customer_id int, name string, signup_date date"
    )
    columns = profile.nulls_and_distinct({"customers": df})
    assert {r["null_rate"] for r in columns.collect()} == {0.0}
    key = profile.primary_keys(columns).first()
    assert (key["row_count"], key["primary_key_guess"]) == (2, "customer_id")
    days = by_column(profile.column_ranges({"customers": df}))["signup_date"]
    assert (days["min_value"], days["max_value"]) == ("2024-01-01 00:00:00", "2024-01-03 00:00:00")


def test_nulls_zeros_and_nested(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1L, CAST(NULL AS STRING), 0.0D, array(1), CAST(1.50 AS DECIMAL(9,2)), true, "
        "CAST('NaN' AS FLOAT)), (1L, NULL, -0.0D, NULL, 1.50, false, CAST('NaN' AS FLOAT)), "
        "(NULL, NULL, 1.0D, array(2), 2.00, NULL, CAST(1 AS FLOAT)) AS t(a, b, c, d, e, f, g)"
    )
    columns = by_column(profile.nulls_and_distinct({"t": df}))
    found = {n: (r["kind"], round(r["null_rate"], 3), r["distinct_count"]) for n, r in columns.items()}
    assert found == {
        "a": ("numeric", 0.333, 1),
        "b": ("categorical", 1.0, 0),
        "c": ("numeric", 0.0, 2),
        "d": ("generic", 0.333, None),
        "e": ("numeric", 0.0, 2),
        "f": ("categorical", 0.333, 2),
        "g": ("numeric", 0.0, 2),
    }
    tops = {(r["column_name"], r["value"]) for r in profile.top_values({"t": df}).collect()}
    assert tops == {("f", "true"), ("f", "false")}
    whole = by_column(profile.column_profile({"t": df}))
    assert whole["e"]["distinct_count"] == 2 and whole["e"]["top_values"] is None
    assert whole["f"]["top_values"] == [("false", 1), ("true", 1)]
    assert whole["c"]["min_value"] == "0.0"


def test_empty_table_has_its_first_column_as_key(spark):
    df = spark.createDataFrame([], "a int, b string, ts timestamp_ntz")
    columns = profile.nulls_and_distinct({"t": df})
    assert {r["null_rate"] for r in columns.collect()} == {0.0}
    assert profile.primary_keys(columns).first()["primary_key_guess"] == "a"
    assert by_column(profile.column_ranges({"t": df}))["ts"]["min_value"] is None
    assert profile.top_values({"t": df}).collect() == []


def test_one_row_has_no_deviation(spark):
    df = spark.createDataFrame([(5,)], "a int")
    row = profile.column_ranges({"t": df}).first()
    assert (row["avg_value"], row["stddev_value"]) == (5.0, None)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_top_values_of_long_texts(spark, monkeypatch, bound):
    """Long texts that share their beginning, tie in frequency and differ only at the end."""
    monkeypatch.setattr(profile, "BROADCAST_ROWS", bound)
    head = "x" * 70
    texts = [head + str(i) for i in range(9, 0, -1)] + ["y" * 64, "y" * 64, "y" * 65, None, "a"] + [head + "5"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    tops = [(r["place"], r["value"], r["frequency"]) for r in profile.top_values({"t": df}).orderBy("place").collect()]
    assert tops == [
        (1, head + "5", 3),
        (2, "y" * 64, 2),
        (3, "a", 1),
        (4, head + "1", 1),
        (5, head + "2", 1),
    ]
    assert profile.nulls_and_distinct({"t": df}).first()["distinct_count"] == 12


def test_relationships(spark):
    schemas = {
        "customers": spark.createDataFrame([], "customer_id int, name string").schema,
        "orders": spark.createDataFrame([], "order_id int, customer_id int").schema,
    }
    inventory = sources.column_inventory(spark, schemas)
    rows = {tuple(r)[:4] for r in profile.relationships(inventory).collect()}
    assert rows == {("customers", "customer_id", "orders", "customer_id"), ("orders", "customer_id", "customers", "customer_id")}
    assert profile.relationships(inventory, STAR_RULE).collect() == []


def test_relationship_support_counts_distinct_values(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "x_id int"),
        "b": spark.createDataFrame([(1,), (2,), (9,), (9,)], "x_id int"),
        "c": spark.createDataFrame([(77,)], "x_id int"),
    }
    found = {(r["from_table"], r["to_table"]): r["support"] for r in profile.relationship_support(tables).collect()}
    shared = {("a", "b"): pytest.approx(2 / 3), ("b", "a"): pytest.approx(2 / 3)}
    assert found == {**shared, ("a", "c"): 0.0, ("c", "a"): 0.0, ("b", "c"): 0.0, ("c", "b"): 0.0}


def test_summaries(spark):
    tables = {
        "a": spark.createDataFrame([(1, "u"), (2, "v")], "a_id int, t string"),
        "b": spark.createDataFrame([(1,), (1,)], "a_id int"),
    }
    inventory = sources.column_inventory(spark, {n: d.schema for n, d in tables.items()})
    keys = profile.primary_keys(profile.nulls_and_distinct(tables))
    text = profile.profile_summary(keys, profile.relationships(inventory)).first()["summary"]
    assert text.split("\n") == [
        "Database profile summary:",
        "- a: 2 rows, key guess a_id",
        "- b: 2 rows, key guess unknown",
        "Likely relationships:",
        "- a.a_id -> b.a_id",
        "- b.a_id -> a.a_id",
    ]
    lone = profile.profile_summary(keys, profile.relationships(inventory).limit(0)).first()["summary"]
    assert lone.endswith("key guess unknown")
    assert profile.schema_summary(inventory).first()["summary"].endswith("- a: columns [a_id, t]\n- b: columns [a_id]")


def test_stored_profile_is_replaced_per_database(spark, tmp_path):
    path = str(tmp_path / "profiles")
    a = profile.nulls_and_distinct({"a": spark.createDataFrame([(1,)], "x int")})
    b = profile.nulls_and_distinct({"b": spark.createDataFrame([(1,), (2,)], "y int")})
    for database, rows in (("one", a), ("two", b), ("one", b)):
        profile.store_profile(rows, database, path)
    assert [r["table_name"] for r in profile.stored_profile(spark, path, "one").collect()] == ["b"]
    assert [r["table_name"] for r in profile.stored_profile(spark, path, "two").collect()] == ["b"]
    # Ids that look like numbers stay text.
    profile.store_profile(a, "007", path)
    assert profile.stored_profile(spark, path, "007").count() == 1


def test_approximate_distinct(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k")
    found = {r["column_name"]: r["approx_distinct"] for r in profile.approximate_distinct({"t": df}).collect()}
    assert found["k"] == 7 and abs(found["id"] - 5000) < 500


def test_time_text_sorts_like_time(spark):
    from hindcast.functions.columns import time_text

    times = [datetime(2024, 1, 1, 0, 0, 7, u) for u in (0, 5, 170000, 179575, 999999)] + [datetime(2024, 1, 1, 0, 0, 8)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    texts = [r[0] for r in df.select(time_text("t")).collect()]
    assert texts == sorted(texts) == [str(t) for t in times]


def test_task_rules(spark):
    assert expected_evidence_of("order-priority", "customer", "custkey") == ("order", "priority", "customer", "custkey")
    schemas = {
        "users": spark.createDataFrame([], "user_id int").schema,
        "posts": spark.createDataFrame([], "post_id int, user_id int").schema,
        "votes": spark.createDataFrame([], "owner int").schema,
        "tags": spark.createDataFrame([], "tag_id int").schema,
    }
    keys = {"votes": {"owner": "users"}}
    assert candidate_tables_of("users", "user_id", schemas, keys) == ("users", "posts", "votes")
    assert IdRule().is_id("user_id") and not IdRule().is_id("userid") and STAR_RULE.is_id("o_custkey")


def test_first_keys_are_those_of_the_profile(spark):
    tables = {
        "plain": spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "x int, k string, y double"),
        "none": spark.createDataFrame([(1, None), (1, 2)], "x int, y int"),
        "empty": spark.createDataFrame([], "p string, q int"),
        "zeros": spark.createDataFrame([(0.0, [1]), (-0.0, [2])], "z double, n array<int>"),
    }
    expected = {r["table_name"]: r["primary_key_guess"] for r in profile.primary_keys(profile.nulls_and_distinct(tables)).collect()}
    assert {r["table_name"]: r["primary_key_guess"] for r in profile.first_keys(tables).collect()} == expected
    assert expected == {"plain": "k", "none": None, "empty": "p", "zeros": None}


def test_store_reads_only_changed_files(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id int, name string, at timestamp, n array<int>, x double"
    row = lambda i, x: (i, f"n{i % 3}" if i % 4 else None, datetime(2024, 1, 1 + i % 20), [i], x)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    write([row(i, float(i)) for i in range(10)])
    write([row(i, None) for i in range(10, 15)])
    table = lambda: {"t": spark.read.schema(schema).parquet(folder)}
    store = profile_store.open_store(spark, str(tmp_path / "store"), {"t": ("id", "name")})
    actions = lambda r: Counter(x["action"] for x in r.files.collect())
    assert store.version() == 0 and actions(store.refresh(table(), {"t": folder})) == {"read": 2}

    def check():
        columns = {r["column_name"]: r for r in store.read("columns").collect()}
        exact = {r["column_name"]: r for r in profile.column_profile(table()).collect()}
        for name, e in exact.items():
            c = columns[name]
            assert (c["row_count"], round(c["null_rate"], 9)) == (e["row_count"], round(e["null_rate"], 9)), name
            if c["distinct_is_exact"] or c["kind"] != "generic":
                assert c["distinct_count"] == e["distinct_count"]  # a sketch of so few values is exact too
            if c["kind"] == "numeric":
                assert abs(c["avg_value"] - e["avg_value"]) < 1e-9 and abs(c["stddev_value"] - e["stddev_value"]) < 1e-9
            if c["kind"] in ("numeric", "temporal"):
                assert (c["min_value"], c["max_value"]) == (e["min_value"], e["max_value"])
        assert store.read("tables").first()["primary_key_guess"] == "id"
        assert f"{e['row_count']}" in store.read("summary").first()["summary"]

    check()
    write([row(i, 0.5) for i in range(20, 24)])
    assert actions(store.refresh(table(), {"t": folder})) == {"read": 1, "kept": 2}
    check()
    oldest = min((p for p in (tmp_path / "t").glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    oldest.unlink()
    found = store.refresh(table(), {"t": folder})
    assert actions(found) == {"kept": 2, "dropped": 1} and found.version == 3
    check()
    assert {r["file_id"] for r in store.files().collect()} == {r["file_id"] for r in found.files.filter("action = 'kept'").collect()}


def test_store_counts_keys_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(profile_store, "TASK_KEYS", 100)
    path = str(tmp_path / "a+b c" / "t")
    rows = spark.range(1000, numPartitions=3).selectExpr("id AS k", "id % 7 AS few", "IF(id % 2 = 0, 'x', CAST(NULL AS STRING)) AS s")
    rows.write.parquet(path)
    tables = {"t": spark.read.schema(rows.schema).parquet(path)}
    store = profile_store.open_store(spark, str(tmp_path / "store"), {"t": ("k", "few", "s")})
    store.refresh(tables, {"t": path})
    rows.limit(300).selectExpr("k + 5000 AS k", "few", "s").coalesce(1).write.mode("append").parquet(path)
    store.refresh(tables, {"t": path})
    found = {r["column_name"]: (r["row_count"], r["distinct_count"], r["distinct_is_exact"]) for r in store.read("columns").collect()}
    assert found == {"k": (1300, 1300, True), "few": (1300, 7, True), "s": (1300, 1, True)}
    keys = spark.createDataFrame([("t", "k", str(i)) for i in range(1000)], "table_name string, column_name string, value_key string")
    assert profile_store.distinct_keys(keys, 1000).rdd.getNumPartitions() == 10
