"""A three-table shop, worked out by hand: two samples, one payment that comes too late for both."""

import dataclasses
from datetime import date

import pytest
from pyspark.sql import functions as F

from hindcast.operators import evidence, predict, refine, training
from hindcast.operators.cutoffs import index_cutoffs
from hindcast.sources import sinks, tables as sources
from hindcast.tasks import Task

CUSTOMERS = [
    (1, "Alice", date(2024, 1, 1), "active"),
    (2, "Bob", date(2024, 2, 1), "active"),
    (3, "Cara", date(2024, 3, 1), "inactive"),
]
ORDERS = [
    (101, 1, date(2024, 4, 1), 120.0),
    (102, 2, date(2024, 4, 6), 80.0),
    (103, 1, date(2024, 4, 8), 50.0),
]
PAYMENTS = [
    (201, 1, date(2024, 4, 1), "paid", 120.0),
    (202, 2, date(2024, 4, 6), "failed", 80.0),
    (203, 1, date(2024, 4, 8), "paid", 50.0),
]
TASK = Task(
    dataset="shop",
    name="payment_status_prediction",
    tables=("customers", "orders", "payments"),
    entity_table="customers",
    lookup_column="customer_id",
    target_column="ground_truth",
    task_type="label",
    candidate_tables=("payments", "customers"),
    expected_evidence=("payment", "customer"),
    question_template="What is the payment outcome of {customer_name} before {cutoff_time}?",
)


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "customers": spark.createDataFrame(CUSTOMERS, "customer_id int, name string, signup_date date, status string"),
        "orders": spark.createDataFrame(ORDERS, "order_id int, customer_id int, order_date date, amount double"),
        "payments": spark.createDataFrame(
            PAYMENTS, "payment_id int, customer_id int, payment_date date, status string, amount double"
        ),
    }


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "train.jsonl")
    with open(path, "w") as out:
        out.write('{"customer_id":"1","cutoff_time":"2024-04-05 00:00:00","ground_truth":"paid","customer_name":"Alice"}\n')
        out.write('{"customer_id":"2","cutoff_time":"2024-04-07 00:00:00","ground_truth":"failed","customer_name":"Bob"}\n')
    rows = sources.read_split(spark, path)
    return rows.select(
        F.col("customer_id").alias("entity_id"),
        F.col("cutoff_time").cast("timestamp_ntz").alias("cutoff"),
        F.col("ground_truth").alias("truth"),
        "customer_name",
    ).withColumn("sample_id", evidence.sample_id(TASK.name, F.col("entity_id"), "cutoff"))


def test_facts(shop, samples):
    rows = evidence.facts(samples.select("sample_id", "entity_id", "cutoff"), TASK, shop).collect()
    found = {(r["sample_id"].split("|")[1], r["table_name"], r["fact_key"]): r for r in rows}
    assert len(found) == 8
    paid = found["1", "payments", "entity_rows"]
    assert paid["sample_rows"] == [
        '{"payment_id":201,"customer_id":1,"payment_date":"2024-04-01 00:00:00","status":"paid","amount":120.0}'
    ]
    assert paid["sql"] == (
        'SELECT * FROM "payments" WHERE "payment_date" <= TIMESTAMP \'2024-04-05 00:00:00\' AND "customer_id" = 1 '
        "ORDER BY 1 LIMIT 10"
    )
    assert found["1", "payments", "aggregate_before_cutoff"]["sample_rows"] == [
        '{"row_count":1,"min_time":"2024-04-01 00:00:00","max_time":"2024-04-01 00:00:00"}'
    ]
    assert found["2", "payments", "aggregate_before_cutoff"]["sample_rows"][0].startswith('{"row_count":2')
    assert not any("203" in text for r in rows for text in r["sample_rows"])


def test_episodes(shop, samples):
    states = refine.refine(samples, TASK, shop, rounds=1)
    done = {r["entity_id"]: r for r in refine.trajectories(states, TASK, rounds=1).collect()}
    for entity, truth, name in (("1", "paid", "Alice"), ("2", "failed", "Bob")):
        row = done[entity]
        assert row["final_answer"]["ranked_entities"][0]["prediction"] == truth
        assert row["final_evaluation"]["reason"] == "substring_match"
        assert row["critic_report"]["prompt_sufficient"] is True
        assert row["critic_report"]["planner_responsibility_score"] == 0.2
        # The names of facts and purposes hold more than the expected words, so both count as missing.
        assert row["critic_report"]["missing_information"] == ["payment", "customer"]
        assert row["planner_input"]["question"].startswith(f"What is the payment outcome of {name} before 2024-04-0")
        assert row["refinement_history"] == [] and row["stop_reason"] == "sufficient"
        assert "203" not in row["final_prompt"]


@pytest.mark.parametrize(
    "expected, rounds_wanted",
    [(("payment", "payment", "payment", "customer"), [["payment"], ["customer"]]), (("Status",), [["Status"], ["Status"]])],
)
def test_rounds_go_on_while_something_is_missing(shop, samples, expected, rounds_wanted):
    task = dataclasses.replace(TASK, expected_evidence=expected)
    hidden = samples.withColumn("truth", F.lit("refunded"))
    for row in refine.trajectories(refine.refine(hidden, task, shop, rounds=2), task, rounds=2).collect():
        assert [h["evidence_types"] for h in row["refinement_history"]] == rounds_wanted


def test_insufficient_samples_are_refined(shop, samples):
    hidden = samples.withColumn("truth", F.lit("refunded"))
    states = refine.refine(hidden, TASK, shop)
    for row in refine.trajectories(states, TASK).collect():
        assert row["critic_report"]["planner_responsibility_score"] == 0.8
        assert row["critic_report"]["wrong_assumptions"]
        assert [h["evidence_types"] for h in row["refinement_history"]] == [["payment", "customer"]]
        assert row["stop_reason"] == "nothing_to_request"
        assert "CRITIC-REQUESTED EVIDENCE" in row["final_prompt"]
        assert "CRITIC-REQUESTED EVIDENCE" not in row["initial_prompt"]
        added = row["evidence_packet"]["additional_evidence"]
        assert [(a["evidence_type"], a["table_name"]) for a in added] == [("payment", "payments"), ("customer", "customers")]
        assert all(a["row_count"] == 1 for a in added)


def test_no_rounds_when_none_are_allowed(shop, samples):
    states = refine.refine(samples.withColumn("truth", F.lit("refunded")), TASK, shop, rounds=0)
    rows = refine.trajectories(states, TASK, rounds=0).collect()
    assert {(r["rounds"], r["stop_reason"]) for r in rows} == {(0, "max_rounds")}


def test_run_state_and_files(spark, shop, samples, tmp_path):
    episodes = training.episodes_of(refine.trajectories(refine.refine(samples, TASK, shop), TASK), seed=3).cache()
    state = training.run_state(episodes).first()
    assert (state["episodes"], state["prompt_sufficiency_rate"], state["ground_truth_match_rate"]) == (2, 1.0, 1.0)
    assert sum(state["role_counts"].asDict().values()) == 2
    sinks.append_json(episodes, str(tmp_path / "trajectories"))
    sinks.append_json(episodes, str(tmp_path / "trajectories"))
    assert spark.read.json(str(tmp_path / "trajectories")).count() == 4
    sinks.write_document(training.run_state(episodes), str(tmp_path / "state"))
    sinks.write_document(training.run_state(episodes), str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "state")).count() == 1


def test_rows_after_every_cutoff_change_nothing(spark, shop, samples):
    late = spark.createDataFrame(
        [(i, i % 3 + 1, date(2024, 4, 9 + i % 20), "late", 1.0) for i in range(100)], shop["payments"].schema
    )
    asked = samples.select("sample_id", "entity_id", "cutoff")
    before = evidence.facts(asked, TASK, shop)
    after = evidence.facts(asked, TASK, {**shop, "payments": shop["payments"].unionByName(late)})
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_audit_sees_a_leak(spark, shop, samples):
    asked = samples.select("sample_id", "entity_id", "cutoff")
    rows = evidence.facts(asked, TASK, shop)
    assert predict.leakage_audit(rows, asked).filter("passed").count() == 2
    leaked = rows.withColumn("times", F.expr("array_append(times, '2024-04-30 00:00:00')"))
    audit = predict.leakage_audit(leaked, asked).first()
    assert audit["violations"] == 4 and not audit["passed"] and audit["max_seen_time"] == "2024-04-30 00:00:00"


def test_unknown_entity_finds_nothing(spark, shop):
    asked = spark.sql("SELECT 's' AS sample_id, 'nobody' AS entity_id, TIMESTAMP_NTZ'2024-04-05 00:00:00' AS cutoff")
    rows = evidence.facts(asked, TASK, shop).filter("fact_key = 'entity_rows'").collect()
    assert [(r["row_count"], r["sample_rows"]) for r in rows] == [(0, []), (0, [])]
    assert all("\"customer_id\" = 'nobody'" in r["sql"] for r in rows)


def test_index_of_one_cutoff(samples):
    index = index_cutoffs(samples.filter("entity_id = '1'"))
    assert (index.count, index.levels, index.small, index.few_entities) == (1, 1, True, True)


def test_samples_that_repeat_or_share_an_entity_and_cutoff(shop, samples):
    asked = samples.select("sample_id", "entity_id", "cutoff")
    other = asked.withColumn("sample_id", F.concat(F.lit("other "), "sample_id"))
    rows = lambda df: sorted(map(str, df.collect()))
    once = evidence.facts(asked, TASK, shop)
    assert rows(evidence.facts(asked.union(asked), TASK, shop)) == rows(once)
    both = evidence.facts(asked.union(other), TASK, shop)
    assert rows(both.filter("NOT startswith(sample_id, 'other ')")) == rows(once)
    renamed = both.filter("startswith(sample_id, 'other ')").withColumn("sample_id", F.substring("sample_id", 7, 100))
    assert rows(renamed.select(*once.columns)) == rows(once)
