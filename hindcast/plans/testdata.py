"""Tasks on the test tables. They stand in for the splits a benchmark ships ready-made.

Entities come from the tables, cutoffs are part of the task, and the target is what happens after the cutoff.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.cutoffs import time_literal
from hindcast.operators.evidence import sample_id
from hindcast.sources.tables import TableKeys, open_tables
from hindcast.tasks import STAR_RULE, Task, expected_evidence_of

RETAIL = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
ACTIVITY = ("benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages")
ALL_TABLES = tuple(sorted(RETAIL + ACTIVITY))

TABLE_KEYS = {
    "customer": TableKeys("c_custkey", None, {"c_nationkey": "nation"}),
    "lineitem": TableKeys(None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "nation": TableKeys("n_nationkey", None, {"n_regionkey": "region"}),
    "orders": TableKeys("o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
    "part": TableKeys("p_partkey"),
    "region": TableKeys("r_regionkey"),
    "supplier": TableKeys("s_suppkey", None, {"s_nationkey": "nation"}),
    "benchmark": TableKeys("item_id"),
    "conversations": TableKeys(),
    "documents": TableKeys("doc_id"),
    "embeddings": TableKeys("vec_id"),
    "events": TableKeys("event_id", "ts"),
    "labels": TableKeys("doc_id", None, {"doc_id": "documents"}),
    "pages": TableKeys("page_id"),
}

SPEND = Task(
    dataset="retail",
    name="customer_spend",
    tables=RETAIL,
    entity_table="customer",
    lookup_column="custkey",
    target_column="spend",
    task_type="regression",
    candidate_tables=("customer", "orders"),
    expected_evidence=expected_evidence_of("customer_spend", "customer", "custkey"),
    label_column="o_orderstatus",
    priority_tables=("orders",),
    id_rule=STAR_RULE,
)
SPEND_TRAIN = (datetime(1999, 1, 1), datetime(2000, 1, 1))
SPEND_TEST = (datetime(2001, 1, 1),)
SPEND_DAYS = 90

PRIORITY = Task(
    dataset="retail",
    name="order_priority",
    tables=RETAIL,
    entity_table="customer",
    lookup_column="custkey",
    target_column="priority",
    task_type="label",
    candidate_tables=("customer", "orders", "region"),
    expected_evidence=expected_evidence_of("order_priority", "customer", "custkey"),
    question_template="Based only on rows before {cutoff_time}, how urgent is the next order of customer {entity_id}?",
    label_column="o_orderpriority",
    priority_tables=("orders",),
    id_rule=STAR_RULE,
)

PURCHASES = Task(
    dataset="activity",
    name="user_purchases",
    tables=ACTIVITY,
    entity_table="events",
    lookup_column="user_id",
    target_column="purchases",
    task_type="regression",
    candidate_tables=("events",),
    expected_evidence=expected_evidence_of("user_purchases", "events", "user_id"),
    label_column="event_type",
    priority_tables=("events",),
)
PURCHASES_TRAIN = (datetime(2024, 1, 10), datetime(2024, 1, 15))
PURCHASES_TEST = (datetime(2024, 1, 20),)
PURCHASES_DAYS = 7

NEXT_EVENT = Task(
    dataset="activity",
    name="next_event",
    tables=ACTIVITY,
    entity_table="events",
    lookup_column="user_id",
    target_column="event_type",
    task_type="label",
    candidate_tables=("events",),
    expected_evidence=expected_evidence_of("next_event", "events", "user_id"),
    question_template="Based only on rows before {cutoff_time}, what will user {entity_id} do next?",
    label_column="event_type",
    priority_tables=("events",),
)
NEXT_EVENT_CUTOFFS = (datetime(2024, 1, 10), datetime(2024, 1, 20))


def tables_of(spark: SparkSession, folder: str, task: Task) -> dict[str, DataFrame]:
    return open_tables(spark, folder, task.tables)


def _cutoffs(cutoffs: tuple[datetime, ...]) -> Column:
    return F.array(*[time_literal(c) for c in cutoffs])


def _samples(entities: DataFrame, key: str, task: Task, cutoffs: tuple[datetime, ...]) -> DataFrame:
    entity = F.col(key).cast("string")
    return (
        entities.select(entity.alias("entity_id"), F.explode(_cutoffs(cutoffs)).alias("cutoff"))
        .withColumn("task_name", F.lit(task.name))
        .withColumn("dataset_name", F.lit(task.dataset))
        .withColumn("sample_id", sample_id(task.name, F.col("entity_id"), "cutoff"))
    )


def spend_samples(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    return _samples(tables["customer"].select("c_custkey"), "c_custkey", SPEND, cutoffs)


def priority_samples(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    return _samples(tables["customer"].select("c_custkey"), "c_custkey", PRIORITY, cutoffs)


def named_samples(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    """Every fiftieth customer by name instead of by key."""
    return _samples(tables["customer"].filter(F.col("c_custkey") % 50 == 0).select("c_name"), "c_name", PRIORITY, cutoffs)


def _users(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["events"].select("user_id").distinct()


def purchase_samples(tables: dict[str, DataFrame], cutoffs=PURCHASES_TEST) -> DataFrame:
    return _samples(_users(tables), "user_id", PURCHASES, cutoffs)


def next_event_samples(tables: dict[str, DataFrame], cutoffs=NEXT_EVENT_CUTOFFS) -> DataFrame:
    return _samples(_users(tables), "user_id", NEXT_EVENT, cutoffs)


def _later(rows: DataFrame, key: str, time: str, cutoffs: tuple[datetime, ...], days: int | None) -> DataFrame:
    """Rows with the cutoffs they come after (within ``days``), out of the task's few."""
    t = F.col(time)
    after = F.filter(_cutoffs(cutoffs), lambda c: c < t)
    if days:
        after = F.filter(after, lambda c: t <= c + F.expr(f"interval {days} days"))
    first = time_literal(min(cutoffs))
    return (
        rows.filter(t > first)
        .withColumn("entity_id", F.col(key).cast("string"))
        .withColumn("cutoff", F.explode(after))
    )


def spend_targets(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    """Order value of the 90 days after the cutoff, for customers who ordered; cents are summed exactly."""
    rows = tables["orders"].select("o_custkey", "o_orderdate", "o_totalprice")
    later = _later(rows, "o_custkey", "o_orderdate", cutoffs, SPEND_DAYS)
    return later.groupBy("entity_id", "cutoff").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend")
    )


def purchase_targets(tables: dict[str, DataFrame], cutoffs=PURCHASES_TEST) -> DataFrame:
    rows = tables["events"].filter(F.col("event_type") == "purchase").select("user_id", "ts")
    later = _later(rows, "user_id", "ts", cutoffs, PURCHASES_DAYS)
    return later.groupBy("entity_id", "cutoff").agg(F.count("*").cast("double").alias("purchases"))


def priority_targets(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    """Priority of the first order after the cutoff."""
    rows = tables["orders"].select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    later = _later(rows, "o_custkey", "o_orderdate", cutoffs, None)
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))
    return later.groupBy("entity_id", "cutoff").agg(first["o_orderpriority"].alias("truth"))


def next_event_targets(tables: dict[str, DataFrame], cutoffs=NEXT_EVENT_CUTOFFS) -> DataFrame:
    """Type of the first event after the cutoff."""
    rows = tables["events"].select("user_id", "ts", "event_id", "event_type")
    later = _later(rows, "user_id", "ts", cutoffs, None)
    first = F.min(F.struct("ts", "event_id", "event_type"))
    return later.groupBy("entity_id", "cutoff").agg(first["event_type"].alias("truth"))


def with_target(samples: DataFrame, targets: DataFrame, column: str, default) -> DataFrame:
    """Samples with their target; one that nothing follows gets the default."""
    joined = samples.join(targets, ["entity_id", "cutoff"], "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(default)))


def spend_split(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    return with_target(spend_samples(tables, cutoffs), spend_targets(tables, cutoffs), "spend", 0.0)


def purchase_split(tables: dict[str, DataFrame], cutoffs=PURCHASES_TEST) -> DataFrame:
    return with_target(purchase_samples(tables, cutoffs), purchase_targets(tables, cutoffs), "purchases", 0.0)


def priority_split(tables: dict[str, DataFrame], cutoffs=SPEND_TEST) -> DataFrame:
    return with_target(priority_samples(tables, cutoffs), priority_targets(tables, cutoffs), "truth", "")


def next_event_split(tables: dict[str, DataFrame], cutoffs=NEXT_EVENT_CUTOFFS) -> DataFrame:
    return with_target(next_event_samples(tables, cutoffs), next_event_targets(tables, cutoffs), "truth", "")
