"""Cutoff evidence against brute force, in every plan: listed or numbered cutoffs, broadcast or shuffled."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.operators import cutoffs, evidence

START = datetime(2024, 1, 1)


def tables(spark, seed, rows, entities, cutoff_count, step, hot=0.4):
    """Rows of few times (so that many equal a cutoff), a hot entity, and cutoffs before, amid and after them."""
    rng = np.random.default_rng(seed)
    entity = np.where(rng.random(rows) < hot, 0, rng.integers(0, entities, rows))
    times = [START + timedelta(seconds=int(s) * step) for s in rng.integers(0, 400, rows)]
    events = pd.DataFrame(
        {"event_id": rng.permutation(rows), "user_id": entity, "ts": times, "note": rng.integers(0, 5, rows).astype(str)}
    )
    events.loc[rng.random(rows) < 0.03, "ts"] = pd.NaT
    picked = sorted({START + timedelta(seconds=int(s) * step) for s in rng.integers(-20, 420, cutoff_count)})
    pairs = [(e, c) for e in range(entities + 1) for c in picked if rng.random() < 0.7]
    samples = pd.DataFrame(
        {"sample_id": [f"{e}|{c}" for e, c in pairs], "entity_id": [str(e) for e, _ in pairs], "cutoff": [c for _, c in pairs]}
    )
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, note string"
    return (
        events,
        samples,
        spark.createDataFrame(rows_of(events), schema).repartition(5),
        spark.createDataFrame(rows_of(samples), "sample_id string, entity_id string, cutoff timestamp_ntz"),
    )


def rows_of(frame):
    plain = lambda v: None if v is pd.NaT else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    return [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]


def brute_aggregate(events, samples):
    out = {}
    for s in samples.itertuples():
        seen = events[events.ts <= s.cutoff].ts
        out[s.sample_id] = (len(seen), seen.min() if len(seen) else None, seen.max() if len(seen) else None)
    return out


def brute_rows(events, samples, recent=False):
    out = {}
    for s in samples.itertuples():
        own = events[(events.user_id == int(s.entity_id)) & (events.ts <= s.cutoff)]
        own = own.sort_values(["ts", "event_id"], ascending=[False, True]) if recent else own.sort_values("event_id")
        if len(own):
            out[s.sample_id] = list(own.event_id[:10])
    return out


def found_aggregate(df):
    return {r["sample_id"]: (r["row_count"], r["min_time"], r["max_time"]) for r in df.collect()}


def found_rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["sample_id"], r["rn"])):
        out.setdefault(r["sample_id"], []).append(r["event_id"])
    return out


@pytest.mark.parametrize("cutoff_count,step", [(1, 3600), (2, 3600), (7, 20_000), (40, 60), (40, 5)])
@pytest.mark.parametrize("plan", ["compared", "swept", "shuffled"])
def test_against_brute_force(spark, monkeypatch, cutoff_count, step, plan):
    if plan != "compared":
        monkeypatch.setattr(cutoffs, "COMPARED", 3)
    if plan == "shuffled":
        monkeypatch.setattr(cutoffs, "BROADCAST_ROWS", 0)
    events, samples, table, asked = tables(spark, cutoff_count * 7 + step, 1500, 6, cutoff_count, step)
    index = cutoffs.index_cutoffs(asked)
    assert index.small == (plan != "shuffled") and index.few_entities == (plan != "shuffled")
    assert index.swept == (plan != "compared" and index.count > 3) and len(index.compared) <= max(3, cutoffs.COMPARED)
    numbers = sorted((r["cutoff"], r["idx"]) for r in index.cutoffs.collect())
    assert [i for _c, i in numbers] == list(range(1, index.count + 1))
    assert found_aggregate(evidence.aggregate_up_to_cutoff(asked, table, "ts", index)) == brute_aggregate(events, samples)
    assert found_rows(evidence.entity_rows(asked, table, "user_id", "ts", index)) == brute_rows(events, samples)


def test_recent_order(spark):
    events, samples, table, asked = tables(spark, 5, 800, 4, 9, 600)
    found = found_rows(evidence.entity_rows(asked, table, "user_id", "ts", order="recent"))
    assert found == brute_rows(events, samples, recent=True)


def test_same_result_under_repartitioning(spark):
    _events, _samples, table, asked = tables(spark, 6, 800, 4, 9, 600)
    one = found_rows(evidence.entity_rows(asked, table.coalesce(1), "user_id", "ts"))
    many = found_rows(evidence.entity_rows(asked.repartition(7), table.repartition(13), "user_id", "ts"))
    assert one == many


def test_cutoff_is_inclusive(spark):
    table = spark.sql(
        "SELECT * FROM VALUES (1L, 7L, TIMESTAMP_NTZ'2024-01-01 10:00:00'), (2L, 7L, TIMESTAMP_NTZ'2024-01-01 10:00:00.000001') "
        "AS t(event_id, user_id, ts)"
    )
    asked = spark.sql(
        "SELECT * FROM VALUES ('a', '7', TIMESTAMP_NTZ'2024-01-01 10:00:00'), ('b', '7', TIMESTAMP_NTZ'2024-01-01 09:59:59.999999') "
        "AS s(sample_id, entity_id, cutoff)"
    )
    assert found_rows(evidence.entity_rows(asked, table, "user_id", "ts")) == {"a": [1]}
    counts = {k: v[0] for k, v in found_aggregate(evidence.aggregate_up_to_cutoff(asked, table, "ts")).items()}
    assert counts == {"a": 1, "b": 0}


def test_limit_runs_before_the_shuffle(spark, tmp_path):
    _events, _samples, table, asked = tables(spark, 7, 200, 4, 1, 600)
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = evidence.entity_rows(asked, stored, "user_id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert "LessThanOrEqual(ts," in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_columns_are_fetched_after_rows_are_chosen(spark):
    """Choosing works on entity and number: an exchange that carries a note is the one that brings it to its sample."""
    _events, _samples, table, asked = tables(spark, 7, 400, 4, 6, 600)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.entity_rows(asked, table, "user_id", "ts")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("note" in line for line in windows)
    scans = [line for line in plan.splitlines() if "Relation" in line and "_place" in line]
    assert len(scans) == 2


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 16, 37])
def test_blocks_cover_every_prefix_once(spark, count):
    levels = max(1, count.bit_length())
    holding = spark.range(1, count + 1).selectExpr("id", f"inline({cutoffs.blocks_holding('id', levels)})")
    asked = spark.range(1, count + 1).selectExpr("id AS cut", f"inline({cutoffs.blocks_up_to('id', levels)})")
    pairs = sorted((r["cut"], r["id"]) for r in asked.join(holding, ["level", "block"]).collect())
    assert pairs == [(c, i) for c in range(1, count + 1) for i in range(1, c + 1)]


def test_many_clustered_cutoffs_and_one_far_outlier(spark):
    """20,000 cutoffs within seven hours and one a thousand years later: no bin, no task that sees all."""
    rng = np.random.default_rng(8)
    micros = np.unique(rng.integers(0, 25_000_000_000, 20_000))
    far = 1000 * 365 * 86_400 * 1_000_000
    marks = np.append(micros, far)
    times = np.concatenate((rng.integers(-1_000_000, 25_000_100_000, 30_000), marks[::50], [far + 1], np.full(10_000, marks[77])))
    asked = spark.createDataFrame(pd.DataFrame({"sample_id": marks.astype(str), "entity_id": "1", "us": marks}))
    rows = spark.createDataFrame(pd.DataFrame({"us": times}))
    base = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    at = F.expr(f"{base} + make_dt_interval(0, 0, 0, CAST(CAST(us AS DECIMAL(18,0)) / 1000000 AS DECIMAL(18,6)))")
    asked, rows = asked.withColumn("cutoff", at), rows.withColumn("ts", at)
    index = cutoffs.index_cutoffs(asked)
    assert index.swept and index.count == len(marks)
    placed = cutoffs.with_interval(rows, "ts", index)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan
    found = sorted((r["us"], r["idx"]) for r in placed.collect())
    seen = np.sort(times[times <= far])
    assert found == list(zip(seen.tolist(), (np.searchsorted(marks, seen, "left") + 1).tolist()))
    totals = found_aggregate(evidence.aggregate_up_to_cutoff(asked, rows, "ts", index))
    upto = np.searchsorted(np.sort(times), marks, "right")
    assert {k: v[0] for k, v in totals.items()} == dict(zip(marks.astype(str), upto.tolist()))
