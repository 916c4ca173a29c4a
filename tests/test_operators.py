"""Prediction, critic, sampling, memory and source operators on small inputs."""

import json
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.operators import critic, evidence, memory, predict, training
from hindcast.plans.testdata import NEXT_EVENT, TABLE_KEYS
from hindcast.sources import tables as sources
from hindcast.tasks import Task


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- prediction ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "answer,truth,expected",
    [
        ("status Unpaid", "paid", (1.0, True, "substring_match")),
        ("x", "  ", (0.0, False, "empty_ground_truth")),
        ("x", None, (0.0, False, "empty_ground_truth")),
        ("x", "PAID", (0.0, False, "ground_truth_not_found")),
        ("it was paid", " PAID ", (1.0, True, "substring_match")),
    ],
)
def test_truth_match(spark, answer, truth, expected):
    assert tuple(one(spark, *predict.truth_match(F.lit(answer), F.lit(truth).cast("string")))) == expected


@pytest.mark.parametrize(
    "output,value,mode",
    [
        ('{"predicted_value": "3.5"}', 3.5, fixed.MODE_MODEL),
        ('{"predicted_value": 7}', 7.0, fixed.MODE_MODEL),
        ('{"predicted_value": " 2 "}', 2.0, fixed.MODE_MODEL),
        ('{"predicted_value": "not-a-number"}', -1.0, fixed.MODE_BASELINE),
        ('{"predicted_value": null}', -1.0, fixed.MODE_BASELINE),
        ("{}", -1.0, fixed.MODE_BASELINE),
        ("no json", -1.0, fixed.MODE_FALLBACK),
        (None, -1.0, fixed.MODE_BASELINE),
    ],
)
def test_coercion(spark, output, value, mode):
    rows = spark.createDataFrame([(output, -1.0)], "output string, train_mean double")
    row = predict.coerced_prediction(rows).first()
    assert (row["predicted_value"], row["predictor_mode"]) == (value, mode)


def test_error_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([], "predicted_value double, ground_truth double")
    assert tuple(predict.mean_absolute_error(rows).first()) == (0, 0.0)


def test_label_order(spark):
    rows = spark.createDataFrame(
        [("s", 0, "Fetch from customers", "active"), ("s", 1, "Aggregate payments", None), ("s", 2, "Fetch from Payments", "paid"),
         ("t", 0, "Fetch from customers", "active"), ("u", 0, "Aggregate payments", None)],
        "sample_id string, query_ordinal int, purpose string, label string",
    )
    labels = {r["sample_id"]: r["label"] for r in predict.inferred_label(rows, ("payments",)).collect()}
    assert labels == {"s": "paid", "t": "active", "u": None}


# --- questions -----------------------------------------------------------------------------------------------------


def test_questions(spark):
    df = spark.sql("SELECT '42' AS entity_id, TIMESTAMP_NTZ'2024-02-01 00:00:00' AS cutoff, 'value' AS known")
    task = Task("d", "t", (), "items", "item_id", "sales", "regression", (), ())
    ask = lambda template, strict=False: df.select(
        evidence.question_text(template, ["known"], task, strict)
    ).first()[0]
    assert ask(None) == "Using only information available on or before 2024-02-01 00:00:00, predict sales for item_id=42."
    assert ask("Predict {target_col} for {entity_id} using {unknown_field} and {known}.") == (
        "Predict sales for 42 using {unknown_field} and value."
    )
    assert ask("No names") == "No names"
    with pytest.raises(KeyError):
        ask("{unknown_field}", strict=True)
    with pytest.raises(ValueError):
        Task("d", "t", (), "items", "item_id", "sales", "regression", (), (), question_template="Is it {sales}?")


def test_matched_table(spark):
    match = lambda kind: one(spark, evidence.matched_table(F.lit(kind), ["customers", "payments"]))[0]
    assert [match(k) for k in ("payment", "Payment_Failures", "weather", "the customer")] == [
        "payments", "payments", "customers", "customers",
    ]


def test_masked_split(spark):
    full = spark.createDataFrame([("1", "a", 2.0), ("2", "a", 3.0)], "entity_id string, cutoff string, y double")
    masked, targets = evidence.masked_split(full, "y", limit=1)
    assert masked.columns == ["entity_id", "cutoff", "repeat_no"]
    assert [tuple(r) for r in targets.collect()] == [("1", "a", 1, 2.0)]


def test_repeated_samples_meet_their_own_targets(spark):
    full = spark.createDataFrame([("1", "a", 2.0), ("1", "a", 3.0)], "entity_id string, cutoff string, y double")
    masked, targets = evidence.masked_split(full, "y")
    scored = masked.join(targets, ["entity_id", "cutoff", "repeat_no"]).collect()
    assert sorted(r["y"] for r in scored) == [2.0, 3.0]


def test_repeat_numbers_tell_nothing_of_the_target(spark):
    rows = [(str(i), "a", y) for i in range(40) for y in (3.0, 9.0)]
    full = spark.createDataFrame(rows, "entity_id string, cutoff string, y double")
    _masked, targets = evidence.masked_split(full, "y")
    firsts = [r["y"] for r in targets.filter("repeat_no = 1").collect()]
    assert len(firsts) == 40 and {3.0, 9.0} == set(firsts)
    again = evidence.masked_split(full.repartition(7), "y")[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, targets.collect()))


def test_times_in_nested_columns(spark):
    schema = "id int, s struct<at: timestamp_ntz, inner: struct<day: date, n: int>>, a array<struct<t: string>>, m map<string, array<date>>, e array<int>"
    df = spark.createDataFrame(
        [
            (1, (datetime(2024, 5, 1), (date(2024, 6, 2), 1)), [("2024-07-03 x",), ("no time",)], {"2023-01-01": [date(2024, 8, 4)], "k": None}, [1]),
            (2, None, None, None, None),
        ],
        schema,
    )
    found = {r["id"]: [tuple(x) for x in r["seen"]] for r in df.selectExpr("id", f"{evidence.seen_times_sql(df.schema)} AS seen").collect()}
    assert found[2] == []
    assert sorted(found[1]) == [
        ("a[].t", "2024-07-03 x"), ("m.key", "2023-01-01"), ("m.value[]", "2024-08-04 00:00:00"),
        ("s.at", "2024-05-01 00:00:00"), ("s.inner.day", "2024-06-02 00:00:00"),
    ]


def test_violations_name_their_query(spark):
    rows = [("s", 0, "First", ["2024-01-01 00:00:00", "2024-03-01 00:00:00"]), ("s", 1, "Second", ["2024-04-01 00:00:00"]), ("t", 0, "First", None)]
    facts = spark.createDataFrame(rows, "sample_id string, query_ordinal int, purpose string, times array<string>")
    asked = spark.createDataFrame([("s", datetime(2024, 2, 1)), ("t", datetime(2024, 2, 1))], "sample_id string, cutoff timestamp_ntz")
    found = {r["sample_id"]: r for r in predict.leakage_audit(facts, asked).collect()}
    assert found["s"]["violation_texts"] == [
        "First: saw value 2024-03-01 00:00:00 past cutoff 2024-02-01 00:00:00",
        "Second: saw value 2024-04-01 00:00:00 past cutoff 2024-02-01 00:00:00",
    ]
    assert not found["s"]["passed"] and found["s"]["max_seen_time"] == "2024-04-01 00:00:00"
    assert found["t"]["passed"] and found["t"]["violations"] == 0 and found["t"]["max_seen_time"] is None


# --- critic --------------------------------------------------------------------------------------------------------


def test_missing_information_and_requests(spark):
    items = F.array(*[F.lit(x) for x in ("b", "a", "Facts", "b", "c", "d")])
    missing = critic.missing_information(items, F.array(F.lit("A"), F.lit("facts")))
    row = one(spark, missing.alias("m"), critic.evidence_requests(missing).alias("r"))
    assert row["m"] == ["b", "Facts", "b", "c", "d"]
    assert [(r["evidence_type"], r["priority"]) for r in row["r"]] == [("b", "high"), ("Facts", "medium"), ("b", "medium")]
    assert row["r"][0]["reason"] == "The final prompt did not clearly include b."


def test_sql_words(spark):
    words = lambda sql: one(spark, *[c.alias(n) for n, c in memory.forbidden_words(F.lit(sql)).items()])
    assert tuple(words("select created_at, payload from t")) == (["CREATE", "LOAD"], [])
    assert tuple(words("DROP table x; call y()")) == (["DROP", "CALL"], ["DROP", "CALL"])


def test_sql_words_of_odd_statements_fold_each_text_once(spark):
    texts = [None, "", "drop; Create x drop", "pragma_x insert", "copy,load\ncall", "created drop_ é drop"]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    df = df.select(*[c.alias(n) for n, c in memory.forbidden_words(F.col("sql")).items()])
    assert [tuple(r) for r in df.collect()] == [
        ([], []), ([], []), (["DROP", "CREATE"], ["DROP", "CREATE"]), (["INSERT", "PRAGMA"], ["INSERT"]),
        (["COPY", "LOAD", "CALL"], ["COPY", "LOAD", "CALL"]), (["DROP", "CREATE"], ["DROP"]),
    ]
    # A function with a lambda folds and splits the text anew for each word.
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


# --- training ------------------------------------------------------------------------------------------------------


def test_numbered_rows_cover_each_task(spark):
    samples = spark.range(3000).selectExpr("concat('t', id % 3) AS task_name", "concat('s', id) AS sample_id")
    rows = training.numbered_rows(samples).collect()
    for task in ("t0", "t1", "t2"):
        assert sorted(r["row_index"] for r in rows if r["task_name"] == task) == list(range(1000))


def test_sampled_episodes_are_uniform_over_tasks(spark):
    samples = spark.createDataFrame(
        [("d1", "a", f"a{i}") for i in range(3)] + [("d2", "b", f"b{i}") for i in range(50)] + [("d2", "c", "c0")],
        "dataset_name string, task_name string, sample_id string",
    )
    drawn = training.sample_episodes(samples, 2000, seed=1).collect()
    assert sorted(r["episode_index"] for r in drawn) == list(range(2000))
    share = {t: sum(r["task_name"] == t for r in drawn) / 2000 for t in "abc"}
    assert abs(share["a"] - 0.5) < 0.05 and abs(share["b"] - 0.25) < 0.05 and abs(share["c"] - 0.25) < 0.05
    again = training.sample_episodes(samples.repartition(5), 2000, seed=1).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))


def test_roles(spark):
    rows = spark.range(4000).select(training.sampled_role("id", 3, {"critic": 0.0}).alias("r")).groupBy("r").count()
    counts = {r["r"]: r["count"] for r in rows.collect()}
    assert "critic" not in counts and all(abs(counts[r] - 1333) < 150 for r in fixed.ROLES[:3])
    only = spark.range(5).select(training.sampled_role("id", 3, roles=("critic",)))
    assert {r[0] for r in only.collect()} == {"critic"}
    with pytest.raises(ValueError):
        training.sampled_role("id", 3, roles=())


@pytest.fixture(scope="module")
def trajectory(spark):
    return spark.sql(
        """SELECT 's' AS sample_id, named_struct('question', 'Q', 'database_summary', 'S', 'memories', array('m')) AS planner_input,
        named_struct('needed_information', array('seen'), 'assumptions', array('right', 'wrong')) AS initial_plan,
        named_struct('prompt_sufficient', false, 'missing_information', array('payment', 'payment', 'seen'),
                     'wrong_assumptions', array('wrong')) AS critic_report,
        'demo' AS dataset_name, 'task' AS task_name, '1' AS entity_id, 'planner-adapter' AS target_adapter,
        named_struct('score', 1.0D) AS final_evaluation, '2024-01-01' AS cutoff_time, 'prompt' AS final_prompt,
        named_struct('summary', 'ok') AS final_answer, 'paid' AS ground_truth,
        named_struct('queries_run', array(named_struct('purpose', 'p', 'sql', 'SELECT 1', 'row_count', 1))) AS evidence_packet"""
    )


def test_examples(trajectory):
    rows = {role: build(trajectory).first() for role, build in training.EXAMPLES.items()}
    for role, row in rows.items():
        assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant"]
        assert row["messages"][0]["content"] == "Return valid JSON only."
        assert row["metadata"]["target_role"] == role
    plan = json.loads(rows["task_planner"]["messages"][2]["content"])
    assert plan == {
        "needed_information": ["seen", "payment"], "assumptions": ["right"], "critic_guided": True, "prompt_sufficient": False,
    }
    assert json.loads(rows["sql_explorer"]["messages"][2]["content"]) == {
        "done": False, "queries": [{"purpose": "p", "sql": "SELECT 1"}],
    }
    assert json.loads(rows["critic"]["messages"][1]["content"])["ground_truth"] == "paid"
    assert rows["final_predictor"]["messages"][1]["content"] == "prompt"


def test_long_conversation_is_one_text(spark):
    turns = spark.range(2500).selectExpr("1 AS conv", "id AS turn", "'user' AS role", "concat('t', id) AS text").repartition(4)
    whole = training.chat_text(turns, "conv", "turn", "role", "text").collect()
    assert len(whole) == 1 and whole[0]["turns"] == 2500
    assert whole[0]["text"] == "\n\n".join(f"USER: t{i}" for i in range(2500))


def test_preference_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.random() < 0.5, float(rng.randrange(3)), rng.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(rows, "input int, attempt_id int, prompt_sufficient boolean, score double, rounds int")
    found = {tuple(r) for r in training.preference_pairs(df, ["input"]).collect()}
    expected = set()
    for key in range(3):
        group = [((r[2], r[3], -r[4]), r[1]) for r in rows if r[0] == key]
        best = max(group)
        expected |= {(key, best[1], i) for rank, i in group if rank < best[0]}
    assert found == expected


def test_head_to_head(spark):
    rows = [
        # input, adapter, run, sufficient, score, rounds
        (1, "a", 1, True, 1.0, 0), (1, "a", 2, False, 1.0, 0), (1, "b", 1, True, 0.0, 1), (1, "b", 1, True, 0.0, 2),
        (2, "a", 1, True, 1.0, 1), (2, "a", 2, True, 1.0, 0), (2, "b", 7, True, 1.0, 0),
        (3, "a", 1, True, 1.0, 0), (4, "b", 1, True, 1.0, 0),
    ]
    df = spark.createDataFrame(rows, "input int, adapter string, run int, prompt_sufficient boolean, score double, rounds int")
    found = {(r["left_adapter"], r["right_adapter"]): r for r in training.head_to_head(df.repartition(3), ["input"]).collect()}
    assert set(found) == {("a", "a"), ("a", "b")}
    both, own = found["a", "b"], found["a", "a"]
    assert (both["inputs"], both["left_wins"], both["right_wins"], both["draws"], both["regression_rate"]) == (2, 0, 1, 1, None)
    assert (own["inputs"], own["left_wins"], own["right_wins"], own["sufficiency_lost"], own["regression_rate"]) == (2, 1, 1, 1, 0.5)


# --- memory --------------------------------------------------------------------------------------------------------


def brute_search(entries, queries, results, summary_type):
    out = []
    for query_id, scope, text in queries:
        words = {w.lower() for w in text.split()}
        own = sorted(e for e in entries if e[1] == scope)
        scored = sorted(((-sum(w in f"{e[2]} {e[3]}".lower() for w in words), e[0], e[2]) for e in own))
        out += [(query_id, e, -s) for s, e, kind in scored[:results] if s < 0 or kind == summary_type]
    return sorted(out)


def test_a_word_is_looked_up_by_its_rarest_piece(spark):
    texts = ["payment made", "repayments", "pay now", "größe", "日本語", "xx"]
    words = ["paym", "ments", "pay", "größe", "日本語", "nothing", "or"]
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    found = {r["word"]: r["gram"] for r in memory.rarest_pieces(one(words, "word"), one(texts, "haystack")).collect()}
    held = lambda gram: sum(gram in t for t in texts)
    assert set(found) == {w for w in words if len(w) > 2}
    for word, gram in found.items():
        pieces = {word[i : i + 3] for i in range(len(word) - 2)}
        assert gram == min(pieces, key=lambda g: (held(g), g))


@pytest.mark.parametrize("bound", [500_000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_memory_search(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(memory, "BROADCAST_WORDS", bound)
    monkeypatch.setattr(memory, "LISTED_WORDS", min(bound, memory.LISTED_WORDS))
    rng = random.Random(seed)
    vocabulary = ["pay", "payment", "Order", "risk", "É", "zz", "ymen", "or", "k"]
    kinds = ["database_summary", "note"]
    entries = [
        (i, f"s{rng.randrange(2)}", rng.choice(kinds), " ".join(rng.choices(vocabulary[:4], k=rng.randrange(3))))
        for i in range(60)
    ]
    queries = [(i, f"s{i % 3}", "  ".join(rng.choices(vocabulary + [""], k=2))) for i in range(12)]
    e = spark.createDataFrame(entries, "entry_id int, scope string, memory_type string, content string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, scope string, query string")
    found = sorted((r["query_id"], r["entry_id"], r["score"]) for r in memory.search_memory(e, q, results=5).collect())
    assert found == brute_search(entries, queries, 5, "database_summary")


def test_memory_stays_in_its_scope(spark):
    e = spark.createDataFrame(
        [(1, "db_one", "database_summary", "customers and orders"), (2, "db_two", "database_summary", "invoices and payments")],
        "entry_id int, scope string, memory_type string, content string",
    )
    q = spark.createDataFrame([(1, "db_one", "customers"), (2, "db_one", "invoices")], "query_id int, scope string, query string")
    rows = memory.search_memory(e, q).collect()
    assert {(r["query_id"], r["entry_id"], r["score"]) for r in rows} == {(1, 1, 1), (2, 1, 0)}
    assert memory.load_summary(e, "db_two").first()["content"] == "invoices and payments"


def test_replace_memory(spark):
    schema = "scope string, memory_type string, content string, version int"
    old = spark.createDataFrame([("a", "t", "old", 1), ("a", "u", "kept", 1), ("b", "t", "kept", 5)], schema)
    new = spark.createDataFrame([("a", "t", "new", 2)], schema)
    rows = memory.replace_memory(old, new, ["scope", "memory_type"], "version").collect()
    assert sorted(r["content"] for r in rows) == ["kept", "kept", "new"]


def test_cascade_delete_keeps_null_references(spark):
    runs = spark.createDataFrame([(1,), (2,)], "id int")
    logs = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "log int, run int")
    left = memory.cascade_delete({"runs": (runs, "id"), "logs": (logs, "run")}, runs.filter("id = 1"), "id")
    assert [r["id"] for r in left["runs"].collect()] == [2]
    assert sorted(r["log"] for r in left["logs"].collect()) == [2, 3]


def test_closure_follows_references(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "databases": one([(1,), (2,)], "id int"),
        "runs": one([(10, 1, None), (11, 2, 10), (12, 2, 11), (13, 2, None), (14, 2, 15), (15, 2, 14)], "id int, db int, parent int"),
        "logs": one([(100, 10, 2), (101, 13, 2), (102, None, 2), (103, 12, None), (104, 13, 1)], "id int, run int, db int"),
        "notes": one([(100,), (101,), (None,)], "log int"),
        "users": one([(1,)], "id int"),
    }
    references = [
        memory.Reference(*r)
        for r in [("runs", "db", "databases"), ("runs", "parent", "runs"), ("logs", "run", "runs"), ("logs", "db", "databases"), ("notes", "log", "logs")]
    ]
    keys = {"databases": "id", "runs": "id", "logs": "id"}
    left = memory.delete_closure(tables, keys, references, {"databases": one([(1,), (None,)], "gone int")})
    kept = {n: sorted((r[0] is None, r[0]) for r in df.collect()) for n, df in left.items()}
    ids = {n: [i for _null, i in rows] for n, rows in kept.items()}
    assert ids == {"databases": [2], "runs": [13, 14, 15], "logs": [101, 102], "notes": [101, None], "users": [1]}
    # a cycle of rows goes as a whole, whichever of them is deleted
    left = memory.delete_closure(tables, keys, references, {"runs": one([(14,)], "gone int")})
    assert sorted(r["id"] for r in left["runs"].collect()) == [10, 11, 12, 13]
    untouched = memory.delete_closure(tables, keys, references, {"users": one([], "gone int")})
    assert {n: df.count() for n, df in untouched.items()} == {n: df.count() for n, df in tables.items()}


def test_levels_follow_references_and_close_cycles():
    chain = [memory.Reference("b", "x", "a"), memory.Reference("c", "x", "b"), memory.Reference("c", "y", "a")]
    assert memory.reference_levels(["c", "b", "a", "d"], chain) == [["a"], ["d"], ["b"], ["c"]]
    loop = [memory.Reference("b", "x", "c"), memory.Reference("c", "x", "b"), memory.Reference("b", "y", "a")]
    assert memory.reference_levels(["c", "b", "a"], loop) == [["a"], ["b", "c"]]


def test_stored_log_pages(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    # many rows share a time, some have none
    rows = [(i, None if rng.random() < 0.05 else start + timedelta(minutes=rng.randrange(40) if i % 3 else 7)) for i in range(700)]
    log = spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(4)
    stored = memory.store_log(log, "ts", "id", str(tmp_path / "log"), range_rows=60)
    assert len(stored.ranges) > 5 and sum(r[1] for r in stored.ranges) == 700
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] - start).total_seconds() if r[1] else 0, r[0]))
    ids = lambda df: [r["id"] for r in df.collect()]
    for offset in (0, 1, 59, 60, 233, 690, 699, 700, 5000):
        page = stored.page(spark, 25, offset)
        assert ids(page) == [r[0] for r in ordered[offset : offset + 25]]
        if 0 < offset < 660 and ordered[offset - 1][1] is not None:
            _last, at = ordered[offset - 1]
            assert ids(stored.page_after(spark, at, ordered[offset - 1][0], 25)) == ids(page)
    plan = stored.page(spark, 25, 233)._jdf.queryExecution().executedPlan().toString()
    read = [int(n) for n in re.search(r"PartitionFilters: \[[^\]]*_range#\d+ (?:IN|INSET|=) ?\(?([^)\]]*)", plan).group(1).replace(",", " ").split()]
    assert 1 <= len(read) <= 2


# --- sources -------------------------------------------------------------------------------------------------------


def test_split_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y"}\n')
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"},\n {"id": 2, "t": "y"}]')
    (tmp_path / "a.csv").write_text('id,t\n1,"x, and\nmore"\n2,y\n')
    for form in ("jsonl", "json"):
        assert sorted(map(tuple, sources.read_split(spark, str(tmp_path / f"a.{form}")).collect())) == [(1, "x"), (2, "y")]
    rows = sources.read_split(spark, str(tmp_path / "a.csv"), multiline=True).collect()
    assert sorted(map(tuple, rows)) == [("1", "x, and\nmore"), ("2", "y")]
    with pytest.raises(ValueError):
        sources.read_split(spark, str(tmp_path / "a.parquet"))


def test_materialize_keeps_or_rebuilds(spark, tmp_path):
    folder = str(tmp_path / "db")
    tables = {"customer": spark.createDataFrame([(1,), (2,)], "c_custkey int")}
    first = sources.materialize(tables, TABLE_KEYS, folder)
    assert [(r["primary_key"], r["row_count"]) for r in first.collect()] == [("c_custkey", 2)]
    more = {"customer": spark.createDataFrame([(1,), (2,), (3,)], "c_custkey int")}
    assert sources.materialize(more, TABLE_KEYS, folder).first()["row_count"] == 2
    assert sources.materialize(more, TABLE_KEYS, folder, rebuild=True).first()["row_count"] == 3


def test_fingerprints(spark, tmp_path):
    for name, rows in (("a", 3), ("b", 4)):
        spark.range(rows).repartition(2).write.parquet(str(tmp_path / name))
    paths = {n: str(tmp_path / n) for n in "ab"}
    sources.file_fingerprints(spark, paths).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert not any(r["is_stale"] for r in sources.stale_tables(sources.file_fingerprints(spark, paths), stored).collect())
    spark.range(1).write.mode("append").parquet(paths["a"])
    stale = {r["table_name"]: r["is_stale"] for r in sources.stale_tables(sources.file_fingerprints(spark, paths), stored).collect()}
    assert stale == {"a": True, "b": False}
    twice = sources.content_fingerprints({"x": spark.sql("SELECT 1 a UNION ALL SELECT 1"), "y": spark.sql("SELECT 2 a UNION ALL SELECT 2")})
    assert len({r["row_hash_sum"] for r in twice.collect()}) == 2


def test_views(spark):
    sources.register_views({"shop_rows": spark.range(3)})
    assert spark.sql("SELECT count(*) AS n FROM shop_rows").first()["n"] == 3


def test_expected_evidence_of_the_tasks():
    assert NEXT_EVENT.expected_evidence == ("next", "event", "events", "user_id")


def test_rows_that_lie_in_one_of_many_parts_are_spread(spark):
    # As a file of one row group: cut into many parts, of which one is given all rows.
    rows = spark.range(0, 3200, 1, 32).filter("id < 100")
    parts = memory.spread(rows).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(p["count"] for p in parts) == 100 and max(p["count"] for p in parts) < 50
    even = spark.range(0, 3200, 1, 32)
    assert memory.spread(even) is even
    assert memory.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("listed", [0, 2, 2_000])
def test_memory_search_finds_the_same_with_and_without_a_list_of_pieces(spark, monkeypatch, listed):
    monkeypatch.setattr(memory, "LISTED_GRAMS", listed)
    entries = [(1, "a", "note", "payment risk"), (2, "a", "note", "no risk"), (3, "b", "note", "order paid"), (4, "b", "note", None)]
    queries = [(1, "a", "payment risk orders late"), (2, "b", "paid"), (3, "c", "paid")]
    e = spark.createDataFrame(entries, "entry_id int, scope string, memory_type string, content string")
    q = spark.createDataFrame(queries, "query_id int, scope string, query string")
    found = sorted((r["query_id"], r["entry_id"], r["score"]) for r in memory.search_memory(e, q, results=5).collect())
    assert found == [(1, 1, 2), (1, 2, 1), (2, 3, 1)]
