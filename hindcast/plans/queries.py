"""The registered queries: every operator over whole test tables, in a flat form that SQL can check."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import kind_of, time_text, value_text
from hindcast.functions.scale import scratch_path, written
from hindcast.operators import critic, evidence, memory, predict, profile, profile_store, refine, requests, training
from hindcast.operators.cutoffs import index_cutoffs
from hindcast.plans import testdata as td
from hindcast.sources import sinks, tables as sources
from hindcast.tasks import STAR_RULE

ALL_CUTOFFS = td.SPEND_TRAIN + td.SPEND_TEST
USER_CUTOFFS = td.PURCHASES_TRAIN + td.PURCHASES_TEST


def _all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return sources.open_tables(spark, folder, td.ALL_TABLES)


def _retail(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return sources.open_tables(spark, folder, td.RETAIL)


def _activity(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return sources.open_tables(spark, folder, td.ACTIVITY)


def _schemas(tables: dict[str, DataFrame]) -> dict:
    return {n: df.schema for n, df in tables.items()}


def _joined(column: str):
    return F.array_join(F.col(column), "|")


# --- sources -------------------------------------------------------------------------------------------------------


def table_inventory(spark, folder):
    return sources.table_inventory(_all(spark, folder))


def split_reader(spark, folder):
    """The spend split written in each format and read back."""
    split = td.spend_split(_retail(spark, folder), ALL_CUTOFFS).select(
        "entity_id", time_text("cutoff").alias("cutoff_time"), F.col("spend").cast("string").alias("spend")
    )
    path = scratch_path(spark, "split")
    split.write.json(f"{path}/split.jsonl")
    split.write.option("header", True).csv(f"{path}/split.csv")
    # A .json file is one array and read by one task, so the split becomes files of at most 10,000 rows per cutoff.
    part = F.concat_ws("-", F.substring("cutoff_time", 1, 10), F.floor(F.col("entity_id").cast("long") / 10_000))
    arrays = split.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*split.columns))).alias("value"))
    arrays.write.partitionBy("part").text(f"{path}/split.json")
    parts = [
        sources.read_split(spark, f"{path}/split.{form}").select(F.lit(form).alias("split_format"), *split.columns)
        for form in ("jsonl", "json", "csv")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("split_format", "cutoff_time").agg(
        F.count("*").alias("split_rows"),
        F.sum(F.col("spend").cast("decimal(18,2)")).cast("double").alias("total_spend"),
    )


def materialize_metadata(spark, folder):
    return sources.materialize(_all(spark, folder), td.TABLE_KEYS, scratch_path(spark, "tables"), rebuild=True)


def fingerprint_stale(spark, folder):
    """Fingerprints of stored copies, written and read back; then one copy gets a row more and one is written anew as it was."""
    root, names = scratch_path(spark, "copies"), ("customer", "nation", "orders", "region")
    tables, paths = sources.open_tables(spark, folder, names), {n: f"{root}/{n}.parquet" for n in names}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    kept = written(sources.file_fingerprints(spark, paths), "fingerprints")
    contents = written(sources.content_fingerprints(sources.open_tables(spark, root, names)), "contents")
    tables["nation"].orderBy("n_nationkey").limit(1).write.mode("append").parquet(paths["nation"])
    tables["orders"].write.mode("overwrite").parquet(paths["orders"])
    found = sources.stale_tables(sources.file_fingerprints(spark, paths), kept)
    now = sources.content_fingerprints(sources.open_tables(spark, root, names))
    before = contents.select("table_name", F.col("row_hash_sum").alias("stored_sum"))
    return found.join(now, "table_name").join(before, "table_name").select(
        "table_name", "row_count", "is_stale", (F.col("row_hash_sum") == F.col("stored_sum")).alias("same_rows")
    )


def fingerprint_rows(spark, folder):
    tables = _all(spark, folder)
    return sources.content_fingerprints(tables).select("table_name", "row_count")


# --- profile -------------------------------------------------------------------------------------------------------


def profile_row_counts(spark, folder):
    return sources.row_counts(_all(spark, folder))


def profile_nulls_distinct(spark, folder):
    flat = profile.nulls_and_distinct(_all(spark, folder))
    return flat.select(
        "table_name", "ordinal", "column_name", "kind", F.round("null_rate", 6).alias("null_rate"),
        F.coalesce("distinct_count", F.lit(-1)).alias("distinct_count"),
    )


def profile_numeric(spark, folder):
    ranges = profile.column_ranges(_all(spark, folder)).filter(F.col("kind") == "numeric")
    return ranges.select(
        "table_name", "column_name", "min_value", "max_value",
        F.round("avg_value", 4).alias("avg_value"), F.round("stddev_value", 4).alias("stddev_value"),
    )


def profile_temporal(spark, folder):
    ranges = profile.column_ranges(_all(spark, folder)).filter(F.col("kind") == "temporal")
    return ranges.select("table_name", "column_name", "min_value", "max_value")


def profile_top_values(spark, folder):
    return profile.top_values(_all(spark, folder))


def primary_key_guess(spark, folder):
    keys = profile.primary_keys(profile.nulls_and_distinct(_all(spark, folder)))
    return keys.select("table_name", F.coalesce("primary_key_guess", F.lit("")).alias("primary_key_guess"))


def infer_relationships(spark, folder):
    inventory = sources.column_inventory(spark, _schemas(_all(spark, folder)))
    plain = profile.relationships(inventory).withColumn("id_rule", F.lit("_id"))
    star = profile.relationships(inventory, STAR_RULE).withColumn("id_rule", F.lit("key"))
    return plain.unionByName(star)


def relationship_support(spark, folder):
    """All tables, by both id rules."""
    tables = _all(spark, folder)
    plain = profile.relationship_support(tables).withColumn("id_rule", F.lit("_id"))
    star = profile.relationship_support(tables, STAR_RULE).withColumn("id_rule", F.lit("key"))
    return plain.unionByName(star).withColumn("support", F.round("support", 6))


def table_sample(spark, folder):
    """The first rows of every table as text, five of each and twenty of one; nested columns are left out of the text."""
    tables = _all(spark, folder)
    parts = []
    for name, rows in [(n, fixed.PROFILE_SAMPLE_ROWS) for n in tables] + [("customer", fixed.INSPECT_SAMPLE_ROWS)]:
        first = profile.table_sample(tables[name], rows)
        texts = [value_text(f.name, f.dataType) for f in first.schema.fields if kind_of(f.dataType) != "generic"]
        parts.append(
            first.select(F.lit(name).alias("table_name"), F.lit(rows).alias("cap"), F.concat_ws("|", *texts).alias("row_text"))
        )
    return reduce(DataFrame.unionByName, parts)


def database_summary(spark, folder):
    tables = _all(spark, folder)
    inventory = sources.column_inventory(spark, _schemas(tables))
    keys = profile.primary_keys(profile.nulls_and_distinct(tables))
    values = profile.profile_summary(keys, profile.relationships(inventory, STAR_RULE))
    return values.select(F.lit("profile").alias("form"), "summary").unionByName(
        profile.schema_summary(inventory).select(F.lit("schema").alias("form"), "summary")
    )


def profile_refresh(spark, folder):
    """Two databases stored, one of them stored again, both listed."""
    path = scratch_path(spark, "profile")
    retail = profile.nulls_and_distinct(_retail(spark, folder))
    profile.store_profile(retail, "retail", path)
    profile.store_profile(profile.nulls_and_distinct(_activity(spark, folder)), "activity", path)
    profile.store_profile(retail, "retail", path)
    columns = ["database_id", "table_name", "ordinal", "column_name", "row_count"]
    return profile.stored_profile(spark, path, "retail").select(*columns).unionByName(
        profile.stored_profile(spark, path, "activity").select(*columns)
    )


def _changing_tables(spark, folder):
    """Two tables of several files under a folder of their own, and their paths."""
    tables, root = _retail(spark, folder), scratch_path(spark, "changing")
    paths = {n: f"{root}/{n}" for n in ("customer", "orders")}
    tables["customer"].repartitionByRange(2, "c_custkey").write.parquet(paths["customer"])
    tables["orders"].repartitionByRange(4, "o_orderkey").write.parquet(paths["orders"])
    return {n: spark.read.schema(tables[n].schema).parquet(path) for n, path in paths.items()}, paths


PROFILE_KEYS = {"customer": ("c_custkey", "c_nationkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus")}


def _refreshed_store(spark, folder):
    """A store filled, then refreshed after orders got another file: their first rows again under new keys and ten days later."""
    tables, paths = _changing_tables(spark, folder)
    store = profile_store.open_store(spark, scratch_path(spark, "store"), PROFILE_KEYS, STAR_RULE)
    first = store.refresh(tables, paths)
    added = _retail(spark, folder)["orders"].filter(F.col("o_orderkey") % 5 == 0).withColumns(
        {"o_orderkey": F.col("o_orderkey") + 10_000_000, "o_orderdate": F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")}
    )
    added.coalesce(1).write.mode("append").parquet(paths["orders"])
    return store, [first, store.refresh(tables, paths)], lambda: store.refresh(tables, paths)


def profile_incremental(spark, folder):
    """The merged profile after the refresh: what the changed tables hold, from states of which one file's were read anew."""
    store = _refreshed_store(spark, folder)[0]
    keys = store.read("tables").select("table_name", "primary_key_guess")
    return store.read("columns").join(keys, "table_name").select(
        "table_name", "column_name", "row_count", F.round("null_rate", 6).alias("null_rate"), "min_value", "max_value",
        F.round("avg_value", 3).alias("avg_value"), F.round("stddev_value", 3).alias("stddev_value"),
        F.when(F.col("distinct_is_exact"), F.col("distinct_count")).alias("exact_distinct"), "primary_key_guess",
    )


def profile_files_read(spark, folder):
    """How many files of each table each of three refreshes read, kept and dropped, and whether the stored fingerprints are current."""
    store, refreshes, once_more = _refreshed_store(spark, folder)
    refreshes.append(once_more())
    parts = [r.files.groupBy("table_name", "action").agg(F.count("*").alias("files")).withColumn("refresh", F.lit(i)) for i, r in enumerate(refreshes, 1)]
    same = refreshes[-1].files.select("table_name", "file_id").join(store.files().select("table_name", "file_id"), ["table_name", "file_id"], "left_anti")
    unknown = same.groupBy("table_name").agg(F.count("*").alias("unknown"))
    rows = reduce(DataFrame.unionByName, parts).join(unknown, "table_name", "left")
    return rows.select("refresh", "table_name", "action", "files", F.coalesce("unknown", F.lit(0)).alias("not_stored"))


def column_profile(spark, folder):
    return profile.column_profile(_all(spark, folder)).select(
        "table_name", "ordinal", "column_name", "kind", "row_count", F.round("null_rate", 6).alias("null_rate"),
        F.coalesce("distinct_count", F.lit(-1)).alias("distinct_count"), F.coalesce("min_value", F.lit("")).alias("min_value"),
        F.coalesce("max_value", F.lit("")).alias("max_value"),
        F.coalesce(
            F.array_join(F.transform("top_values", lambda v: F.concat_ws("=", v["value"], v["frequency"].cast("string"))), "|"),
            F.lit(""),
        ).alias("top_values"),
    )


# --- evidence ------------------------------------------------------------------------------------------------------


def date_range(spark, folder):
    return evidence.date_ranges(_all(spark, folder))


def evidence_agg_cutoff(spark, folder):
    """Orders and line items up to each of three cutoffs, for every customer; events for every user."""
    tables = _retail(spark, folder)
    samples = td.spend_samples(tables, ALL_CUTOFFS)
    index = index_cutoffs(samples)
    users = _activity(spark, folder)
    visits = td.purchase_samples(users, USER_CUTOFFS)
    parts = [
        evidence.aggregate_up_to_cutoff(samples, tables[n], c, index).withColumn("table_name", F.lit(n))
        for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    parts.append(
        evidence.aggregate_up_to_cutoff(visits, users["events"], "ts").withColumn("table_name", F.lit("events"))
    )
    both = reduce(DataFrame.unionByName, parts)
    return both.select(
        "sample_id", "table_name", "row_count",
        time_text("min_time").alias("min_time"), time_text("max_time").alias("max_time"),
    )


def evidence_entity_rows(spark, folder):
    tables = _retail(spark, folder)
    samples = td.spend_samples(tables, ALL_CUTOFFS)
    found = evidence.entity_rows(samples, tables["orders"], "o_custkey", "o_orderdate")
    return found.select(
        "sample_id", F.col("rn").cast("int").alias("rn"), "o_orderkey", "o_orderstatus", "o_totalprice",
        time_text("o_orderdate").alias("o_orderdate"),
    )


def evidence_entity_rows_recent(spark, folder):
    """The same with the newest rows first, on events, whose users are few and busy."""
    tables = _activity(spark, folder)
    samples = td.purchase_samples(tables, USER_CUTOFFS)
    found = evidence.entity_rows(samples, tables["events"], "user_id", "ts", order="recent")
    return found.select("sample_id", F.col("rn").cast("int").alias("rn"), "event_id", time_text("ts").alias("ts"))


def evidence_entity_static(spark, folder):
    tables = _retail(spark, folder)
    samples = td.spend_samples(tables, ALL_CUTOFFS)
    found = evidence.entity_rows(samples, tables["customer"], "c_custkey")
    return found.select("sample_id", F.col("rn").cast("int").alias("rn"), "c_custkey", "c_name", "c_mktsegment")


def evidence_fallback_sample(spark, folder):
    tables = _retail(spark, folder)
    samples = td.spend_samples(tables).select("sample_id", F.lit("part").alias("table_name"))
    rows = evidence.fallback_rows(tables["part"]).select(F.lit("part").alias("table_name"), "rn", "p_partkey", "p_name")
    return samples.join(F.broadcast(rows), "table_name").withColumn("rn", F.col("rn").cast("int"))


def _priority_facts(spark, folder):
    tables = _retail(spark, folder)
    samples = td.priority_samples(tables, ALL_CUTOFFS)
    return samples, evidence.facts(samples, td.PRIORITY, tables)


def result_summary(spark, folder):
    _samples, rows = _priority_facts(spark, folder)
    return rows.select(
        "sample_id", "table_name", "fact_key", "row_count", F.size("sample_rows").alias("kept_rows"),
        _joined("sample_rows").alias("sample_rows"),
    )


def evidence_packet(spark, folder):
    samples, rows = _priority_facts(spark, folder)
    packed = evidence.packets(rows)
    return packed.select("sample_id", "facts", F.posexplode("queries_run").alias("position", "q")).select(
        "sample_id",
        "position",
        F.col("q.purpose").alias("purpose"),
        F.col("q.sql").alias("sql"),
        F.col("q.result_summary.row_count").alias("row_count"),
        F.size("facts").alias("fact_count"),
        F.array_join(F.array_sort(F.map_keys("facts")), "|").alias("fact_keys"),
    )


def _requests(samples, task):
    """Requests as a critic makes them that found nothing of what a task expects."""
    wanted = F.array(*[F.lit(e) for e in task.expected_evidence])
    return samples.select("sample_id", critic.evidence_requests(wanted).alias("requests"))


def match_evidence_table(spark, folder):
    tables = _retail(spark, folder)
    samples = td.priority_samples(tables)
    names = sorted(tables)
    asked = samples.select("sample_id", F.explode(F.array(*[F.lit(e) for e in td.PRIORITY.expected_evidence])).alias("evidence_type"))
    return asked.withColumn("table_name", evidence.matched_table(F.col("evidence_type"), names))


def followup_evidence(spark, folder):
    tables = _retail(spark, folder)
    samples = td.priority_samples(tables)
    found = evidence.followup_evidence(
        _requests(samples, td.PRIORITY), samples, td.PRIORITY, tables, list(td.PRIORITY.expected_evidence)
    )
    return found.select(
        "sample_id", "position", "evidence_type", "reason", "table_name", "row_count",
        _joined("sample_rows").alias("sample_rows"),
    )


def render_question(spark, folder):
    tables = _retail(spark, folder)
    spend, priority = td.spend_samples(tables, ALL_CUTOFFS), td.priority_samples(tables)
    strict = "Up to {cutoff_time}: what does {entity_id} ({dataset_name}) do?"
    loose = "Predict {target_col} for {entity_id} using {unknown_field}."
    forms = [
        (spend, "default", evidence.question_text(None, [], td.SPEND)),
        (priority, "template", evidence.question_text(td.PRIORITY.question_template, [], td.PRIORITY)),
        (spend, "unknown", evidence.question_text(loose, [], td.SPEND)),
        (spend, "strict", evidence.question_text(strict, ["dataset_name"], td.SPEND, strict=True)),
    ]
    return reduce(
        DataFrame.unionByName,
        [s.select("sample_id", F.lit(n).alias("form"), q.alias("question")) for s, n, q in forms],
    )


def masked_split(spark, folder):
    """A split in which every third customer occurs twice, with two targets."""
    once = td.spend_split(_retail(spark, folder), ALL_CUTOFFS)
    again = once.filter(F.col("entity_id").cast("long") % 3 == 0).withColumn("spend", F.col("spend") + 1)
    masked, targets = evidence.masked_split(once.unionByName(again), "spend")
    return masked.join(targets, ["entity_id", "cutoff", "repeat_no"]).select(
        "sample_id", "entity_id", time_text("cutoff").alias("cutoff_time"), F.round("spend", 2).alias("spend")
    )


def classify_question(spark, folder):
    """Every user turn as a question."""
    turns = _activity(spark, folder)["conversations"].filter(F.col("role") == "user")
    parts = _retail(spark, folder)["customer"].select(
        F.col("c_custkey").alias("conv_id"),
        F.lit(-1).cast("long").alias("turn"),
        F.concat(F.lit("How LIKELY is churn of customer "), "c_name", F.lit(" in "), "c_mktsegment").alias("text"),
    )
    questions = turns.select("conv_id", "turn", "text").unionByName(parts)
    return questions.select("conv_id", "turn", *evidence.classify_question(F.col("text")))


def initial_plan(spark, folder):
    samples = td.priority_samples(_retail(spark, folder), ALL_CUTOFFS)
    return samples.select("sample_id", evidence.initial_plan(td.PRIORITY).alias("plan")).select(
        "sample_id",
        F.col("plan.prediction_type").alias("prediction_type"),
        F.col("plan.target.description").alias("target_description"),
        _joined("plan.needed_information").alias("needed_information"),
        _joined("plan.candidate_tables").alias("candidate_tables"),
        _joined("plan.assumptions").alias("assumptions"),
        F.col("plan.cutoff_time").alias("cutoff_time"),
    )


def _answered(spark, folder, tables):
    turns = _activity(spark, folder)["conversations"].filter(F.col("role") == "user")
    questions = turns.select("conv_id", "turn", F.col("text").alias("question"))
    return requests.answer_requests(questions, requests.inspections(tables)).select(
        "conv_id", "turn", "prediction_type", "entity_name", "target_name", "summary", "confidence",
        _joined("limitations").alias("limitations"), F.explode("queries_run").alias("q"),
    ).select(
        "conv_id", "turn", "prediction_type", "entity_name", "target_name", "summary", "confidence", "limitations",
        F.col("q.position").alias("position"), F.col("q.purpose").alias("purpose"), F.col("q.sql").alias("sql"),
        F.col("q.row_count").alias("row_count"), F.array_join("q.sample_rows", "|").alias("sample_rows"),
    )


def predict_requests(spark, folder):
    """Every user turn as a question about three small retail tables, answered from what inspecting them shows."""
    tables = _retail(spark, folder)
    return _answered(spark, folder, {n: tables[n] for n in ("customer", "nation", "orders")})


def predict_requests_all(spark, folder):
    """The same about all retail tables; the operator's rule chooses which of them are inspected."""
    return _answered(spark, folder, _retail(spark, folder))


# --- prediction ----------------------------------------------------------------------------------------------------


def _spend_predictions(tables):
    train = td.spend_split(tables, td.SPEND_TRAIN)
    test = td.spend_split(tables)
    mean = predict.train_mean(train, "spend")
    return test.join(F.broadcast(mean), "task_name").select(
        "sample_id", "dataset_name", "task_name", "entity_id", "cutoff", "train_mean",
        F.col("train_mean").alias("predicted_value"), F.col("spend").alias("ground_truth"),
    )


def _purchase_predictions(tables):
    train = td.purchase_split(tables, td.PURCHASES_TRAIN)
    mean = predict.train_mean(train, "purchases")
    return td.purchase_split(tables).join(F.broadcast(mean), "task_name").select(
        "sample_id", "dataset_name", "task_name", "entity_id", "cutoff", "train_mean",
        F.col("train_mean").alias("predicted_value"), F.col("purchases").alias("ground_truth"),
    )


def train_mean_baseline(spark, folder):
    spend = predict.train_mean(td.spend_split(_retail(spark, folder), td.SPEND_TRAIN), "spend")
    visits = predict.train_mean(td.purchase_split(_activity(spark, folder), td.PURCHASES_TRAIN), "purchases")
    return spend.unionByName(visits).select("task_name", F.round("train_mean", 4).alias("train_mean"))


def infer_label(spark, folder):
    samples, rows = _priority_facts(spark, folder)
    return predict.inferred_label(rows, td.PRIORITY.priority_tables).select(
        "sample_id", F.coalesce("label", F.lit("")).alias("label")
    )


def _priority_answers(spark, folder):
    tables = _retail(spark, folder)
    split = td.priority_split(tables)
    rows = evidence.facts(split.select("sample_id", "entity_id", "cutoff"), td.PRIORITY, tables)
    labels = predict.inferred_label(rows, td.PRIORITY.priority_tables)
    answer = predict.heuristic_answer(critic.task_purposes(td.PRIORITY, tables))
    return split.join(labels, "sample_id", "left").withColumn("answer", answer)


def heuristic_answer(spark, folder):
    answers = _priority_answers(spark, folder)
    first = F.col("answer.ranked_entities")[0]
    return answers.select(
        "sample_id",
        F.col("answer.summary").alias("summary"),
        F.col("answer.narrative_answer").alias("narrative_answer"),
        first["prediction"].alias("prediction"),
        first["confidence"].alias("confidence"),
        F.array_join(first["reasoning"], "|").alias("reasoning"),
    )


def coerce_prediction(spark, folder):
    """Event rows as model responses: a number, a number as text, a text, an empty object, broken JSON, none."""
    tables = _activity(spark, folder)
    kind, value = F.col("event_type"), F.col("value").cast("string")
    output = (
        F.when(kind == "click", F.concat(F.lit('{"predicted_value": '), value, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"predicted_value": " '), value, F.lit(' "}')))
        .when(kind == "purchase", F.concat(F.lit('{"predicted_value": "about '), value, F.lit('"}')))
        .when(kind == "signup", F.lit("{}"))
        .when(kind == "error", F.when(F.col("user_id") % 2 == 0, F.lit("no answer")))
    )
    rows = tables["events"].select("event_id", output.alias("output"), F.lit(-1.0).alias("train_mean"))
    return predict.coerced_prediction(rows).select("event_id", "predicted_value", "predictor_mode")


def regression_mae(spark, folder):
    both = _spend_predictions(_retail(spark, folder)).unionByName(_purchase_predictions(_activity(spark, folder)))
    scored = predict.mean_absolute_error(both, "task_name")
    return scored.select("task_name", "rows_evaluated", F.round("mae", 4).alias("mae"))


def ground_truth_match(spark, folder):
    return _priority_answers(spark, folder).select("sample_id", "truth", *predict.truth_match(predict.answer_text(), F.col("truth")))


def _spend_audit(tables):
    samples = td.spend_samples(tables).select("sample_id", "entity_id", "cutoff")
    return predict.leakage_audit(evidence.facts(samples, td.SPEND, tables), samples)


def leakage_audit(spark, folder):
    tables = _retail(spark, folder)
    samples = td.priority_samples(tables, ALL_CUTOFFS)
    rows = evidence.facts(samples, td.PRIORITY, tables)
    audit = predict.leakage_audit(rows, samples).drop("violation_texts")
    return audit.withColumn("max_seen_time", F.coalesce("max_seen_time", F.lit("")))


def leakage_violations(spark, folder):
    """The same evidence against cutoffs 400 days earlier for every seventh customer: each leak with its query."""
    tables = _retail(spark, folder)
    samples = td.priority_samples(tables, ALL_CUTOFFS)
    rows = evidence.facts(samples, td.PRIORITY, tables)
    moved = F.when(F.col("entity_id").cast("long") % 7 == 0, F.col("cutoff") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("cutoff"))
    audit = predict.leakage_audit(rows, samples.withColumn("cutoff", moved))
    return audit.select("sample_id", "violations", F.posexplode("violation_texts").alias("position", "violation"))


def prediction_records(spark, folder):
    """The predictions file of the spend task, written as JSON lines and read back; two of three customers have a response."""
    tables = _retail(spark, folder)
    number = F.col("entity_id").cast("long")
    output = F.when(number % 3 == 0, F.concat(F.lit('{"predicted_value": '), "entity_id", F.lit("}"))).when(number % 3 == 1, "no answer")
    responses = _spend_predictions(tables).drop("predicted_value").withColumn("output", output)
    samples = td.spend_samples(tables).select("sample_id", "entity_id", "cutoff")
    facts = evidence.facts(samples, td.SPEND, tables)
    audits = predict.leakage_audit(facts, samples)
    records = predict.prediction_records(predict.coerced_prediction(responses), facts, audits, td.SPEND)
    path = scratch_path(spark, "predictions")
    sinks.append_json(records, path)
    read = spark.read.schema(records.schema).json(path)
    return read.select(
        "sample_id", "question", "predictor_mode", F.round("predicted_value", 4).alias("predicted_value"),
        F.round("absolute_error", 4).alias("absolute_error"), F.round("ground_truth", 2).alias("ground_truth"),
        F.col("task_plan.target.name").alias("plan_target"), F.col("evidence_packet.benchmark_task.entity_col").alias("entity_col"),
        F.round("evidence_packet.benchmark_baseline.train_target_mean", 4).alias("train_target_mean"),
        F.size("evidence_packet.queries_run").alias("queries_run"), F.size("evidence_packet.facts").alias("facts"),
        F.col("leakage_audit.passed").alias("audit_passed"), F.coalesce("leakage_audit.max_seen_time", F.lit("")).alias("max_seen_time"),
        F.coalesce("predictor_output", F.lit("")).alias("output"),
    )


def evaluation_summary(spark, folder):
    tables = _retail(spark, folder)
    summary = predict.evaluation_summary(_spend_predictions(tables), _spend_audit(tables), "spend")
    return summary.withColumn("mae", F.round("mae", 4)).withColumn(
        "train_mean_baseline", F.round("train_mean_baseline", 4)
    )


def customer_spend(spark, folder):
    """The flagship: every customer's evidence up to the cutoff, prediction, truth, error and audit."""
    tables = _retail(spark, folder)
    samples = td.spend_samples(tables).select("sample_id", "entity_id", "cutoff")
    rows = evidence.facts(samples, td.SPEND, tables)
    per_sample = rows.groupBy("sample_id").agg(
        F.count("*").alias("queries"),
        F.sum(F.when(F.col("fact_key") == fixed.FACT_ENTITY, F.col("row_count")).otherwise(0)).alias("entity_rows"),
        F.flatten(F.collect_list("times")).alias("times"),
    )
    cutoff = time_text("cutoff")
    scored = predict.with_error(_spend_predictions(tables)).join(per_sample, "sample_id")
    return scored.select(
        "sample_id", "entity_id", cutoff.alias("cutoff_time"), "queries", "entity_rows",
        F.array_max("times").alias("max_seen_time"),
        (F.size(F.filter("times", lambda t: t > cutoff)) == 0).alias("passed"),
        F.round("predicted_value", 4).alias("predicted_value"),
        F.round("ground_truth", 2).alias("ground_truth"),
        F.round("absolute_error", 4).alias("absolute_error"),
    )


# --- critic and refinement -----------------------------------------------------------------------------------------


def _first_states(spark, folder):
    tables = _activity(spark, folder)
    samples = td.next_event_split(tables)
    index = index_cutoffs(samples)
    return refine.first_states(samples, td.NEXT_EVENT, tables, index).withColumn("report", critic.critic_report())


def available_sections(spark, folder):
    states = _first_states(spark, folder)
    return states.select("sample_id", F.posexplode(critic.available_sections()).alias("position", "section"))


def final_prompt(spark, folder):
    states = _first_states(spark, folder)
    return states.select("sample_id", "prompt")


def critic_judgement(spark, folder):
    report = F.col("report")
    return _first_states(spark, folder).select(
        "sample_id",
        report["prompt_sufficient"].alias("prompt_sufficient"),
        report["planner_responsibility_score"].alias("planner_score"),
        report["predictor_responsibility_score"].alias("predictor_score"),
        _joined("report.wrong_assumptions").alias("wrong_assumptions"),
        _joined("report.comments").alias("comments"),
    )


def missing_evidence(spark, folder):
    requests = F.col("report.additional_evidence_requests")
    return _first_states(spark, folder).select(
        "sample_id", _joined("report.missing_information").alias("missing"), F.posexplode(requests).alias("position", "r")
    ).select(
        "sample_id", "missing", "position",
        F.col("r.evidence_type").alias("evidence_type"), F.col("r.reason").alias("reason"),
        F.col("r.priority").alias("priority"),
    )


def _trajectories(spark, folder):
    tables = _activity(spark, folder)
    states = refine.refine(td.next_event_split(tables), td.NEXT_EVENT, tables)
    return refine.trajectories(states, td.NEXT_EVENT)


def refine_rounds(spark, folder):
    """Every round with what it brought and how the answer was judged then."""
    done = _trajectories(spark, folder)
    told = F.transform(
        "h.additional_evidence",
        lambda e: F.concat_ws("#", e["evidence_type"], e["table_name"], e["row_count"].cast("string"), F.array_join(e["sample_rows"], "|")),
    )
    return done.select("sample_id", F.explode("refinement_history").alias("h")).select(
        "sample_id", F.col("h.round").alias("round"), _joined("h.evidence_types").alias("evidence_types"),
        F.col("h.score").alias("score"), F.col("h.matched").alias("matched"), F.col("h.evaluation.reason").alias("reason"),
        F.array_join(told, "~").alias("evidence"),
    )


def trajectories(spark, folder):
    return _trajectories(spark, folder).select(
        "sample_id", "entity_id", "cutoff_time", "ground_truth", "rounds", "stop_reason",
        F.col("initial_evaluation.reason").alias("initial_reason"),
        F.col("final_evaluation.reason").alias("final_reason"),
        F.col("critic_report.prompt_sufficient").alias("prompt_sufficient"),
        F.size("evidence_packet.additional_evidence").alias("added"),
        _joined("critic_report.missing_information").alias("still_missing"),
    )


# --- training sets -------------------------------------------------------------------------------------------------

SEED = 7
WEIGHTS = {"task_planner": 2.0, "critic": 0.5}


def _episodes(spark, folder):
    return training.episodes_of(_trajectories(spark, folder), SEED, WEIGHTS)


def sample_episodes(spark, folder):
    """As many draws as there are orders, over four tasks of two datasets."""
    retail, activity = _retail(spark, folder), _activity(spark, folder)
    columns = ["dataset_name", "task_name", "sample_id"]
    samples = reduce(
        DataFrame.unionByName,
        [
            td.spend_samples(retail, td.SPEND_TRAIN).select(*columns),
            td.priority_samples(retail).select(*columns),
            td.purchase_samples(activity, td.PURCHASES_TRAIN).select(*columns),
            td.next_event_samples(activity).select(*columns),
        ],
    )
    return training.sample_episodes(samples, retail["orders"].count(), SEED).select(
        "episode_index", "task_name", "row_index", "sample_id"
    )


def sample_roles(spark, folder):
    orders = _retail(spark, folder)["orders"]
    role = training.sampled_role("o_orderkey", SEED, WEIGHTS)
    return orders.select("o_orderkey", role.alias("target_role"))


def examples_planner(spark, folder):
    examples = training.planner_examples(_episodes(spark, folder))
    answer = F.from_json(
        F.col("messages")[2]["content"],
        "needed_information array<string>, assumptions array<string>, critic_guided boolean, prompt_sufficient boolean",
    )
    return examples.select("sample_id", "metadata", F.size("messages").alias("turns"), answer.alias("a")).select(
        "sample_id", "turns", _joined("a.needed_information").alias("needed_information"),
        _joined("a.assumptions").alias("assumptions"), F.col("a.critic_guided").alias("critic_guided"),
        F.col("a.prompt_sufficient").alias("prompt_sufficient"),
        F.col("metadata.ground_truth_score").alias("ground_truth_score"),
    )


def examples_explorer(spark, folder):
    examples = training.explorer_examples(_episodes(spark, folder))
    answer = F.from_json(F.col("messages")[2]["content"], "done boolean, queries array<struct<purpose:string,sql:string>>")
    return examples.select("sample_id", answer.alias("a")).select(
        "sample_id", F.col("a.done").alias("done"), F.posexplode("a.queries").alias("position", "q")
    ).select("sample_id", "done", "position", F.col("q.purpose").alias("purpose"), F.col("q.sql").alias("sql"))


def examples_predictor(spark, folder):
    examples = training.predictor_examples(_episodes(spark, folder))
    answer = F.from_json(F.col("messages")[2]["content"], "ranked_entities array<struct<prediction:string>>")
    return examples.select(
        "sample_id", F.size("messages").alias("turns"), F.col("messages")[1]["content"].alias("final_prompt"),
        F.col("metadata.ground_truth_score").alias("ground_truth_score"),
        answer["ranked_entities"][0]["prediction"].alias("prediction"),
    )


def examples_critic(spark, folder):
    examples = training.critic_examples(_episodes(spark, folder))
    user = F.from_json(F.col("messages")[1]["content"], "final_prompt string, ground_truth string")
    report = F.from_json(
        F.col("messages")[2]["content"], "prompt_sufficient boolean, missing_information array<string>"
    )
    return examples.select("sample_id", user.alias("u"), report.alias("r")).select(
        "sample_id", F.col("u.final_prompt").alias("final_prompt"), F.col("u.ground_truth").alias("ground_truth"),
        F.col("r.prompt_sufficient").alias("prompt_sufficient"), _joined("r.missing_information").alias("still_missing"),
    )


def examples_written(spark, folder):
    """Examples of each role's own episodes, appended as JSON lines and read back."""
    path = scratch_path(spark, "examples")
    for role, examples in training.examples_by_role(_episodes(spark, folder)).items():
        sinks.append_json(examples.withColumn("target_role", F.lit(role)), path, partition_by="target_role")
    read = spark.read.schema("sample_id string, messages array<struct<role:string,content:string>>, target_role string").json(path)
    return read.groupBy("target_role").agg(
        F.count("*").alias("examples"), F.sum(F.size("messages")).alias("turns"),
        F.min("sample_id").alias("first_sample"),
    )


def chat_text(spark, folder):
    return training.chat_text(_activity(spark, folder)["conversations"], "conv_id", "turn", "role", "text")


def run_state(spark, folder):
    state = training.run_state(_episodes(spark, folder))
    return state.select(
        "episodes", F.round("prompt_sufficiency_rate", 6).alias("prompt_sufficiency_rate"),
        F.round("ground_truth_match_rate", 6).alias("ground_truth_match_rate"), "role_counts.*",
    )


def loop_metrics(spark, folder):
    metrics = training.loop_metrics(_episodes(spark, folder))
    rounded = [F.round(c, 4).alias(c) for c in metrics.columns if c not in ("target_role", "target_adapter", "episodes")]
    return metrics.select("target_role", "target_adapter", "episodes", *rounded)


def example_labels(spark, folder):
    return training.example_labels(_episodes(spark, folder))


def preference_pairs(spark, folder):
    """Orders as attempts: the customer and priority are the input, status and price the outcome, part the rounds."""
    orders = _retail(spark, folder)["orders"]
    attempts = orders.select(
        "o_custkey",
        "o_orderpriority",
        F.col("o_orderkey").alias("attempt_id"),
        (F.col("o_orderstatus") == "F").alias("prompt_sufficient"),
        F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("score"),
        (F.col("o_orderkey") % 3).cast("int").alias("rounds"),
    )
    return training.preference_pairs(attempts, ["o_custkey", "o_orderpriority"])


def head_to_head(spark, folder):
    """Orders as attempts of adapters (their priorities) at inputs (customers of a remainder), a year as a run."""
    orders = _retail(spark, folder)["orders"]
    attempts = orders.select(
        (F.col("o_custkey") % 100).alias("input"),
        F.col("o_orderpriority").alias("adapter"),
        F.year("o_orderdate").alias("run"),
        (F.col("o_orderstatus") == "F").alias("prompt_sufficient"),
        F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("score"),
        (F.col("o_orderkey") % 3).cast("int").alias("rounds"),
    )
    found = training.head_to_head(attempts, ["input"])
    return found.withColumns({c: F.round(c, 4) for c in ("left_win_rate", "regression_rate")})


# --- memory and logs -----------------------------------------------------------------------------------------------


def memory_search(spark, folder):
    """Every benchmark text as a question to one source of documents."""
    tables = _activity(spark, folder)
    entries = tables["documents"].select(
        F.col("doc_id").alias("entry_id"), F.col("source").alias("scope"), F.col("lang").alias("memory_type"),
        F.col("text").alias("content"),
    )
    queries = tables["benchmark"].select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"),
        F.col("text").alias("query"),
    )
    found = memory.search_memory(entries, queries, summary_type="fr")
    return found.select("query_id", F.col("place").cast("int").alias("place"), "entry_id", "scope", "memory_type", "score")


def memory_upsert(spark, folder):
    """Documents as memory by source and language; those with a quality label come as the new ones."""
    tables = _activity(spark, folder)
    rows = tables["documents"].select(
        F.col("source").alias("scope"), F.col("lang").alias("memory_type"), F.col("text").alias("content"),
        F.col("doc_id").alias("version"),
    )
    labelled = tables["labels"].select(F.col("doc_id").alias("version"))
    new = rows.join(labelled, "version", "left_semi").select(*rows.columns)
    old = rows.join(labelled, "version", "left_anti").select(*rows.columns)
    return memory.replace_memory(old, new, ["scope", "memory_type"], "version")


def log_page(spark, folder):
    events = _activity(spark, folder)["events"]
    page = memory.log_page(events, "ts", "event_id", limit=50, offset=100)
    return page.select("event_id", time_text("ts").alias("ts"), "user_id", "event_type")


def log_deep_page(spark, folder):
    """A page from the middle of the stored events and the one that follows its last row."""
    tables = _activity(spark, folder)
    log = memory.store_log(tables["events"], "ts", "event_id", scratch_path(spark, "log"), range_rows=2_000)
    offset = sum(rows for _number, rows, _newest, _oldest in log.ranges) // 2
    page = log.page(spark, limit=50, offset=offset)
    last = page.orderBy(F.asc("ts"), F.desc("event_id")).select("ts", "event_id").first()
    parts = [page.withColumn("page", F.lit(1))]
    if last:
        parts.append(log.page_after(spark, last["ts"], last["event_id"], limit=50).withColumn("page", F.lit(2)))
    return reduce(DataFrame.unionByName, parts).select("page", "event_id", time_text("ts").alias("ts"), "user_id", "event_type")


def delete_closure(spark, folder):
    """A region deleted with its nations, their customers and suppliers, their orders, and the line items of both."""
    tables = {n: df for n, df in _retail(spark, folder).items()}
    references = [
        memory.Reference("nation", "n_regionkey", "region"),
        memory.Reference("customer", "c_nationkey", "nation"),
        memory.Reference("supplier", "s_nationkey", "nation"),
        memory.Reference("orders", "o_custkey", "customer"),
        memory.Reference("lineitem", "l_orderkey", "orders"),
        memory.Reference("lineitem", "l_suppkey", "supplier"),
    ]
    keys = {
        "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
        "orders": "o_orderkey",
    }
    deleted = tables["region"].filter(F.col("r_name") == "ASIA").select("r_regionkey")
    left = memory.delete_closure(tables, keys, references, {"region": deleted})
    firsts = {**keys, "lineitem": "l_orderkey", "part": "p_partkey"}
    return memory.union_all(
        [
            df.agg(F.count("*").alias("rows_left"), F.sum(firsts[n]).cast("long").alias("key_sum")).select(
                F.lit(n).alias("table_name"), "rows_left", "key_sum"
            )
            for n, df in left.items()
        ]
    )


def cascade_delete(spark, folder):
    """Orders with status F deleted together with their line items."""
    tables = _retail(spark, folder)
    deleted = tables["orders"].filter(F.col("o_orderstatus") == "F")
    left = memory.cascade_delete(
        {"orders": (tables["orders"], "o_orderkey"), "lineitem": (tables["lineitem"], "l_orderkey")},
        deleted,
        "o_orderkey",
    )
    return memory.union_all(
        [
            left["orders"].agg(F.count("*").alias("rows_left"), F.sum("o_orderkey").alias("key_sum")).select(
                F.lit("orders").alias("table_name"), "rows_left", "key_sum"
            ),
            left["lineitem"].agg(F.count("*").alias("rows_left"), F.sum("l_orderkey").alias("key_sum")).select(
                F.lit("lineitem").alias("table_name"), "rows_left", "key_sum"
            ),
        ]
    )


def query_audit(spark, folder):
    """The priority samples, and every fiftieth customer asked for by name, which is no key, of a task with a table too many."""
    tables = _retail(spark, folder)
    named = td.named_samples(tables)
    samples = td.priority_samples(tables, ALL_CUTOFFS).unionByName(named)
    task = dataclasses.replace(td.PRIORITY, candidate_tables=(*td.PRIORITY.candidate_tables, "returns"))
    rows = evidence.facts(samples, task, tables)
    return memory.query_audit(rows, "analyst", "retail", evidence.skipped_queries(named, task, tables))


def sql_word_audit(spark, folder):
    """The audited statements, each with the write words in it; user turns are audited as statements too."""
    _samples, rows = _priority_facts(spark, folder)
    audited = memory.query_audit(rows, "analyst", "retail").select(
        F.concat_ws("#", "sample_id", F.col("query_ordinal").cast("string")).alias("statement_id"), "sql"
    )
    turns = _activity(spark, folder)["conversations"].select(
        F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("statement_id"),
        F.concat(F.lit("select created_at from loads; drop "), "text").alias("sql"),
    )
    found = memory.forbidden_words(F.col("sql"))
    return audited.unionByName(turns).select(
        "statement_id",
        *[F.array_join(words, "|").alias(name) for name, words in found.items()],
    )


QUERIES = {
    f.__name__: f
    for f in (
        table_inventory, split_reader, materialize_metadata, fingerprint_stale, fingerprint_rows,
        profile_row_counts, profile_nulls_distinct, profile_numeric, profile_temporal, profile_top_values,
        primary_key_guess, infer_relationships, relationship_support, table_sample, database_summary,
        profile_refresh, profile_incremental, profile_files_read, column_profile,
        date_range, evidence_agg_cutoff, evidence_entity_rows, evidence_entity_rows_recent, evidence_entity_static,
        evidence_fallback_sample, result_summary, evidence_packet, match_evidence_table, followup_evidence,
        render_question, masked_split, classify_question, initial_plan, predict_requests,
        predict_requests_all,
        train_mean_baseline, infer_label, heuristic_answer, coerce_prediction, regression_mae, ground_truth_match,
        leakage_audit, leakage_violations, prediction_records, evaluation_summary, customer_spend,
        available_sections, final_prompt, critic_judgement, missing_evidence, refine_rounds, trajectories,
        sample_episodes, sample_roles, examples_planner, examples_explorer, examples_predictor, examples_critic,
        examples_written, chat_text, run_state, loop_metrics, example_labels, preference_pairs, head_to_head,
        memory_search, memory_upsert, log_page, log_deep_page, cascade_delete, delete_closure, query_audit, sql_word_audit,
    )
}
