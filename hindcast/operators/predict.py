"""Baselines, rule-based answers, scoring and the leakage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import filled, literal, time_text
from hindcast.operators.evidence import initial_plan, packets, question_text
from hindcast.tasks import Task


def train_mean(train: DataFrame, target_column: str, by: str = "task_name") -> DataFrame:
    """Mean target of the training rows of each task."""
    return train.groupBy(by).agg(F.avg(target_column).alias("train_mean"))


def first_label(priority_tables: tuple[str, ...]) -> Column:
    """Aggregate over a sample's facts: its first non-null label, priority queries first, then in query order."""
    named = " OR ".join(f"contains(lower(purpose), {literal(t)})" for t in priority_tables) or "false"
    place = f"struct(CASE WHEN {named} THEN 0 ELSE 1 END AS place, query_ordinal, label)"
    return F.expr(f"min({place}) FILTER (WHERE label IS NOT NULL).label")


def inferred_label(fact_rows: DataFrame, priority_tables: tuple[str, ...]) -> DataFrame:
    return fact_rows.groupBy("sample_id").agg(first_label(priority_tables).alias("label"))


def heuristic_answer(purposes: list[str]) -> Column:
    """Answer to a sample (entity_id, cutoff, label) from its label and the first three purposes."""
    support = F.array(*[F.lit(p) for p in purposes[:3]]).cast("array<string>")
    outcome = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit(fixed.ANSWER_UNCERTAIN))
    cutoff = time_text("cutoff")
    named = {"entity": F.col("entity_id"), "cutoff": cutoff}
    entity = F.struct(
        F.col("entity_id"),
        F.lit(1).alias("rank"),
        outcome.alias("prediction"),
        F.lit("medium" if purposes else "low").alias("confidence"),
        support.alias("reasoning"),
        F.struct(cutoff.alias("cutoff_time")).alias("supporting_facts"),
    )
    return F.struct(
        F.lit(fixed.ANSWER_TYPE).alias("answer_type"),
        filled(fixed.ANSWER_SUMMARY, **named).alias("summary"),
        F.array(entity).alias("ranked_entities"),
        filled(fixed.ANSWER_NARRATIVE, outcome=outcome, **named).alias("narrative_answer"),
        F.array().cast("array<string>").alias("limitations"),
    )


def answer_text(answer: str = "answer") -> Column:
    """The searchable text of an answer: summary, narrative and the ranked entities."""
    return F.concat_ws(
        " ", F.col(f"{answer}.summary"), F.col(f"{answer}.narrative_answer"), F.to_json(f"{answer}.ranked_entities")
    )


def coerced_prediction(responses: DataFrame, output: str = "output", baseline: str = "train_mean") -> DataFrame:
    """Numeric value of each response, its mode, and the baseline where there is no usable number.

    A null response means no model was asked; a response that is not JSON means the call failed.
    """
    text = F.trim(F.get_json_object(output, "$.predicted_value"))
    number = text.try_cast("double")
    readable = F.try_parse_json(output).isNotNull()
    mode = (
        F.when(number.isNotNull(), fixed.MODE_MODEL)
        .when(F.col(output).isNotNull() & ~readable, fixed.MODE_FALLBACK)
        .otherwise(fixed.MODE_BASELINE)
    )
    return responses.withColumn("predicted_value", F.coalesce(number, F.col(baseline))).withColumn(
        "predictor_mode", mode
    )


def with_error(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("absolute_error", F.abs(F.col("predicted_value") - F.col("ground_truth")))


def mean_absolute_error(predictions: DataFrame, *by: str) -> DataFrame:
    """Rows and mean absolute error, over all rows or per group; no rows at all give 0."""
    return with_error(predictions).groupBy(*by).agg(
        F.count("*").alias("rows_evaluated"),
        F.coalesce(F.avg("absolute_error"), F.lit(0.0)).alias("mae"),
    )


def truth_match(answer: Column, truth: Column) -> list[Column]:
    """score, matched and reason of an answer text against the truth text, ignoring case."""
    wanted = F.lower(F.trim(truth.cast("string")))
    blank = F.coalesce(wanted, F.lit("")) == ""
    matched = ~blank & F.contains(F.lower(answer), wanted)
    return [
        F.when(matched, 1.0).otherwise(0.0).alias("score"),
        matched.alias("matched"),
        F.when(blank, fixed.REASON_EMPTY).when(matched, fixed.REASON_MATCH).otherwise(fixed.REASON_MISS).alias("reason"),
    ]


def leakage_audit(fact_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample: the latest time among the kept rows, what lies past the cutoff and in which query, and the verdict.

    ``samples`` holds the cutoffs to audit against, as a rule those ``fact_rows`` were gathered for. Times compare as
    texts, see ``time_text``. ``violation_texts`` are in the order of the queries, their rows and columns.
    """
    cutoff = time_text("cutoff")
    asked = samples.select("sample_id", cutoff.alias("cutoff_time")).distinct()
    past = F.filter("times", lambda t: t > F.col("cutoff_time"))
    seen = fact_rows.select("sample_id", "query_ordinal", "purpose", "times").join(asked, "sample_id")
    told = F.transform(past, lambda t: filled(fixed.VIOLATION, purpose=F.col("purpose"), value=t, cutoff=F.col("cutoff_time")))
    per_query = seen.select("sample_id", "cutoff_time", "query_ordinal", F.array_max("times").alias("latest"), told.alias("told"))
    audited = per_query.groupBy("sample_id", "cutoff_time").agg(
        F.max("latest").alias("max_seen_time"),
        F.array_sort(F.collect_list(F.when(F.size("told") > 0, F.struct("query_ordinal", "told")))).alias("found"),
    )
    texts = F.flatten(F.transform("found", lambda q: q["told"]))
    return audited.select(
        "sample_id",
        "cutoff_time",
        "max_seen_time",
        F.size(texts).cast("long").alias("violations"),
        texts.alias("violation_texts"),
        (F.size("found") == 0).alias("passed"),
    )


def prediction_records(predictions: DataFrame, fact_rows: DataFrame, audits: DataFrame, task: Task) -> DataFrame:
    """One record per sample, as a line of the predictions file: question, plan, packet, audit, mode, value and error.

    ``predictions``: sample_id, dataset_name, task_name, entity_id, cutoff, train_mean, ground_truth, and from
    ``coerced_prediction`` predicted_value, predictor_mode and output. The packet names the benchmark task and its baseline.
    """
    asked = with_error(predictions).select(
        "sample_id", "dataset_name", "task_name", "entity_id", time_text("cutoff").alias("cutoff_time"),
        question_text(task.question_template, [], task).alias("question"), "ground_truth", "predicted_value", "absolute_error",
        "predictor_mode", F.col("output").alias("predictor_output"), initial_plan(task).alias("task_plan"), "train_mean",
    )
    audit = audits.select(
        "sample_id",
        F.struct("passed", "cutoff_time", "max_seen_time", F.col("violation_texts").alias("violations")).alias("leakage_audit"),
    )
    benchmark = F.struct(
        "dataset_name", "task_name", F.lit(task.target_column).alias("target_col"), F.lit(task.task_type).alias("task_type"),
        F.lit(task.lookup_column).alias("entity_col"), "cutoff_time",
    )
    packet = F.struct(
        "queries_run", "facts", "candidate_entities", "limitations", benchmark.alias("benchmark_task"),
        F.struct(F.col("train_mean").alias("train_target_mean")).alias("benchmark_baseline"),
    )
    joined = asked.join(packets(fact_rows), "sample_id").join(audit, "sample_id")
    kept = [c for c in asked.columns if c != "train_mean"]
    return joined.select(*kept, packet.alias("evidence_packet"), "leakage_audit")


def evaluation_summary(predictions: DataFrame, audits: DataFrame, target_column: str) -> DataFrame:
    """One row per task: rows, target, baseline, mean absolute error and failed audits."""
    return (
        with_error(predictions)
        .join(audits.select("sample_id", "passed"), "sample_id")
        .groupBy("dataset_name", "task_name")
        .agg(
            F.count("*").alias("rows_evaluated"),
            F.max("train_mean").alias("train_mean_baseline"),
            F.coalesce(F.avg("absolute_error"), F.lit(0.0)).alias("mae"),
            F.sum((~F.col("passed")).cast("long")).alias("leakage_failures"),
        )
        .withColumn("target_col", F.lit(target_column))
    )
