"""Prompts built from evidence, and the judgement whether they were sufficient.

A sample's state is one row with its question, plan, queries (array of struct) and additional evidence (array of
struct); context (schema summary, tables, relationships) is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import filled
from hindcast.operators.evidence import evidence_queries, initial_plan, question_text
from hindcast.operators.predict import answer_text, first_label
from hindcast.operators.profile import first_keys, relationships, schema_summary
from hindcast.sources.tables import column_inventory
from hindcast.tasks import Task, relevant_tables

QUERY_TYPE = (
    "array<struct<query_ordinal:int,table_name:string,fact_key:string,purpose:string,sql:string,"
    "row_count:bigint,sample_rows:array<string>>>"
)
ADDITION_TYPE = (
    "array<struct<evidence_type:string,reason:string,table_name:string,row_count:bigint,sample_rows:array<string>>>"
)


def task_context(spark: SparkSession, task: Task, tables: dict[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """One row: schema summary, relevant tables without values, relationships. ``keys`` may be a stored profile's."""
    schemas = {n: tables[n].schema for n in sorted(tables) if n in task.tables}
    inventory = column_inventory(spark, schemas)
    roles = relevant_tables(task, schemas)
    shown = [r.table for r in roles]
    if keys is None:
        keys = first_keys({n: tables[n] for n in shown})
    columns = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "kind")))
    described = (
        inventory.filter(F.col("table_name").isin(shown))
        .groupBy("table_name")
        .agg(F.transform(columns, lambda c: c.dropFields("ordinal")).alias("columns"))
        .join(keys.select("table_name", "primary_key_guess"), "table_name", "left")
        .agg(F.array_sort(F.collect_list(F.struct("table_name", "primary_key_guess", "columns"))).alias("relevant_tables"))
    )
    related = relationships(inventory, task.id_rule).agg(
        F.array_sort(
            F.collect_list(F.struct("from_table", "from_column", "to_table", "to_column", "confidence", "evidence_rule"))
        ).alias("relationships")
    )
    named = lambda df: df.withColumn("dataset_name", F.lit(task.dataset))
    summary = named(schema_summary(inventory)).withColumnRenamed("summary", "database_summary")
    return summary.join(F.broadcast(named(described)), "dataset_name").join(
        F.broadcast(named(related)), "dataset_name"
    )


def sample_states(samples: DataFrame, fact_rows: DataFrame, task: Task, context: DataFrame) -> DataFrame:
    """Samples (sample_id, entity_id, cutoff, truth) with question, plan, queries and context; nothing added yet."""
    query = F.struct("query_ordinal", "table_name", "fact_key", "purpose", "sql", "row_count", "sample_rows")
    gathered = fact_rows.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(query)).cast(QUERY_TYPE).alias("queries"),
        first_label(task.priority_tables).alias("label"),
    )
    row_columns = [c for c in samples.columns if c not in ("sample_id", "entity_id", "cutoff", "truth")]
    return (
        samples.withColumns(
            {
                "question": question_text(task.question_template, row_columns, task),
                "dataset_name": F.lit(task.dataset),
                "plan": initial_plan(task),
                "additional": F.array().cast(ADDITION_TYPE),
            }
        )
        .join(gathered, "sample_id")
        .join(F.broadcast(context), "dataset_name")
    )


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _rows(q: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(q["sample_rows"], ","), F.lit("]"))


def _summary(q: Column) -> Column:
    return F.concat(
        F.lit('{"row_count":'), q["row_count"].cast("string"), F.lit(',"sample_rows":'), _rows(q), F.lit("}")
    )


def _fact(q: Column) -> Column:
    return F.concat(F.lit('"'), q["table_name"], F.lit("_"), q["fact_key"], F.lit('":'), _summary(q))


def _query(q: Column) -> Column:
    head = F.to_json(F.struct(q["purpose"].alias("purpose"), q["sql"].alias("sql")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"result_summary":'), _summary(q), F.lit("}"))


def _addition(a: Column) -> Column:
    return F.concat(
        _json_text(a["evidence_type"]),
        F.lit(':{"requested_by_critic":true,"reason":'),
        _json_text(a["reason"]),
        F.lit(',"rows":'),
        _rows(a),
        F.lit(',"row_count":'),
        a["row_count"].cast("string"),
        F.lit("}"),
    )


def _filled_array(column: str, text: Column) -> Column:
    return F.when(F.size(column) > 0, text)


def packet_texts() -> dict[str, Column]:
    """JSON text of every packet field; null where the field is empty."""
    null = F.lit(None).cast("string")
    return {
        "user_question": F.when(F.col("question") != "", _json_text(F.col("question"))),
        "database_id": _json_text(F.col("dataset_name")),
        "database_summary": F.when(F.col("database_summary") != "", _json_text(F.col("database_summary"))),
        "task": F.to_json("plan"),
        "relevant_tables": _filled_array("relevant_tables", F.to_json("relevant_tables")),
        "relationships": _filled_array("relationships", F.to_json("relationships")),
        "facts": _filled_array("queries", _object(F.transform("queries", _fact))),
        "candidate_entities": null,
        "limitations": null,
        "queries_run": _filled_array(
            "queries", F.concat(F.lit("["), F.array_join(F.transform("queries", _query), ","), F.lit("]"))
        ),
        "additional_evidence": null,  # see final_prompt
    }


ADDED_LABEL = "CRITIC-REQUESTED EVIDENCE"


def prompt_parts() -> dict[str, Column]:
    """The sections before and after the requested evidence, which refinement leaves as they are."""
    texts = packet_texts()
    shown = [
        F.when(texts[field].isNotNull(), F.concat(F.lit(f"{label}:\n"), texts[field]))
        for label, field in fixed.PROMPT_SECTIONS
    ]
    at = [label for label, _field in fixed.PROMPT_SECTIONS].index(ADDED_LABEL)
    return {
        "prompt_head": F.concat_ws("\n\n", *shown[:at]),
        "prompt_tail": F.concat_ws("\n\n", *shown[at + 1 :]),
    }


def final_prompt() -> Column:
    """Header and labelled sections in their fixed order; empty sections are left out."""
    added = F.concat(F.lit(f"{ADDED_LABEL}:\n"), _object(F.transform("additional", _addition)))
    sections = F.concat_ws(
        "\n\n",
        F.nullif("prompt_head", F.lit("")),
        _filled_array("additional", added),
        F.nullif("prompt_tail", F.lit("")),
    )
    return F.concat(F.lit(fixed.PROMPT_HEADER), sections)


def available_sections() -> Column:
    """Names of everything a packet holds: filled fields, fact keys, purposes, additional evidence."""
    sizes = {
        "user_question": F.col("question") != "",
        "database_id": F.lit(True),
        "database_summary": F.col("database_summary") != "",
        "task": F.lit(True),
        "relevant_tables": F.size("relevant_tables") > 0,
        "relationships": F.size("relationships") > 0,
        "facts": F.size("queries") > 0,
        "candidate_entities": F.lit(False),
        "limitations": F.lit(False),
        "queries_run": F.size("queries") > 0,
        "additional_evidence": F.size("additional") > 0,
    }
    named = F.array(*[F.when(sizes[f], F.lit(f)) for f in [*fixed.PACKET_FIELDS, "additional_evidence"]])
    return F.concat(
        F.array_compact(named),
        F.transform("queries", lambda q: F.concat_ws("_", q["table_name"], q["fact_key"])),
        F.filter(F.transform("queries", lambda q: q["purpose"]), lambda p: p.isNotNull() & (p != "")),
        F.transform("additional", lambda a: a["evidence_type"]),
    )


def missing_information(expected: Column, sections: Column) -> Column:
    """Expected items that are not, word for word, among the lower-cased section names; order and repeats kept."""
    lowered = F.transform(sections, F.lower)
    return F.filter(expected, lambda item: ~F.array_contains(lowered, item))


def evidence_requests(missing: Column) -> Column:
    """Requests for the first missing items; the first one is urgent."""
    return F.transform(
        F.slice(missing, 1, fixed.MAX_REQUESTS),
        lambda item, i: F.struct(
            item.alias("evidence_type"),
            filled(fixed.CRITIC_REASON, item=item).alias("reason"),
            F.when(i == 0, "high").otherwise("medium").alias("priority"),
            F.array().cast("array<string>").alias("likely_tables"),
        ),
    )


def truth_found(text: Column, truth: Column) -> Column:
    """Whether a text holds the truth, ignoring case; an empty truth is in no text."""
    wanted = F.lower(truth.cast("string"))
    return F.coalesce((wanted != "") & F.contains(F.lower(text), wanted), F.lit(False))


def judged(states: DataFrame, expected: list[str] | tuple[str, ...]) -> DataFrame:
    """Add what the critic's report follows from: truth in prompt, truth in answer, missing information."""
    items = F.array(*[F.lit(e) for e in expected]).cast("array<string>")
    return states.withColumns(
        {
            "in_prompt": truth_found(F.col("prompt"), F.col("truth")),
            "in_answer": truth_found(answer_text(), F.col("truth")),
            "missing": missing_information(items, available_sections()),
        }
    )


def critic_report() -> Column:
    """The critic's report on a judged state: sufficiency, how planner and predictor share the blame, requests."""
    sufficient = F.col("in_prompt") | F.col("in_answer")
    planner = (
        F.when(F.col("in_answer"), fixed.SCORE_TRUTH_IN_ANSWER)
        .when(F.col("in_prompt"), fixed.SCORE_TRUTH_IN_PROMPT)
        .otherwise(fixed.SCORE_TRUTH_ABSENT)
    )
    nothing = F.array().cast("array<string>")
    return F.struct(
        sufficient.alias("prompt_sufficient"),
        planner.alias("planner_responsibility_score"),
        F.round(F.lit(1.0) - planner, 10).alias("predictor_responsibility_score"),
        F.lit(fixed.CRITIC_CONFIDENCE).alias("confidence_in_critique"),
        F.col("missing").alias("missing_information"),
        nothing.alias("irrelevant_information"),
        F.when(sufficient, nothing).otherwise(F.array(F.lit(fixed.CRITIC_ASSUMPTION))).alias("wrong_assumptions"),
        evidence_requests(F.col("missing")).alias("additional_evidence_requests"),
        F.array(F.when(sufficient, fixed.CRITIC_SUFFICIENT).otherwise(fixed.CRITIC_INSUFFICIENT)).alias("comments"),
    )


def task_purposes(task: Task, tables: dict[str, DataFrame]) -> list[str]:
    roles = relevant_tables(task, {n: df.schema for n, df in tables.items()})
    return [purpose for role in roles for _fact_key, purpose in evidence_queries(role)]
