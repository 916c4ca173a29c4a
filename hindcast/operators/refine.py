"""Bounded refinement of all samples at once, and the trajectories it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import literal, time_text
from hindcast.functions.scale import cut_lineage
from hindcast.operators.critic import (
    ADDITION_TYPE,
    critic_report,
    final_prompt,
    judged,
    prompt_parts,
    sample_states,
    task_context,
    task_purposes,
)
from hindcast.operators.cutoffs import CutoffIndex, index_cutoffs
from hindcast.operators.evidence import facts, first_facts, matched_tables
from hindcast.operators.predict import answer_text, heuristic_answer, truth_match
from hindcast.tasks import Task

# A sample that is not settled and still asks for something.
OPEN = "(NOT (in_prompt OR in_answer) AND size(missing) > 0)"

HISTORY_TYPE = (
    f"array<struct<round:int,evidence_types:array<string>,score:double,matched:boolean,additional_evidence:{ADDITION_TYPE},"
    "evaluation:struct<score:double,matched:boolean,reason:string>>>"
)


def first_states(
    samples: DataFrame, task: Task, tables: dict[str, DataFrame], index: CutoffIndex, context: DataFrame | None = None
) -> DataFrame:
    """Samples with evidence, prompt, answer, evaluation and report before any refinement."""
    fact_rows = facts(samples.select("sample_id", "entity_id", "cutoff"), task, tables, index)
    context = task_context(samples.sparkSession, task, tables) if context is None else context
    states = (
        sample_states(samples, fact_rows, task, context)
        .withColumns({**prompt_parts(), "answer": heuristic_answer(task_purposes(task, tables))})
        .withColumns(
            {
                "prompt": final_prompt(),
                "evaluation": F.struct(*truth_match(answer_text(), F.col("truth"))),
                "history": F.array().cast(HISTORY_TYPE),
            }
        )
    )
    return judged(states, task.expected_evidence)


def refine(
    samples: DataFrame,
    task: Task,
    tables: dict[str, DataFrame],
    rounds: int = fixed.REFINEMENT_ROUNDS,
    index: CutoffIndex | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Run up to ``rounds`` rounds over the samples that are still insufficient and still ask for something.

    What a request brings depends on the sample and the table it matches, not on the round. So the evidence that any
    round could ask for is fetched once, for the samples that are open after the first judgement; each round is then
    a projection: add what was asked for, make the prompt and the judgement anew. The label comes from the first
    evidence, so the answer and its evaluation stay. The first states are written to the checkpoint folder because both the
    fetch and the rounds start from them. A round is empty for a sample that is settled or has nothing left to ask for.
    """
    index = index or index_cutoffs(samples)
    state = cut_lineage(first_states(samples, task, tables, index, context))
    expected = list(dict.fromkeys(task.expected_evidence))
    matches = matched_tables(samples.sparkSession, task, tables, expected)
    open_samples = state.filter(OPEN).select("sample_id", "entity_id", "cutoff")
    fetched = first_facts(open_samples, task, tables, sorted(set(matches.values())), index)
    per_sample = fetched.groupBy("sample_id").agg(
        F.expr("map_from_entries(collect_list(struct(table_name, struct(row_count, sample_rows))))").alias("fetched")
    )
    state = state.join(per_sample, "sample_id", "left")
    pairs = ", ".join(f"{literal(item)}, {literal(table)}" for item, table in matches.items())
    asked = f"array_distinct(slice(missing, 1, {fixed.MAX_REQUESTS}))"  # evidence is kept once per type
    answer = f"""transform(transform({asked}, m -> named_struct('type', m, 'table', map({pairs})[m])),
        x -> named_struct('evidence_type', x.type, 'reason', {_reason("x.type")}, 'table_name', x.table,
            'row_count', fetched[x.table].row_count, 'sample_rows', fetched[x.table].sample_rows))"""
    added = F.expr(f"CASE WHEN {OPEN} AND fetched IS NOT NULL THEN {answer} END").cast(ADDITION_TYPE)
    kept = "filter(additional, a -> NOT array_contains(added.evidence_type, a.evidence_type))"
    state = state.withColumn("initial_prompt", F.col("prompt"))
    for number in range(1, rounds + 1):
        entry = (
            f"named_struct('round', {number}, 'evidence_types', added.evidence_type, "
            "'score', evaluation.score, 'matched', evaluation.matched, 'additional_evidence', added, 'evaluation', evaluation)"
        )
        state = (
            state.withColumn("added", added)
            .withColumns(
                {
                    "additional": F.expr(f"CASE WHEN added IS NULL THEN additional ELSE concat({kept}, added) END"),
                    "history": F.expr(f"CASE WHEN added IS NULL THEN history ELSE array_append(history, {entry}) END"),
                }
            )
            .withColumn("prompt", final_prompt())
        )
        state = judged(state, task.expected_evidence)
    return state.drop("added", "fetched")


def _reason(item: str) -> str:
    """SQL for the reason of a request."""
    before, after = fixed.CRITIC_REASON.split("{item}")
    return f"concat({literal(before)}, {item}, {literal(after)})"


def trajectories(states: DataFrame, task: Task, rounds: int = fixed.REFINEMENT_ROUNDS) -> DataFrame:
    """The record of every sample: inputs, plan, first and last state, history and why it stopped."""
    done = F.size("history")
    stop = (
        F.when(F.col("in_prompt") | F.col("in_answer"), "sufficient")
        .when(F.size("missing") == 0, "nothing_to_request")
        .when(done >= rounds, "max_rounds")
        .otherwise("no_new_evidence")
    )
    return states.select(
        "sample_id",
        "dataset_name",
        F.lit(task.name).alias("task_name"),
        "entity_id",
        time_text("cutoff").alias("cutoff_time"),
        F.col("truth").alias("ground_truth"),
        F.struct(
            F.col("question"),
            F.col("database_summary"),
            F.col("relevant_tables").alias("memories"),
            time_text("cutoff").alias("cutoff_time"),
            F.col("entity_id"),
            F.lit(task.name).alias("task_name"),
        ).alias("planner_input"),
        F.col("plan").alias("initial_plan"),
        F.col("evaluation").alias("initial_evaluation"),
        critic_report().alias("critic_report"),
        F.col("evaluation").alias("final_evaluation"),
        "initial_prompt",
        F.col("prompt").alias("final_prompt"),
        F.col("answer").alias("initial_answer"),
        F.col("answer").alias("final_answer"),
        F.struct(F.col("queries").alias("queries_run"), F.col("additional").alias("additional_evidence")).alias(
            "evidence_packet"
        ),
        F.col("history").alias("refinement_history"),
        done.alias("rounds"),
        stop.alias("stop_reason"),
    )
