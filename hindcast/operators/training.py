"""Training examples, episode sampling and metrics over trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import hash_uniform
from hindcast.functions.scale import written


# --- T1 / T2 sampling ----------------------------------------------------------------------------------------------


def numbered_rows(samples: DataFrame, key: str = "task_name", id_column: str = "sample_id") -> DataFrame:
    """Number the rows of each task from 0 in the order of an id hash, without sorting a task in one place.

    Rows are numbered within 4,096 hash buckets; the bucket offsets come from a running sum over bucket sizes.
    """
    hashed = samples.withColumn("_h", F.md5(id_column)).withColumn("_bucket", F.substring("_h", 1, 3))
    offsets = (
        hashed.groupBy(key, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n"))
        .select(key, "_bucket", "_before")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy("_h", id_column)
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [key, "_bucket"])
        .withColumn("row_index", F.col("_before") + F.col("_rn") - 1)
        .drop("_h", "_bucket", "_before", "_rn")
    )


def sample_episodes(samples: DataFrame, episodes: int, seed: int) -> DataFrame:
    """Draw episodes with replacement: a dataset, then one of its tasks, then one of its rows, each uniformly.

    ``samples`` has dataset_name, task_name and sample_id.
    """
    spark = samples.sparkSession
    tasks = samples.groupBy("dataset_name", "task_name").agg(F.count("*").alias("task_rows"))
    sets = Window.orderBy("dataset_name")
    inside = Window.partitionBy("dataset_name").orderBy("task_name")
    # One row per task: as many as are configured.
    tasks = (
        tasks.withColumn("dataset_index", F.dense_rank().over(sets) - 1)
        .withColumn("task_index", F.row_number().over(inside) - 1)
        .withColumn("task_count", F.count("*").over(Window.partitionBy("dataset_name")))
    )
    datasets = tasks.agg(F.max("dataset_index").alias("last_dataset"))
    per_dataset = tasks.select("dataset_index", "task_count").distinct()

    def pick(purpose: str, count: Column) -> Column:
        return F.floor(hash_uniform(f"{seed}:{purpose}", F.col("episode_index")) * count)

    drawn = (
        spark.range(episodes)
        .withColumnRenamed("id", "episode_index")
        .join(F.broadcast(datasets))
        .withColumn("dataset_index", pick("dataset", F.col("last_dataset") + 1).cast("int"))
        .join(F.broadcast(per_dataset), "dataset_index")
        .withColumn("task_index", pick("task", F.col("task_count")).cast("int"))
        .join(F.broadcast(tasks.drop("task_count")), ["dataset_index", "task_index"])
        .withColumn("row_index", pick("row", F.col("task_rows")).cast("long"))
        .select("episode_index", "dataset_name", "task_name", "row_index")
    )
    return drawn.join(numbered_rows(samples.select("task_name", "sample_id")), ["task_name", "row_index"])


def sampled_role(id_column: str, seed: int, weights: dict[str, float] | None = None, roles=tuple(fixed.ROLES)) -> Column:
    """A role per row, drawn with the given weights (1 where none is given)."""
    if not roles:
        raise ValueError("at least one role is needed")
    shares = [(weights or {}).get(r, 1.0) for r in roles]
    total, running = sum(shares), 0.0
    u = hash_uniform(f"{seed}:role", F.col(id_column))
    choice = None
    for role, share in zip(roles[:-1], shares[:-1]):
        running += share
        condition = u < F.lit(running / total)
        choice = F.when(condition, role) if choice is None else choice.when(condition, role)
    return F.lit(roles[-1]) if choice is None else choice.otherwise(roles[-1])


def adapter_of(role: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in fixed.ADAPTERS.items() for x in pair])[role]


def episodes_of(trajectories: DataFrame, seed: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Trajectories with the role and adapter each one trains."""
    return trajectories.withColumn("target_role", sampled_role("sample_id", seed, weights)).withColumn(
        "target_adapter", adapter_of(F.col("target_role"))
    )


# --- T3 - T7 examples ----------------------------------------------------------------------------------------------


def _example(user: Column, assistant: Column, role: str, scored: bool) -> list[Column]:
    turn = lambda name, content: F.struct(F.lit(name).alias("role"), content.alias("content"))
    metadata = [
        F.lit(role).alias("target_role"),
        F.col("target_adapter"),
        F.col("dataset_name").alias("dataset"),
        F.col("task_name").alias("task"),
        F.col("entity_id"),
    ]
    if scored:
        metadata.append(F.col("final_evaluation.score").alias("ground_truth_score"))
    return [
        F.col("sample_id"),
        F.array(
            turn("system", F.lit(fixed.EXAMPLE_SYSTEM)), turn("user", user), turn("assistant", assistant)
        ).alias("messages"),
        F.struct(*metadata).alias("metadata"),
    ]


def improved_plan() -> Column:
    """The initial plan with what the critic missed added and what it found wrong removed."""
    plan, report = F.col("initial_plan"), F.col("critic_report")
    needed = plan["needed_information"]
    fresh = F.filter(F.array_distinct(report["missing_information"]), lambda m: ~F.array_contains(needed, m))
    sound = F.filter(plan["assumptions"], lambda a: ~F.array_contains(report["wrong_assumptions"], a))
    return (
        plan.withField("needed_information", F.concat(needed, fresh))
        .withField("assumptions", sound)
        .withField("critic_guided", F.lit(True))
        .withField("prompt_sufficient", report["prompt_sufficient"])
    )


def planner_examples(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(
        *_example(F.to_json("planner_input"), F.to_json(improved_plan()), "task_planner", scored=True)
    )


def explorer_examples(trajectories: DataFrame) -> DataFrame:
    user = F.struct(
        F.col("initial_plan").alias("task"),
        F.col("planner_input.database_summary").alias("schema_summary"),
        F.col("planner_input.memories").alias("available_tables"),
        F.col("cutoff_time"),
    )
    queries = F.transform(
        "evidence_packet.queries_run", lambda q: F.struct(q["purpose"].alias("purpose"), q["sql"].alias("sql"))
    )
    answer = F.struct(F.lit(False).alias("done"), queries.alias("queries"))
    return trajectories.select(*_example(F.to_json(user), F.to_json(answer), "sql_explorer", scored=False))


def predictor_examples(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(
        *_example(F.col("final_prompt"), F.to_json("final_answer"), "final_predictor", scored=True)
    )


def critic_examples(trajectories: DataFrame) -> DataFrame:
    user = F.to_json(F.struct("final_prompt", "final_answer", "ground_truth"))
    return trajectories.select(*_example(user, F.to_json("critic_report"), "critic", scored=False))


EXAMPLES = {
    "task_planner": planner_examples,
    "sql_explorer": explorer_examples,
    "final_predictor": predictor_examples,
    "critic": critic_examples,
}


def examples_by_role(episodes: DataFrame) -> dict[str, DataFrame]:
    """For every role the examples of the episodes that train it."""
    return {role: build(episodes.filter(F.col("target_role") == role)) for role, build in EXAMPLES.items()}


def chat_text(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: ``ROLE: content`` of all turns in order, joined by blank lines."""
    line = F.concat(F.upper(role), F.lit(": "), F.col(text))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line"))))
    return (
        turns.groupBy(key)
        .agg(F.count("*").alias("turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))
    )


# --- T8 - T11 metrics ----------------------------------------------------------------------------------------------


def run_state(episodes: DataFrame) -> DataFrame:
    """Episodes, sufficiency rate, match rate and the number of episodes per role, in one row."""
    counts = [F.count_if(F.col("target_role") == r).alias(r) for r in fixed.ROLES]
    rate = lambda flag: F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))
    return episodes.agg(
        F.count("*").alias("episodes"),
        rate("critic_report.prompt_sufficient").alias("prompt_sufficiency_rate"),
        rate("final_evaluation.matched").alias("ground_truth_match_rate"),
        *counts,
    ).select(
        "episodes",
        "prompt_sufficiency_rate",
        "ground_truth_match_rate",
        F.struct(*fixed.ROLES).alias("role_counts"),
    )


def loop_metrics(episodes: DataFrame) -> DataFrame:
    """Per adapter: accuracy, sufficiency, rounds, blame, requests answered, queries, prompt words, wins, regressions.

    Prompt length is counted in words.
    """
    before, after = F.col("initial_evaluation.matched"), F.col("final_evaluation.matched")
    requested = F.size("critic_report.missing_information") + F.size("evidence_packet.additional_evidence")
    answered = F.size("evidence_packet.additional_evidence")
    queries = F.size("evidence_packet.queries_run") + answered
    words = F.size(F.filter(F.split("final_prompt", r"\s+"), lambda w: w != ""))
    share = lambda c: F.avg(c.cast("double"))
    per_adapter = episodes.groupBy("target_role", "target_adapter").agg(
        F.count("*").alias("episodes"),
        share(after).alias("accuracy"),
        share(F.col("critic_report.prompt_sufficient")).alias("sufficiency_rate"),
        share(F.col("rounds")).alias("mean_rounds"),
        F.avg("critic_report.planner_responsibility_score").alias("mean_planner_responsibility"),
        F.coalesce(F.sum(answered) / F.nullif(F.sum(requested), F.lit(0)), F.lit(1.0)).alias("request_fulfilment"),
        share(queries).alias("queries_per_task"),
        share(words).alias("mean_prompt_words"),
        share(before).alias("success_before"),
        share(after).alias("success_after"),
        share(after & F.col("critic_report.prompt_sufficient")).alias("win_rate"),
        share(before & ~after).alias("regression_rate"),
    )
    total = F.sum("episodes").over(Window.partitionBy())  # one row per adapter
    return per_adapter.withColumn("role_share", F.col("episodes") / total)


def head_to_head(attempts: DataFrame, keys: list[str], adapter: str = "adapter", run: str = "run") -> DataFrame:
    """Per pair of adapters, how their attempts at the same inputs compare, and what a later run of one lost or gained.

    ``attempts``: keys, adapter, run, prompt_sufficient, score, rounds. Better is: sufficient, then higher score, then
    fewer rounds. Each input counts once for a pair of adapters, by the best attempt of each in their last runs; an
    adapter against itself is its last run against the run before, input by input. Attempts become one row per (input, adapter,
    run) in the task that reads them, so an input that everybody tried meets as often as there are adapters.
    """
    rank = F.struct(F.col("prompt_sufficient").cast("int").alias("sufficient"), F.col("score"), (-F.col("rounds")).alias("few_rounds"))
    best = attempts.groupBy(*keys, adapter, run).agg(F.max(rank).alias("rank"))
    best = written(best, "attempts")
    latest = Window.partitionBy(*keys, adapter).orderBy(F.desc(run))
    turn = best.withColumn("_turn", F.row_number().over(latest)).filter("_turn <= 2").drop(run)
    last, before = turn.filter("_turn = 1").drop("_turn"), turn.filter("_turn = 2").drop("_turn")
    named = lambda df, side: df.select(*keys, F.col(adapter).alias(side), F.col("rank").alias(f"{side}_rank"))
    others = named(last, "left_adapter").join(named(last, "right_adapter"), keys).filter("left_adapter < right_adapter")
    own = named(last, "left_adapter").join(named(before, "right_adapter"), keys).filter("left_adapter = right_adapter")
    both = others.unionByName(own)
    count = lambda test: F.count_if(F.expr(test))
    return (
        both.groupBy("left_adapter", "right_adapter")
        .agg(
            F.count(F.lit(1)).alias("inputs"),
            count("left_adapter_rank > right_adapter_rank").alias("left_wins"),
            count("left_adapter_rank < right_adapter_rank").alias("right_wins"),
            count("left_adapter_rank = right_adapter_rank").alias("draws"),
            count("right_adapter_rank.sufficient = 1 AND left_adapter_rank.sufficient = 0").alias("sufficiency_lost"),
        )
        .withColumn("left_win_rate", F.col("left_wins") / F.col("inputs"))
        .withColumn("regression_rate", F.when(F.col("left_adapter") == F.col("right_adapter"), F.col("right_wins") / F.col("inputs")))
    )


def example_labels(episodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Positive: sufficient, and scored or settled by refinement. Weak: insufficient, or the target role is to blame."""
    report = F.col("critic_report")
    blame = F.when(
        F.col("target_role").isin("task_planner", "sql_explorer"), report["planner_responsibility_score"]
    ).otherwise(report["predictor_responsibility_score"])
    sufficient = report["prompt_sufficient"]
    strong = (F.col("final_evaluation.score") >= threshold) | (F.col("rounds") > 0)
    label = (
        F.when(sufficient & strong, "positive").when(~sufficient | (blame > threshold), "weak").otherwise("neutral")
    )
    return episodes.select("sample_id", "target_role", blame.alias("responsibility"), label.alias("example_label"))


def preference_pairs(attempts: DataFrame, keys: list[str], attempt_id: str = "attempt_id") -> DataFrame:
    """For the same input, the best attempt against each of the others that is worse.

    Better is: sufficient, then higher score, then fewer rounds. The best attempt is an aggregate (one row per input
    leaves each task) and each other attempt meets only that one, so a popular input is never paired with itself.
    """
    rank = F.struct(
        F.col("prompt_sufficient").cast("int").alias("sufficient"),
        F.col("score"),
        (-F.col("rounds")).alias("few_rounds"),
    )
    ranked = attempts.select(*keys, attempt_id, rank.alias("rank"))
    best = ranked.groupBy(*keys).agg(F.max(F.struct("rank", attempt_id)).alias("best"))
    return (
        ranked.join(best, keys)
        .filter(F.col("rank") < F.col("best.rank"))
        .select(*keys, F.col(f"best.{attempt_id}").alias("chosen"), F.col(attempt_id).alias("rejected"))
    )
