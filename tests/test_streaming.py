import json

from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.operators import training
from hindcast.streaming.examples import export_examples


def test_examples_follow_the_log(spark, tmp_path):
    episodes = spark.range(40).selectExpr(
        "concat('s', id) AS sample_id",
        "named_struct('question', 'Q', 'database_summary', 'S', 'memories', array('m')) AS planner_input",
        "named_struct('needed_information', array('seen'), 'assumptions', array('right')) AS initial_plan",
        "named_struct('prompt_sufficient', false, 'missing_information', array('payment'), 'wrong_assumptions', array('w')) "
        "AS critic_report",
        "'demo' AS dataset_name",
        "'task' AS task_name",
        "cast(id AS string) AS entity_id",
        "named_struct('score', 1.0D) AS final_evaluation",
        "'2024-01-01' AS cutoff_time",
        "'prompt' AS final_prompt",
        "named_struct('summary', 'ok') AS final_answer",
        "'paid' AS ground_truth",
        "named_struct('queries_run', array(named_struct('purpose', 'p', 'sql', 'SELECT 1'))) AS evidence_packet",
    )
    episodes = training.episodes_of(episodes, seed=1)
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    roles = {r["target_role"]: r["count"] for r in episodes.groupBy("target_role").count().collect()}
    assert set(roles) == set(fixed.ROLES)

    def run():
        query = export_examples(spark, log, episodes.schema, out, checkpoint, available_now=True)
        query.awaitTermination(120)
        written = spark.read.text(out)
        return {r["target_role"]: r["count"] for r in written.groupBy("target_role").count().collect()}

    episodes.write.json(log)
    assert run() == roles
    assert run() == roles  # nothing new, nothing repeated
    episodes.write.mode("append").json(log)
    assert run() == {r: 2 * n for r, n in roles.items()}
    line = json.loads(spark.read.text(out).filter(F.col("target_role") == "task_planner").first()["value"])
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
