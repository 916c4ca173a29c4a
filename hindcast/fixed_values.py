"""Values that results depend on, stated once."""

# Limits of the evidence and answer rules.
PROFILE_SAMPLE_ROWS = 5
INSPECT_SAMPLE_ROWS = 20
INSPECT_TABLES = 3
INSPECT_QUERIES = 10
PREDICT_ROW_CAP = 1000
EVIDENCE_ROW_CAP = 50
FOLLOWUP_ROW_CAP = 20
ENTITY_ROWS = 10
KEPT_ROWS = 5
TOP_VALUES = 5
MAX_EVIDENCE_TABLES = 5
FALLBACK_TABLES = 3
MAX_REQUESTS = 3
MAX_SUMMARY_RELATIONSHIPS = 10
MEMORY_RESULTS = 10
REFINEMENT_ROUNDS = 2

# Relationship rule.
RELATIONSHIP_CONFIDENCE = 0.6
RELATIONSHIP_RULE = "shared_id_name"

# Words refused in a read-only statement.
FORBIDDEN_WORDS = [
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "CREATE",
    "TRUNCATE",
    "COPY",
    "EXPORT",
    "ATTACH",
    "INSTALL",
    "LOAD",
    "PRAGMA",
    "CALL",
]

# Purposes and fact keys of the evidence queries.
PURPOSE_AGGREGATE = "Aggregate {table} up to cutoff time"
PURPOSE_ENTITY = "Fetch entity-specific evidence from {table}"
PURPOSE_SAMPLE = "Inspect stable sample from {table}"
FACT_AGGREGATE = "aggregate_before_cutoff"
FACT_ENTITY = "entity_rows"
FACT_SAMPLE = "sample_rows"
ERROR_ENTITY = "Entity id {entity} is not a {kind} as {column} is"
ERROR_TABLE = "The database has no table {table}"
VIOLATION = "{purpose}: saw value {value} past cutoff {cutoff}"
PURPOSE_INSPECT = "Inspect recent sample from {table}"
PURPOSE_RANGE = "Check date range in {table}"

# Question template used when a task has none.
DEFAULT_QUESTION = (
    "Using only information available on or before {cutoff_time}, predict {target_col} for {entity_col}={entity_id}."
)

# Plan texts.
PLAN_INTENT = "predictive_query"
PLAN_TYPE = "benchmark_supervised_prediction"
PLAN_ASSUMPTION = "Do not use rows newer than the entity cutoff_time."
PLAN_CUTOFF_ASSUMPTION = "Cutoff time for this benchmark entity is {cutoff}."
PLAN_LEAKAGE_NOTE = "Do not use rows newer than cutoff_time {cutoff}."
PLAN_TARGET = "Predict {target} without using data after cutoff."
PLAN_HORIZON = "as defined by benchmark task"

# Answer texts.
ANSWER_TYPE = "heuristic_prediction"
ANSWER_UNCERTAIN = "uncertain"
ANSWER_SUMMARY = "Prediction for entity {entity} at cutoff {cutoff}."
ANSWER_NARRATIVE = (
    "The available evidence up to cutoff time {cutoff} was used to form a "
    "prediction for entity {entity}. Predicted outcome: {outcome}."
)

# Question classes.
RISK_WORDS = ["likely", "risk"]
QUESTION_NEEDS = ["activity recency", "payments", "support signals"]

# Answer to a free question.
REQUEST_SUMMARY = "The prediction follows by rule from the profiled tables."
REQUEST_NARRATIVE = "Rows of the first tables were read and summed up. No entity was ranked."
REQUEST_ASSUMPTION = "The answer is made by rules; no model was asked."
REQUEST_NO_QUERIES = "No successful exploratory queries were available."

# Evaluation reasons.
REASON_EMPTY = "empty_ground_truth"
REASON_MATCH = "substring_match"
REASON_MISS = "ground_truth_not_found"

# Predictor modes.
MODE_MODEL = "llm_regression_predictor"
MODE_FALLBACK = "train_mean_fallback"
MODE_BASELINE = "train_mean_baseline"

# Critic scores and texts.
SCORE_TRUTH_IN_ANSWER = 0.2
SCORE_TRUTH_IN_PROMPT = 0.35
SCORE_TRUTH_ABSENT = 0.8
CRITIC_CONFIDENCE = "medium"
CRITIC_SUFFICIENT = "The final prompt appears to contain enough information to recover the ground truth."
CRITIC_INSUFFICIENT = "The final prompt appears insufficient for a reliable recovery of ground truth."
CRITIC_ASSUMPTION = "The initial evidence did not fully cover the target signals."
CRITIC_REASON = "The final prompt did not clearly include {item}."

# Prompt header, section labels and the packet fields they show.
PROMPT_HEADER = (
    "You are a predictive analyst.\nUse only the evidence below. Separate facts from assumptions.\n\n"
)
PROMPT_SECTIONS = [
    ("USER QUESTION", "user_question"),
    ("DATABASE SUMMARY", "database_summary"),
    ("TASK", "task"),
    ("RELEVANT TABLES", "relevant_tables"),
    ("RELATIONSHIPS", "relationships"),
    ("FACTS", "facts"),
    ("CANDIDATE ENTITIES", "candidate_entities"),
    ("CRITIC-REQUESTED EVIDENCE", "additional_evidence"),
    ("LIMITATIONS", "limitations"),
    ("QUERIES RUN", "queries_run"),
]

# Packet fields in their order.
PACKET_FIELDS = [
    "user_question",
    "database_id",
    "database_summary",
    "task",
    "relevant_tables",
    "relationships",
    "facts",
    "candidate_entities",
    "limitations",
    "queries_run",
]

# Profile summary texts.
SUMMARY_PROFILE_HEADER = "Database profile summary:"
SUMMARY_PROFILE_LINE = "- {table}: {rows} rows, key guess {key}"
SUMMARY_NO_KEY = "unknown"
SUMMARY_RELATIONSHIPS = "Likely relationships:"
SUMMARY_SCHEMA_HEADER = "Database schema summary:"
SUMMARY_MEMORY_TYPE = "database_summary"

# Roles, their adapters, and the system turn of every training example.
ROLES = ["task_planner", "sql_explorer", "final_predictor", "critic"]
ADAPTERS = {
    "task_planner": "task-planner-adapter",
    "sql_explorer": "sql-explorer-adapter",
    "final_predictor": "final-predictor-adapter",
    "critic": "critic-adapter",
}
EXAMPLE_SYSTEM = "Return valid JSON only."
