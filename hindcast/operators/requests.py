"""Answering a table of free questions about one set of tables.

What is looked at does not depend on the question: a sample and the date range of the first tables. It is gathered
once and handed to every question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast import fixed_values as fixed
from hindcast.functions.columns import kind_of, literal, quoted, value_sql
from hindcast.operators.evidence import classify_question, row_json_sql, row_order
from hindcast.operators.profile import table_sample


def inspections(tables: dict[str, DataFrame], row_cap: int = fixed.PREDICT_ROW_CAP) -> DataFrame:
    """(position, table_name, purpose, sql, row_count, sample_rows) of the queries over the first three tables."""
    parts = []
    for name in sorted(tables)[: fixed.INSPECT_TABLES]:
        df = tables[name]
        # At most twenty rows; numbered because what is collected has no order.
        first = table_sample(df, min(fixed.INSPECT_SAMPLE_ROWS, row_cap))
        place = F.row_number().over(Window.orderBy(*row_order(df.schema, "first_column", None)))
        rows = first.select(F.struct(place.alias("rn"), F.expr(row_json_sql(df.schema)).alias("text")).alias("r"))
        sample = rows.selectExpr("count(*) AS row_count", "array_sort(collect_list(r)).text AS row_texts")
        sql = f'SELECT * FROM "{name}" LIMIT {fixed.INSPECT_SAMPLE_ROWS}'
        parts.append((name, fixed.PURPOSE_INSPECT, sql, sample))
        temporal = [f for f in df.schema.fields if kind_of(f.dataType) == "temporal"]
        if temporal:
            c, data_type = quoted(temporal[0].name), temporal[0].dataType
            shown = (
                f"to_json(named_struct('min_value', {value_sql(f'min({c})', data_type)}, "
                f"'max_value', {value_sql(f'max({c})', data_type)}, 'row_count', count(*)))"
            )
            one = df.agg(F.lit(1).cast("bigint").alias("row_count"), F.expr(f"array({shown})").alias("row_texts"))
            d = f'"{temporal[0].name}"'
            sql = f'SELECT MIN({d}) AS min_value, MAX({d}) AS max_value, COUNT(*) AS row_count FROM "{name}" LIMIT {row_cap}'
            parts.append((name, fixed.PURPOSE_RANGE, sql, one))
    listed = [
        one.selectExpr(
            f"{i} AS position",
            f"{literal(name)} AS table_name",
            f"{literal(purpose.format(table=name))} AS purpose",
            f"{literal(sql)} AS sql",
            "row_count",
            f"slice(row_texts, 1, {fixed.KEPT_ROWS}) AS sample_rows",
        )
        for i, (name, purpose, sql, one) in enumerate(parts[: fixed.INSPECT_QUERIES])
    ]
    return reduce(DataFrame.unionByName, listed)


def answer_requests(questions: DataFrame, looked_at: DataFrame, question: str = "question") -> DataFrame:
    """Class, answer, confidence and limitations of every question, with the queries it rests on.

    ``looked_at`` has at most ten rows (see ``inspections``); they become one row that every question gets.
    """
    entry = F.struct("position", "purpose", "sql", "row_count", "sample_rows")
    packed = looked_at.agg(F.array_sort(F.collect_list(entry)).alias("queries_run")).withColumn("one", F.lit(1))
    answered = (
        questions.select("*", *classify_question(F.col(question)))
        .withColumn("one", F.lit(1))
        .join(F.broadcast(packed), "one")
        .drop("one")
    )
    some = F.size("queries_run") > 0
    return answered.select(
        "*",
        F.lit(fixed.ANSWER_TYPE).alias("answer_type"),
        F.lit(fixed.REQUEST_SUMMARY).alias("summary"),
        F.lit(fixed.REQUEST_NARRATIVE).alias("narrative_answer"),
        F.array(*[F.lit(n) for n in fixed.QUESTION_NEEDS]).alias("needed_information"),
        F.when(some, "medium").otherwise("low").alias("confidence"),
        F.array_compact(
            F.array(F.when(~some, fixed.REQUEST_NO_QUERIES), F.lit(fixed.REQUEST_ASSUMPTION))
        ).alias("limitations"),
    )
