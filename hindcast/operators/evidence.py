"""Point-in-time evidence for whole sample sets.

``samples`` are rows (sample_id, entity_id, cutoff): what a benchmark asks, without its answer. Every operator takes
all of them at once and returns no row later than the sample's own cutoff.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import fixed_values as fixed
from hindcast.functions.columns import (
    filled,
    kind_of,
    literal,
    looks_like_time_sql,
    quoted,
    strict_filled,
    time_sql,
    time_text,
    value_sql,
    value_text,
)
from hindcast.functions.scale import small_relation, written
from hindcast.operators.cutoffs import CutoffIndex, blocks_holding, blocks_up_to, index_cutoffs, with_interval
from hindcast.tasks import TableRole, Task, relevant_tables


def sample_id(task_name: str, entity: Column, cutoff: str) -> Column:
    return F.concat_ws("|", F.lit(task_name), entity, time_text(cutoff))


# --- E1 date range -------------------------------------------------------------------------------------------------


def date_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    """First temporal column of every table that has one: min, max and the row count of the table."""
    parts = []
    for name, df in tables.items():
        temporal = [f for f in df.schema.fields if kind_of(f.dataType) == "temporal"]
        if temporal:
            c = F.col(f"`{temporal[0].name}`")
            parts.append(
                df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("row_count")).select(
                    F.lit(name).alias("table_name"),
                    F.lit(temporal[0].name).alias("time_column"),
                    value_text("lo", temporal[0].dataType).alias("min_value"),
                    value_text("hi", temporal[0].dataType).alias("max_value"),
                    "row_count",
                )
            )
    return reduce(DataFrame.unionByName, parts)


# --- E2 aggregate up to the cutoff ---------------------------------------------------------------------------------


def aggregate_per_cutoff(table: DataFrame, time_column: str, index: CutoffIndex) -> DataFrame:
    """(cutoff, row_count, min_time, max_time) of the rows up to each distinct cutoff.

    The table is reduced to one row per interval inside each task; only those rows are shuffled.
    """
    time = F.col(quoted(time_column))
    # Equal times are one row before they are placed, so a time that many rows share is not moved as often.
    times = table.filter(time.isNotNull()).groupBy(time).agg(F.count("*").alias("_n")) if index.swept else table.select(time, F.lit(1).alias("_n"))
    per_interval = (
        with_interval(times, time_column, index)
        .groupBy("idx")
        .agg(F.sum("_n").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    )
    per_block = (
        per_interval.selectExpr("n", "lo", "hi", f"inline({blocks_holding('idx', index.levels)})")
        .groupBy("level", "block")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    asked = index.cutoffs.selectExpr("cutoff", f"inline({blocks_up_to('idx', index.levels)})")
    return (
        asked.join(per_block, ["level", "block"], "left")
        .groupBy("cutoff")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.min("lo").alias("min_time"),
            F.max("hi").alias("max_time"),
        )
    )


def aggregate_up_to_cutoff(
    samples: DataFrame, table: DataFrame, time_column: str, index: CutoffIndex | None = None
) -> DataFrame:
    """Per sample: count, first and last time of all rows of the table up to its cutoff (inclusive)."""
    index = index or index_cutoffs(samples)
    per_cutoff = aggregate_per_cutoff(table, time_column, index)
    return samples.select("sample_id", "cutoff").join(index.broadcast(per_cutoff), "cutoff").drop("cutoff")


# --- E3 / E4 rows of the entity ------------------------------------------------------------------------------------


def row_order(schema: T.StructType, order: str, time_column: str | None) -> list[Column]:
    """By the first column, ties by the others (default), or newest first."""
    columns = [F.col(f"`{f.name}`").asc_nulls_last() for f in schema.fields if f.dataType.typeName() != "map"]
    if order == "recent" and time_column:
        return [F.col(f"`{time_column}`").desc_nulls_last(), *columns]
    return columns


def entity_rows(
    samples: DataFrame,
    table: DataFrame,
    key_column: str,
    time_column: str | None = None,
    index: CutoffIndex | None = None,
    keep: int = fixed.ENTITY_ROWS,
    order: str = "first_column",
) -> DataFrame:
    """(sample_id, rn, columns of the table): at most ``keep`` rows of the sample's entity, up to its cutoff.

    Rows are limited per entity and interval before they are shuffled or joined, so an entity that owns a third of
    the table leaves each task as ``keep`` rows per interval, however many cutoffs ask for it. With several cutoffs the
    rows left are numbered and written; cutoffs and samples choose among the numbers, and the columns are fetched once,
    for the rows that a sample gets.
    """
    index = index or index_cutoffs(samples)
    schema, columns = table.schema, table.columns
    order_by = row_order(schema, order, time_column)
    key = F.col(f"`{key_column}`")
    asked = samples.select(
        "sample_id", "cutoff", F.col("entity_id").try_cast(schema[key_column].dataType).alias("_key")
    ).filter(F.col("_key").isNotNull())
    rows = table.filter(key.isNotNull())
    known = asked.select(F.col("_key").alias(key_column)).distinct()
    known = F.broadcast(known) if index.few_entities else known
    rows = rows.join(known, key_column, "left_semi").select(*[quoted(c) for c in columns])

    if time_column is None or index.count <= 1:
        # One interval: the limit per entity is already the answer.
        kept = rows if time_column is None else with_interval(rows, time_column, index).drop("idx")
        kept = _first_rows(kept, [key_column], order_by, keep).withColumn("_key", key)
        return asked.join(kept, "_key").select("sample_id", "rn", *[quoted(c) for c in columns])

    # What any cutoff could ask for, numbered in the order of all columns. From here on a row is its entity and its number.
    per_interval = _first_rows(with_interval(rows, time_column, index), [key_column, "idx"], order_by, keep).drop("rn")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    payload = written(per_interval.withColumn("_place", place).withColumn("_key", key), "candidates")
    spread = payload.selectExpr("_key", "_place", f"inline({blocks_holding('idx', index.levels)}) AS (_level, _block)")
    per_block = _first_rows(spread, ["_key", "_level", "_block"], [F.col("_place")], keep).drop("rn")
    numbered = asked.join(index.broadcast(index.cutoffs.select("cutoff", "idx")), "cutoff")
    wanted = numbered.selectExpr(
        "sample_id", "_key", f"inline({blocks_up_to('idx', index.levels)}) AS (_level, _block)"
    )
    found = wanted.join(per_block, ["_key", "_level", "_block"]).select("sample_id", "_key", "_place")
    chosen = _first_rows(found, ["sample_id"], [F.col("_place")], keep)
    return chosen.join(payload.drop("idx"), ["_key", "_place"]).select("sample_id", "rn", *[quoted(c) for c in columns])


def _first_rows(df: DataFrame, keys: list[str], order_by: list[Column], keep: int) -> DataFrame:
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order_by)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= keep)


# --- E5 fallback ---------------------------------------------------------------------------------------------------


def fallback_rows(table: DataFrame, keep: int = fixed.ENTITY_ROWS) -> DataFrame:
    """(rn, columns): the first rows of a table that has neither a time nor the entity column."""
    order_by = row_order(table.schema, "first_column", None)
    first = table.orderBy(*order_by).limit(keep)
    return first.withColumn("rn", F.row_number().over(Window.orderBy(*order_by)))


# --- E7 / E9 facts and packets -------------------------------------------------------------------------------------

FACTS = [
    (fixed.FACT_AGGREGATE, fixed.PURPOSE_AGGREGATE),
    (fixed.FACT_ENTITY, fixed.PURPOSE_ENTITY),
    (fixed.FACT_SAMPLE, fixed.PURPOSE_SAMPLE),
]


def evidence_queries(role: TableRole) -> list[tuple[str, str]]:
    """(fact_key, purpose) of the queries one table gets."""
    wanted = [role.time_column is not None, role.key_column is not None]
    wanted.append(not any(wanted))
    return [(fact, purpose.format(table=role.table)) for (fact, purpose), w in zip(FACTS, wanted) if w]


def query_list(roles: list[TableRole]) -> list[tuple[int, TableRole, str, str]]:
    """(ordinal, role, fact_key, purpose) of all queries of a task, in the order they run."""
    flat = [(role, fact, purpose) for role in roles for fact, purpose in evidence_queries(role)]
    return [(i, *entry) for i, entry in enumerate(flat)]


def query_sql(role: TableRole, fact: str, cap: int) -> str:
    """SQL expression over entity_id and cutoff whose value is the text of the statement."""
    table = f'"{role.table}"'
    digits = "entity_id RLIKE '^[0-9]+$'"
    entity = f"CASE WHEN {digits} THEN entity_id ELSE concat('\\'', replace(entity_id, '\\'', '\\'\\''), '\\'') END"
    before = f"""{literal(f'"{role.time_column}" <= TIMESTAMP ')}, '\\'', {time_sql("cutoff")}, '\\''"""
    if fact == fixed.FACT_AGGREGATE:
        c = f'"{role.time_column}"'
        head = f"SELECT COUNT(*) AS row_count, MIN({c}) AS min_time, MAX({c}) AS max_time FROM {table} WHERE "
        return f"concat({literal(head)}, {before}, ' LIMIT {cap}')"
    if fact == fixed.FACT_ENTITY:
        time = f"{before}, ' AND ', " if role.time_column else ""
        equal = literal(f'"{role.key_column}" = ')
        tail = f" ORDER BY 1 LIMIT {fixed.ENTITY_ROWS}"
        return f"concat({literal(f'SELECT * FROM {table} WHERE ')}, {time}{equal}, {entity}, '{tail}')"
    return literal(f"SELECT * FROM {table} LIMIT {fixed.ENTITY_ROWS}")


def row_json_sql(schema: T.StructType) -> str:
    """SQL for a row as one JSON object; times as text, nulls kept."""
    fields = []
    for f in schema.fields:
        value = value_sql(quoted(f.name), f.dataType) if kind_of(f.dataType) == "temporal" else quoted(f.name)
        fields += [literal(f.name), value]
    return f"to_json(named_struct({', '.join(fields)}), map('ignoreNullFields', 'false'))"


_SEEN = "CAST(array() AS ARRAY<STRUCT<path: STRING, seen: STRING>>)"


def _walked(sql: str, data_type: T.DataType, path: str, depth: int = 0) -> str | None:
    """SQL for the (path, seen) of all times and texts in a value of any type; None if its type can hold none."""
    if kind_of(data_type) == "temporal" or isinstance(data_type, T.StringType):
        return f"array(named_struct('path', {literal(path)}, 'seen', {value_sql(sql, data_type)}))"
    if isinstance(data_type, T.StructType):
        parts = [_walked(f"{sql}.{quoted(f.name)}", f.dataType, f"{path}.{f.name}", depth) for f in data_type.fields]
        parts = [p for p in parts if p]
        return f"concat({', '.join(parts)})" if parts else None
    each = []
    if isinstance(data_type, T.ArrayType):
        each = [(sql, data_type.elementType, f"{path}[]")]
    elif isinstance(data_type, T.MapType):
        each = [(f"map_keys({sql})", data_type.keyType, f"{path}.key"), (f"map_values({sql})", data_type.valueType, f"{path}.value")]
    parts = []
    for held, kind, where in each:
        one = _walked(f"x{depth}", kind, where, depth + 1)
        if one:
            parts.append(f"coalesce(flatten(transform({held}, x{depth} -> {one})), {_SEEN})")
    return f"concat({', '.join(parts)})" if parts else None


def seen_times_sql(schema: T.StructType) -> str:
    """SQL for the times a row shows, wherever structs, arrays and maps hold them: an array of (path, seen)."""
    parts = [p for f in schema.fields if (p := _walked(quoted(f.name), f.dataType, f.name))]
    return f"filter(concat({_SEEN}, {', '.join(parts)}), t -> {looks_like_time_sql('t.seen')})" if parts else _SEEN


def _times(schema: T.StructType) -> str:
    """SQL for the texts of a row that look like times."""
    return f"transform({seen_times_sql(schema)}, t -> t.seen)"


ROW_COLUMNS = ["sample_id", "query_ordinal", "rn", "row_json", "times", "label"]


def _shown_rows(df: DataFrame, schema: T.StructType, ordinal: int, label_column: str, *keys: str) -> DataFrame:
    """Rows (keys, rn, columns) in the common form: their JSON, the times in them and their label."""
    label = quoted(label_column) if label_column in schema.names else "NULL"
    return df.selectExpr(
        *keys,
        f"{ordinal} AS query_ordinal",
        "CAST(rn AS INT) AS rn",
        f"{row_json_sql(schema)} AS row_json",
        f"{_times(schema)} AS times",
        f"CAST({label} AS STRING) AS label",
    )


def _summarized(kept: int) -> list[Column]:
    """Aggregates over the rows of one query: their number, the first ones, and the first label among those."""
    return [
        F.expr("count(rn)").alias("row_count"),
        F.expr(f"array_sort(collect_list(struct(rn, row_json, times)) FILTER (WHERE rn <= {kept}))").alias("kept"),
        F.expr(f"min(struct(rn, label)) FILTER (WHERE rn <= {kept} AND label IS NOT NULL).label").alias("label"),
    ]


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def facts(
    samples: DataFrame,
    task: Task,
    tables: dict[str, DataFrame],
    index: CutoffIndex | None = None,
    queries: list[tuple[int, TableRole, str, str]] | None = None,
    kept: int = fixed.KEPT_ROWS,
    cap: int = fixed.EVIDENCE_ROW_CAP,
) -> DataFrame:
    """One row per sample and query: purpose, SQL text, capped row count and the first rows.

    Evidence is gathered once for each (entity, cutoff), however many samples ask for it or repeat. Only rows of the entity are shuffled to their sample (at most ten each), together with a placeholder per (sample,
    query) so that queries that found nothing are listed too. What samples share is joined on afterwards: aggregates
    by cutoff, and the ten-row samples of tables without time and entity.
    """
    if queries is None:
        queries = query_list(relevant_tables(task, {n: df.schema for n, df in tables.items()}))
    named = written(samples.select("sample_id", "entity_id", "cutoff").distinct(), "samples")
    pairs = written(named.groupBy("entity_id", "cutoff").agg(F.min("sample_id").alias("sample_id")), "pairs")
    index = index or index_cutoffs(pairs)
    if pairs.count() == named.count():
        return _facts(named, task, tables, index, queries, kept, cap)
    found = _facts(pairs, task, tables, index, queries, kept, cap)
    asking = named.alias("n").join(pairs.alias("p"), F.expr("n.entity_id <=> p.entity_id AND n.cutoff <=> p.cutoff"))
    asking = asking.select(F.col("n.sample_id").alias("_asking"), F.col("p.sample_id").alias("sample_id"))
    columns = [F.col(c) for c in found.columns if c != "sample_id"]
    return asking.join(found, "sample_id").select(F.col("_asking").alias("sample_id"), *columns)


def _facts(
    samples: DataFrame, task: Task, tables: dict[str, DataFrame], index: CutoffIndex,
    queries: list[tuple[int, TableRole, str, str]], kept: int, cap: int,
) -> DataFrame:
    """``facts`` of samples without repeats."""
    own, by_cutoff, shared = [], [], []
    for ordinal, role, fact, _purpose in queries:
        table = tables[role.table]
        if fact == fixed.FACT_AGGREGATE:
            one = aggregate_per_cutoff(table, role.time_column, index).withColumn("rn", F.lit(1))
            schema = one.select("row_count", "min_time", "max_time").schema
            shown = _shown_rows(one, schema, ordinal, task.label_column, "cutoff")
            by_cutoff.append(
                shown.selectExpr(
                    "cutoff", "query_ordinal", "1L AS row_count", "array(struct(rn, row_json, times)) AS kept", "label"
                )
            )
        elif fact == fixed.FACT_ENTITY:
            found = entity_rows(samples, table, role.key_column, role.time_column, index)
            own.append(_shown_rows(found, table.schema, ordinal, task.label_column, "sample_id"))
        else:
            shown = _shown_rows(fallback_rows(table), table.schema, ordinal, task.label_column)
            shared.append(shown.groupBy("query_ordinal").agg(*_summarized(kept)))

    ordinals = ", ".join(str(q[0]) for q in queries)
    placeholders = samples.selectExpr(
        "sample_id", f"explode(array({ordinals})) AS query_ordinal", "CAST(NULL AS INT) AS rn",
        "CAST(NULL AS STRING) AS row_json", "CAST(NULL AS ARRAY<STRING>) AS times", "CAST(NULL AS STRING) AS label",
        "entity_id", "cutoff",
    )
    rows = [
        df.selectExpr(*ROW_COLUMNS, "CAST(NULL AS STRING) AS entity_id", "CAST(NULL AS TIMESTAMP_NTZ) AS cutoff")
        for df in own
    ]
    found = (
        _union([placeholders, *rows])
        .repartition("sample_id")
        .groupBy("sample_id", "query_ordinal")
        .agg(F.expr("max(entity_id)").alias("entity_id"), F.expr("max(cutoff)").alias("cutoff"), *_summarized(kept))
    )
    sources = ["o"]
    found = found.alias("o")
    if by_cutoff:
        per_cutoff = index.broadcast(_union(by_cutoff)).alias("c")
        same = F.expr("o.query_ordinal = c.query_ordinal AND o.cutoff = c.cutoff")
        found, sources = found.join(per_cutoff, same, "left"), ["c", *sources]
    if shared:
        # At most ten rows per query.
        few = F.broadcast(_union(shared)).alias("s")
        found, sources = found.join(few, F.expr("o.query_ordinal = s.query_ordinal"), "left"), ["s", *sources]

    def best(column: str) -> str:
        return f"coalesce({', '.join(f'{source}.{column}' for source in sources)})"

    merged = found.selectExpr(
        "o.sample_id", "o.query_ordinal", "o.entity_id", "o.cutoff",
        f"least({best('row_count')}, {cap}) AS row_count", f"{best('kept')} AS kept", f"{best('label')} AS label",
    )

    def per_query(value) -> str:
        return "CASE query_ordinal " + " ".join(f"WHEN {q[0]} THEN {value(q)}" for q in queries) + " END"

    return merged.selectExpr(
        "sample_id",
        "query_ordinal",
        f"{per_query(lambda q: literal(q[1].table))} AS table_name",
        f"{per_query(lambda q: literal(q[2]))} AS fact_key",
        f"{per_query(lambda q: literal(q[3]))} AS purpose",
        f"{per_query(lambda q: query_sql(q[1], q[2], cap))} AS sql",
        f"{per_query(lambda q: str(q[1].time_column is not None))} AS cutoff_applied",
        "row_count",
        "transform(kept, k -> k.row_json) AS sample_rows",
        "flatten(transform(kept, k -> k.times)) AS times",
        "label",
        f"{per_query(lambda q: _error_sql(q[1], q[2], tables[q[1].table].schema))} AS error",
    )


def _error_sql(role: TableRole, fact: str, schema: T.StructType) -> str:
    """SQL for what is wrong with a query of one sample, null as a rule; the other samples' queries are not touched by it."""
    if fact != fixed.FACT_ENTITY:
        return "CAST(NULL AS STRING)"
    kind = schema[role.key_column].dataType.simpleString()
    before, after = fixed.ERROR_ENTITY.format(entity="\0", kind=kind, column=role.key_column).split("\0")
    return f"CASE WHEN try_cast(entity_id AS {kind}) IS NULL THEN concat({literal(before)}, entity_id, {literal(after)}) END"


def skipped_queries(samples: DataFrame, task: Task, tables: dict[str, DataFrame]) -> DataFrame:
    """(sample_id, query_ordinal, purpose, error) of the queries a task's tables would get that are not there."""
    known = query_list(relevant_tables(task, {n: df.schema for n, df in tables.items()}))
    absent = [t for t in task.candidate_tables if t not in tables]
    rows = [
        f"named_struct('query_ordinal', {len(known) + i}, 'purpose', {literal(fixed.PURPOSE_ENTITY.format(table=t))}, "
        f"'error', {literal(fixed.ERROR_TABLE.format(table=t))})"
        for i, t in enumerate(absent)
    ]
    listed = f"array({', '.join(rows)})" if rows else "CAST(array() AS ARRAY<STRUCT<query_ordinal: INT, purpose: STRING, error: STRING>>)"
    return samples.select("sample_id").distinct().selectExpr("sample_id", f"inline({listed})")


def packets(fact_rows: DataFrame) -> DataFrame:
    """One nested packet per sample: the queries in order and the facts under ``<table>_<fact_key>``."""
    summary = F.struct("row_count", "sample_rows")
    run = F.struct("query_ordinal", "purpose", "sql", summary.alias("result_summary"))
    fact = F.struct(F.concat_ws("_", "table_name", "fact_key").alias("key"), summary.alias("value"))
    grouped = fact_rows.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("query_ordinal", run.alias("run"), fact.alias("fact")))).alias("all")
    )
    return grouped.select(
        "sample_id",
        F.transform("all", lambda a: a["run"].dropFields("query_ordinal")).alias("queries_run"),
        F.map_from_entries(F.transform("all", lambda a: a["fact"])).alias("facts"),
        F.array().cast("array<string>").alias("candidate_entities"),
        F.array().cast("array<string>").alias("limitations"),
    )


# --- E11 / E12 follow-up evidence ----------------------------------------------------------------------------------


def matched_table(evidence_type: Column, tables: list[str]) -> Column:
    """First table, in name order, whose name contains a word of the requested type; else the first table."""
    names = F.array(*[F.lit(t) for t in tables])
    tokens = F.filter(F.split(F.lower(F.regexp_replace(evidence_type, "_", " ")), r"\s+"), lambda w: w != "")
    hits = F.filter(names, lambda t: F.exists(tokens, lambda w: F.contains(F.lower(t), w)))
    return F.coalesce(F.get(hits, F.lit(0)), F.get(names, F.lit(0)))


def matched_tables(
    spark: SparkSession, task: Task, tables: dict[str, DataFrame], evidence_types: list[str]
) -> dict[str, str]:
    """Table of each evidence type a task lists. As small as the task's definition."""
    names = sorted(n for n in tables if n in task.tables)
    types = small_relation(spark, [(t,) for t in evidence_types], "evidence_type string")
    matched = types.select("evidence_type", matched_table(F.col("evidence_type"), names).alias("table_name"))
    return {r["evidence_type"]: r["table_name"] for r in matched.collect()}


def first_facts(
    samples: DataFrame,
    task: Task,
    tables: dict[str, DataFrame],
    wanted: list[str],
    index: CutoffIndex | None = None,
) -> DataFrame:
    """The first query of each wanted table for every sample, capped for follow-up use."""
    from hindcast.tasks import table_role

    roles = [table_role(task, t, i, tables[t].schema) for i, t in enumerate(wanted)]
    queries = [(i, role, *evidence_queries(role)[0]) for i, role in enumerate(roles)]
    return facts(samples, task, tables, index, queries, cap=fixed.FOLLOWUP_ROW_CAP)


def followup_evidence(
    requests: DataFrame,
    samples: DataFrame,
    task: Task,
    tables: dict[str, DataFrame],
    evidence_types: list[str],
    index: CutoffIndex | None = None,
) -> DataFrame:
    """Answer the first three requests of every sample: (sample_id, position, evidence_type, reason, table, rows).

    ``requests`` holds an array of (evidence_type, reason, priority) per sample; ``evidence_types`` are the types a
    request can have, which the task lists, so only the tables they match are read.
    """
    matches = matched_tables(samples.sparkSession, task, tables, evidence_types)
    fetched = first_facts(samples, task, tables, sorted(set(matches.values())), index)
    asked = requests.select("sample_id", F.posexplode(F.slice("requests", 1, fixed.MAX_REQUESTS)).alias("position", "r"))
    table_of = F.create_map(*[F.lit(x) for pair in matches.items() for x in pair])
    asked = asked.select(
        "sample_id",
        "position",
        F.col("r.evidence_type").alias("evidence_type"),
        F.col("r.reason").alias("reason"),
        table_of[F.col("r.evidence_type")].alias("table_name"),
    )
    return asked.join(fetched.select("sample_id", "table_name", "fact_key", "row_count", "sample_rows"),
                      ["sample_id", "table_name"])


# --- E13 / E15 / E16 / E17 questions and plans ---------------------------------------------------------------------


def question_text(template: str | None, row_columns: list[str], task: Task, strict: bool = False) -> Column:
    """The question of a sample row. Safe mode leaves unknown names as they are; strict mode refuses them."""
    values: dict[str, Column | str] = {c: F.col(f"`{c}`").cast("string") for c in row_columns}
    values["entity_id"] = F.col("entity_id")
    if strict:
        values["cutoff_time"] = time_text("cutoff")
        return strict_filled(template, **values)
    values |= {
        "cutoff_time": time_text("cutoff"),
        "target_col": task.target_column,
        "entity_col": task.lookup_column,
    }
    return filled(template or fixed.DEFAULT_QUESTION, **values)


def masked_split(full: DataFrame, target_column: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The split without its target, and the targets by (entity_id, cutoff, repeat_no) to score with afterwards.

    ``repeat_no`` numbers the rows of one entity and cutoff, so each meets its own target. Rows are ordered by what is not
    hidden, rows alike in that by a hash of the whole row: the number is repeatable and tells nothing of the target.
    """
    rows = full.orderBy("entity_id", "cutoff").limit(limit) if limit is not None else full
    columns = [F.col(quoted(c)) for c in sorted(full.columns)]
    shown = [c for c, name in zip(columns, sorted(full.columns)) if name != target_column]
    drawn = F.md5(F.concat_ws(":", F.lit("repeat"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    repeats = Window.partitionBy("entity_id", "cutoff").orderBy(*shown, drawn)
    rows = rows.withColumn("repeat_no", F.row_number().over(repeats))
    return rows.drop(target_column), rows.select("entity_id", "cutoff", "repeat_no", target_column)


def classify_question(question: Column) -> list[Column]:
    """prediction_type, entity_name and target_name of a free question."""
    text = F.lower(question)
    risky = reduce(lambda a, b: a | b, [text.contains(w) for w in fixed.RISK_WORDS])
    return [
        F.when(risky, "risk_ranking").otherwise("forecast").alias("prediction_type"),
        F.when(text.contains("customer"), "customer").otherwise("entity").alias("entity_name"),
        F.when(text.contains("churn"), "churn").otherwise("future outcome").alias("target_name"),
    ]


def initial_plan(task: Task) -> Column:
    """Plan for a sample: what is asked, which tables and information it needs, and the no-leak note."""
    cutoff = time_text("cutoff")
    note = filled(fixed.PLAN_LEAKAGE_NOTE, cutoff=cutoff)
    stated = F.array(F.lit(fixed.PLAN_ASSUMPTION), filled(fixed.PLAN_CUTOFF_ASSUMPTION, cutoff=cutoff))
    texts = lambda items: F.array(*[F.lit(i) for i in items]).cast("array<string>")
    return F.struct(
        F.lit(fixed.PLAN_INTENT).alias("intent"),
        F.lit(fixed.PLAN_TYPE).alias("prediction_type"),
        F.struct(F.lit("entity").alias("name"), F.col("entity_id")).alias("entity"),
        F.struct(
            F.lit(task.target_column).alias("name"),
            F.lit(fixed.PLAN_TARGET.format(target=task.target_column)).alias("description"),
            F.lit(fixed.PLAN_HORIZON).alias("time_horizon"),
        ).alias("target"),
        texts(task.expected_evidence).alias("needed_information"),
        texts(task.candidate_tables).alias("candidate_tables"),
        F.when(F.array_contains(stated, note), stated).otherwise(F.array_append(stated, note)).alias("assumptions"),
        cutoff.alias("cutoff_time"),
    )
