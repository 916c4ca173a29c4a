"""Profiling a set of tables.

One shuffle serves the whole set: every table is unpivoted to (table, column, value) and the rows are counted per
value with map-side combining, so a value that fills a third of a table leaves each task as one row. Null rates,
distinct counts and top values all read those counts. Ranges and moments are one-row aggregates per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.fixed_values import (
    MAX_SUMMARY_RELATIONSHIPS,
    PROFILE_SAMPLE_ROWS,
    RELATIONSHIP_CONFIDENCE,
    RELATIONSHIP_RULE,
    SUMMARY_NO_KEY,
    SUMMARY_PROFILE_HEADER,
    SUMMARY_PROFILE_LINE,
    SUMMARY_RELATIONSHIPS,
    SUMMARY_SCHEMA_HEADER,
    TOP_VALUES,
)
from hindcast.functions.columns import filled, kind_of, literal, quoted, value_sql
from hindcast.functions.scale import BROADCAST_ROWS, cut_lineage, small_relation
from hindcast.sources.tables import column_inventory, row_counts
from hindcast.tasks import IdRule

# A value longer than HEAD characters travels as its first HEAD characters plus a sha-256 of the whole value: equal
# keys mean equal values, keys sort like values unless the heads tie, and no long text is shuffled.
HEAD = 64
LONG_KEY = HEAD + 1 + 64


def key_sql(text: str) -> str:
    long = f"concat(substring({text}, 1, {HEAD}), '\\u0001', sha2({text}, 256))"
    return f"CASE WHEN length({text}) <= {HEAD} THEN {text} ELSE {long} END"


def family_of(data_type: T.DataType) -> str:
    """Type in which values of a column are compared: whole numbers, floats and times stay fixed-width."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"
    return "generic" if kind_of(data_type) == "generic" else "string"


def _comparable(sql: str, data_type: T.DataType) -> str:
    family = family_of(data_type)
    if family == "string":
        return key_sql(value_sql(sql, data_type))
    return f"CAST({sql} AS DOUBLE) + 0D" if family == "double" else f"CAST({sql} AS {family})"


def _unpivot(tables: dict[str, DataFrame], families: tuple[str, ...], form) -> DataFrame | None:
    """(table_name, column_name, value) of all columns of the given families; nulls are kept."""
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if family_of(f.dataType) in families]
        if fields:
            values = df.selectExpr(*[f"{form(quoted(f.name), f.dataType)} AS {quoted(f.name)}" for f in fields])
            long = values.unpivot([], [quoted(f.name) for f in fields], "column_name", "value")
            parts.append(long.selectExpr(f"{literal(name)} AS table_name", "column_name", "value"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def value_counts(tables: dict[str, DataFrame], family: str) -> DataFrame | None:
    """(table_name, column_name, value_key, frequency) of all columns of one family; null is a value here."""
    long = _unpivot(tables, (family,), _comparable)
    if long is None:
        return None
    return long.withColumnRenamed("value", "value_key").groupBy("table_name", "column_name", "value_key").agg(
        F.count("*").alias("frequency")
    )


def nested_nulls(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Null counts of nested columns, which have no distinct count."""
    long = _unpivot(tables, ("generic",), lambda c, _type: f"CAST({c} IS NULL AS BIGINT)")
    if long is None:
        return None
    return long.groupBy("table_name", "column_name").agg(
        F.sum("value").alias("null_count"), F.lit(None).cast("long").alias("distinct_count")
    )


def nulls_and_distinct(tables: dict[str, DataFrame], texts: DataFrame | None = None) -> DataFrame:
    """Per column: kind, row count, null rate and exact distinct count (null is not a value).

    ``texts`` may pass in the value counts of the string family when they were computed before.
    """
    spark = next(iter(tables.values())).sparkSession
    per_family = [value_counts(tables, f) for f in ("bigint", "double", "timestamp_ntz")]
    per_family.append(value_counts(tables, "string") if texts is None else texts)
    summed = [
        counts.groupBy("table_name", "column_name").agg(
            F.sum(F.when(F.col("value_key").isNull(), F.col("frequency")).otherwise(0)).alias("null_count"),
            F.count("value_key").alias("distinct_count"),
        )
        for counts in per_family
        if counts is not None
    ]
    summed += [n for n in [nested_nulls(tables)] if n is not None]
    flat = reduce(DataFrame.unionByName, summed)
    inventory = column_inventory(spark, {n: df.schema for n, df in tables.items()})
    zero = F.when(F.col("kind") != "generic", F.lit(0))
    return (
        inventory.join(F.broadcast(row_counts(tables)), "table_name")
        .join(flat, ["table_name", "column_name"], "left")
        .select(
            "table_name",
            "ordinal",
            "column_name",
            "data_type",
            "kind",
            "row_count",
            (F.coalesce("null_count", F.lit(0)) / F.greatest("row_count", F.lit(1))).alias("null_rate"),
            F.coalesce("distinct_count", zero.cast("long")).alias("distinct_count"),
        )
    )


def approximate_distinct(tables: dict[str, DataFrame], rsd: float = 0.02) -> DataFrame:
    """Approximate distinct counts in one scan without a shuffle of values, for tables where exact ones cost too much."""
    parts = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if kind_of(f.dataType) != "generic"]
        one = df.agg(*[F.approx_count_distinct(f"`{c}`", rsd).alias(c) for c in columns])
        parts.append(
            one.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "approx_distinct").select(
                F.lit(name).alias("table_name"), "column_name", "approx_distinct"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def column_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    """Min and max as text for numeric and temporal columns, mean and sample deviation for numeric ones."""
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if kind_of(f.dataType) in ("numeric", "temporal")]
        if not fields:
            continue
        aggregates, entries = [], []
        for i, f in enumerate(fields):
            c, kind = quoted(f.name), kind_of(f.dataType)
            moments = f"avg(CAST({c} AS DOUBLE)), stddev_samp({c})" if kind == "numeric" else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
            aggregates.append(f"struct(min({c}) AS lo, max({c}) AS hi, {moments}) AS s{i}")
            low, high = value_sql(f"s{i}.lo", f.dataType), value_sql(f"s{i}.hi", f.dataType)
            entries.append(f"struct({literal(f.name)}, {literal(kind)}, {low}, {high}, s{i}.col3, s{i}.col4)")
        names = "column_name, kind, min_value, max_value, avg_value, stddev_value"
        parts.append(
            df.selectExpr(*aggregates).selectExpr(
                f"{literal(name)} AS table_name", f"inline(array({', '.join(entries)})) AS ({names})"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _categorical(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The categorical columns of every table that has any."""
    names = {n: [f.name for f in df.schema.fields if kind_of(f.dataType) == "categorical"] for n, df in tables.items()}
    return {n: tables[n].select([f"`{c}`" for c in columns]) for n, columns in names.items() if columns}


def top_values(tables: dict[str, DataFrame], counts: DataFrame | None = None, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent non-null values of each categorical column; ties by value.

    Candidates are ranked on keys. Only for long values whose keys made it is the table read again, to get the
    values themselves.
    """
    categorical = _categorical(tables)
    if counts is None:
        counts = value_counts(categorical, "string")
    else:
        columns = [(n, c) for n, df in categorical.items() for c in df.columns]
        wanted = small_relation(counts.sparkSession, columns, "table_name string, column_name string")
        counts = counts.join(F.broadcast(wanted), ["table_name", "column_name"], "left_semi")
    per_column = Window.partitionBy("table_name", "column_name")
    by_key = per_column.orderBy(F.desc("frequency"), F.substring("value_key", 1, HEAD))
    candidates = cut_lineage(
        counts.filter(F.col("value_key").isNotNull()).withColumn("place", F.rank().over(by_key)).filter(
            F.col("place") <= top
        )
    )
    is_long = F.length("value_key") == LONG_KEY
    values = candidates.filter(~is_long).withColumn("value", F.col("value_key"))
    long_keys = candidates.filter(is_long)
    found = long_keys.limit(BROADCAST_ROWS + 1).count()
    if found:
        texts = _unpivot(categorical, ("string",), value_sql).filter(F.length("value") > HEAD)
        wanted = F.broadcast(long_keys) if found <= BROADCAST_ROWS else long_keys
        hits = texts.withColumn("value_key", F.expr(key_sql("value"))).join(
            wanted, ["table_name", "column_name", "value_key"]
        )
        one = hits.groupBy("table_name", "column_name", "value_key", "frequency").agg(F.min("value").alias("value"))
        values = values.select(*one.columns).unionByName(one)
    by_value = per_column.orderBy(F.desc("frequency"), "value")
    return (
        values.withColumn("place", F.row_number().over(by_value))
        .filter(F.col("place") <= top)
        .select("table_name", "column_name", "place", "value", "frequency")
    )


def primary_keys(columns: DataFrame) -> DataFrame:
    """Per table the first column, in schema order, that is never null and has as many values as rows."""
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("null_rate") == 0)
    key = F.min_by(F.when(unique, F.col("column_name")), F.when(unique, F.col("ordinal")))
    return columns.groupBy("table_name").agg(
        F.first("row_count").alias("row_count"), key.alias("primary_key_guess")
    )


def first_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, primary_key_guess) as ``primary_keys`` has it, without counting every column exactly.

    One scan of a table gives each column's nulls and a sketch of its values. Columns that are null somewhere, or whose sketch
    has not half as many values as there are rows, are no key; the others are counted exactly in turn until one is.
    """
    found = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if kind_of(f.dataType) != "generic"]
        sums = [F.count(quoted(f.name)).alias(f"n{i}") for i, f in enumerate(fields)]
        sums += [F.approx_count_distinct(quoted(f.name)).alias(f"d{i}") for i, f in enumerate(fields)]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
        guess = None
        for i, f in enumerate(fields):
            possible = one[f"n{i}"] == one["rows"] and 2 * one[f"d{i}"] >= one["rows"]
            # What is equal is decided as the profile decides it.
            if possible and df.select(F.count_distinct(F.expr(_comparable(quoted(f.name), f.dataType)))).first()[0] == one["rows"]:
                guess = f.name
                break
        found.append((name, guess))
    return small_relation(next(iter(tables.values())).sparkSession, found, "table_name string, primary_key_guess string")


def relationships(inventory: DataFrame, id_rule: IdRule = IdRule()) -> DataFrame:
    """Pairs of tables that share the name of an id column, in both directions."""
    logical = F.regexp_replace("column_name", "^[^_]*_", "") if id_rule.strip_prefix else F.col("column_name")
    ids = inventory.withColumn("id_name", logical).filter(F.col("id_name").endswith(id_rule.suffix))
    left = ids.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "id_name")
    right = ids.select(F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), "id_name")
    return (
        left.join(right, "id_name")
        .filter(F.col("from_table") != F.col("to_table"))
        .select(
            "from_table",
            "from_column",
            "to_table",
            "to_column",
            F.lit(RELATIONSHIP_CONFIDENCE).alias("confidence"),
            F.lit(RELATIONSHIP_RULE).alias("evidence_rule"),
        )
    )


def relationship_support(tables: dict[str, DataFrame], id_rule: IdRule = IdRule()) -> DataFrame:
    """For every related pair, the share of distinct values on the left that also occur on the right, 0 if none does.

    One shuffle on (id name, value) serves all pairs: the tables that hold a value meet there, at most one row each.
    """
    parts = [
        df.select(
            F.lit(name).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.lit(id_rule.logical(column)).alias("id_name"),
            F.col(f"`{column}`").cast("string").alias("value"),
        )
        for name, df in tables.items()
        for column in df.columns
        if id_rule.is_id(column)
    ]
    held = (
        reduce(DataFrame.unionByName, parts)
        .filter(F.col("value").isNotNull())
        .groupBy("id_name", "value", "table_name", "column_name")
        .agg(F.count("*").alias("copies"))
        .groupBy("id_name", "value")
        .agg(F.collect_set(F.struct("table_name", "column_name")).alias("holders"))
    )
    # Distinct sets of holders are as few as subsets of the schema: count values per set, then pair within the set.
    per_set = held.groupBy("id_name", "holders").agg(F.count("*").alias("values"))
    left = per_set.select("id_name", "holders", "values", F.explode("holders").alias("l"))
    pairs = (
        left.select("id_name", "values", "l", F.explode("holders").alias("r"))
        .filter(F.col("l.table_name") != F.col("r.table_name"))
        .groupBy("id_name", "l", "r")
        .agg(F.sum("values").alias("shared"))
    )
    totals = left.groupBy("id_name", "l").agg(F.sum("values").alias("total"))
    shares = pairs.join(totals, ["id_name", "l"]).select(
        F.col("l.table_name").alias("from_table"),
        F.col("l.column_name").alias("from_column"),
        F.col("r.table_name").alias("to_table"),
        F.col("r.column_name").alias("to_column"),
        (F.col("shared") / F.col("total")).alias("support"),
    )
    spark = next(iter(tables.values())).sparkSession
    names = ["from_table", "from_column", "to_table", "to_column"]
    related = relationships(column_inventory(spark, {n: df.schema for n, df in tables.items()}), id_rule).select(*names)
    return related.join(shares, names, "left").select(*names, F.coalesce("support", F.lit(0.0)).alias("support"))


def table_sample(df: DataFrame, rows: int = PROFILE_SAMPLE_ROWS) -> DataFrame:
    """The first rows in the order of all columns; a top-k per task, so nothing is sorted as a whole."""
    sortable = [F.col(f"`{f.name}`").asc_nulls_last() for f in df.schema.fields if f.dataType.typeName() != "map"]
    return df.orderBy(*sortable).limit(rows)


def profile_summary(keys: DataFrame, related: DataFrame) -> DataFrame:
    """Text of the profile: a line per table, then the first relationships. Its inputs are as small as the schemas."""
    line = filled(
        SUMMARY_PROFILE_LINE,
        table=F.col("table_name"),
        rows=F.col("row_count").cast("string"),
        key=F.coalesce("primary_key_guess", F.lit(SUMMARY_NO_KEY)),
    )
    tables = keys.agg(_lines(F.col("table_name"), line).alias("table_lines"))
    arrow = F.concat("from_table", F.lit("."), "from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column")
    first = related.orderBy("from_table", "from_column", "to_table").limit(MAX_SUMMARY_RELATIONSHIPS)
    relations = first.agg(
        _lines(F.struct("from_table", "from_column", "to_table"), F.concat(F.lit("- "), arrow)).alias("relation_lines")
    )
    text = F.concat_ws(
        "\n",
        F.lit(SUMMARY_PROFILE_HEADER),
        F.when(F.length("table_lines") > 0, F.col("table_lines")),
        F.when(F.length("relation_lines") > 0, F.concat(F.lit(SUMMARY_RELATIONSHIPS + "\n"), "relation_lines")),
    )
    return tables.join(F.broadcast(relations)).select(text.alias("summary"))


def schema_summary(inventory: DataFrame) -> DataFrame:
    """Text of the schema without any value: a line per table with its columns."""
    per_table = inventory.groupBy("table_name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]),
            ", ",
        ).alias("names")
    )
    line = F.concat(F.lit("- "), "table_name", F.lit(": columns ["), "names", F.lit("]"))
    return per_table.agg(
        F.concat_ws("\n", F.lit(SUMMARY_SCHEMA_HEADER), _lines(F.col("table_name"), line)).alias("summary")
    )


def _lines(order: Column, line: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return F.array_join(F.transform(pairs, lambda x: x["line"]), "\n")


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """The whole profile, one row per column, from one set of value counts."""
    counts = cut_lineage(value_counts(tables, "string"))
    tops = top_values(tables, counts).groupBy("table_name", "column_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "value", "frequency"))),
            lambda x: F.struct(x["value"].alias("value"), x["frequency"].alias("frequency")),
        ).alias("top_values")
    )
    key = ["table_name", "column_name"]
    ranges = column_ranges(tables).drop("kind")
    return nulls_and_distinct(tables, counts).join(ranges, key, "left").join(tops, key, "left")


def store_profile(profile: DataFrame, database_id: str, path: str) -> None:
    """Replace the stored profile of one database and leave the others."""
    rows = profile.withColumn("database_id", F.lit(database_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("database_id").parquet(path)


def stored_profile(spark, path: str, database_id: str) -> DataFrame:
    """The stored profile of one database, by table name and column position; other partitions are not read."""
    return (
        spark.read.parquet(path)
        .filter(F.col("database_id") == database_id)
        .orderBy("table_name", "ordinal")
    )
