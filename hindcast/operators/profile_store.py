"""A stored profile that is brought up to date by reading only the files that changed.

Every file of a table leaves one state per column: rows, nulls, sum, sum of squares, smallest and largest value, a sketch
of its distinct values and, for the columns asked for, the values' keys with their numbers. States of the files that exist
are merged into the profile; a file is known by the fingerprint of its name, size and time. Tables, columns,
relationships and the summary of a refresh are written under one version, and a version counts once all of them are
there, so a reader never sees parts of two.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.columns import kind_of, literal, quoted, value_sql
from hindcast.functions.scale import written
from hindcast.operators.profile import key_sql, primary_keys, profile_summary, relationships
from hindcast.sources.tables import column_inventory, file_listing
from hindcast.tasks import IdRule

# Values of the states that merging adds up, and those it compares.
STATE = (
    "table_name string, file_id string, column_name string, rows bigint, nulls bigint, total double, squares double, "
    "low_long bigint, high_long bigint, low_double double, high_double double, low_time timestamp_ntz, high_time timestamp_ntz, sketch binary"
)
# Keys that one task counts: each is an entry of its hash table.
TASK_KEYS = 200_000
KEYS = "table_name string, file_id string, column_name string, value_key string, frequency bigint"


def distinct_keys(keys: DataFrame, count: int) -> DataFrame:
    """(table_name, column_name, value_key) without repeats, in tasks of about ``TASK_KEYS`` of the ``count`` keys.

    A value comes once for each file, so equal ones are dealt to one task as they are, without a hash table of a split before.
    """
    key = ["table_name", "column_name", "value_key"]
    return keys.select(*key).repartition(max(1, -(-count // TASK_KEYS)), *key).distinct()


@dataclass(frozen=True)
class Refresh:
    """What a refresh found: (table_name, path, file_id, action), action one of read, kept, dropped."""

    version: int
    files: DataFrame


@dataclass(frozen=True)
class ProfileStore:
    """Profile of one database under ``path``; ``exact`` names the columns whose distinct values are counted exactly."""

    spark: SparkSession
    path: str
    exact: dict[str, tuple[str, ...]]
    id_rule: IdRule

    def _stored(self, name: str, schema: str) -> DataFrame:
        """A part of the store, empty before the first refresh."""
        folder = f"{self.path}/{name}"
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def files(self) -> DataFrame:
        """The files the newest version stands on."""
        every = self._stored("files", "version int, table_name string, path string, file_id string")
        return every.filter(F.col("version") == self.version()).drop("version")

    def version(self) -> int:
        return self._stored("versions", "version int").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self, part: str) -> DataFrame:
        """``tables``, ``columns``, ``relationships`` or ``summary`` of the newest version."""
        return self.spark.read.parquet(f"{self.path}/{part}/version={self.version()}")

    def refresh(self, tables: dict[str, DataFrame], paths: dict[str, str]) -> Refresh:
        """Read what changed since the last refresh and replace the profile. ``paths`` holds the folder or file of each table."""
        version = self.version()
        current = written(file_listing(self.spark, paths), "listing")
        before = written(self.files(), "listed")
        changed = current.join(before, ["table_name", "file_id"], "left_anti")
        kept = current.join(before, ["table_name", "file_id"], "left_semi")
        dropped = before.join(current, ["table_name", "file_id"], "left_anti")
        actions = changed.withColumn("action", F.lit("read"))
        for df, action in ((kept, "kept"), (dropped, "dropped")):
            actions = actions.unionByName(df.select(*changed.columns).withColumn("action", F.lit(action)))
        actions = written(actions, "actions")
        to_read: dict[str, list[tuple[str, str]]] = {}
        for row in actions.filter(F.col("action") == "read").select("table_name", "path", "file_id").collect():
            to_read.setdefault(row["table_name"], []).append((row["path"], row["file_id"]))
        for name, files in to_read.items():
            self._add_states(name, tables[name].schema, files)
        self._publish(tables, current, version + 1)
        return Refresh(version + 1, actions)

    def _add_states(self, name: str, schema: T.StructType, files: list[tuple[str, str]]) -> None:
        """States of some files of a table, one group of rows per file; nothing but states is shuffled."""
        rows = self.spark.read.schema(schema).parquet(*[path for path, _id in files])
        numbered = self.spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "_file int, path string, file_id string")
        # Listings and scans write a path with one, two or three slashes after its scheme.
        bare = lambda c: F.regexp_replace(c, "^[A-Za-z0-9+.-]+:/+", "/")
        numbered = F.broadcast(numbered.select("_file", "file_id", bare(F.col("path")).alias("_bare")))
        # Paths are compared once for each file; a row meets its file's number by the path as the scan gives it.
        scanned = rows.select(F.col("_metadata.file_path").alias("_path")).distinct()
        scanned = scanned.withColumn("_bare", bare(F.url_decode(F.regexp_replace("_path", r"\+", "%2B"))))
        ids = written(scanned.join(numbered, "_bare").select("_path", "_file", "file_id"), "files_read")
        files_of, ids = F.broadcast(ids.select("_path", "_file")), F.broadcast(ids.select("_file", "file_id").distinct())
        aggregates, entries = ["count(*) AS rows"], []
        for i, f in enumerate(schema.fields):
            values, entry = _state_of(f)
            aggregates += [f"{sql} AS s{i}_{part}" for part, sql in values.items()]
            held = [f"{literal(p)}, {f's{i}_{p}' if p in values else f'CAST(NULL AS {t})'}" for p, t in entry]
            entries.append(f"named_struct('column_name', {literal(f.name)}, 'rows', rows, {', '.join(held)})")
        located = rows.withColumn("_path", F.col("_metadata.file_path")).join(files_of, "_path")
        per_file = located.groupBy("_file").agg(*[F.expr(a) for a in aggregates])
        parts = ", ".join(["column_name", "rows", *[p for p, _t in _PARTS]])
        states = per_file.join(ids, "_file").selectExpr(f"{literal(name)} AS table_name", "file_id", f"inline(array({', '.join(entries)})) AS ({parts})")
        states.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("append").parquet(f"{self.path}/states")
        exact = [f for f in schema.fields if f.name in self.exact.get(name, ())]
        if exact:
            pairs = ", ".join(f"named_struct('c', {i}, 'k', {key_sql(value_sql(quoted(f.name), f.dataType))})" for i, f in enumerate(exact))
            held = located.select("_file", *[quoted(f.name) for f in exact])
            parts = -(-rows.count() * len(exact) // TASK_KEYS)
            if parts > 1:
                held = held.withColumn("_at", F.monotonically_increasing_id()).repartition(parts, "_at")
            keys = held.selectExpr("_file", f"inline(array({pairs})) AS (_column, value_key)").filter("value_key IS NOT NULL")
            keys = keys.groupBy("_file", "_column", "value_key").agg(F.count("*").alias("frequency")).join(ids, "_file")
            keys = keys.withColumn("column_name", F.element_at(F.array(*[F.lit(f.name) for f in exact]), F.col("_column") + 1))
            keys = keys.select(F.lit(name).alias("table_name"), *[c.split()[0] for c in KEYS.split(", ")[1:]])
            keys.write.mode("append").parquet(f"{self.path}/keys")

    def _publish(self, tables: dict[str, DataFrame], current: DataFrame, version: int) -> None:
        live = current.select("table_name", "file_id").distinct()
        states = self._stored("states", STATE).join(F.broadcast(live), ["table_name", "file_id"], "left_semi")
        # A file whose states were written by a refresh that did not end has them twice.
        states = states.dropDuplicates(["table_name", "file_id", "column_name"])
        key = ["table_name", "column_name"]
        moments = states.groupBy(*key).agg(
            F.sum("rows").alias("row_count"), F.sum("nulls").alias("null_count"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
            *[F.min(f"low_{t}").alias(f"low_{t}") for t in ("long", "double", "time")],
            *[F.max(f"high_{t}").alias(f"high_{t}") for t in ("long", "double", "time")],
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approximate"),
        )
        keys = self._stored("keys", KEYS).join(F.broadcast(live), ["table_name", "file_id"], "left_semi")
        exact = distinct_keys(keys, self._stored("keys", KEYS).count()).groupBy(*key).agg(F.count("*").alias("exact"))
        inventory = column_inventory(self.spark, {n: df.schema for n, df in tables.items()})
        filled = F.when(F.col("total").isNotNull(), F.col("row_count") - F.col("null_count"))
        spread = F.try_divide(F.col("squares") - F.col("total") * F.try_divide("total", filled), filled - 1)
        columns = inventory.join(moments, key, "left").join(exact, key, "left").select(
            "table_name", "ordinal", "column_name", "data_type", "kind", F.coalesce("row_count", F.lit(0)).alias("row_count"),
            (F.coalesce("null_count", F.lit(0)) / F.greatest(F.coalesce("row_count", F.lit(0)), F.lit(1))).alias("null_rate"),
            F.coalesce("exact", "approximate", F.when(F.col("kind") != "generic", F.lit(0))).cast("long").alias("distinct_count"),
            F.col("exact").isNotNull().alias("distinct_is_exact"),
            F.coalesce(F.col("low_long").cast("string"), F.col("low_double").cast("string"), F.expr(value_sql("low_time", T.TimestampNTZType()))).alias("min_value"),
            F.coalesce(F.col("high_long").cast("string"), F.col("high_double").cast("string"), F.expr(value_sql("high_time", T.TimestampNTZType()))).alias("max_value"),
            F.try_divide("total", filled).alias("avg_value"),
            F.when(filled > 1, F.sqrt(F.greatest(F.lit(0.0), spread))).alias("stddev_value"),
        )
        columns = written(columns, "columns")
        # A guess needs exact counts: columns without them are no candidates.
        sure = columns.withColumn("distinct_count", F.when(F.col("distinct_is_exact") | (F.col("row_count") == 0), F.col("distinct_count")))
        guessed = primary_keys(sure)
        counts = columns.groupBy("table_name").agg(F.max("row_count").alias("row_count"))
        keyed = counts.join(guessed.select("table_name", "primary_key_guess"), "table_name", "left")
        related = relationships(inventory, self.id_rule)
        parts = {
            "tables": keyed, "columns": columns, "relationships": related, "summary": profile_summary(keyed, related),
        }
        for part, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{part}/version={version}")
        files = current.select("table_name", "path", "file_id")
        files.select(F.lit(version).alias("version"), "*").write.mode("append").parquet(f"{self.path}/files")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/versions")


_PARTS = [
    ("nulls", "BIGINT"), ("total", "DOUBLE"), ("squares", "DOUBLE"), ("low_long", "BIGINT"), ("high_long", "BIGINT"),
    ("low_double", "DOUBLE"), ("high_double", "DOUBLE"), ("low_time", "TIMESTAMP_NTZ"), ("high_time", "TIMESTAMP_NTZ"), ("sketch", "BINARY"),
]


def _state_of(field: T.StructField) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """SQL aggregates of a column by part of its state, and all parts with their types."""
    c, kind, data_type = quoted(field.name), kind_of(field.dataType), field.dataType
    values = {"nulls": f"count_if({c} IS NULL)"}
    if kind == "numeric":
        number = f"CAST({c} AS DOUBLE)"
        values |= {"total": f"sum({number})", "squares": f"sum({number} * {number})"}
        family = "long" if isinstance(data_type, T.IntegralType) else "double"
        same = f"CAST({c} AS BIGINT)" if family == "long" else f"{number} + 0D"
        values |= {f"low_{family}": f"min({same})", f"high_{family}": f"max({same})"}
    elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        time = f"CAST({c} AS TIMESTAMP_NTZ)"
        values |= {"low_time": f"min({time})", "high_time": f"max({time})"}
    if kind != "generic":
        values["sketch"] = f"hll_sketch_agg({value_sql(c, data_type)})"
    return values, _PARTS


def open_store(spark: SparkSession, path: str, exact: dict[str, tuple[str, ...]] | None = None, id_rule: IdRule = IdRule()) -> ProfileStore:
    return ProfileStore(spark, path.rstrip("/"), exact or {}, id_rule)
