"""Opening, reading, materializing and fingerprinting sets of tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.columns import kind_of
from hindcast.functions.scale import small_relation


def open_tables(spark: SparkSession, folder: str, names: list[str] | tuple[str, ...]) -> dict[str, DataFrame]:
    """One DataFrame per parquet table of a folder, in name order. Only footers are read here."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in sorted(names)}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make every table reachable from ``spark.sql`` under its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def column_inventory(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """One row per column; its size is that of the schemas."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for table, schema in schemas.items()
        for i, f in enumerate(schema.fields)
    ]
    return small_relation(
        spark, rows, "table_name string, ordinal int, column_name string, data_type string, kind string"
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table. No column is read."""
    counted = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
               for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, row count and column count per table."""
    widths = F.create_map(*[F.lit(x) for n, df in tables.items() for x in (n, len(df.columns))])
    return row_counts(tables).withColumn("column_count", widths[F.col("table_name")])


def read_split(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows of a split file: .jsonl (one row per line), .json (one array) or .csv (header, all text).

    A .json array is one document and therefore one task; large splits belong in .jsonl. A .csv is split between tasks unless
    ``multiline`` says that quoted values hold line ends.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.json(path)
    if suffix == "json":
        return spark.read.option("multiLine", True).json(path)
    if suffix == "csv":
        return spark.read.option("header", True).option("multiLine", multiline).csv(path)
    raise ValueError(f"unsupported split format: {path}")


@dataclass(frozen=True)
class TableKeys:
    """Declared keys of a table."""

    primary_key: str | None = None
    time_column: str | None = None
    foreign_keys: dict = field(default_factory=dict)  # column -> table


def materialize(
    tables: dict[str, DataFrame], keys: dict[str, TableKeys], folder: str, rebuild: bool = False
) -> DataFrame:
    """Write the tables and their metadata under ``folder``; an existing table stays unless ``rebuild``.

    Returns the metadata: table_name, primary_key, time_column, foreign_keys, row_count.
    """
    spark = next(iter(tables.values())).sparkSession
    mode = "overwrite" if rebuild else "ignore"
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")
    written = open_tables(spark, folder, list(tables))
    metadata = table_metadata(written, keys)
    metadata.coalesce(1).write.mode(mode).json(f"{folder}/metadata.json")
    schema = metadata.schema
    return spark.read.schema(schema).json(f"{folder}/metadata.json")


def table_metadata(tables: dict[str, DataFrame], keys: dict[str, TableKeys]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    declared = small_relation(
        spark,
        [
            (n, k.primary_key, k.time_column, ",".join(f"{c}={t}" for c, t in sorted(k.foreign_keys.items())))
            for n, k in ((n, keys.get(n, TableKeys())) for n in tables)
        ],
        "table_name string, primary_key string, time_column string, foreign_keys string",
    )
    return declared.join(row_counts(tables), "table_name")


def file_listing(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, path, file_id) of every file: sha256 of path, size and modification time; contents are not read."""
    per_table = []
    for table, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        per_table.append(files.select(F.lit(table).alias("table_name"), "path", "length", "modificationTime"))
    stamp = F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return reduce(DataFrame.unionByName, per_table).select("table_name", "path", F.sha2(stamp, 256).alias("file_id"))


def file_fingerprints(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One fingerprint per table over its files."""
    # The sum of 60-bit prefixes does not depend on file order and needs no list of files in one place.
    part = F.conv(F.substring("file_id", 1, 15), 16, 10).cast("decimal(38,0)")
    return file_listing(spark, paths).groupBy("table_name").agg(
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string")), 256).alias("fingerprint")
    )


def content_fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """Order-free fingerprint of the rows: count and sum of row hashes (a sum keeps duplicate rows apart)."""
    per_table = [
        df.agg(
            F.count("*").alias("row_count"),
            F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("row_hash_sum"),
        ).select(F.lit(name).alias("table_name"), "row_count", "row_hash_sum")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, per_table)


def stale_tables(current: DataFrame, stored: DataFrame) -> DataFrame:
    """A table is stale when a fingerprint was stored for it and differs from the current one."""
    old = stored.select("table_name", F.col("fingerprint").alias("stored_fingerprint"))
    return current.join(old, "table_name", "left").withColumn(
        "is_stale",
        F.coalesce(F.col("stored_fingerprint") != F.col("fingerprint"), F.lit(False)),
    )
