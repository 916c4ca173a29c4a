"""Size checks and lineage cuts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a narrow relation (keys, cutoffs, short texts) that every executor can hold.
BROADCAST_ROWS = 200_000
# Rows of a part that ``spread`` deals.
SPREAD_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if counting it (up to the bound) proves it small, else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input anew if a few of its parts hold most of them; a large input in even parts stays where it lies.

    A file may be cut into many parts and still be read by one: a part without the middle of a row group gets no rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    one = held.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    if one["rows"] is None or one["largest"] * cores <= 2 * one["rows"]:
        return df
    return written(df.repartition(max(cores, -(-one["rows"] // SPREAD_ROWS))), "spread")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master else a folder beside the warehouse tables."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
        folder = spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/hindcast-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table an operator has to write; all paths of a run have one root."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this run wrote to the shared folder. Call it when no result of the run is read any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there.

    The rows survive lost executors, are computed once however often they are read, and their size is known to the
    planner, which then broadcasts what is small and shuffles what is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Continue from a written copy of ``df``."""
    return written(df, "cut")


def small_relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known to the driver (names, schemas, cutoffs) as a relation the optimizer knows the size of."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us")}
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table({n: pa.array(list(c), types[t]) for (n, t), c in zip(fields, columns)})
    return spark.createDataFrame(table, schema=StructType.fromDDL(schema))
