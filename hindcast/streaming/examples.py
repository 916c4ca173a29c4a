"""Exporting training examples while episodes are still being appended.

The trajectory log grows as JSON files. This job reads the new files, turns each trajectory into the example of the
role it trains and appends it under ``target_role=<role>``. The checkpoint folder remembers what was read, so a
restart neither loses nor repeats an episode's example.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hindcast.operators.training import EXAMPLES


def example_lines(episodes: DataFrame) -> DataFrame:
    """(target_role, value): one JSON line per episode, the example of its own role."""
    parts = []
    for role, build in EXAMPLES.items():
        example = build(episodes.filter(F.col("target_role") == role))
        parts.append(example.select(F.lit(role).alias("target_role"), F.to_json(F.struct("*")).alias("value")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def export_examples(
    spark: SparkSession, log: str, schema: T.StructType, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start the export. ``available_now`` stops after the files that are there; otherwise it runs on.

    Files are taken by the thousand so that micro-batches stay bounded.
    """
    episodes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(log)
    writer = (
        example_lines(episodes)
        .writeStream.format("text")
        .partitionBy("target_role")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
