"""Appending line-delimited JSON and writing one-document JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows as JSON lines; every task writes its own files."""
    writer = df.write.mode("append").option("ignoreNullFields", False)
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """Replace a one-row document (run state, evaluation summary)."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
