"""Numbering rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scale import written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with column ``name``: 0, 1, 2, ... in the given order.

    Rows are dealt into ranges, numbered within each, and shifted by the rows of the ranges before.
    """
    names = [c for c in rows.columns if c != name]
    ranged = rows.select(*names).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_within", F.row_number().over(within))
        .join(F.broadcast(starts), "_range")
        .select(*names, (F.col("_start") + F.col("_within") - 1).alias(name))
    )
