"""Numbering of cutoff times, and the decomposition of "everything up to a cutoff" into equi-joins.

The distinct cutoffs c1 < c2 < ... split time into intervals (c[i-1], c[i]]. A row belongs to one interval. The rows
up to cutoff c[i] are those of intervals 1..i, and 1..i is the union of at most log2(n) aligned blocks of intervals.
A row is known to one block per level, a cutoff asks for one block per set bit of i, so "time <= cutoff" becomes an
equality of (level, block): no range join, no row copied per cutoff, and hot keys spread over blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.columns import quoted
from hindcast.functions.scale import BROADCAST_ROWS, small_relation, written

# Cutoffs a row is compared with where it lies, by halving: all of them while they are no more than this, else every n-th.
COMPARED = 64
# Parts in which the rows between two compared cutoffs meet the cutoffs in between.
SALTS = 16


@dataclass(frozen=True)
class CutoffIndex:
    """Distinct cutoffs of a sample set, numbered from 1, with the short summary the plans depend on."""

    cutoffs: DataFrame  # cutoff, idx
    count: int
    first: datetime | None
    last: datetime | None
    compared: tuple[tuple[datetime, int], ...]  # (cutoff, idx) of those rows are compared with, the last one included
    entities: int

    @property
    def levels(self) -> int:
        return max(1, self.count.bit_length())

    @property
    def swept(self) -> bool:
        """Whether there are more cutoffs than rows are compared with."""
        return len(self.compared) < self.count

    @property
    def small(self) -> bool:
        """Whether a row per cutoff fits on every executor."""
        return self.count <= BROADCAST_ROWS

    @property
    def few_entities(self) -> bool:
        return self.entities <= BROADCAST_ROWS // 2

    def broadcast(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def time_literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def index_cutoffs(samples: DataFrame) -> CutoffIndex:
    """Number the distinct cutoffs of ``samples``.

    Runs one job for a one-row summary and one to list the cutoffs that rows are compared with, ``COMPARED`` at most.
    """
    one = samples.agg(
        F.count_distinct("cutoff").alias("n"),
        F.min("cutoff").alias("first"),
        F.max("cutoff").alias("last"),
        F.approx_count_distinct("entity_id").alias("entities"),
    ).first()
    count = one["n"]
    distinct = samples.select("cutoff").filter(F.col("cutoff").isNotNull()).distinct()
    if count <= COMPARED:
        listed = [(c, i) for i, c in enumerate(sorted(r["cutoff"] for r in distinct.collect()), start=1)]
        numbered = small_relation(samples.sparkSession, listed, "cutoff timestamp_ntz, idx bigint")
    else:
        numbered = written(ranked(distinct, "cutoff", "idx"), "cutoffs")
        step = -(-count // COMPARED)
        chosen = numbered.filter((F.col("idx") % step == 0) | (F.col("idx") == count)).collect()
        listed = sorted((r["cutoff"], r["idx"]) for r in chosen)
    return CutoffIndex(numbered, count, one["first"], one["last"], tuple(listed), one["entities"])


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3, ... in the order of a column without repeats, and no task that sees all of them.

    Rows are dealt into ranges and numbered within each; what goes before a range is the sum of the ranges before, one
    number for each.
    """
    columns = rows.columns
    ranged = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    held = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for number, n in held:
        starts.append((number, total))
        total += n
    offsets = small_relation(rows.sparkSession, starts, "_range int, _start bigint")
    within = Window.partitionBy("_range").orderBy(order)
    numbered = ranged.withColumn("_within", F.row_number().over(within)).join(F.broadcast(offsets), "_range")
    return numbered.select(*columns, (F.col("_start") + F.col("_within")).alias(name))


def _by_halving(time: str, bounds: tuple[tuple[datetime, int], ...]) -> str:
    """SQL for the number beside the first bound that is not before ``time``; the last bound is not."""
    if len(bounds) == 1:
        return f"{bounds[0][1]}L"
    middle = len(bounds) // 2
    left, right = _by_halving(time, bounds[:middle]), _by_halving(time, bounds[middle:])
    return f"IF({time} <= TIMESTAMP_NTZ'{bounds[middle - 1][0].isoformat(sep=' ')}', {left}, {right})"


def with_interval(df: DataFrame, time_column: str, index: CutoffIndex) -> DataFrame:
    """Keep rows not later than the last cutoff and add ``idx``, the number of the first cutoff not before the row.

    A row is first compared with the listed cutoffs where it lies. If those are all, that is its interval. Otherwise the
    rows up to each listed cutoff are sorted together with the cutoffs among them, in parts that each get these cutoffs,
    and swept once: a row belongs to the next cutoff. However cutoffs cluster, a part holds the same number of them.
    """
    time = F.col(quoted(time_column))
    if index.last is None:
        return df.filter(F.lit(False)).withColumn("idx", F.lit(1).cast("long"))
    kept = df.filter(time <= time_literal(index.last))
    stretch = F.expr(_by_halving(f"CAST({quoted(time_column)} AS TIMESTAMP_NTZ)", index.compared))
    if not index.swept:
        return kept.withColumn("idx", stretch)
    columns = [F.col(quoted(c)) for c in df.columns]
    rows = kept.select(
        F.struct(*columns).alias("_row"), time.cast("timestamp_ntz").alias("_time"), stretch.alias("_stretch"),
        F.pmod(F.xxhash64(*[c for c, f in zip(columns, df.schema.fields) if f.dataType.typeName() != "map"]), F.lit(SALTS)).cast("int").alias("_salt"),
        F.lit(None).cast("long").alias("_idx"),
    )
    marks = index.cutoffs.select(
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("cutoff").alias("_time"),
        F.expr(_by_halving("cutoff", index.compared)).alias("_stretch"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.col("idx").alias("_idx"),
    )
    # From the latest backwards, a cutoff before the rows of its own time: the last number seen is the next cutoff's.
    swept = Window.partitionBy("_stretch", "_salt").orderBy(F.desc("_time"), F.desc_nulls_last("_idx"))
    swept = swept.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.unionByName(marks).withColumn("idx", F.last("_idx", ignorenulls=True).over(swept))
    return placed.filter(F.col("_row").isNotNull()).select("_row.*", "idx")


def blocks_holding(idx: str, levels: int) -> str:
    """SQL for the (level, block) pairs interval ``idx`` belongs to, one per level, as far as any cutoff asks for them.

    Only even blocks are ever asked for.
    """
    blocks = ", ".join(f"named_struct('level', {l}, 'block', shiftright({idx} - 1, {l}))" for l in range(levels))
    return f"filter(array({blocks}), b -> b.block % 2 = 0)"


def blocks_up_to(idx: str, levels: int) -> str:
    """SQL for the disjoint blocks whose union is the intervals 1..idx: one per set bit."""
    blocks = ", ".join(f"named_struct('level', {l}, 'block', shiftright({idx}, {l}) - 1)" for l in range(levels))
    return f"filter(array({blocks}), b -> b.block % 2 = 0)"
