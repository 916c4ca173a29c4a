"""Mixing sources to target weights with a curriculum that changes over training time.

Each source has a target in words and a schedule, a piecewise linear weight over training time 0 to 1. The integral
of the schedule, scaled to the target, is the source's cumulative demand. The documents of a source stand in a hash
order; the words before a document, inverted through the demand, give the time at which it is drawn, and the demand of
all sources up to that time is its position in the training stream. The stream is range-sorted by position.

Targets: the words to take are shared by weight, no target exceeds ``MAX_REPEATS`` times its source's words, and what
is above is shared again until nothing is. A source whose target exceeds its words is passed twice.

The words before a document are a prefix sum over (source, hash bucket) cells, so a source with a third of all rows is
spread over many tasks; documents with their texts are shuffled once for the prefix sum and once for the sort.

Defined results: a null or empty text has size 0 and takes nothing (in the stream it stands once); a null source is a
source, ordered last; equal rows stand one after the other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions.scale import written
from hindcast.llm.order import numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 7
# Documents of a cell, about.
CELL_ROWS = 1000
# (time, weight) knots; a source takes the next one in turn. Rising, level, and first rising then falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)))
WORD = r"[^\x20\x09-\x0D]+"
WORK = ("_size", "_key", "_source", "_bucket", "_before", "_rank", "_source_size", "_target", "_start", "_limit")


@dataclass(frozen=True)
class Segment:
    """A linear piece of a schedule whose whole area is 1: times, weight at its start, slope, area before it."""

    start: float
    end: float
    weight: float
    slope: float
    before: float

    @property
    def upto(self) -> float:
        dt = self.end - self.start
        return self.before + self.weight * dt + self.slope * dt * dt / 2


def segments(knots: tuple[tuple[float, float], ...]) -> list[Segment]:
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(Segment(t0, t1, w0 / area, (w1 - w0) / area / (t1 - t0), before))
        before = out[-1].upto
    return out


def time_of(share: Column, knots) -> Column:
    """The time by which a schedule has asked for ``share`` (0 to 1) of its demand."""
    pieces = segments(knots)
    expression = None
    for piece in reversed(pieces):
        left = share - F.lit(piece.before)
        root = F.sqrt(F.lit(piece.weight * piece.weight) + F.lit(2 * piece.slope) * left)
        at = F.lit(piece.start) + F.lit(2.0) * left / (F.lit(piece.weight) + root)
        expression = at if expression is None else F.when(share <= F.lit(piece.upto), at).otherwise(expression)
    return expression


def demand_at(time: Column, knots) -> Column:
    """Share of its demand that a schedule has asked for by ``time``."""
    expression = None
    for piece in reversed(segments(knots)):
        dt = time - F.lit(piece.start)
        share = F.lit(piece.before) + F.lit(piece.weight) * dt + F.lit(piece.slope / 2) * dt * dt
        expression = share if expression is None else F.when(time <= F.lit(piece.end), share).otherwise(expression)
    return expression


def _by_rank(choices: list[Column]) -> Column:
    turn = F.pmod(F.col("_rank"), F.lit(len(choices)))
    expression = choices[-1]
    for i, choice in enumerate(choices[:-1]):
        expression = F.when(turn == i, choice).otherwise(expression)
    return expression


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, repeats=MAX_REPEATS) -> tuple[DataFrame, float]:
    """``sources`` (_source, _source_size, _rank) with ``_target``, and the words per unit of weight behind it."""
    size, weight = F.col("_source_size"), _by_rank([F.lit(w) for w in weights])
    total = sources.agg(F.sum(size)).first()[0] or 0
    wanted, unit, capped = share * total, 0.0, -1
    while True:  # a few rows: each round caps at least one more source
        over = F.lit(unit) * weight > size * repeats
        row = sources.agg(
            F.sum(F.when(over, size * repeats).otherwise(0)).alias("full"),
            F.sum(F.when(over, 0).otherwise(weight)).alias("open"),
            F.sum(F.when(over, 1).otherwise(0)).alias("capped"),
        ).first()
        if not row["open"] or row["capped"] == capped:
            break
        capped, unit = row["capped"], (wanted - row["full"]) / row["open"]
    over = F.lit(unit) * weight > size * repeats
    return sources.withColumn("_target", F.when(over, (size * repeats).cast("double")).otherwise(F.lit(unit) * weight)), unit


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    repeats: int = MAX_REPEATS,
    schedules=SCHEDULES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and ``draws``, an array of (pass, words, time, position)."""
    docs = docs.drop("size", "source_size", "target", "taken", "draws", *WORK)
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / cell_rows)))
    content = F.coalesce(F.col(text), F.lit(""))
    identity = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(content.cast("binary")))
    placed = (
        docs.withColumn("_size", F.regexp_count(content, F.lit(WORD)).cast("long"))
        .withColumn("_key", F.md5(identity.cast("binary")))
        .withColumn("_source", F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("2")))  # null last
        .withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits))
    )
    cells = placed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_cell"))
    cells = written(cells, "cells")
    sizes = numbered(cells.groupBy("_source").agg(F.sum("_cell").alias("_source_size")), [F.col("_source").asc()], "_rank")
    wanted, _unit = targets(written(sizes, "sources"), weights, share, repeats)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0))).drop("_cell")
    plan = written(plan.join(wanted, "_source"), "plan")

    sums = {r["turn"]: r["words"] for r in wanted.groupBy(F.pmod("_rank", F.lit(len(schedules))).alias("turn")).agg(
        F.sum("_target").alias("words")).collect()}  # a row for each schedule
    within = Window.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        placed.join(plan, ["_source", "_bucket"])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .withColumn("_limit", F.floor("_target"))
    )

    def draw(number: int) -> Column:
        offset = F.col("_start") + F.col("_source_size") * number
        words = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_limit") - offset))
        asked = F.when(F.col("_target") > 0, offset / F.col("_target")).otherwise(F.lit(0.0))
        time = _by_rank([time_of(asked, knots) for knots in schedules])
        position = sum((F.lit(sums.get(i, 0.0)) * demand_at(F.col("_time"), knots) for i, knots in enumerate(schedules)), F.lit(0.0))
        return words, time, position

    for number in range(repeats):
        words, time, position = draw(number)
        rows = (
            rows.withColumn(f"_words{number}", words)
            .withColumn("_time", time)
            .withColumn(f"_draw{number}", F.struct(F.lit(number).alias("pass"), F.col(f"_words{number}").alias("words"),
                                                   F.col("_time").alias("time"), position.alias("position")))
        )
    draws = F.array(*[F.col(f"_draw{n}") for n in range(repeats)])
    stands = lambda d: (d["words"] > 0) | ((F.col("_size") == 0) & (d["pass"] == 0))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        sum((F.col(f"_words{n}") for n in range(1, repeats)), F.col("_words0")).alias("taken"),
        F.filter(draws, stands).alias("draws"),
        F.col("_key"),
    )


def stream(mix: DataFrame) -> DataFrame:
    """The training stream: every draw of at least half a document's words is a row, in the order of positions."""
    names = [c for c in mix.columns if c not in ("size", "source_size", "target", "taken", "draws", "_key")]
    drawn = mix.withColumn("_draw", F.explode("draws")).where(2 * F.col("_draw.words") >= F.col("size"))
    return drawn.orderBy("_draw.position", "_key").select(*[F.col(f"`{c}`") for c in names])
