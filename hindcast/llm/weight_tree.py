"""Sharding by a weighted hash tree.

A row descends from the root through region and rack to a shard. At each node every child draws
``-ln(u) / weight`` with a hash ``u`` of row key and child, and the smallest draw wins, so a child gets its share of the
weight of its siblings. The draw of a child does not look at its siblings: where the weight of a subtree changes,
rows move only into it or out of it. A new shard opens a region of its own, hence no other weight changes and rows
move into the new shard only.

The draws are a few hash calls per row, no shuffle. Slots number the rows of a shard without gaps: equal
narrow rows are counted first, rows are dealt into hash buckets of a shard, numbered within each, and shifted by
the rows of the buckets before, so no task holds a shard.

Defined results: a null key is a key; a null text counts as empty; equal rows get slots of their own; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scale import written

# Rows of one hash bucket of a shard, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A subtree with its path; a leaf has the number of its shard and its own weight."""

    path: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, planned: int = 16, racks: int = 2, rack_shards: int = 4, weights: dict[int, float] | None = None) -> Node:
    """The first ``planned`` shards in regions of ``racks`` racks of ``rack_shards``; each later shard is a region."""
    weights = weights or {}

    def leaf(path: str, shard: int) -> Node:
        return Node(f"{path}/shard{shard}", shard=shard, own_weight=weights.get(shard, 1.0))

    first, regions = min(shards, planned), []
    for r, start in enumerate(range(0, first, racks * rack_shards)):
        region, members = f"/region{r}", []
        for k, at in enumerate(range(start, min(first, start + racks * rack_shards), rack_shards)):
            rack = f"{region}/rack{k}"
            members.append(Node(rack, tuple(leaf(rack, s) for s in range(at, min(first, start + (k + 1) * rack_shards)))))
        regions.append(Node(region, tuple(members)))
    for shard in range(first, shards):
        region = f"/added{shard}"
        regions.append(Node(region, (Node(f"{region}/rack0", (leaf(f"{region}/rack0", shard),)),)))
    return Node("", tuple(regions))


def _draw(key: Column, child: Node) -> Column:
    # 53 bits of the hash as a number above 0 and at most 1
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.path)), 11) + F.lit(1)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(child.weight)


def shard_of(key: Column, node: Node) -> Column:
    """Number of the shard that ``key`` descends to."""
    if not node.children:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return shard_of(key, children[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(children)])
    chosen = F.array_min(draws)["child"]
    below = [shard_of(key, c) for c in children]
    # The draws of this node are made once; the branches below are evaluated only where chosen.
    if all(not c.children for c in children):
        return F.element_at(F.array(*below), chosen + 1)
    expression = F.when(chosen == 0, below[0])
    for i, column in enumerate(below[1:], start=1):
        expression = expression.when(chosen == i, column)
    return expression


def slotted(rows: DataFrame, shard: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each shard, in the order of a hash of the row."""
    names = [c for c in rows.columns if c != "slot"]
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    counted = written(counted.withColumn("_hash", F.xxhash64(*names)), "sharded")
    total = counted.agg(F.sum("_copies")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_rows))
    counted = counted.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy(shard, "_bucket")
        .agg(F.sum("_copies").alias("_rows"))
        .select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy("_hash", *names).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("_within", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
        .join(starts, [shard, "_bucket"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(*names, (F.col("_start") + F.col("_within") + F.col("_copy")).alias("slot"))
    )


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", **layout) -> DataFrame:
    """Key, size, checksum, shard and slot of every document, and its shard with one shard more."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree(shards, **layout)).alias("shard"),
        shard_of(F.col(key), tree(shards + 1, **layout)).alias("grown_shard"),
    )
    return slotted(rows)
