"""How filters of a corpus interact: what each removes after any others, and whom it only repeats.

Every filter's failing rows are stored as a table of ids. What an order of filters does at a step depends only on the set of
filters before it, so all sets are asked at once: a failing id is dealt to the sets without its filter, and a second
relation names the ids that each set has removed already. A left-anti join of the two gives the removals of every
(set, filter), a left-semi join the redundancies; ids found among good or toxic labels by left-semi joins go through
the same anti join and give the label losses. Survivors are what removals leave. The sets are 32 however large the
corpus; the relations hold ids alone, are keyed by id, and no text is shuffled.

Copies of a text are found by SHA-256; a text that fills a third of the corpus is counted inside the tasks first, and
its rows meet their first id in ``SALTS`` parts.

Defined results: a null text is empty; a row without an id is no copy of another and has no label, a row is no copy of
one with the same id, and rows that are equal in all columns are rows each; a label row counts if any label row of the id has the
value; a null language is the empty string and one part with it; an empty table gives no rows. Other input columns, also
those named like a result column, do not matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scale import scratch_path, written

SALTS = 16

# The filters by letter and when a document fails them; E is identity with the text of a smaller id.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_points",
    "D": "has_symbol",
    "E": None,
}
LETTERS = "".join(FILTERS)
_BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
_EVERY = (1 << len(LETTERS)) - 1


def measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """One narrow row per document: a number of its own, id, part, digest of the text, and its filters A to D."""
    texts = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    worded = texts.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    facts = worded.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.length("text").cast("long").alias("n_points"),
        F.rlike("text", F.lit(r"[#$%&*|]")).alias("has_symbol"),
    )
    fails = F.array_compact(F.array(*[F.when(F.expr(test), letter) for letter, test in FILTERS.items() if test]))
    return written(facts.select("doc_id", "part", "digest", fails.alias("fails"), F.monotonically_increasing_id().alias("id")), "measured")


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    dealt = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["digest", "salt"]).where("doc_id > first").select(*rows.columns)


def failing(rows: DataFrame) -> DataFrame:
    """The stored id tables, one folder per filter: (filter, id, doc_id, part)."""
    kept = ["id", "doc_id", "part"]
    path = scratch_path(rows.sparkSession, "failing")
    own = rows.select(F.explode("fails").alias("filter"), *kept)
    own.unionByName(copies(rows).select(F.lit("E").alias("filter"), *kept)).write.partitionBy("filter").parquet(path)
    return rows.sparkSession.read.schema(own.select(*kept, "filter").schema).parquet(path)


def _sets(holds: bool) -> Column:
    """The sets of filters, as bits, that hold (or do not hold) a row's filter. Every row is known to the sixteen."""
    def of(letter):
        return F.array(*[F.lit(s) for s in range(_EVERY + 1) if bool(s & _BIT[letter]) == holds])

    chosen = of(LETTERS[-1])
    for letter in LETTERS[:-1]:
        chosen = F.when(F.col("filter") == letter, of(letter)).otherwise(chosen)
    return F.explode(chosen).alias("before")


def effects(tables: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, filter, before, removed, redundant, good_lost, toxic_lost) of every filter after every set of others."""
    ids = ["filter", "id", "part"]
    parts = [tables.select(*ids, F.lit("removed").alias("what"))]
    for what, column in (("good_lost", "quality"), ("toxic_lost", "toxic")):
        named = labels.where(F.col(column) == 1).select(F.col(key).alias("doc_id"))
        parts.append(tables.join(named, "doc_id", "left_semi").select(*ids, F.lit(what).alias("what")))
    asked = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("*", _sets(holds=False))
    # Sixteen sets per id compress well, so that a size measured by the shuffle would understate what a broadcast holds.
    gone = tables.select("id", _sets(holds=True)).hint("merge")
    counted = ["part", "filter", "before", "what"]
    lost = asked.join(gone, ["before", "id"], "left_anti").groupBy(*counted).agg(F.count(F.lit(1)).alias("n"))
    again = (
        asked.where("what = 'removed'").join(gone, ["before", "id"], "left_semi")
        .withColumn("what", F.lit("redundant")).groupBy(*counted).agg(F.count(F.lit(1)).alias("n"))
    )
    kinds = ("removed", "redundant", "good_lost", "toxic_lost")
    sums = [F.sum(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in kinds]
    return lost.unionByName(again).groupBy("part", "filter", "before").agg(*sums)


def audited(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", label_key: str = "doc_id"
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    rows = measured(docs, key, text, part)
    found = written(effects(failing(rows), labels, label_key), "effects")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    before = sum(F.when(F.instr(F.col("filter_order"), letter) < F.col("step"), bit).otherwise(0) for letter, bit in _BIT.items())
    plan = (
        rows.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
        .select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
        .select("*", F.substr("filter_order", F.col("step"), F.lit(1)).alias("filter"))
        .select("*", before.alias("before"))
    )
    alone = found.where(F.col("before") == _EVERY - sum(F.when(F.col("filter") == k, bit).otherwise(0) for k, bit in _BIT.items()))
    alone = alone.select("part", "filter", F.col("removed").alias("unique_fails"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    steps = plan.join(found, ["part", "filter", "before"], "left").join(alone, ["part", "filter"], "left")
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.sum(zero("removed")).over(so_far)).alias("kept"),
        *[zero(name).alias(name) for name in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")],
        F.sum(zero("removed")).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
