"""Memory search and replacement, logs, cascading deletes and audits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import fixed_values as fixed
from hindcast.functions.columns import quoted, words_of
from hindcast.functions.scale import broadcast_if_small, spread, written
from hindcast.operators.cutoffs import time_literal


# Rows (asked words, matches of words and tokens) that every executor can hold.
BROADCAST_WORDS = 500_000
# Characters of the pieces words are looked up by; shorter words have a way of their own.
GRAM = 3
# Up to this many pieces that the words of a scope are looked up by go beside each text of the scope.
LISTED_GRAMS = 2_000
# Up to this many words shorter than that are looked for in the texts themselves.
LISTED_WORDS = 1_000
# Parts in which the entries of one (scope, word) meet the queries that ask it, once those are too many to be held.
SALTS = 16


def search_memory(
    entries: DataFrame,
    queries: DataFrame,
    results: int = fixed.MEMORY_RESULTS,
    summary_type: str = fixed.SUMMARY_MEMORY_TYPE,
) -> DataFrame:
    """Keyword search of many queries at once, each in its own scope.

    ``entries``: entry_id, scope, memory_type, content. ``queries``: query_id, scope, query. The score is the number of
    distinct query words found anywhere in "type content". The ten best entries of the scope (ties by id) stay if they
    scored or are summaries.

    Texts are indexed by their trigrams, but only by those that words are looked up by: a word meets the entries of its
    scope that hold its rarest trigram, and what it meets is checked. A query and an entry meet only if they share a
    word. An entry that scored nothing can be among the ten best only if
    it is among the ten first of its scope, so only those are ranked besides the ones that scored.
    """
    asked = queries.select("query_id", "scope", F.explode(words_of(F.col("query"))).alias("word"))
    asked = written(asked, "asked")
    is_short = F.length("word") < GRAM
    sizes = asked.agg(
        F.count("*").alias("words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars"),
        F.count_distinct(F.when(is_short, F.col("word"))).alias("short"),
    ).first()
    found = _hits(entries, asked, sizes)
    first = Window.partitionBy("scope").orderBy("entry_id")
    leading = (
        entries.select("scope", "entry_id")
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= results)
        .drop("place")
    )
    # At most ``results`` rows a query.
    silent = (
        queries.select("query_id", "scope").join(leading, "scope").select("query_id", "entry_id")
        .join(found, ["query_id", "entry_id"], "left_anti")
        .withColumn("score", F.lit(0).cast("long"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("entry_id"))
    ranked = found.unionByName(silent).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= results)
    # Only what made a page gets its type.
    ranked = written(ranked.join(queries.select("query_id", "scope"), "query_id"), "ranked")
    shown = entries.select("entry_id", "scope", "memory_type").join(broadcast_if_small(ranked), ["entry_id", "scope"])
    shown = shown.select("query_id", "entry_id", "scope", "memory_type", "score", "place")
    return shown.filter((F.col("score") > 0) | (F.col("memory_type") == summary_type))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def rarest_pieces(words: DataFrame, texts: DataFrame, few: bool = False) -> DataFrame:
    """(word, gram): of the pieces of each word of ``GRAM`` characters or more, the one that the fewest texts hold.

    ``words``: word, distinct. ``texts``: haystack. Pieces that no word has are dropped where they are cut; ``few`` tells
    that those of all words fit in every task.
    """
    held = F.broadcast if few else lambda df: df
    pieces = words.filter(F.length("word") >= GRAM).select("word", F.explode(_grams(F.col("word"), GRAM)).alias("gram"))
    found = texts.select(F.explode(_grams(F.col("haystack"), GRAM)).alias("gram"))
    frequency = found.join(held(pieces.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A piece that no text holds is the rarest, and its word is found nowhere.
    rarest = F.expr("min_by(gram, struct(coalesce(texts, 0L), gram))").alias("gram")
    return pieces.join(frequency, "gram", "left").groupBy("word").agg(rarest)


def _hits(entries: DataFrame, asked: DataFrame, sizes: Row) -> DataFrame:
    """(query_id, entry_id, score) of queries and entries of one scope that share a word.

    ``sizes``: how many words are asked, their characters, and how many different ones are short. They bound the scopes,
    the pieces and the index.
    """
    ids = ["entry_id", "scope"]
    few = sizes["words"] <= BROADCAST_WORDS
    held = F.broadcast if few else lambda df: df
    haystack = F.lower(F.concat_ws(" ", "memory_type", "content")).alias("haystack")
    texts = spread(entries.join(held(asked.select("scope").distinct()), "scope", "left_semi").select(*ids, haystack))
    words = asked.select("word").distinct()
    index = asked.select("scope", "word").distinct().join(rarest_pieces(words, texts, sizes["chars"] <= BROADCAST_WORDS), "word")
    index = index.groupBy("scope", "gram").agg(F.collect_list("word").alias("words"))
    pieces = _grams(F.col("haystack"), GRAM)
    if few:
        # The text stays beside its pieces, and what an entry might hold is looked for at once. As every piece takes a copy of
        # the text along, those that no word of the scope is looked up by are left out before, where their list is short.
        index = written(index, "index")
        listed = index.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.collect_list("gram").alias("_listed"))
        listed = F.broadcast(listed.filter(F.col("n") <= LISTED_GRAMS).select("scope", "_listed"))
        own = F.when(F.col("_listed").isNull(), pieces).otherwise(F.array_intersect("_listed", pieces))
        met = texts.join(listed, "scope", "left").select(*ids, "haystack", F.explode(own).alias("gram"))
        met = met.join(F.broadcast(index), ["scope", "gram"])
        present = met.select(*ids, "haystack", F.explode("words").alias("word")).filter(F.contains("haystack", "word"))
    else:
        met = texts.select(*ids, F.explode(pieces).alias("gram")).join(index, ["scope", "gram"])
        possible = met.groupBy(*ids).agg(F.flatten(F.collect_list("words")).alias("words"))
        both = texts.join(possible.select("entry_id", "scope", "words"), ["entry_id", "scope"])
        present = both.select(*ids, F.explode(F.filter("words", lambda w: F.contains("haystack", w))).alias("word"))
    present = present.select(*ids, "word").unionByName(_short_hits(texts, words, ids, sizes["short"]))
    if few:
        pairs = present.join(F.broadcast(asked), ["scope", "word"])
    else:
        salted = present.withColumn("_salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int"))
        dealt = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = salted.join(dealt, ["scope", "word", "_salt"])
    scored = pairs.groupBy("query_id", "entry_id").agg(F.count(F.lit(1)).alias("score"))
    return written(scored, "hits")


def _short_hits(texts: DataFrame, words: DataFrame, ids: list[str], count: int) -> DataFrame:
    """(ids, word) of the words shorter than ``GRAM``: a few are looked for in each text, many meet its pieces of their size."""
    short = words.filter(F.length("word") < GRAM)
    if count <= LISTED_WORDS:
        each = F.array(*[F.lit(r["word"]) for r in short.collect()] if count else []).cast("array<string>")
        return texts.select(*ids, F.explode(F.filter(each, lambda w: F.contains("haystack", w))).alias("word"))
    held = F.array_union(*[_grams(F.col("haystack"), size) for size in range(1, GRAM)])
    return texts.select(*ids, F.explode(held).alias("word")).join(short, "word", "left_semi").select(*ids, "word")


def replace_memory(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored entries with the new ones put in: per key only the newest version stays.

    Versions are unique within a key. Only keys and versions are shuffled to find the newest; contents move once.
    """
    both = stored.unionByName(new)
    newest = both.groupBy(*keys).agg(F.max(version).alias(version))
    return both.join(broadcast_if_small(newest), [*keys, version], "left_semi")


def load_summary(entries: DataFrame, scope: str, summary_type: str = fixed.SUMMARY_MEMORY_TYPE) -> DataFrame:
    return entries.filter((F.col("scope") == scope) & (F.col("memory_type") == summary_type)).select("content")


def log_page(log: DataFrame, time: str, id_column: str, limit: int, offset: int) -> DataFrame:
    """Newest first, one page. A top-k of offset + limit rows per task; the log is not sorted as a whole."""
    return log.orderBy(F.desc(time), F.asc(id_column)).offset(offset).limit(limit)


# Rows of a range of a stored log, about what one page or two may have to read.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class StoredLog:
    """A log stored in ranges from its newest row to its oldest, with what each range holds."""

    path: str
    schema: T.StructType
    time: str
    id_column: str
    ranges: tuple[tuple[int, int, datetime, datetime], ...]  # number, rows, newest, oldest

    def read(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """The rows of some ranges; no other file is opened."""
        stored = spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(self.path)
        return stored.filter(F.col("_range").isin(numbers)).drop("_range")

    def page(self, spark: SparkSession, limit: int, offset: int) -> DataFrame:
        """Newest first, from any offset on. The counts tell which ranges hold the page and where it begins in them."""
        wanted, before, skipped = [], 0, 0
        for number, rows, _newest, _oldest in self.ranges:
            if before + rows <= offset:
                skipped = before + rows
            elif before < offset + limit:
                wanted.append(number)
            before += rows
        rows = self.read(spark, wanted).orderBy(F.desc(self.time), F.asc(self.id_column))
        return rows.offset(max(0, offset - skipped)).limit(limit)

    def page_after(self, spark: SparkSession, time: datetime, last_id, limit: int) -> DataFrame:
        """The page that follows the row with this time and id: rows that come before it are not counted again.

        A range that begins after the row is read only as far as the ranges before it may leave the page short.
        """
        wanted, sure = [], 0
        for number, rows, newest, oldest in self.ranges:
            if oldest > time or sure >= limit:
                continue
            wanted.append(number)
            sure += rows if newest < time else 0
        at, key = F.col(quoted(self.time)), F.col(quoted(self.id_column))
        moment = time_literal(time)
        rows = self.read(spark, wanted).filter((at < moment) | at.isNull() | ((at == moment) & (key > F.lit(last_id))))
        return rows.orderBy(F.desc(self.time), F.asc(self.id_column)).limit(limit)


def store_log(log: DataFrame, time: str, id_column: str, path: str, range_rows: int = RANGE_ROWS) -> StoredLog:
    """Write ``log`` in ranges of about ``range_rows`` rows, newest first. Rows without a time come last, as pages have them.

    The driver sees four numbers per range. A time that many rows share is cut by id.
    """
    spark = log.sparkSession
    parts = max(1, -(-log.count() // range_rows))
    order = [F.desc_nulls_last(time), F.asc(id_column)]
    ranged = log.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_range").parquet(path)
    stored = spark.read.schema(T.StructType([*log.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    known = stored.groupBy("_range").agg(
        F.count("*").alias("n"), F.count(time).alias("timed"), F.max(time).alias("newest"), F.min(time).alias("oldest")
    ).collect()
    lowest = datetime.min
    ranges = sorted((r["_range"], r["n"], r["newest"] or lowest, r["oldest"] if r["timed"] == r["n"] else lowest) for r in known)
    return StoredLog(path, log.schema, time, id_column, tuple(ranges))


@dataclass(frozen=True)
class Reference:
    """Column of a table that holds keys of another one (or of its own)."""

    table: str
    column: str
    target: str


def reference_levels(tables: list[str], references: list[Reference]) -> list[list[str]]:
    """The tables in an order in which each follows what it refers to; tables of a cycle come together, as one level."""
    left, levels = sorted(tables), []
    while left:
        free = [t for t in left if not any(r.table == t and r.target in left for r in references)]
        levels += [[t] for t in free] if free else [left]
        left = [t for t in left if t not in free] if free else []
    return levels


def delete_closure(
    tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], deleted: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """The tables after some rows are deleted with everything that refers to them, directly or not.

    ``keys`` names the key of each table that is referred to, ``deleted`` holds ids (one column) by table. Every table is
    read once its targets are settled, and the keys of its rows that go drive the next level; tables that refer to each
    other are gone over until no new id turns up. Only keys move; a null reference keeps its row.
    """
    gone: dict[str, DataFrame] = {
        name: written(ids.select(F.col(quoted(ids.columns[0])).alias("_id")).filter("_id IS NOT NULL").distinct(), "deleted")
        for name, ids in deleted.items()
    }

    def dependents(name: str, among: dict[str, DataFrame]) -> DataFrame | None:
        """Keys of rows of a table that refer to ids among those given."""
        found = [
            tables[name].select(F.col(quoted(keys[name])).alias("_id"), F.col(quoted(r.column)).alias("_to"))
            .join(broadcast_if_small(among[r.target].select(F.col("_id").alias("_to"))), "_to", "left_semi").select("_id")
            for r in references
            if r.table == name and r.target in among
        ]
        return union_all(found).filter("_id IS NOT NULL").distinct() if found else None

    for level in reference_levels(list(tables), references):
        fresh = dict(gone)
        while True:
            added = {}
            for name in [n for n in level if n in keys]:
                ids = dependents(name, fresh)
                if ids is not None:
                    ids = written(ids.join(gone[name], "_id", "left_anti") if name in gone else ids, "dependents")
                    if not ids.isEmpty():
                        added[name] = ids
            for name, ids in added.items():
                gone[name] = gone[name].unionByName(ids) if name in gone else ids
            fresh = added
            if not any(r.table in level and r.target in added for r in references):
                break
    left = {}
    for name, df in tables.items():
        conditions = [(keys[name], name)] if name in keys and name in gone else []
        conditions += [(r.column, r.target) for r in references if r.table == name and r.target in gone]
        for column, target in conditions:
            ids = broadcast_if_small(gone[target])
            df = df.join(ids, F.col(quoted(column)) == F.col("_id"), "left_anti")
        left[name] = df
    return left


def cascade_delete(
    tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, id_column: str
) -> dict[str, DataFrame]:
    """The tables without the rows whose reference column holds a deleted id; a null reference stays."""
    ids = written(deleted.select(F.col(quoted(id_column)).alias("_deleted")).distinct(), "deleted")
    ids = broadcast_if_small(ids)
    return {
        name: df.join(ids, F.col(quoted(reference)) == F.col("_deleted"), "left_anti")
        for name, (df, reference) in tables.items()
    }


def query_audit(fact_rows: DataFrame, user_id: str, database_id: str, skipped: DataFrame | None = None) -> DataFrame:
    """An audit row per query of every sample: ``success`` with its row count, ``failed`` with the error of that one query, or
    ``skipped`` if its table is not there (``skipped``, see ``evidence.skipped_queries``). A batch job has no time-outs of
    single queries.
    """
    failed = F.col("error").isNotNull()
    ran = fact_rows.select(
        "sample_id",
        "query_ordinal",
        "sql",
        "purpose",
        F.when(~failed, F.col("row_count")).alias("row_count"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("error").alias("error_message"),
    )
    if skipped is not None:
        ran = ran.unionByName(
            skipped.select(
                "sample_id", "query_ordinal", F.lit(None).cast("string").alias("sql"), "purpose",
                F.lit(None).cast("long").alias("row_count"), F.lit("skipped").alias("status"), F.col("error").alias("error_message"),
            )
        )
    return ran.select(F.lit(user_id).alias("user_id"), F.lit(database_id).alias("database_id"), *ran.columns)


def forbidden_words(sql: Column) -> dict[str, Column]:
    """Write and DDL words in a statement: anywhere in its text, and as whole words.

    The text is folded once for all words, and only a statement that holds some word is split. What is a whole word is
    also found anywhere, so it is looked for among those.
    """
    text, none = F.upper(sql), F.array().cast("array<string>")
    held = F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in fixed.FORBIDDEN_WORDS])
    # The lists keep the order of the words; both functions are compiled, which those that take a lambda are not.
    anywhere = F.array_except(held, F.array(F.lit(None).cast("string")))
    tokens = F.coalesce(F.split(text, "[^A-Z0-9_]+"), none)
    return {
        "found_anywhere": anywhere,
        "found_as_words": F.when(F.size(anywhere) > 0, F.array_intersect(anywhere, tokens)).otherwise(none),
    }


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
