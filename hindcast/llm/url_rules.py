"""URL rules by a sort-merge range join, in DataFrame functions only.

Hosts are written with their labels reversed, so the subdomains of a host are one interval of keys, and the paths that begin
with a prefix are another. Intervals of prefixes nest or are apart. Interval bounds and keys are sorted together
and swept: the depth is a running sum of opened and closed intervals, and the last interval opened at each depth up to it
is the stack of active rules. One sweep finds the rule hosts of every host, a second one the rule paths of every
path under each of these hosts.

The sweep is dealt into ranges of the key. An interval is opened again at the start of each further range it
covers, so the ranges are independent; only distinct keys are swept, and the rules come back to the pages by joins that Spark
broadcasts or splits. The number of window columns is the depth of the rules, which the labels of a host bound.

Defined results: a null URL, or one without ``://``, has an empty host and path and meets no rule; equal rules count once,
and of two with different verdicts ``block`` stands; repeated rows are judged each; pages without a rule get the
default verdict. An empty host in a rule fits every host.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scale import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Sorts after every character of a key.
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a character below all others, so that a host's key begins all its subdomains' keys."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001")))


def sweep(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``keys`` (key) with ``stack``, the ids of all ``prefixes`` (id, prefix) that the key begins with, shortest first.

    ``prefixes`` are distinct, and ids follow no order.
    """
    # kind orders what happens at one key: intervals end, then open from the shortest on, then keys are looked up
    opened = prefixes.select(F.col("prefix").alias("at"), F.lit(1).alias("kind"), F.length("prefix").alias("size"), "id", F.lit(1).alias("step"))
    closed = prefixes.select(F.concat("prefix", F.lit(LAST)).alias("at"), F.lit(0).alias("kind"), (-F.length("prefix")).alias("size"), "id", F.lit(-1).alias("step"))
    asked = keys.select(F.col("key").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("step"))
    events = opened.unionByName(closed).unionByName(asked).repartitionByRange("at").withColumn("range_no", F.spark_partition_id())
    events = written(events, "sweep")

    # open again in each further range that an interval covers, before all else
    last = events.where("kind = 0").select("id", F.col("range_no").alias("last"))
    carried = (
        events.where("kind = 1").join(last, "id").where("range_no < last")
        .withColumn("range_no", F.explode(F.sequence(F.col("range_no") + 1, F.col("last"))))
        .select(F.lit("").alias("at"), F.lit(-1).alias("kind"), "size", "id", "step", "range_no")
    )
    events = events.unionByName(carried)
    order = Window.partitionBy("range_no").orderBy("at", "kind", "size", "id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("depth", F.sum("step").over(running))
    deepest = depth_of(prefixes)
    levels = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("id")), ignorenulls=True).over(running) for d in range(1, deepest + 1)]
    swept = swept.withColumn("_levels", F.array(*levels) if levels else F.array().cast("array<long>"))
    return swept.where("kind = 2").select(F.col("at").alias("key"), F.slice("_levels", F.lit(1), F.col("depth").cast("int")).alias("stack"))


def depth_of(prefixes: DataFrame) -> int:
    """How many of the prefixes can nest: the largest number of them that begin one of them.

    Each prefix is joined to the prefixes it begins with by equality, over the lengths that occur.
    """
    sizes = sorted(r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    longer = prefixes.select("id", F.col("prefix").alias("whole"), F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")).alias("n"))
    begins = longer.where(F.length("whole") >= F.col("n")).select("id", F.expr("substring(whole, 1, n)").alias("prefix"))
    nested = begins.join(prefixes.select("prefix"), "prefix").groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    return nested.agg(F.max("depth")).first()[0] or 0


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Key, host, path, the longest rule that fits (host and path) and the verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    rules = written(rules, "rules")
    hosts = rules.select("rule_host").distinct().select(F.xxhash64("rule_host").alias("id"), "rule_host", host_key(F.col("rule_host")).alias("prefix"))
    hosts = written(hosts, "rule_hosts")
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.coalesce(F.col(url).contains("://"), F.lit(False)).alias("_whole"))
    places = written(rows.where("_whole").select("host", "path").distinct(), "places")

    under = sweep(places.select(host_key(F.col("host")).alias("key")).distinct(), hosts.select("id", "prefix"))
    under = under.select(F.col("key").alias("_key"), F.explode("stack").alias("id")).join(hosts.select("id", "rule_host"), "id")
    asked = places.withColumn("_key", host_key(F.col("host"))).join(under.select("_key", "rule_host"), "_key")
    asked = written(asked.select("host", "path", "rule_host"), "asked")

    # the rule host before the path, so that one sweep serves all rule hosts
    inside = lambda host, path: F.concat(host_key(F.col(host)), F.lit("\u0002"), F.col(path))
    prefixes = rules.select(F.xxhash64("rule_host", "rule_path").alias("id"), inside("rule_host", "rule_path").alias("prefix"), "rule_host", "rule_path", "verdict")
    prefixes = written(prefixes, "rule_paths")
    found = sweep(asked.select(inside("rule_host", "path").alias("key")).distinct(), prefixes.select("id", "prefix"))
    # prefixes of one rule host nest, so its longest is the last of the stack
    best = found.select("key", F.try_element_at("stack", F.lit(-1)).alias("id")).where("id IS NOT NULL").join(prefixes, "id").select("key", "rule_host", "rule_path", "verdict")
    chosen = asked.withColumn("key", inside("rule_host", "path")).join(best.drop("rule_host"), "key")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    chosen = written(chosen.groupBy("host", "path").agg(F.max(rank).alias("_best")).select("host", "path", "_best.rule", "_best.verdict"), "chosen")
    return rows.join(chosen, ["host", "path"], "left").select(
        key, "host", "path",
        F.when(F.col("_whole"), F.col("rule")).alias("rule"),
        F.coalesce(F.when(F.col("_whole"), F.col("verdict")), F.lit(default)).alias("verdict"),
    )
