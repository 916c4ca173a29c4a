"""Quality rules with host verdicts.

Every document is measured once. The failures of each rule are summed per host, each host's rate is shrunk towards
the rates of all hosts by a beta prior fitted to them (moments), and a host with a rate above the limit loses all of
its documents. The measures are numpy over Arrow batches; hosts are one aggregate with map-side sums, so a host with
a third of all rows leaves each task as one row, and the verdicts come back by a join that Spark broadcasts when the
hosts are few and splits when one of them is large.

Defined results: a null or empty text has no words and fails ``short``; a null host is a host of its own; repeated
rows count and stay as often as they occur; an empty table gives no rows. Input columns named like a result column
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scale import written
from hindcast.llm import text as tx

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

# Rule: true where a document fails it. The first two reject a document by themselves.
RULES = {
    "short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE_RULES = ("short", "repetitive")
HOST_LIMIT = 0.5
# Strength of the prior, in documents: the fitted one within these bounds.
STRENGTH = (1.0, 10_000.0)


def _measure(texts: pa.Array) -> pa.Array:
    columns = {name: [] for name in MEASURES}
    for first, last, data, offsets in tx.chunks(texts):
        count = last - first
        found = tx.words(data, offsets, tx.NOT_SPACE)
        doc_of_byte = np.searchsorted(offsets, np.flatnonzero(_SYMBOLS[data]), "right") - 1
        points = np.concatenate(([0], np.cumsum(tx.CODE_POINT[data] & tx.NOT_SPACE[data])))
        columns["n_words"].append(tx.per_document(found.doc, count))
        columns["word_chars"].append(points[offsets[1:]] - points[offsets[:-1]])
        columns["n_symbols"].append(tx.per_document(doc_of_byte, count))
        at, hashes = tx.windows(found, WINDOW)
        again = at[tx.repeated(found.doc[at], hashes)]
        covered = found.doc[tx.covered(again, WINDOW, len(found.doc))]
        columns["n_repeat_words"].append(tx.per_document(covered, count))
        lines = tx.words(data, offsets, tx.NOT_NEWLINE)
        upto = np.concatenate(([0], np.cumsum(tx.NOT_SPACE[data])))
        filled = upto[lines.end] > upto[lines.start]
        doc, line = lines.doc[filled], lines.hash[filled]
        total = tx.per_document(doc, count)
        columns["n_lines"].append(total)
        columns["n_dup_lines"].append(total - tx.per_document(tx.distinct(doc, line)[0], count))
    arrays = [pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()) for parts in columns.values()]
    return pa.StructArray.from_arrays(arrays, list(columns))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one long column per measure."""
    docs = docs.drop(*MEASURES)
    measure = F.arrow_udf(_measure, ", ".join(f"{name} long" for name in MEASURES))
    return docs.withColumn("_m", measure(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns], "_m.*")


def host_rates(rows: DataFrame, host: str, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per host: documents, and per rule the failures and their shrunk rate."""
    counts = rows.groupBy(host).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(F.expr(f"CASE WHEN {test} THEN 1 ELSE 0 END")).alias(f"{rule}_failures") for rule, test in rules.items()],
    )
    counts = written(counts, "hosts")
    prior = counts.agg(
        *[F.avg(F.col(f"{r}_failures") / F.col("documents")).alias(f"{r}_mean") for r in rules],
        *[F.var_pop(F.col(f"{r}_failures") / F.col("documents")).alias(f"{r}_variance") for r in rules],
    )  # one row
    return counts.join(F.broadcast(prior)).select(
        host, "documents", *[f"{r}_failures" for r in rules], *[_shrunk(r).alias(f"{r}_rate") for r in rules]
    )


def _shrunk(rule: str) -> Column:
    mean, variance = F.col(f"{rule}_mean"), F.col(f"{rule}_variance")
    fitted = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(F.lit(STRENGTH[1]))
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), fitted))
    return (F.col(f"{rule}_failures") + mean * strength) / (F.col("documents") + strength)


def judged(
    docs: DataFrame, host: str = "source", text: str = "text", rules: dict[str, str] = RULES, limit: float = HOST_LIMIT
) -> DataFrame:
    """``docs`` without their text, with measures, ``base_failed``, ``host_rejected`` and ``kept``."""
    rows = measured(docs, text).drop(text, "base_failed", "host_rejected", "kept")
    rows = written(rows.withColumn("base_failed", F.expr(" OR ".join(f"({rules[r]})" for r in BASE_RULES))), "measured")
    rates = host_rates(rows, host, rules)
    rejected = F.greatest(*[F.col(f"{r}_rate") for r in rules]) > limit
    verdicts = written(rates.select(F.col(host).alias("_host"), rejected.alias("host_rejected")), "host_verdicts")
    return (
        rows.join(verdicts, F.col(host).eqNullSafe(F.col("_host")))
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )
