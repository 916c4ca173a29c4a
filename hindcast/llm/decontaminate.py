"""Removing benchmark passages from documents.

The benchmark's word windows are hashed into a table that every task gets; a task hashes the windows of its documents,
looks them up, and compares the words of each hit with those of the benchmark, so only true occurrences count. Documents are
scanned where they lie and nothing is shuffled. A benchmark larger than ``BLOCK_BYTES`` goes through in blocks, each
within that bound; the scans follow one another over the same rows and add up what they hit.

Defined results: a null or empty text has no words and is clean; an item without words has no window; an item of
fewer words than a window is one window; items with equal texts are all named; repeated rows are judged each; an empty
benchmark leaves all documents clean. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import text as tx

WINDOW = 10
# Bytes of benchmark text whose windows are broadcast at once.
BLOCK_BYTES = 4 << 20
STATE = "n_words long, spans array<int>, items array<string>"
# Largest prefilter of a window length; fewer windows take a smaller one, of 16 places for each or more.
_FILTER_BITS = 22


class Windows:
    """Windows of benchmark items by length: sorted hashes, the words behind each, and the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, self.tables = size, {}
        found: dict[int, dict[int, tuple[bytes, set]]] = defaultdict(dict)
        names, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.string())
        for first, last, data, offsets in tx.chunks(texts):
            words = tx.words(data, offsets, tx.ALPHANUMERIC, tx.ASCII_LOWER)
            folded = tx.ASCII_LOWER[data].tobytes()
            count = tx.per_document(words.doc, last - first)
            for length in np.unique(np.minimum(count[count > 0], size)).tolist():
                at, hashes = tx.windows(words, length)
                whole = count[words.doc[at]] == length if length < size else np.ones(len(at), bool)
                for place, value in zip(at[whole].tolist(), hashes[whole].tolist()):
                    phrase = _phrase(folded, words, place, length)
                    # two phrases with one hash share a chain, so that each is compared
                    chain = found[length].setdefault(value, {})
                    chain.setdefault(phrase, set()).add(names[first + int(words.doc[place])])
        for length, table in found.items():
            keys = np.array(sorted(table), np.uint64)
            self.tables[length] = (keys, [table[int(k)] for k in keys], _prefilter(keys))

    def hits(self, data: np.ndarray, words: tx.Words):
        """(document, place of the first word, length, items) of every occurrence of a window."""
        folded = None
        for length, (keys, chains, maybe) in self.tables.items():
            at, hashes = tx.windows(words, length)
            possible = np.flatnonzero(maybe[_place(hashes, maybe)])
            if not len(possible):
                continue
            slot = np.minimum(np.searchsorted(keys, hashes[possible]), len(keys) - 1)
            equal = keys[slot] == hashes[possible]
            for place, k in zip(at[possible[equal]].tolist(), slot[equal].tolist()):
                folded = tx.ASCII_LOWER[data].tobytes() if folded is None else folded
                items = chains[k].get(_phrase(folded, words, place, length))
                if items:
                    yield int(words.doc[place]), place, length, items


def _phrase(folded: bytes, words: tx.Words, place: int, length: int) -> bytes:
    ends = zip(words.start[place : place + length].tolist(), words.end[place : place + length].tolist())
    return b" ".join(folded[a:b] for a, b in ends)


def _prefilter(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << min(_FILTER_BITS, (16 * len(keys)).bit_length()), bool)
    bits[_place(keys, bits)] = True
    return bits


def _place(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The place of each hash in a prefilter: its first bits."""
    return (hashes >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)


def _scan(windows: Windows, texts: pa.Array, earlier: pa.Array | None) -> pa.Array:
    count, spans, items = [], [], []
    before = earlier.to_pylist() if earlier is not None else None
    for first, last, data, offsets in tx.chunks(texts):
        words = tx.words(data, offsets, tx.ALPHANUMERIC, tx.ASCII_LOWER)
        n = tx.per_document(words.doc, last - first)
        start = np.cumsum(n) - n
        hit, named = defaultdict(list), defaultdict(set)
        for doc, place, length, found in windows.hits(data, words):
            hit[doc].append((place - int(start[doc]), place - int(start[doc]) + length))
            named[doc] |= found
        for doc in range(last - first):
            bounds, names = hit.get(doc, []), named.get(doc, set())
            if before is not None:
                old = before[first + doc]
                bounds = bounds + list(zip(old["spans"][::2], old["spans"][1::2]))
                names = names | set(old["items"])
            spans.append([x for pair in _merged(bounds) for x in pair])
            items.append(sorted(names))
        count.append(n)
    return pa.StructArray.from_arrays(
        [
            pa.array(np.concatenate(count) if count else np.empty(0, np.int64), pa.int64()),
            pa.array(spans, pa.list_(pa.int32())),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["n_words", "spans", "items"],
    )


def _merged(bounds: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(bounds):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Lists of (item, text), each of about ``block_bytes`` of text at most."""
    items = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    items = items.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(parts)))
    for part in range(parts):
        yield [(r["_item"], r["_text"]) for r in items.where(F.col("_part") == part).collect()]


def scanned(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``hits``: n_words, word spans (start, end, start, end, ...) and the items found."""
    rows = docs.drop("hits")
    for number, part in enumerate(blocks(benchmark, item, item_text, block_bytes)):
        rows = rows.withColumn("hits", _scanner(part, size, number > 0)(F.col(text), *([F.col("hits")] if number else [])))
    return rows


def _scanner(items: list[tuple[str, str]], size: int, continued: bool):
    def windows() -> Windows:
        if "windows" not in state:
            state["windows"] = Windows(items, size)
        return state["windows"]

    state: dict = {}
    if continued:
        def scan(texts: pa.Array, earlier: pa.Array) -> pa.Array:
            return _scan(windows(), texts, earlier)
    else:
        def scan(texts: pa.Array) -> pa.Array:
            return _scan(windows(), texts, None)
    return F.arrow_udf(scan, STATE)



def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: words, words inside windows, items found and a digest of their names."""
    rows = scanned(docs.select(key, text), benchmark, text, **options).select(key, "hits")
    inside = F.aggregate(F.transform("hits.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return rows.select(
        key,
        F.col("hits.n_words").alias("n_words"),
        inside.cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window."""
    return scanned(docs, benchmark, text, **options).where(F.size("hits.spans") == 0).drop("hits")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the words inside benchmark windows cut out of their texts."""
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out, found = [], hits.to_pylist()
        for first, last, data, offsets in tx.chunks(texts):
            words = tx.words(data, offsets, tx.ALPHANUMERIC, tx.ASCII_LOWER)
            begin = np.searchsorted(words.doc, np.arange(last - first))
            for doc in range(last - first):
                at, kept, bounds = int(offsets[doc]), [], found[first + doc]["spans"]
                for a, b in zip(bounds[::2], bounds[1::2]):
                    kept.append(data[at : words.start[begin[doc] + a]].tobytes())
                    at = int(words.end[begin[doc] + b - 1])
                out.append(b"".join([*kept, data[at : offsets[doc + 1]].tobytes()]).decode())
        return pa.array(out, pa.string())

    rows = scanned(docs, benchmark, text, **options)
    shortened = F.when(F.size("hits.spans") > 0, F.arrow_udf(cut, "string")(F.col(text), F.col("hits"))).otherwise(F.col(text))
    return rows.withColumn(text, shortened).drop("hits")
