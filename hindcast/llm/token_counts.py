"""Token counts of whole texts by a public byte-level vocabulary, without moving a single pre-token between tasks.

The library's pre-tokenizer cuts a text into pieces, and each piece is encoded by itself, so a text has as many tokens
as its pieces together. Lengths are looked up where the text lies, in two tiers:

1. A table of frequent pieces goes to every task. One pass over all texts finds them with a mergeable sketch of
   bounded size; what is shuffled is the sketches. The table holds at most ``FREQUENT`` pieces of at most
   ``PIECE_CHARS`` characters, whatever the corpus.
2. Pieces that are not in it go to the library once and stay in a cache of the worker, which starts anew when it holds
   ``CACHE_CHARS`` characters.

Both tiers only spare work: the count of a piece is what the library says, wherever it is found.

Special strings inside texts count as the library's default has it: each is one token and cuts the text. Texts with
characters from ``LATER`` on are cut by the library itself, because Unicode versions differ there; others by the same
pattern, which is faster. Long texts are cut block by block, at a place where a piece begins.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; ties among frequent
pieces decide only which of them are sent; an empty table gives no rows. Other input columns, also those named like a
result column, do not matter: only the key and the text are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the first tier, of the sketch behind it and of the second tier.
FREQUENT = 1 << 12
TRACKED = 1 << 14
PIECE_CHARS = 32
CACHE_CHARS = 1 << 23
# Groups in which the sketches of tasks are merged first.
GROUPS = 32
# Characters of a long text that are cut at once.
BLOCK_CHARS = 1 << 18
# The first character whose class differs between versions of Unicode that are in use.
LATER = "԰"
LIMIT = 512

# How the byte-level pre-tokenizer cuts a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def special_strings(path: str) -> list[str]:
    """The special strings of a vocabulary file, which must be byte-level and free of rules that reach beyond a piece."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if not plain or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    added = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path} has special strings that take in what is around them")
    return [t["content"] for t in added]


class Counter:
    """Counts tokens of texts with a vocabulary file, a table of frequent pieces and a cache for the others."""

    def __init__(self, path: str, frequent: dict[str, int], cache_chars: int = CACHE_CHARS, block_chars: int = BLOCK_CHARS):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        self.library = Tokenizer.from_file(path)
        special = sorted(special_strings(path), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces, self.later = regex.compile(PIECES), regex.compile(f"[{LATER}-\U0010ffff]")
        self.begins = regex.compile(r"(?<=\S)\s")
        self.frequent, self.cache, self.cached_chars = frequent, {}, 0
        self.cache_chars, self.block_chars, self.asked = cache_chars, block_chars, 0

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(part) for part in parts if part)

    def _plain(self, text: str) -> int:
        cut = self._cut_by_library if self.later.search(text) else self.pieces.findall
        if len(text) <= self.block_chars:
            return self._lengths(cut(text))
        total, start = 0, 0
        while start < len(text):
            # A white space after another character begins a piece, and nothing before it looks beyond it.
            end = self.begins.search(text, start + self.block_chars)
            stop = end.start() if end else len(text)
            total += self._lengths(cut(text[start:stop]))
            start = stop
        return total

    def _cut_by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _lengths(self, pieces: list[str]) -> int:
        counts = list(map(self.frequent.get, pieces))
        if None not in counts:
            return sum(counts)
        missed = [p for p, n in zip(pieces, counts) if n is None]
        cache = self.cache
        new = [p for p in set(missed) if p not in cache]
        if new:
            self.asked += len(new)
            encoded = self.library.encode_batch(new, add_special_tokens=False)
            found = {p: len(e.ids) for p, e in zip(new, encoded)}
            chars = sum(map(len, new))
            if self.cached_chars + chars > self.cache_chars:
                # What this text needs stays until it is counted.
                cache, self.cached_chars = {p: cache[p] for p in set(missed) if p in cache}, 0
                self.cached_chars = sum(map(len, cache))
                self.cache = cache
            cache.update(found)
            self.cached_chars += chars
        return sum(n for n in counts if n is not None) + sum(map(cache.__getitem__, missed))


def frequent_pieces(docs: DataFrame, path: str, text: str = "text", keep: int = FREQUENT) -> dict[str, int]:
    """The most frequent pieces of all texts and their numbers of tokens: the driver sees ``keep`` of them at most."""
    pieces = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))).alias("piece"))
    short = pieces.where(F.length("piece") <= PIECE_CHARS)
    # The sketches of tasks are merged in groups before they meet.
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("group")
    partly = short.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(piece, {TRACKED})").alias("sketch"))
    # One group, which is not there if no text has a piece.
    whole = partly.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    found = whole.select(F.expr(f"approx_top_k_estimate(sketch, {keep})").alias("top")).collect()
    names = sorted(r["item"] for row in found for r in row["top"] or [])
    counter = Counter(path, {})
    return {name: counter.count(name) for name in names}


def counted(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, keep: int = FREQUENT
) -> DataFrame:
    """Per document: its key, n_bytes, n_tokens and whether they are more than ``limit``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, text, keep))

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path, table.value)
        for texts in batches:
            yield pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())

    tokens = F.arrow_udf(count, "long")(F.col(text))
    rows = docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens.alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
