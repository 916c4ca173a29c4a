"""Words, lines and windows of whole texts as numpy arrays.

The texts of an Arrow column lie one after the other in one buffer. They are cut into chunks of documents of about
``CHUNK`` bytes, and all words of a chunk are found and hashed at once. A longer document is a chunk of its own and
is hashed piece by piece, so memory follows the number of its words, not a multiple of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 17

_BYTES = np.arange(256)
ASCII_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
AS_IS = _BYTES.astype(np.uint8)
# [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = ~((_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F)))
NOT_NEWLINE = _BYTES != 0x0A
CODE_POINT = (_BYTES & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words (or lines) of a chunk: number of the document in the chunk, byte bounds in the chunk, 64-bit hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins and the last one ends. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def give_back() -> None:
    """Return freed memory to the system, as a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, their bytes, their offsets) of chunks that cover the column."""
    if len(column) == 0:
        return
    data, offsets = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def _pieces(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about CHUNK bytes that cut no word."""
    start = 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        while end < len(data):
            gaps = np.flatnonzero(~is_word[data[start:end]][-CHUNK:])
            if len(gaps):
                end = end - min(CHUNK, end - start) + int(gaps[-1]) + 1
                break
            end = min(len(data), end + CHUNK)  # one word is longer than a piece
        yield start, end
        start = end


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the maximal runs of word bytes; a run ends with its document."""
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: differences of one running polynomial, each shifted to its own start."""
    if not len(data):
        return np.empty(0, np.uint64)
    if "powers" not in _tables or len(_tables["powers"]) <= len(data):
        size = max(len(data), 2 * CHUNK) + 1
        _tables["powers"] = _powers(_BASE, size)
        _tables["inverse"] = _powers(pow(_BASE, -1, 1 << 64), size)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _tables["powers"][: len(data)], out=running[1:])
    return mix((running[end] - running[start]) * _tables["inverse"][start] + (end - start).astype(np.uint64))


_tables: dict[str, np.ndarray] = {}


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = AS_IS) -> Words:
    """The words of a chunk, after folding each byte (``ASCII_LOWER`` or ``AS_IS``)."""
    if len(data) <= 2 * CHUNK:
        folded = fold[data]
        start, end = spans(folded, offsets, is_word)
        found = [(start, end, span_hashes(folded, start, end))]
    else:  # one long document
        found = []
        for a, b in _pieces(data, is_word):
            folded = fold[data[a:b]]
            start, end = spans(folded, np.array([0, b - a]), is_word)
            found.append((start + a, end + a, span_hashes(folded, start, end)))
    start, end, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, hashes.astype(np.uint64))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of every run of ``size`` consecutive words of one document."""
    count = len(found.doc) - size + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = found.hash[:count].copy()
    for j in range(1, size):
        total *= np.uint64(0xA0761D6478BD642F)
        total += found.hash[j : j + count]
    first = np.flatnonzero(found.doc[:count] == found.doc[size - 1 :])
    return first, mix(total[first])


def covered(first: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of ``count`` words lie in a run of ``size`` words that begins at one of ``first``."""
    steps = np.zeros(count + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _bounds(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) pairs without repeats, ordered by document, then hash. ``doc`` ascends."""
    hashes, bounds = hashes.copy(), _bounds(doc)
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashes[a:b].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]


def repeated(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (document, hash) pairs occur more than once. ``doc`` ascends."""
    marked, bounds = np.zeros(len(doc), bool), _bounds(doc)
    for a, b in zip(bounds[:-1], bounds[1:]):
        order = np.argsort(hashes[a:b])
        ordered = hashes[a:b][order]
        same = ordered[1:] == ordered[:-1]
        if same.any():
            marked[a + order[1:][same]] = True
            marked[a + order[:-1][same]] = True
    return marked


def per_document(doc: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=count).astype(np.int64)


def shingles(found: Words, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each of ``count`` documents; fewer words are one shingle as a whole."""
    first, hashes = windows(found, size)
    docs, values = [found.doc[first]], [hashes]
    n = per_document(found.doc, count)
    for length in range(1, size):
        short = np.flatnonzero(n == length)
        if len(short):
            at, whole = windows(found, length)
            keep = n[found.doc[at]] == length
            docs.append(found.doc[at[keep]])
            values.append(mix(whole[keep] + np.uint64(length)))
    doc, value = np.concatenate(docs), np.concatenate(values)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return distinct(doc, value)
