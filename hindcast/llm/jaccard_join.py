"""Exact similarity join of word-shingle sets by token-combination prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches a ratio. The tokens (shingles) of a
document are put in one global order: rare classes first, by a hash within a class. A linked partner lacks at most
``d`` of a document's n tokens, so some ``d + 1`` of its first tokens must be shared. Rare tokens are indexed one by one. In a
frequent class one token says little, so k-token combinations are indexed instead, within cells of the hash range, and
the prefix is extended until the tokens of all cells beyond the first k - 1 number ``d + 1``: then one cell keeps k shared
tokens whichever ``d`` are lacking. The cells follow the size of the larger of two documents, so a document is indexed for the
cells of its own size and of every larger one a partner may have. Small cells give few combinations, but each loses k - 1
tokens: a document that does not reach ``d + 1`` is indexed for cells twice the size as well. Of two that link, one that
reaches it finds the other, and two that do not meet there, where every document reaches it. Documents with equal sets are
indexed once.

Near copies share most of their entries, so the entries that begin with the same node, and of those the ones that end with the
same, are made one wherever all pairs of the nodes together are fewer than those of the entries one by one. A group of near
copies is then compared about once and not once for each entry; every pair of an entry is still a pair of what it went into.

Work on an index entry with several documents is done in blocks of bounded size. A parity sketch bounds the symmetric
difference of two sets from below, so most pairs are ruled out without their sets. Of the pairs left an entry passes on
only a spanning forest; those are held against wider sketches, with a bit for each token, as a narrow one is full for
a long document. What is still near is verified on the full sets and gives first components. An entry that holds a pair that
failed is read again, and all its pairs between different components are verified. So no link between components is
lost, and copies do not become all their pairs. Documents with equal sets are one node throughout. In the second reading
the members of an entry that could link to another component meet with their sets, and a part of an entry gives no more
links than join its components.

Links are counted once the components are known, as both ends of a link are in one: the nodes of a component meet in
blocks, and every pair that sizes and sketches allow is verified there on the full sets. A block gives a sum for each node, so a
large group of near copies costs its pairs in work but not in rows. Copies count by the number of their documents.

Token counts cover all documents: tasks sort and count their own tokens, ship them in ranges, and ranges are counted. The
tokens called frequent go to all tasks; the bound for it rises with powers of two until at most ``MAX_FREQUENT`` are
left, which changes the work, never the result.

Defined results: a null or empty text has no shingles, no links, and is its own component; equal sets are one
component; repeated rows count as documents; a null key is never a component's name unless all its keys are null.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scale import written
from hindcast.llm import text as tx
from hindcast.llm.components import components

# Tokens in fewer documents than the first bound are indexed one by one; from a bound on, by combinations of k.
CLASSES = ((16, 2), (1024, 3))
# Least tokens of a cell on average, before classes; the combinations of a cell grow with the power k of it.
CELL = 4
MAX_FREQUENT = 1 << 20
# Documents of an index entry that are compared in one go.
BLOCK = 256
# Blocks that are one where sketches alone are compared: rows are copied once for each block of their entry.
SKETCHED = 4
# Tokens of a block of a component, whose sets one task holds.
BLOCK_TOKENS = 1 << 20
SKETCH_BYTES = 64
# Token counting: the bytes of text whose tokens make one range of the hash space (there are 256 or more ranges, so that what
# is left of 48 bits fits in 5 bytes), and the tokens a task gathers before it ships them.
RANGE_BYTES = 16 << 20
GATHER = 500_000
_FIRST_SIGNATURES = 24
# Rows and bytes of a batch that goes to Python.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
# Documents up to which keys go to all tasks for a semi or anti join.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Shingle size, and the ratio from which sets link: ``over * intersection >= times * union``."""

    words: int = 5
    times: int = 80
    over: int = 100

    def lacking(self, n: int) -> int:
        """Most tokens of a set of ``n`` that a linked set may lack."""
        return n - -(-self.times * n // self.over)

    def sizes(self, n: int) -> tuple[int, int]:
        """Smallest and largest size of a linked set."""
        return -(-self.times * n // self.over), self.over * n // self.times


# --- token counts --------------------------------------------------------------------------------------------------


def _sets(texts: pa.Array, size: int):
    """(document, tokens) of every text with words; tokens ascend."""
    for first, last, data, offsets in tx.chunks(texts):
        found = tx.words(data, offsets, tx.NOT_SPACE, tx.ASCII_LOWER)
        doc, hashes = tx.shingles(found, last - first, size)
        bounds = np.searchsorted(doc, np.arange(last - first + 1))
        for i in range(last - first):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]


def _short(tokens: np.ndarray) -> np.ndarray:
    """48 bits of a token name it in the counts; two tokens that share them count together."""
    return tokens >> np.uint64(16)


def frequent_tokens(docs: DataFrame, text: str, size: int, bounds: tuple[int, ...], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted short names of the frequent tokens and the class (0, 1, ...) of each."""
    gather, least = GATHER, bounds[0]
    size_of_texts = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # a range is what the tokens with the same first bits are
    rest_bits = np.uint64(48 - min(40, max(8, (size_of_texts // RANGE_BYTES).bit_length())))

    def ship(parts):
        names, counts = np.unique(_short(np.concatenate(parts)), return_counts=True)
        part = names >> rest_bits
        rest = names - (part << rest_bits)
        present, starts = np.unique(part, return_index=True)
        edges = np.append(starts, len(part))
        out: dict[str, list] = {"part": [], "low": [], "high": [], "often": [], "counts": []}
        for p, start, end in zip(present.tolist(), edges[:-1], edges[1:]):
            r, c = rest[start:end], counts[start:end]
            once = r[c == 1]
            out["part"].append(p)
            out["low"].append(once.astype(np.uint32).tobytes())
            out["high"].append((once >> np.uint64(32)).astype(np.uint8).tobytes())
            out["often"].append(r[c > 1].astype(np.uint64).tobytes())
            out["counts"].append(c[c > 1].astype(np.int64).tobytes())
        return pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in list(out)[1:])]))

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for _doc, tokens in _sets(batch.column(0), size):
                parts.append(tokens)
                held += len(tokens)
                if held >= gather:
                    yield ship(parts)
                    parts, held = [], 0
        if held:
            yield ship(parts)

    def total(part, names, counts):
        once, where = np.unique(np.concatenate(names), return_inverse=True)
        sums = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        keep = sums >= least
        return pa.RecordBatch.from_arrays(
            [pa.array((once[keep] + (np.uint64(part) << rest_bits)).astype(np.int64), pa.int64()), pa.array(sums[keep], pa.int64())], ["token", "documents"]
        )

    def add(batches):
        current, names, counts = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for part, low, high, often, times in zip(*columns):
                if part != current and names:
                    yield total(current, names, counts)
                    names, counts = [], []
                current = part
                once = np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32))
                names += [once, np.frombuffer(often, np.uint64)]
                counts += [np.ones(len(once), np.int64), np.frombuffer(times, np.int64)]
        if names:
            yield total(current, names, counts)
        del names, counts
        tx.give_back()

    shipped = docs.select(text).mapInArrow(count, "part long, low binary, high binary, often binary, counts binary")
    counted = shipped.repartition("part").sortWithinPartitions("part").mapInArrow(add, "token long, documents long")
    counted = written(counted, "frequent")
    # A histogram by powers of two: the bound rises until few enough tokens are left.
    levels = {r["level"]: r["tokens"] for r in counted.groupBy(F.floor(F.log2("documents")).cast("int").alias("level")).agg(F.count("*").alias("tokens")).collect()}
    factor = 1
    while levels and sum(n for level, n in levels.items() if (1 << level) >= least * factor) > limit:
        factor *= 2
    chosen = counted.where(F.col("documents") >= least * factor).collect() if levels else []
    names = np.array([r["token"] for r in chosen], np.uint64)
    order = np.argsort(names)
    often = np.array([r["documents"] for r in chosen], np.int64)[order]
    classes = np.searchsorted(np.array(bounds, np.int64) * factor, often, "right") - 1
    return names[order], classes.astype(np.int8)


# --- index ---------------------------------------------------------------------------------------------------------


def _cell_levels(n: int, similarity: Similarity) -> range:
    """Levels (powers of two) of cells for the size of a set of ``n`` and every larger size a partner may have."""
    level = lambda s: max(0, (s // CELL).bit_length() - 1)
    return range(level(n), level(similarity.sizes(n)[1]) + 1)


def _combined(tokens: np.ndarray, classes: np.ndarray, ks: tuple[int, ...], level: int, cut: int, credit: int) -> tuple[list[int], int]:
    """Entries of the frequent tokens in the ``2 ** cut`` cells used at a level, and what they lack of ``credit``."""
    entries: list[int] = []
    for c, k in enumerate(ks, start=1):
        members = tokens[classes == c]
        # cells are ranges of the hash, so cell by cell is the order of the hash
        cells = members >> np.uint64(64 - cut) if cut else np.zeros(len(members), np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True]))) if len(members) else []
        for a, b in zip(edges[:-1], edges[1:]):
            taken = members[a : min(b, a + credit + k - 1)].tolist()
            credit -= max(0, len(taken) - k + 1)
            for combination in combinations(taken, k):
                entries.append(hash((level, cut, c, *combination)))
            if credit <= 0:
                return entries, 0
    return entries, credit


def signatures(tokens: np.ndarray, classes: np.ndarray, similarity: Similarity, ks: tuple[int, ...]) -> np.ndarray:
    """Index entries of a set: ``classes`` is 0 for rare tokens, i for the i-th frequent class."""
    n = len(tokens)
    needed = similarity.lacking(n) + 1
    rare = tokens[classes == 0][:needed]
    found = [tx.mix(rare)]
    if len(rare) < needed:
        entries: list[int] = []
        for level in _cell_levels(n, similarity):
            fine, short = _combined(tokens, classes, ks, level, level, needed - len(rare))
            entries += fine
            if short and level:
                entries += _combined(tokens, classes, ks, level, level - 1, needed - len(rare))[0]
        found.append(tx.mix(np.array(entries, np.int64).view(np.uint64)))
    return np.unique(np.concatenate(found)).view(np.int64)


def _sketch(tokens: np.ndarray, size: int = SKETCH_BYTES) -> bytes:
    """One bit per hash bucket: the parity of the tokens in it. Sets that differ in m tokens differ in m bits at most."""
    counts = np.bincount((tokens & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _wide(tokens: np.ndarray) -> bytes | None:
    """A sketch with a bit or more for each token, a power of two; None where the narrow one has as many."""
    size = 1 << max(0, (len(tokens) - 1).bit_length() - 3)
    return _sketch(tokens, size) if size > SKETCH_BYTES else None


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the wider one is folded, as the parity of two buckets is that of both."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "big")
    for width in range(len(a).bit_length() - 2, len(b).bit_length() - 2, -1):
        half = 8 << width
        x = (x >> half) ^ (x & ((1 << half) - 1))
    return (x ^ int.from_bytes(b, "big")).bit_count()


def _node(tokens: np.ndarray) -> int:
    """A number for the set."""
    total = np.bitwise_xor.reduce(tx.mix(tokens + np.uint64(0x5851F42D4C957F2D))) if len(tokens) else np.uint64(0)
    return int(tx.mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def indexed(docs: DataFrame, key: str, text: str, similarity: Similarity, names: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Per document: key, set size ``n``, number of the set ``node``, its sketches and its index entries."""
    ks = tuple(k for _, k in CLASSES) if 5 * similarity.times >= 4 * similarity.over else (1,) * len(CLASSES)
    size = similarity.words

    def classes_of(tokens):
        out = np.zeros(len(tokens), np.int8)
        if len(names):
            short = _short(tokens)
            maybe = np.flatnonzero(state["bits"][(short >> np.uint64(26)).astype(np.int64)])
            at = np.minimum(np.searchsorted(names, short[maybe]), len(names) - 1)
            hit = names[at] == short[maybe]
            out[maybe[hit]] = classes[at[hit]] + 1
        return out

    def index(texts: pa.Array) -> pa.Array:
        if "bits" not in state:
            state["bits"] = np.zeros(1 << 22, bool)
            state["bits"][(names >> np.uint64(26)).astype(np.int64)] = True
        n, node, sketch, wide, entries = [], [], [], [], []
        for _doc, tokens in _sets(texts, size):
            n.append(len(tokens))
            node.append(_node(tokens))
            sketch.append(_sketch(tokens))
            wide.append(_wide(tokens))
            entries.append(signatures(tokens, classes_of(tokens), similarity, ks) if len(tokens) else [])
        return pa.StructArray.from_arrays(
            [
                pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(wide, pa.binary()),
                pa.array(entries, pa.list_(pa.int64())),
            ],
            ["n", "node", "sketch", "wide", "entries"],
        )

    state: dict = {}
    udf = F.arrow_udf(index, "n long, node long, sketch binary, wide binary, entries array<long>")
    return docs.select(F.col(key).alias("key"), udf(F.col(text)).alias("_i")).select("key", "_i.*")


# --- pairs within an index entry -----------------------------------------------------------------------------------

# more than the bits of a sketch; distances are 16 bits, as a task holds those of all pairs of two blocks
_FAR = 1 << 14


def _possible(part: dict, similarity: Similarity, crossing: bool) -> np.ndarray:
    """Distances of sketches where the sizes and the sketches allow a link, else ``_FAR``."""
    sketch, n, block = part["sketch"], part["n"], part["block"]
    times, over = similarity.times, similarity.over
    out = np.full((len(n), len(n)), _FAR, np.int16)
    # of two different blocks: pairs within one belong to another part of the entry
    across = np.flatnonzero(block != block[0])
    sketches, sizes = (sketch[across], n[across]) if crossing else (sketch, n)
    for i in np.flatnonzero(block == block[0]) if crossing else range(len(n) - 1):
        after = 0 if crossing else i + 1
        m = sizes[after:]
        distance = np.bitwise_count(sketch[i] ^ sketches[after:]).sum(axis=1, dtype=np.int64)
        allowed = (over + times) * distance <= (over - times) * (m + n[i])
        allowed &= over * np.minimum(m, n[i]) >= times * np.maximum(m, n[i])
        found = np.flatnonzero(allowed)
        others = across[found] if crossing else found + after
        out[i, others] = out[others, i] = distance[found]
    return out


def _forest(distance: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Nearest pairs that span what is connected: every tree takes its nearest link to another until none is left."""
    label, out = np.arange(len(nodes)), set()
    while True:
        apart = np.where(label[:, None] != label[None, :], distance, _FAR)
        best = apart.argmin(axis=1)  # nodes ascend, so of equally near ones the smallest
        reach = apart[np.arange(len(nodes)), best]
        found = {}
        for i in np.flatnonzero(reach < _FAR):
            j = int(best[i])
            rank = (int(reach[i]), *sorted((int(nodes[i]), int(nodes[j]))))
            if int(label[i]) not in found or rank < found[int(label[i])][0]:
                found[int(label[i])] = (rank, int(i), j)
        if not found:
            return sorted(out)
        for _rank, i, j in found.values():
            out.add((min(i, j), max(i, j)))
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)


_FOREST = "a long, b long, entry long"
_CROSSING = "entry long, block_a int, block_b int, node long"


def _hopeless(rows, similarity: Similarity) -> bool:
    """Whether no pair of a short list is possible, without the cost of arrays."""
    sketches = [int.from_bytes(r[2], "little") for r in rows]
    times, over = similarity.times, similarity.over
    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if (over + times) * (sketches[i] ^ sketches[j]).bit_count() <= (over - times) * (a + b) and over * min(a, b) >= times * max(a, b):
            return False
    return True


def _block_reader(similarity: Similarity, found, schema: str, *more: str):
    """mapInArrow function over rows sorted by (entry, block_a, block_b): what ``found(where, rows, distance)`` yields for each."""
    columns = ["entry", "block_a", "block_b", "node", "n", "sketch", "block", *more]
    fields = [tuple(f.split()) for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}

    def read(where, rows):
        if len(rows) <= 8 and _hopeless(rows, similarity):
            return
        rows = list({r[0]: r for r in rows}.values())  # a node once
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[0])
        part = {
            "n": np.array([r[1] for r in rows], np.int64),
            "sketch": np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1),
            "block": np.array([r[3] for r in rows]),
        }
        yield from found(where, rows, _possible(part, similarity, where[1] != where[2]))

    def run(batches):
        current, rows, out = None, [], []

        def flush():
            arrays = [pa.array(column, types[kind]) for column, (_name, kind) in zip(zip(*out), fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, [name for name, _kind in fields])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:3] != current:
                    if len(rows) > 1:
                        out.extend(read(current, rows))
                        if len(out) > 50_000:
                            yield flush()
                    current, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            out.extend(read(current, rows))
        if out:
            yield flush()
        del rows
        tx.give_back()

    return run


def _forests(similarity: Similarity):
    """For each part of an entry a spanning forest of its possible pairs, which are at most its members less one."""
    def found(where, rows, distance):
        nodes = np.array([r[0] for r in rows], np.int64)
        for a, b in _forest(distance, nodes):
            yield int(nodes[a]), int(nodes[b]), where[0]

    return _block_reader(similarity, found, _FOREST)


def _crossing(similarity: Similarity):
    """For each part of an entry the nodes that have a possible pair in another component: its members at most."""
    times, over = similarity.times, similarity.over

    def found(where, rows, distance):
        label = np.array([r[4] for r in rows], np.int64)
        firsts = [frozenset(r[5]) for r in rows]
        possible = (distance < _FAR) & (label[:, None] != label[None, :])
        marked = np.zeros(len(rows), bool)

        def wanted(i, j):
            # a pair that shares a smaller entry is looked at there
            if any(e < where[0] for e in firsts[i] & firsts[j]):
                return False
            if rows[i][6] is None and rows[j][6] is None:
                return True
            apart = _apart(rows[i][6] or rows[i][2], rows[j][6] or rows[j][2])
            return (over + times) * apart <= (over - times) * (rows[i][1] + rows[j][1])

        for i in np.flatnonzero(possible.any(axis=1)):
            for j in np.flatnonzero(possible[i]):
                if not (marked[i] and marked[j]) and wanted(i, j):
                    marked[i] = marked[j] = True
        for i in np.flatnonzero(marked):
            yield (*where, rows[i][0])

    return _block_reader(similarity, found, _CROSSING, "root", "firsts", "wide")


def _set_reader(batches, more: tuple[str, ...], done):
    """What ``done(where, rows)`` makes of the rows of each part, which have their sets as views of the batches."""
    current, rows = None, []
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        columns = ("entry", "block_a", "block_b", "node", "block", *more)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
            if row[:3] != current:
                if len(rows) > 1:
                    yield done(current, rows)
                current, rows = row[:3], []
            rows.append((*row[3:], values[offsets[i] : offsets[i + 1]]))
    if len(rows) > 1:
        yield done(current, rows)
    del rows
    tx.give_back()


class _Sets:
    """The sets of a part side by side, to count what one of them shares with others."""

    def __init__(self, sets: list[np.ndarray], blocks, similarity: Similarity, crossing: bool):
        self.times, self.over, self.n = similarity.times, similarity.over, np.array([len(t) for t in sets], np.int64)
        sketch = np.frombuffer(b"".join(_sketch(t.view(np.uint64)) for t in sets), np.uint64).reshape(len(sets), -1)
        self.possible = _possible({"n": self.n, "sketch": sketch, "block": np.array(blocks)}, similarity, crossing) < _FAR
        tokens, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts, self.held = np.concatenate(([0], np.cumsum(self.n))), np.zeros(len(tokens), np.int64)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that the i-th set links to."""
        starts, ids, held = self.starts, self.ids, self.held
        own = ids[starts[i] : starts[i + 1]]
        held[own] = 1
        if 8 * len(others) < len(self.n):
            shared = np.array([held[ids[starts[j] : starts[j + 1]]].sum() for j in others], np.int64)
        else:
            shared = np.add.reduceat(held[ids], starts[:-1])[others]
        held[own] = 0
        return others[self.over * shared >= self.times * (self.n[others] + self.n[i] - shared)]


def _links_of(similarity: Similarity):
    """mapInArrow function: verified links that join two components, at most one less than the components of a part."""
    def join(where, rows):
        nodes, blocks, roots, sets = (list(x) for x in zip(*rows))
        label, found = np.unique(roots, return_inverse=True)[1], []
        part = _Sets(sets, blocks, similarity, where[1] != where[2])
        for i in np.flatnonzero(part.possible.any(axis=1)):
            others = np.flatnonzero(part.possible[i] & (label != label[i]))
            for j in part.linked(i, others) if len(others) else ():
                if label[j] != label[i]:
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    label[label == label[j]] = label[i]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lambda batches: _set_reader(batches, ("root",), join)


def _counts_of(similarity: Similarity):
    """mapInArrow function over rows sorted by (entry, block_a, block_b): for each node the documents it links to there."""
    def count(where, rows):
        nodes, blocks, copies, sets = (list(x) for x in zip(*rows))
        copies, linked = np.array(copies, np.int64), np.zeros(len(nodes), np.int64)
        part = _Sets(sets, blocks, similarity, where[1] != where[2])
        possible = np.triu(part.possible)
        for i in np.flatnonzero(possible.any(axis=1)):
            others = part.linked(i, np.flatnonzero(possible[i]))
            linked[i] += copies[others].sum()
            linked[others] += copies[i]
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)[some]), pa.array(linked[some])], ["node", "linked"])

    return lambda batches: _set_reader(batches, ("copies",), count)


def _once(filled: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row for each node of ``filled`` (node, n, sketch, wide, entries); only the rows of copies are brought together."""
    columns = ("n", "sketch", "wide", "entries")
    copied = _few(written(keyed.where("copies > 1").select("node"), "copied"))
    one = filled.join(copied, "node", "left_semi").groupBy("node").agg(*[F.min(c).alias(c) for c in columns])
    return filled.join(copied, "node", "left_anti").select("node", *columns).unionByName(written(one, "once"))


def _merged(members: DataFrame) -> DataFrame:
    """``members`` (entry, node) with entries of the same first node, then of the same last node, made one where that is fewer pairs."""
    for name, end in (("first", F.min), ("last", F.max)):
        ends = members.groupBy("entry").agg(end("node").alias("hub"), F.count(F.lit(1)).cast("double").alias("members"))
        ends = written(ends, "ends")
        several = ends.groupBy("hub").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("members") * F.col("members")).alias("apart"))
        several = written(several.where("entries > 1").drop("entries"), "hubs")
        shared = ends.join(_few(several.select("hub")), "hub", "left_semi").select("entry", "hub")
        together = written(members.join(shared, "entry").select("hub", "node").distinct(), "together")
        united = together.groupBy("hub").agg(F.count(F.lit(1)).cast("double").alias("members")).join(several, "hub")
        united = _few(written(united.where("members * members <= apart").select("hub"), "united"))
        one = together.join(united, "hub", "left_semi").select(F.xxhash64(F.lit(name), "hub").alias("entry"), "node")
        left = members.join(ends.join(united, "hub", "left_anti").select("entry"), "entry", "left_semi")
        members = written(left.select("entry", "node").unionByName(one), "merged")
    return members


def _blocked(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows (entry, node, ...) copied to each pair of blocks of their entry that they take part in."""
    blocks = F.ceil(F.col("members") / block)
    if "tokens" in sizes.columns:
        blocks = F.greatest(blocks, F.ceil(F.col("tokens") / BLOCK_TOKENS))
    rows = members.join(sizes.select("entry", blocks.cast("int").alias("blocks")), "entry")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("_other"))
    return rows.withColumns({"block_a": F.least("block", "_other"), "block_b": F.greatest("block", "_other")}).drop("_other", "blocks")


def _near(pairs: DataFrame, shapes: DataFrame, similarity: Similarity) -> DataFrame:
    """``pairs`` (a, b, ...) with ``near``: whether sizes and wide sketches allow a link."""
    times, over = similarity.times, similarity.over

    def apart(sketch_a: pa.Array, sketch_b: pa.Array) -> pa.Array:
        return pa.array([_apart(x.as_py(), y.as_py()) for x, y in zip(sketch_a, sketch_b)], pa.int64())

    both, columns = pairs, pairs.columns
    for side in ("a", "b"):
        sketch = F.coalesce("wide", "sketch")
        both = both.join(shapes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), sketch.alias(f"s_{side}")), side)
    distance = F.arrow_udf(apart, "long")("s_a", "s_b")
    near = ((over + times) * distance <= (over - times) * (F.col("n_a") + F.col("n_b"))) & (
        over * F.least("n_a", "n_b") >= times * F.greatest("n_a", "n_b")
    )
    return both.select(*columns, near.alias("near"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("entry", "block_a", "block_b").sortWithinPartitions("entry", "block_a", "block_b", "node")


# --- the join ------------------------------------------------------------------------------------------------------


@contextmanager
def _small_batches(spark):
    """Texts go to Python in batches of few rows and bytes while this lasts, so that a batch of long texts stays small."""
    limits = {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES}
    before = {f"spark.sql.execution.arrow.{name}": spark.conf.get(f"spark.sql.execution.arrow.{name}") for name in limits}
    for (name, value), limit in zip(before.items(), limits.values()):
        spark.conf.set(name, min(limit, int(value)) if value.isdigit() and int(value) > 0 else limit)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _few(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _sets_for(wanted: DataFrame, docs: DataFrame, keyed: DataFrame, key: str, text: str, similarity: Similarity) -> DataFrame:
    """(node, tokens) of the wanted nodes (node), from the texts of one key of each."""
    size = similarity.words

    def tokens(texts: pa.Array) -> pa.Array:
        found = [t for _, t in _sets(texts, size)]
        sets = pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array([_node(t) for t in found], pa.int64()), sets], ["own", "tokens"])

    wanted = written(keyed.join(wanted, "node").select("node", "key"), "wanted")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    # not called deterministic, so that the filter on its result does not evaluate it a second time
    found = F.arrow_udf(tokens, "own long, tokens array<long>").asNondeterministic()(F.col("_text"))
    sets = texts.join(_few(wanted), texts["key"].eqNullSafe(wanted["key"])).select("node", found.alias("_s"))
    sets = written(sets.where("node = _s.own").select("node", "_s.tokens"), "sets")
    # rows that repeat a key and its text have one set; only those are brought together
    again = written(sets.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node"), "repeated")
    if not again.isEmpty():
        one = sets.join(again, "node", "left_semi").groupBy("node").agg(F.min("tokens").alias("tokens"))
        sets = written(sets.join(again, "node", "left_anti").unionByName(one), "sets")
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs (a, b) with ``linked``, from the full sets of both."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = similarity.over * shared >= similarity.times * (F.size("sa") + F.size("sb") - shared)
    return written(both.select("a", "b", linked.alias("linked")), "verified")


def _linked(roots: DataFrame, keyed: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """(node, linked) for every node of a component of several: the documents of other nodes that it links to."""
    placed = written(roots.join(keyed.select("node", "n", "copies"), "node").withColumnRenamed("root", "entry"), "placed")
    sizes = placed.groupBy("entry").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"), F.sum("copies").alias("documents")
    )
    sizes = written(sizes, "components")
    # two nodes are a component by their link
    two = placed.join(sizes.where("members = 2"), "entry").select("node", (F.col("documents") - F.col("copies")).alias("linked"))
    larger = sizes.where("members > 2")
    rows = placed.join(larger.select("entry"), "entry", "left_semi").select("entry", "node", "copies").join(sets, "node")
    dealt = _blocked(rows, larger, BLOCK).repartition("entry", "block_a", "block_b").sortWithinPartitions("entry", "block_a", "block_b")
    counted = dealt.mapInArrow(_counts_of(similarity), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    return written(two.unionByName(counted), "degrees")


def _numbers(size: int):
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([_node(t) for _, t in _sets(texts, size)], pa.int64())

    return numbers


def joined(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Similarity = Similarity(), links: bool = True
) -> DataFrame:
    """Per document: key, n_shingles, node (number of its set), root (number of its component), component_id and n_links.

    ``component_id`` is the smallest key of the document's component. ``n_links`` is the number of other documents that the
    document links to, copies of it among them; a caller that needs components only leaves it out with ``links``.
    """
    with _small_batches(docs.sparkSession):
        return _joined(docs, key, text, similarity, links)


def _joined(docs: DataFrame, key: str, text: str, similarity: Similarity, counts: bool) -> DataFrame:
    names, classes = frequent_tokens(docs, text, similarity.words, tuple(b for b, _ in CLASSES), MAX_FREQUENT)
    rows = written(indexed(docs, key, text, similarity, names, classes), "indexed")
    filled = rows.where("n > 0")
    keyed = filled.groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    keyed = written(keyed, "nodes")

    # Copies have the same entries and sketches, which are taken from one of them.
    filled = _once(filled, keyed)

    # An entry of two nodes is a pair by itself; only entries of more are gathered.
    entries = filled.select("node", F.explode("entries").alias("entry"))
    met = entries.groupBy("entry").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows"))
    met = written(met.where("a <> b"), "entries")
    large = written(met.where("rows > 2").select("entry"), "large")
    members = _merged(written(entries.join(_few(large), "entry", "left_semi"), "members"))
    sizes = written(members.groupBy("entry").agg(F.count(F.lit(1)).alias("members")), "sizes")
    twos = met.where("rows = 2").select("a", "b").distinct()

    taking_part = members.select("node").union(twos.select("a")).union(twos.select("b")).distinct()
    shapes = written(filled.join(taking_part, "node", "left_semi").select("node", "n", "sketch", "wide"), "sketches")

    narrow = shapes.drop("wide")
    forest = _dealt(_blocked(members.join(narrow, "node"), sizes, SKETCHED * BLOCK)).mapInArrow(_forests(similarity), _FOREST)
    forest = written(forest, "forest")
    # a pair of a forest counts as failed if it is not near: its entry may hold another that links; a pair by itself does not
    pairs = forest.select("a", "b", F.lit(True).alias("forest")).union(twos.withColumn("forest", F.lit(False)))
    pairs = _near(pairs.groupBy("a", "b").agg(F.max("forest").alias("forest")), shapes, similarity)
    pairs = written(pairs.where("near OR forest").select("a", "b", "near"), "pairs")
    near = pairs.where("near").select("a", "b")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _sets_for(wanted, docs, keyed, key, text, similarity)
    tested = _verified(near, sets, similarity).union(pairs.where("NOT near").select("a", "b", F.lit(False).alias("linked")))
    links = tested.where("linked").select("a", "b")

    # a forest names the entry it is of: those with a failed pair are read again
    failed = written(forest.join(tested.where("NOT linked").select("a", "b"), ["a", "b"], "left_semi").select("entry").distinct(), "failed")
    if not failed.isEmpty():
        # whoever could link to anyone in an entry is in its forest, so the others need not be read again
        open_nodes = written(tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct(), "open")
        listed = written(members.join(open_nodes, "node", "left_semi"), "listed")
        firsts = listed.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("entry")), 1, _FIRST_SIGNATURES).alias("firsts"))
        known = shapes.join(firsts, "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = written(known, "known")
        blocked = _blocked(listed.join(failed, "entry", "left_semi").join(known, "node"), sizes, SKETCHED * BLOCK)
        crossing = written(_dealt(blocked).mapInArrow(_crossing(similarity), _CROSSING), "crossing")
        if not crossing.isEmpty():
            unread = crossing.select("node").distinct().join(sets.select("node"), "node", "left_anti")
            sets = sets.unionByName(_sets_for(unread, docs, keyed, key, text, similarity))
            # a part of an entry is cut again, so that the sets of a task stay few
            parts = crossing.select(F.xxhash64("entry", "block_a", "block_b").alias("entry"), "node").distinct()
            parts = written(parts.join(known.select("node", "n", "root"), "node"), "parts")
            held = parts.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
            dealt = _blocked(parts.drop("n").join(sets, "node"), held, BLOCK).repartition("entry", "block_a", "block_b").sortWithinPartitions("entry", "block_a", "block_b")
            links = written(links.union(dealt.mapInArrow(_links_of(similarity), "a long, b long")).distinct(), "links")
    roots = components(links)
    found = _named(rows, keyed, roots)
    if not counts:
        return found
    degrees = keyed.join(_linked(roots, keyed, sets, similarity), "node", "left")
    degrees = degrees.select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    # an empty text is not a node and has no links
    return found.join(written(degrees, "n_links"), "node", "left").select(*found.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _named(rows: DataFrame, keyed: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    names = written(rooted.join(smallest, "root").select("node", "root", "component_id"), "names")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return rows.select("key", "n", "node").join(names, "node", "left").select(
        "key", F.col("n").alias("n_shingles"), "node", F.coalesce("root", "node").alias("root"), component.alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Similarity = Similarity()) -> DataFrame:
    """The documents that bear the name of their component, each once.

    The rows to drop are removed by an anti join on their key, with a copy of the keys in every task while they are few.
    Rows that share a key are few as a rule and settled apart: equal rows become one, and of several texts of one
    component under one key the smallest stays.
    """
    found = written(joined(docs, key, text, similarity, links=False).select("key", "node", "root", "component_id"), "joined")
    shared = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "shared_keys")
    dropped = written(found.where(~F.col("key").eqNullSafe(F.col("component_id"))).select("key").union(shared).distinct(), "dropped")
    kept = docs.join(_few(dropped), docs[key].eqNullSafe(dropped["key"]), "left_anti")
    if shared.isEmpty():
        return kept
    same = docs.join(_few(shared), docs[key].eqNullSafe(shared["key"]), "left_semi").distinct()
    number = F.arrow_udf(_numbers(similarity.words), "long")(F.col(text))
    same = same.withColumn("_node", number)
    names = found.select(F.col("key").alias("_key"), F.col("node").alias("_own"), F.col("root").alias("_root"), F.col("component_id").alias("_component")).distinct()
    same = same.join(names, same[key].eqNullSafe(F.col("_key")) & (F.col("_node") == F.col("_own")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = same.where(F.col("_component").eqNullSafe(F.col("_key"))).groupBy("_key", "_root").agg(
        F.min(F.struct(F.col(text).alias("_first"), *columns)).alias("_row")
    )
    return kept.unionByName(one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))
