"""Repairing the turns of conversations by iterative-deepening A*.

A conversation is a sequence of rows, and a repair is a sequence of edits (Delete, Insert, Keep, Rerole) after which
the initials of the roles read ``(s?(ua)+)?``. Edits are tried depth first in the ASCII order of their initials, under a
bound on the cost that rises to the least cost that went beyond it. A table holds for each state (rows read, what the
last role was) how much a repair from there is known to cost at least: first an estimate that is never too high, then
what failed searches have proved. A state is entered only if the rest of the bound reaches that. The first path that is
accepted is therefore the cheapest, and among the cheapest the least in ASCII order.

A long conversation is searched stretch by stretch from its end: the search from each stretch's first row, for each
state, leaves exact costs in the table, so the bound of no search rises by more than what ``STRETCH`` rows cost, and the work
grows with the number of rows.

What a task holds of a conversation is two bytes, a digest and its place per row, not its texts: the rows come sorted, and
the texts meet their edits in a second pass that hashes them one after the other. Rows of one turn are ordered by role,
then by the first ``TIE_CHARS`` characters of the text, then by its SHA-256; equal rows need no order.

Defined results: a null role or text is one space, a null conversation or turn in the drawn number too; rows without a
conversation are one conversation, its id null; a conversation all of whose rows were dropped has zeros, no edits and
the hash of the empty string; repeated rows are rows, and all but the first of equal ones are duplicates; an empty table
gives no rows; a turn may be null, and such rows come first. Other input columns, also those named like a result column,
do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scale import written

STRETCH = 64
TIE_CHARS = 64

# Costs of the edits, and what an undeleted truncated row adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
# Of how many drawn numbers each damage has one.
DRAWS = 20

# What was read last: nothing, s, u, a. NEXT_ROLE: what may be inserted there (1 user, 2 assistant) and where it leads.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTED = (_NOTHING, _ASSISTANT)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
# Where a kept row leads, by the initial of its role (0 other, 1 s, 2 u, 3 a); None where it may not stand.
_KEPT = (
    (None, _SYSTEM, _USER, None),
    (None, None, _USER, None),
    (None, None, None, _ASSISTANT),
    (None, None, _USER, None),
)
_INITIALS = {"s": 1, "u": 2, "a": 3}
_MUST_GO, _CUT = 1, 2  # flags of a row: blank or duplicate; truncated


class Repair:
    """The cheapest edits of one conversation. ``initials`` and ``flags`` have one number per row."""

    def __init__(self, initials, flags, stretch: int = STRETCH):
        self.initials, self.flags = (np.asarray(x, np.uint8).tobytes() for x in (initials, flags))
        self.rows = len(self.flags)
        least = self._least_costs()
        # Rows from here on cost at least this much in any state: what the parts after it have proved, and each row's own.
        self.known = [[0] * 4 for _ in range(self.rows + 1)]
        self.known[self.rows] = [0, 2 * INSERT, INSERT, 0]
        end, floor = self.rows, 0
        while end > 0:
            start = max(0, end - stretch)
            tail = 0
            for row in range(end - 1, start - 1, -1):
                tail += least[row]
                self.known[row] = [floor + tail] * 4
            if start:
                for state in range(4):
                    self._deepen(start, state)
                floor = min(self.known[start])
            end = start
        self.audit = "".join(self._deepen(0, _NOTHING))
        self.cost = self.known[0][_NOTHING]

    def _least_costs(self) -> list[int]:
        """What each row costs whatever stands around it."""
        out = []
        for initial, flags in zip(self.initials, self.flags):
            stays = DELETE if flags & _MUST_GO else (KEEP if initial else REROLE) + (TRUNCATED if flags & _CUT else 0)
            out.append(min(DELETE, stays))
        return out

    def _deepen(self, row: int, state: int) -> list[str]:
        bound = self.known[row][state]
        while (edits := self._search(row, state, bound)) is None:
            bound = self.known[row][state]  # the least cost beyond the bound
        return edits

    def _edits(self, row: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, row after it, state after it), in ASCII order."""
        follow = _NEXT[state]
        if row == self.rows:
            return [("I", INSERT, row, follow)]
        flags, edits = self.flags[row], [("D", DELETE, row + 1, state), ("I", INSERT, row, follow)]
        if not flags & _MUST_GO:
            more = TRUNCATED if flags & _CUT else 0
            kept = _KEPT[state][self.initials[row]]
            if kept is not None:
                edits.append(("K", KEEP + more, row + 1, kept))
            edits.append(("R", REROLE + more, row + 1, follow))
        return edits

    def _search(self, row: int, state: int, bound: int) -> list[str] | None:
        """The first accepted path that costs at most ``bound``; without one, the table learns from what failed."""
        known, rows = self.known, self.rows
        path: list[str] = []
        # One entry per step: row, state, what is left of the bound, the edits not tried yet, the least cost seen beyond.
        stack = [[row, state, bound, iter(self._edits(row, state)), None]]
        while stack:
            top = stack[-1]
            row, state, left, untried, _ = top
            if row == rows and state in _ACCEPTED:
                return path
            for initial, cost, to_row, to_state in untried:
                needed = cost + known[to_row][to_state]
                if needed <= left:
                    path.append(initial)
                    stack.append([to_row, to_state, left - cost, iter(self._edits(to_row, to_state)), None])
                    break
                if top[4] is None or needed < top[4]:
                    top[4] = needed
            else:
                # Every way out of this state costs more than was left; the table holds the least of them.
                stack.pop()
                if top[4] > known[row][state]:
                    known[row][state] = top[4]
                if stack:
                    above, cost = stack[-1], stack[-1][2] - left
                    path.pop()
                    needed = cost + known[row][state]
                    if above[4] is None or needed < above[4]:
                        above[4] = needed
        return None


def damaged(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (_conv, _turn, _role, _text) as a lossy log would hold them, drawn by conversation and turn."""
    named = turns.select(
        F.col(conversation).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
    )
    name = F.concat(F.coalesce(F.col("_conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("_turn").cast("string"), F.lit(" ")))
    drawn = named.withColumn("_draw", F.crc32(name.cast("binary")) % DRAWS).where("_draw <> 0")
    one, two = F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))
    changed = drawn.select(
        "_conv",
        "_turn",
        F.when(F.col("_draw") == 4, "user").otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_draw") == 3, two).otherwise(one).alias("_copies"),
    )
    return changed.select("_conv", "_turn", "_role", "_text", F.explode("_copies").alias("_copy")).drop("_copy")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """The rows of a conversation in one task, one after the other, sorted outside Python."""
    order = ["_conv", *first, "_turn", "_role", "_tie", "_digest"]
    return rows.repartition("_conv").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """(conversation, whether it begins, its part of a batch) of sorted batches."""
    last, begun = None, False
    for batch in batches:
        names = batch.column("_conv").to_pylist()
        start = 0
        while start < len(names):
            end = start + 1
            while end < len(names) and names[end] == names[start]:
                end += 1
            new = not begun or names[start] != last
            last, begun = names[start], True
            yield last, new, batch.slice(start, end - start)
            start = end


class _Counts:
    """What the first pass keeps of a conversation."""

    def __init__(self):
        self.turns_seen, self.low, self.high, self.last_turn = 0, None, None, None
        self.initials, self.flags, self.digests = bytearray(), bytearray(), []

    def add(self, part: pa.RecordBatch):
        for turn in part.column("_turn").to_pylist():
            if turn is not None and (self.turns_seen == 0 or turn != self.last_turn):
                self.low = turn if self.low is None else self.low
                self.high, self.last_turn, self.turns_seen = turn, turn, self.turns_seen + 1
        self.initials += bytes(part.column("_initial").to_pylist())
        self.flags += bytes(part.column("_flags").to_pylist())
        self.digests.append(b"".join(part.column("_digest").to_pylist()))

    def result(self) -> dict:
        rows = len(self.flags)
        flags, initials = np.frombuffer(bytes(self.flags), np.uint8), np.frombuffer(bytes(self.initials), np.uint8)
        # First of each equal digest; a digest takes in the role and the text.
        digests = np.frombuffer(b"".join(self.digests), np.dtype("V32"))
        first = np.zeros(rows, bool)
        first[np.unique(digests, return_index=True)[1]] = True
        blank = (flags & _BLANK_TEXT) > 0
        duplicate = ~blank & ~first
        cut = ~blank & ~duplicate & ((flags & _NO_END) > 0)
        pairs = initials[:-1].astype(int) * 4 + initials[1:] if rows else np.empty(0, int)
        legal = np.isin(pairs, [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])
        found = Repair(initials, (blank | duplicate) * _MUST_GO + cut * _CUT)
        return {
            "gaps": self.high - self.low + 1 - self.turns_seen if self.turns_seen else 0,
            "blank": int(blank.sum()),
            "duplicate": int(duplicate.sum()),
            "truncated": int(cut.sum()),
            "illegal": int((~legal).sum()),
            "cost": found.cost,
            "audit": found.audit,
        }


# Flags of a row before its conversation is known.
_BLANK_TEXT, _NO_END = 1, 2
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """(_conv, counts, cost, audit) of every conversation of damaged ``rows``: the search, on narrow rows."""
    schema = f"_conv {rows.schema['_conv'].dataType.simpleString()}, {COUNTS}"
    initial = F.left("_role", F.lit(1))
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    flags = F.when(~F.rlike("_text", F.lit(r"[^\x20\x09-\x0D]")), _BLANK_TEXT).when(
        ~F.rlike("_text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), _NO_END
    ).otherwise(0)
    narrow = rows.select(
        "_conv", F.col("_turn").cast("long").alias("_turn"), "_role", F.left("_text", F.lit(TIE_CHARS)).alias("_tie"),
        _digest().alias("_digest"), number.cast("int").alias("_initial"), flags.cast("int").alias("_flags"),
    )
    type_of = rows.schema["_conv"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def table(done: list[dict]) -> pa.RecordBatch:
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
            columns = [pa.array([d["_conv"] for d in done], to_arrow_type(type_of))]
            columns += [pa.array([d[n] for d in done], pa.int64()) for n in names]
            columns.append(pa.array([d["audit"] for d in done], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["_conv", *names, "audit"])

        open_, name, done, size = None, None, [], 0
        for conversation, new, part in _by_conversation(batches):
            if new:
                if open_ is not None:
                    done.append({"_conv": name, **open_.result()})
                    size += len(done[-1]["audit"])
                open_, name = _Counts(), conversation
                if len(done) >= 1000 or size > 1 << 20:
                    yield table(done)
                    done, size = [], 0
            open_.add(part)
        if open_ is not None:
            done.append({"_conv": name, **open_.result()})
        if done:
            yield table(done)

    return _in_order(narrow).mapInArrow(search, schema)


def _digest():
    return F.unhex(F.sha2(F.concat(F.unhex(F.sha2(F.col("_role").cast("binary"), 256)), F.col("_text").cast("binary")), 256))


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256): edits are applied to the texts as they pass, one conversation after the other."""
    schema = f"_conv {rows.schema['_conv'].dataType.simpleString()}, repaired_sha256 string"
    type_of = rows.schema["_conv"].dataType
    texts = rows.select(
        "_conv", F.lit(1).alias("_kind"), F.col("_turn").cast("long").alias("_turn"), "_role",
        F.left("_text", F.lit(TIE_CHARS)).alias("_tie"), _digest().alias("_digest"), "_text",
    )
    edits = found.select(
        "_conv", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"),
        F.lit("").alias("_tie"), F.lit(b"").alias("_digest"), F.col("audit").alias("_text"),
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def table(done: list[tuple]) -> pa.RecordBatch:
            names, hashes = [d[0] for d in done], [d[1] for d in done]
            return pa.RecordBatch.from_arrays([pa.array(names, to_arrow_type(type_of)), pa.array(hashes, pa.string())], ["_conv", "repaired_sha256"])

        open_, name, done = None, None, []
        for conversation, new, part in _by_conversation(batches):
            columns = [part.column(c).to_pylist() for c in ("_kind", "_role", "_text")]
            for kind, role, text in zip(*columns):
                if kind == 0:
                    if open_ is not None:
                        done.append((name, open_.finished()))
                    open_, name = Rewriter(text), conversation
                else:
                    open_.read(role, text)
            if len(done) >= 1000:
                yield table(done)
                done = []
        if open_ is not None:
            done.append((name, open_.finished()))
        if done:
            yield table(done)

    return _in_order(texts.unionByName(edits), "_kind").mapInArrow(apply, schema)


class Rewriter:
    """Applies an audit to rows as they come and hashes what is left of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _NOTHING
        self.hash, self.begun = hashlib.sha256(), False

    def _put(self, role: str, text: str):
        if self.begun:
            self.hash.update(b"\n")
        self.hash.update(role.encode() + b":" + text.encode())
        self.begun = True

    def _insert(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = _NEXT[self.state], self.at + 1
            self._put("user" if self.state == _USER else "assistant", "")

    def read(self, role: str, text: str):
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _KEPT[self.state][_INITIALS[role[:1]]]
            self._put(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self._put("user" if self.state == _USER else "assistant", text)

    def finished(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def repaired(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation of ``turns``: what the damage left of it, and its cheapest repair."""
    rows = damaged(turns, conversation, turn, role, text)
    found = written(audits(rows), "audits")
    hashes = repaired_hashes(rows, found)
    names = turns.select(F.col(conversation).alias("_name")).distinct()
    return (
        names.join(found, F.col("_name").eqNullSafe(F.col("_conv")), "left")
        .drop("_conv")
        .join(hashes, F.col("_name").eqNullSafe(F.col("_conv")), "left")
        .select(
            F.col("_name").alias(conversation),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
