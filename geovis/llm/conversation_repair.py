"""Conversation structure repair: the cheapest edits that give a conversation its proper shape.

A repaired conversation's role initials read `(s?(ua)+)?`: an optional system row, then user and
assistant in turn. Rows are kept (0), given another role (3), deleted (4) or inserted (3); a row
that is blank or repeats an earlier one must go; a truncated row that stays costs 3 more. Of the
cheapest edit sequences the one whose initials (D, I, K, R) come first is taken.

Method. Between two rows a repair is in one of four states: nothing yet, after the system row,
after a user row, after an assistant row. Forward cost vectors (state to cost, and the rank of each
state's least audit) and backward cost vectors meet in the middle of the conversation; the crossing
with the least total, and of these the one with the least audit, splits the problem in two, and each
half is solved the same way. Only two vectors are held at a time, so memory beside the rows is
constant, and the work is n log n.

Ranks suffice for ties: the state after a sequence of edits follows from the edits, so the audits of
two states differ before either ends, and what follows cannot change their order. Rows that must go
never change a state, and an insertion after them reads less than one before, so the vectors pass
them by.

Scale. Rows are sorted over all tasks by conversation, so one that holds a third of all rows lies in
many tasks. Each task summarises its part of such a conversation as a 4 x 4 table of costs and
ranks; the same meeting of vectors at the borders of the parts fixes every part's first and last
state (at most two parts per task, in plain numbers, go to the driver), and the parts are solved
apart. Only the digest of a whole conversation must read its rows in order: those that lie in one
task are read there, the others are streamed.

Defined results: a null role or text is one space, so a null text is blank; a role is judged by its
first character, and one other than s, u or a has to change; turns are ordered with nulls first,
ties by role, then text; equal rows stand side by side and count as repeats; rows of a null conv_id
are one conversation; a conversation without rows after damage has zeros, an empty audit and the
digest of the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, cut, map_arrow, record, stored

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state after the only row that may be added to each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: What completes a conversation from each state: cost of the insertions, and their number.
ENDING = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}

NONE, BLANK, REPEAT, CUT_OFF = range(4)
FAULTS = {BLANK: "blank", REPEAT: "duplicate", CUT_OFF: "truncated"}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}

FAR = 1 << 60
#: A state this much dearer than another one is never on a cheapest way: from any state, two
#: insertions and one edit do what the other can.
DOMINATED = 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row dropped, emptied, robbed of its sentence ends,
    doubled or made a user's, as the checksum of `conv_id:turn` says."""
    blank = F.lit(" ")
    of = lambda name: F.coalesce(F.col(name).cast("string"), blank)
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    text, role = of("text"), of("role")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    return rows.filter("_kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn over all tasks, equal ones as one row with their number: conv_id,
    turn, role, text, copies, fault of the first copy."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    of = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    rows = rows.select("conv_id", "turn", of("role"), of("text"), "copies")
    who = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role"), "role")
    said = F.unhex(F.sha2(F.concat(who, F.lit(":"), F.col("text")), 256)).alias("_said")
    turn = F.struct("turn")
    # What a conversation says in several turns, from digests alone: mostly a small table, which
    # Spark then joins without moving the texts.
    spread = rows.groupBy(said).agg(F.min(turn).alias("_first"), F.max(turn).alias("_last"))
    again = stored(spread.filter("_first <> _last").drop("_last"), "repeated-turns")
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    alike = alike.withColumn("_said", said).join(again, "_said", "left")
    trimmed = F.rtrim("text", F.lit(SPACE))
    later = F.col("_first").isNotNull() & ~F.col("_first.turn").eqNullSafe(F.col("turn"))
    fault = (
        F.when(trimmed == "", BLANK).when(later, REPEAT).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(NONE)
    )
    judged = alike.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))
    # Range bounds are kept on the driver, so they are of short keys in the same order.
    short = F.when(F.length("role") <= 64, F.substring("text", 1, 64))
    ranged = judged.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), short.asc_nulls_last())
    return cut(ranged.sortWithinPartitions("conv_id", "turn", "role", "text"))


class Edit(NamedTuple):
    """Way of one row: so many insertions before it, then the row's own edit."""

    cost: int
    audit: str
    to: int


def initial_class(role: str, fault: int) -> int:
    """Class of a row that may stay: place of its initial, and 4 more if it is truncated."""
    at = INITIALS.find(role[0]) if role else -1
    return (at if at >= 0 else 3) + (4 if fault == CUT_OFF else 0)


@cache
def edits_from(state: int, kind: int) -> tuple[Edit, ...]:
    initial, extra = kind % 4, TRUNCATED if kind >= 4 else 0
    out = [Edit(DELETE, "D", state)]
    for inserted in range(3):
        cost, audit = INSERT * inserted, "I" * inserted
        if initial == 0 and state == START:
            out.append(Edit(cost + KEEP + extra, audit + "K", SYSTEM))
        elif initial == NEXT[state] - 1:
            out.append(Edit(cost + KEEP + extra, audit + "K", NEXT[state]))
        out.append(Edit(cost + REROLE + extra, audit + "R", NEXT[state]))
        state = NEXT[state]
    return tuple(out)


class Vector(NamedTuple):
    """Cost of each state above the cheapest one, and the rank of its least audit."""

    costs: tuple[int, ...]
    ranks: tuple[int, ...]


def at_state(state: int) -> Vector:
    return Vector(tuple(0 if s == state else FAR for s in STATES), (0,) * len(STATES))


@cache
def advance(now: Vector, kind: int) -> tuple[Vector, int]:
    """The vector after one more row, and what its zero stands for."""
    best: dict[int, tuple] = {}
    for state in STATES:
        if now.costs[state] < FAR:
            for edit in edits_from(state, kind):
                way = (now.costs[state] + edit.cost, now.ranks[state], edit.audit)
                best[edit.to] = min(best.get(edit.to, way), way)
    return ranked(best)


def forward(now: Vector, kind: int) -> Vector:
    return advance(now, kind)[0]


def ranked(best: dict[int, tuple]) -> tuple[Vector, int]:
    """Vector of each state's (cost, what its audit is compared by ...), and its zero."""
    least = min(way[0] for way in best.values())
    order = sorted(best, key=lambda s: best[s][1:])
    cost = lambda s: best[s][0] - least if s in best else FAR
    costs = tuple(cost(s) if cost(s) <= DOMINATED else FAR for s in STATES)
    return Vector(costs, tuple(order.index(s) if s in best else 0 for s in STATES)), least


@cache
def backward(now: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Cost from each state before one more row, above the cheapest one."""
    ways = [min((e.cost + now[e.to] for e in edits_from(s, kind)), default=FAR) for s in STATES]
    least = min(ways)
    return tuple(w - least if w < FAR else FAR for w in ways)


def meet(ahead: Vector, behind: tuple[int, ...]) -> int:
    """The crossing of least cost, and of these of least audit."""
    return min(STATES, key=lambda s: (min(ahead.costs[s] + behind[s], FAR), ahead.ranks[s]))


def cross(kinds: bytes, lo: int, hi: int, start: int, end: int, found: list[Edit]) -> None:
    """Append the edits of the rows lo to hi - 1, from one state to another."""
    if hi - lo == 1:
        found.append(min(e for e in edits_from(start, kinds[lo]) if e.to == end))
        return
    middle = (lo + hi) // 2
    ahead, behind = at_state(start), at_state(end).costs
    for kind in kinds[lo:middle]:
        ahead = forward(ahead, kind)
    for kind in reversed(kinds[middle:hi]):
        behind = backward(behind, kind)
    state = meet(ahead, behind)
    cross(kinds, lo, middle, start, state, found)
    cross(kinds, middle, hi, state, end, found)


def solve(kinds: bytes, start: int = START, end: int | None = None) -> tuple[list[Edit], int]:
    """The edits of all rows and the state they end in; without an `end`, the best one."""
    if end is None:
        ahead = at_state(start)
        for kind in kinds:
            ahead = forward(ahead, kind)
        end = meet(ahead, ENDING)
    found: list[Edit] = []
    if kinds:
        cross(kinds, 0, len(kinds), start, end, found)
    return found, end


class Span(NamedTuple):
    """What is known of one task's part of a conversation: its states at both ends (None: to be
    found), and whether the conversation ends there."""

    start: int = START
    end: int | None = None
    last: bool = True


def split_conversations(ordered: DataFrame) -> set:
    """Ids of conversations that lie in several tasks: at most one per border between tasks."""
    ends = ordered.groupBy(F.spark_partition_id().alias("block")).agg(
        F.min(F.struct("conv_id")).alias("first"), F.max(F.struct("conv_id")).alias("last")
    )
    blocks = sorted((r["block"], r["first"][0], r["last"][0]) for r in ends.collect())
    return {before[2] for before, after in zip(blocks, blocks[1:], strict=False) if before[2] == after[1]}


def spans(ordered: DataFrame, split: set) -> dict[tuple, Span]:
    """(task, conversation): the states at the ends of every part of a split conversation. Each part
    is one row of 32 numbers, and a task has at most two."""
    schema = arrow_schema(block=pa.int32(), conv_id=pa.int64(), costs=pa.list_(pa.int64()), ranks=pa.list_(pa.int32()))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = TaskContext.get().partitionId(), {}
        for batch in batches:
            for conv, role, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv in split:
                    ways = now.setdefault(conv, [(at_state(s), 0) for s in STATES])
                    if fault not in (BLANK, REPEAT):
                        kind = initial_class(role, fault)
                        moved = [(advance(v, kind), zero) for v, zero in ways]
                        now[conv] = [(v, zero + more) for (v, more), zero in moved]
        rows = [
            (block, conv, [c + zero if c < FAR else FAR for v, zero in ways for c in v.costs], [r for v, _ in ways for r in v.ranks])
            for conv, ways in now.items()
        ]
        yield record(schema, *(zip(*rows, strict=True) if rows else [[]] * 4))

    narrow = ordered.select("conv_id", F.substring("role", 1, 1).alias("role"), "fault")
    parts = map_arrow(narrow, tables, "block int, conv_id long, costs array<long>, ranks array<int>")
    by_conv: dict = {}
    for part in sorted(parts.collect(), key=lambda r: r["block"]):
        by_conv.setdefault(part["conv_id"], []).append(part)
    return {key: span for conv, rows in by_conv.items() for key, span in chain(conv, rows)}


def chain(conv, parts: list) -> Iterator[tuple[tuple, Span]]:
    """The spans of one conversation from the tables of its parts in order: vectors go forward over
    the parts, the last one meets the ending, and the states are followed back."""
    now, ways = at_state(START), []
    for part in parts:
        best: dict[int, tuple] = {}
        via: dict[int, int] = {}
        for s in STATES:
            for t in STATES:
                cost = part["costs"][4 * s + t]
                if now.costs[s] < FAR and cost < FAR:
                    way = (now.costs[s] + cost, now.ranks[s], part["ranks"][4 * s + t])
                    if t not in best or way < best[t]:
                        best[t], via[t] = way, s
        now = ranked(best)[0]
        ways.append(via)
    end = meet(now, ENDING)
    for part, via in zip(reversed(parts), reversed(ways), strict=True):
        yield (part["block"], conv), Span(via[end], end, part is parts[-1])
        end = via[end]


EDITED = (
    "conv_id long, block int, place long, edit string, times long, cost long, turn long, fault int, initial string, role string, text string"
)
EDITED_ARROW = arrow_schema(
    conv_id=pa.int64(), block=pa.int32(), place=pa.int64(), edit=pa.string(), times=pa.int64(), cost=pa.int64(),
    turn=pa.int64(), fault=pa.int32(), initial=pa.string(), role=pa.string(), text=pa.string(),
)


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of rows sorted by conversation."""
    conv, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row)
    if rows:
        yield conv, rows


def edited_rows(rows: list[tuple], span: Span) -> Iterator[tuple]:
    """The edits of one part of a conversation in order, as (edit, times, cost, turn, fault, initial,
    role, text): what was inserted has no turn, what was deleted no role and text."""
    free = bytes(initial_class(role, fault) for _, _, role, _, _, fault in rows if fault not in (BLANK, REPEAT))
    found, end = solve(free, span.start, span.end)
    ways, state = iter(found), span.start
    insert = lambda to: ("I", 1, INSERT, None, None, None, ROLES[to], "")
    for _, turn, role, text, copies, fault in rows:
        initial = role[:1]
        if fault in (BLANK, REPEAT):
            yield "D", copies, DELETE * copies, turn, fault, initial, None, None
            continue
        way = next(ways)
        for _ in way.audit[:-1]:
            state = NEXT[state]
            yield insert(state)
        edit, cost = way.audit[-1], way.cost - INSERT * (len(way.audit) - 1)
        state = way.to
        new = {"D": None, "R": ROLES.get(state), "K": role}[edit]
        yield edit, 1, cost, turn, fault, initial, new, None if edit == "D" else text
        if copies > 1:
            yield "D", copies - 1, DELETE * (copies - 1), turn, REPEAT, initial, None, None
    if span.last:
        for _ in range(ENDING[end] // INSERT):
            state = NEXT[state]
            yield insert(state)


def edits(ordered: DataFrame, found: dict[tuple, Span], split: set, apart: bool | None = None) -> DataFrame:
    """The edits of all conversations, or only of those that lie in one task (`apart` False) or in
    several (True); in order within a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, place = TaskContext.get().partitionId(), [], 0
        for conv, group in conversations_of(batches):
            if apart is None or apart == (conv in split):
                for edit in edited_rows(group, found.get((block, conv), Span())):
                    held.append((conv, block, place, *edit))
                    place += 1
                    if len(held) == 1000:
                        yield record(EDITED_ARROW, *zip(*held, strict=True))
                        held = []
        if held:
            yield record(EDITED_ARROW, *zip(*held, strict=True))

    return map_arrow(ordered, rows, EDITED)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of `rows` (conv_id, turn, role, text, and copies if there),
    ordered by block and place: edit (K, R, D, I) and its cost, how many equal rows it stands for,
    the row's turn, fault and first character of its role, and role and text of what stays."""
    ordered = in_order(rows)
    split = split_conversations(ordered)
    return edits(ordered, spans(ordered, split) if split else {}, split)


class Digest:
    """Counts and digest of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.turns: list[int] = []  # first and last one
        self.distinct = self.illegal = self.cost = 0
        self.faults = [0] * 4
        self.initial: str | None = None
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.any = False

    def add(self, edit: str, times: int, cost: int, turn, fault, initial, role, text) -> None:
        self.audit.append(edit * times)
        self.cost += cost
        if edit != "I":
            if turn is not None:
                self.distinct += not self.turns or turn != self.turns[-1]
                self.turns = [*self.turns[:1], turn]
            self.faults[fault] += times
            self.illegal += times - 1 + (self.initial is not None and self.initial + initial not in LEGAL)
            self.initial = initial
        if role is not None:
            self.sha.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.turns[-1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
DIGESTS_ARROW = arrow_schema(
    conv_id=pa.int64(), **dict.fromkeys(("gaps", *FAULTS.values(), "illegal", "cost"), pa.int64()), audit=pa.string(), repaired_sha256=pa.string()
)


def digests(edited: DataFrame) -> DataFrame:
    """One row per conversation of edits that are in order within their tasks. Rows are read one by
    one; of a conversation only its counts and its audit are held."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            at, *fields = [batch.column(i).to_pylist() for i in (0, *range(3, batch.num_columns))]
            for key, *edit in zip(at, *fields, strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, *state.row()))
                    conv, state = key, Digest()
                state.add(*edit)
            if done:
                yield record(DIGESTS_ARROW, *zip(*done, strict=True))
                done = []
        if state is not None:
            yield record(DIGESTS_ARROW, *zip((conv, *state.row()), strict=True))

    return map_arrow(edited, rows, DIGESTS)


def repaired_digests(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """One row per conv_id of `originals`: faults before the repair, cost, audit and digest of it."""
    ordered = in_order(rows)
    split = split_conversations(ordered)
    found = digests(edits(ordered, {}, split, apart=False))
    if split:
        streamed = edits(ordered, spans(ordered, split), split, apart=True).repartition("conv_id")
        found = found.unionByName(digests(streamed.sortWithinPartitions("conv_id", "block", "place")))
    ids = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = found.withColumnRenamed("conv_id", "_conv")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    columns = [F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "_conv"]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *columns)
