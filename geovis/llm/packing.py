"""Packing documents into sequences of a fixed number of tokens.

Large-item matching. A piece above a third of the capacity shares its sequence with at most one
other such piece; these are paired greedily, the largest with the largest that still fits. The
smaller pieces then go, largest first, to the tightest gap that takes them, and open a new
sequence only if there is none.

A length is an integer of 1 to `capacity`, so the plan needs only the number of pieces of each
length (at most `capacity` numbers, whatever the corpus). Equal sequences are planned together:
the plan has `Run`s, each placing consecutive pieces of one length into consecutive sequences.
Spark counts the lengths, ranks the pieces within their length and looks their place up.

Ranking needs no shuffle of equal lengths into one task: a piece's rank is its place among the
pieces of its length in its own input split, written with the piece, plus the number of such
pieces in earlier splits.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are
packed once each; a null doc_id is kept as null; an empty table gives no rows. Columns of the
input other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, id_and_text, map_arrow, record, slices, stored
from geovis.llm.word_tokens import word_ids

CAPACITY = 2048


class Run(NamedTuple):
    """Pieces of `length` with ranks `rank` to `rank + count - 1`: `each` per sequence, from
    sequence `first` on, the first of each at `base`."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    base: int


class Plan:
    """Places for `counts[length]` pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.done = dict.fromkeys(self.left, 0)
        self.runs: list[Run] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, sequences)]
        self.sizes: list[int] = []  # the gaps there are, ascending
        if any(not 0 < s <= capacity for s in self.left):
            raise ValueError("a length is 1 to the capacity")
        self.match_large()
        for length in sorted((s for s in self.left if 3 * s <= capacity), reverse=True):
            self.fill(length)

    def put(self, length: int, count: int, first: int, each: int, base: int) -> None:
        self.runs.append(Run(length, self.done[length], count, first, each, base))
        self.done[length] += count
        self.left[length] -= count

    def open(self, count: int, used: int) -> None:
        """`count` new sequences, `used` tokens of each taken."""
        self.keep(self.sequences, count, self.capacity - used)
        self.sequences += count

    def keep(self, first: int, count: int, gap: int) -> None:
        if count and gap:
            if gap not in self.gaps:
                insort(self.sizes, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((first, count))

    def match_large(self) -> None:
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            a = large[-1]
            at = bisect_left(large, self.capacity - a + 1) - 1
            if at >= 0 and large[at] == a and self.left[a] == 1:
                at -= 1
            if at < 0:
                n = self.left[a]
                self.put(a, n, self.sequences, 1, 0)
                self.open(n, a)
            elif large[at] == a:
                n = self.left[a] // 2
                self.put(a, 2 * n, self.sequences, 2, 0)
                self.open(n, 2 * a)
            else:
                b = large[at]
                n = min(self.left[a], self.left[b])
                self.put(a, n, self.sequences, 1, 0)
                self.put(b, n, self.sequences, 1, a)
                self.open(n, a + b)
            large = [s for s in large if self.left[s]]

    def fill(self, length: int) -> None:
        while self.left[length]:
            at = bisect_left(self.sizes, length)
            if at == len(self.sizes):
                n = self.left[length]
                each = self.capacity // length
                self.keep(self.sequences, -(-n // each), self.capacity)
                self.sequences += -(-n // each)
                continue
            gap = self.sizes[at]
            first, count = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                del self.sizes[at]
            each, base = gap // length, self.capacity - gap
            full = min(count, self.left[length] // each)
            if full:
                self.put(length, full * each, first, each, base)
                self.keep(first, full, gap - each * length)
            if full < count:
                some = self.left[length]  # fewer than a sequence takes, or none
                if some:
                    self.put(length, some, first + full, some, base)
                    self.keep(first + full, 1, gap - some * length)
                    full += 1
                self.keep(first + full, count - full, gap)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's ids and `end_id`, cut into pieces of at most `capacity`: doc_id, piece,
    start, length, ids_crc32; `split` and `split_rank` place a piece among those of its length
    in its input split. `with_ids` adds the ids as little-endian unsigned 32-bit integers."""
    schema = arrow_schema(
        doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(),
        split=pa.int64(), split_rank=pa.int64(), **({"ids": pa.binary()} if with_ids else {}),
    )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = word_ids(vocabulary), TaskContext.get().partitionId()
        seen, end, step = np.zeros(capacity + 1, np.int64), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in slices(batches, 500):
            rows = []
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(part), split, int(seen[n]), *([part] if with_ids else [])))
                    seen[n] += 1
            yield record(schema, *zip(*rows, strict=True))

    return map_arrow(id_and_text(docs), cut_up, ", ".join(f"{f.name} {SQL[f.type]}" for f in schema))


SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for a written table of `pieces`."""
    by_split = cut.groupBy("length", "split").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_split.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(Plan(counts, capacity).runs)  # at most a few per length
    columns = np.array(runs, np.int64).reshape(-1, len(Run._fields)).T
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_split.select("length", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["length", "split"]).withColumn("rank", F.col("earlier") + F.col("split_rank"))
    kept = [c for c in cut.columns if c not in ("split", "split_rank")]
    ranked = ranked.select(*kept, "rank")
    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    length_at, rank_at = ranked.columns.index("length"), ranked.columns.index("rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, each, base = columns
        keys = (length << 48) + rank
        for batch in batches:
            s, r = (batch.column(i).to_numpy() for i in (length_at, rank_at))
            run = np.searchsorted(keys, (s << 48) + r, side="right") - 1
            past = r - rank[run]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != rank_at]
            places = pa.array(first[run] + past // each[run]), pa.array(base[run] + past % each[run] * s)
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*rest, *places], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked, look_up, out)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places: doc_id, piece, start, length, ids_crc32,
    (ids,) sequence_id, offset. Tokenising happens once; its pieces are written to the shared
    folder."""
    return place(stored(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from `pack(..., with_ids=True)`: sequence_id, ids. A
    sequence never holds more than the capacity."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(placed, F.lit(b"").cast("binary"), lambda so_far, x: F.concat(so_far, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
