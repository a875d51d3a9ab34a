"""Connected components, and spanning forests of blocks of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of `links` (a, b: long) other
    than the smallest of each component.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are
    linked to the smallest one. The number of rounds grows with the logarithm of the size of a
    component. The smallest neighbours are written before they meet the links again, so both
    sides of that join are plain exchanges and Spark can split the rows of a large star.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, signature(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def signature(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = links.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 24))).first()
    return tuple(row)


class Forest:
    """Links of a block between rows and columns, cut down to those that keep every connection. The
    columns come in slices, each of which is forgotten; what is kept of them is how rows hang
    together."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, rows: Iterable[tuple[int, np.ndarray]], n_columns: int) -> list[tuple[int, int]]:
        """The links to keep of one slice of columns, as (row, column). `rows` gives each row with
        the columns it is linked to."""
        owner, parent, root = np.full(n_columns, -1, np.int64), self.parent, self.root
        kept = []
        for r, columns in rows:
            parent.setdefault(r, r)
            owners = owner[columns]
            fresh = columns[owners < 0]
            owner[fresh] = r
            kept += [(r, int(c)) for c in fresh]
            if len(fresh) < len(columns):
                for other, at in zip(*np.unique(owners, return_index=True), strict=True):
                    if other >= 0 and root(int(other)) != root(r):
                        parent[root(int(other))] = root(r)
                        kept.append((r, int(columns[at])))
        return kept


def forest(rows: Iterable[tuple[int, np.ndarray]], n_columns: int) -> list[tuple[int, int]]:
    """(row, column) pairs that keep every connection of a block of links, at most one per row
    and column. `rows` gives each row with the columns it is linked to."""
    return Forest().add(rows, n_columns)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables that end where a value of the sorted key column ends, of `rows` rows or one more
    group each."""
    for table, _ in bounded_groups(batches, key, None, rows):
        yield table


def bounded_groups(batches: Iterator[pa.RecordBatch], key: int, later: int | None, rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of about `rows` rows that end where a value of the sorted key column ends, with False.
    Of a group of more rows than that, parts come as tables of their own, with True; its last rows
    begin the table behind them. Parts end only where the flag column `later` is set, so the rows
    without the flag, which come first, are all in the first part. Without such a column no group
    is cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield table.slice(0, last), False
            table = table.slice(last)
        if later is not None and table.num_rows >= rows and table.column(later)[-1].as_py():
            yield table, True
            table = table.slice(table.num_rows)
        held = table.to_batches()
        n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False
