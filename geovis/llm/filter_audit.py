"""Interaction of filters: what every order of a set of filters removes, step by step.

A document's failure mask has one bit per filter. All orders depend on the masks alone, so Spark
counts documents by part and mask (at most 2^filters rows a part, pre-aggregated before every
shuffle), and each part's counts become one small decision diagram.

Diagram. A level per filter in the present order, the low edge for documents that pass, the high
edge for those that fail, and one leaf per distinct count vector (documents, good, toxic). Every
node knows the sum of the leaves below it. Nodes are kept once (equal children on equal levels are
the same node). Neighbouring levels are swapped in place, and one swap leads from each order to the
next, so all orders are visited without building a diagram anew. In an order, the path of low edges
from the root is the history of the documents that nothing removed yet: the weight on its high edge
is what a step removes, the weight on its low edge is what the step keeps.

Identical texts are found by SHA-256 and whole-table minimum of doc_id. Rows are summed per text
before they meet, so a text that a third of the rows share costs as little as any other.

Defined results: a null or empty text is the empty text; a null lang is the part of the empty
string; rows with a null doc_id count, take no label, and are never a repeat nor repeated; repeated
rows count once each and are no repeats of one another (a smaller doc_id is needed); a doc_id with
several label rows is good (toxic) if any of them says so; an empty table has no parts. Columns
other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, map_arrow, record, stored

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("n", "good", "toxic")
STEPS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_rules(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: name and failure condition."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": size < 200,
        "B": F.lit(100) * distinct < F.lit(50) * size,
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


#: The filter that needs the whole table: the text stands at a smaller doc_id too.
REPEAT = "E"


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by failure mask. Bit 0 is filter A."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = text_rules(F.col("_text"))
    bits = [F.when(rules[name], 1 << at).otherwise(0) for at, name in enumerate(rules)]
    judged = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text")).select(
        "doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("mask"), F.unhex(F.sha2("_text", 256)).alias("sha")
    )
    rows = stored(judged, "failure-masks")
    flag = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(name)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    by_doc = rows.filter("doc_id is not null").groupBy("doc_id", "sha", "part", "mask").agg(F.count("*").alias("n"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    known = by_doc.join(marks, "doc_id", "left").select("doc_id", "sha", "part", "mask", "n", zero("quality"), zero("toxic"))

    # All rows of a text in a part with equal labels become one row, which keeps the smallest
    # doc_id and how many rows have it: only those can be free of a smaller one.
    alike = known.groupBy("sha", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("sha"))
    fresh = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = alike.withColumn("fresh", fresh).select(
        "part", "mask", "quality", "toxic",
        F.explode(F.array(
            F.struct(F.lit(0).alias("repeat"), F.col("fresh").alias("n")),
            F.struct(F.lit(1).alias("repeat"), (F.col("n") - F.col("fresh")).alias("n")),
        )).alias("s"),
    ).filter("s.n > 0")
    whole = (F.col("mask") + F.col("s.repeat") * (1 << len(rules))).alias("mask")
    masks = split.select("part", whole, "quality", "toxic", F.col("s.n").alias("n"))
    nameless = rows.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    masks = masks.unionByName(nameless.select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "n"))
    total = lambda name, of: F.sum(of).cast("long").alias(name)
    return masks.groupBy("part", "mask").agg(
        total("n", F.col("n")), total("good", F.col("n") * F.col("quality")), total("toxic", F.col("n") * F.col("toxic"))
    )


class Diagram:
    """Decision diagram of the counts of all failure masks, in a changing order of filters.

    A node is a number; `low`, `high` and `weight` hold its edges and the sum of its leaves. Levels
    are never skipped, so a node on level k has its children on level k + 1.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.filters = (len(counts) - 1).bit_length()
        self.order = list(range(self.filters))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[np.ndarray] = []
        self.known: dict[tuple, int] = {}
        self.root = self.grow(counts, 0, 0)

    def grow(self, counts: np.ndarray, level: int, mask: int) -> int:
        if level == self.filters:
            return self.leaf(counts[mask])
        passing = self.grow(counts, level + 1, mask)
        return self.node(level, passing, self.grow(counts, level + 1, mask | 1 << self.order[level]))

    def leaf(self, counts: np.ndarray) -> int:
        return self.keep((self.filters, *counts.tolist()), -1, -1, counts)

    def node(self, level: int, low: int, high: int) -> int:
        return self.keep((level, low, high), low, high, self.weight[low] + self.weight[high])

    def keep(self, key: tuple, low: int, high: int, weight: np.ndarray) -> int:
        if key not in self.known:
            self.known[key] = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.weight.append(weight)
        return self.known[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next one. The leaves and everything below the two
        levels stay; above them the edges are drawn anew."""
        self.root = self.swapped(self.root, 0, level, {})
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def swapped(self, node: int, at: int, level: int, done: dict[int, int]) -> int:
        if node not in done:
            low, high = self.low[node], self.high[node]
            if at == level:
                new_low = self.node(level + 1, self.low[low], self.low[high])
                new_high = self.node(level + 1, self.high[low], self.high[high])
            else:
                new_low, new_high = (self.swapped(x, at + 1, level, done) for x in (low, high))
            done[node] = self.node(at, new_low, new_high)
        return done[node]

    def path(self) -> Iterator[tuple[int, int, int]]:
        """(filter, low child, high child) along the all-pass path, in the present order."""
        node = self.root
        for bit in self.order:
            yield bit, self.low[node], self.high[node]
            node = self.low[node]

    def only(self, node: int) -> np.ndarray:
        """Leaf of a node that passes everything below."""
        while self.low[node] >= 0:
            node = self.low[node]
        return self.weight[node]


def orders(count: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that every order of `count` filters is met once: the
    last filter moves through every order of the others, up and down in turn."""
    if count < 2:
        return
    inner, down = orders(count - 1), True
    while True:
        yield from range(count - 2, -1, -1) if down else range(count - 1)
        step = next(inner, None)
        if step is None:
            return
        # With the last filter in front, the others stand one level lower.
        yield step + 1 if down else step
        down = not down


def steps(counts: np.ndarray, names: str) -> Iterator[tuple]:
    """(filter_order, step, *STEPS) for all orders, from the counts of every mask."""
    diagram = Diagram(counts)
    fails = [counts[[m for m in range(len(counts)) if m >> bit & 1], 0].sum() for bit in range(len(names))]
    rows, shapley = [], np.zeros(len(names), np.int64)
    for swap in (None, *orders(len(names))):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(names[bit] for bit in diagram.order)
        for step, (bit, low, high) in enumerate(diagram.path(), 1):
            removed, good, toxic = diagram.weight[high]
            kept, alone = diagram.weight[low][0], diagram.only(high)[0]
            rows.append((order, step, kept, removed, fails[bit] - removed, alone, good, toxic, bit))
            shapley[bit] += removed
    for *row, bit in rows:
        yield *row, shapley[bit]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of STEPS, for every part and every order."""
    names = "".join(text_rules(F.lit(""))) + REPEAT
    return audit_masks(mask_counts(docs, labels), names)


def audit_masks(masks: DataFrame, names: str) -> DataFrame:
    """The audit of any filters from (part, mask, n, good, toxic); bit k of a mask is `names[k]`. A
    part has at most 2^filters masks, so its row stays small."""
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))
    schema = arrow_schema(part=pa.string(), filter_order=pa.string(), step=pa.int32(), **{name: pa.int64() for name in STEPS})
    sql = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in STEPS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.zeros((1 << len(names), len(COUNTS)), np.int64)
                for m in found:
                    counts[m["mask"]] += [m[c] for c in COUNTS]
                columns = list(zip(*steps(counts, names), strict=True))
                yield record(schema, [part] * len(columns[0]), *columns)

    return map_arrow(parts, rows, sql)
