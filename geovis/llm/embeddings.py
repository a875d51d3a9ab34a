"""Embedding near-duplicates by quantised tile products with rigorous error bounds.

Equal vectors are one node. Nodes are dealt into tiles: by the nearest of a few pivots, and within
a pivot by hash, so that a tile has about TILE vectors. Two pivots' tiles meet only if the angles
of their members allow a link: the angle between the pivots less both radii is at most the
angle of the threshold. A pair of tiles is one product of 8-bit integers.

Each unit vector v is s*q + e with integer q in -127..127; the error's length |e| is computed
exactly and kept. For unit u and v the true product differs from s_u*s_v*(q_u . q_v) by at most
|s_u*q_u|*|e_v| + |e_u|. Pairs certain by that bound are taken or left; only the rest, possibly
above the threshold, are computed again from the full vectors in double precision. A pair of
tiles returns link counts per vector and a spanning forest of its links, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have
no links and are a component of their own; vectors of different length do not link; equal
vectors link with each other; rows with a null vec_id link and bridge, but have a null component and
are not kept (ids are below 2^62 then); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, cut, map_arrow, record, slices, stored
from geovis.llm.components import components, forest, whole_groups

THRESHOLD = 0.9
TILE = 4096
PIVOTS = 16
SAMPLE_VECTORS = 2048
STRIP = 512  # rows of a tile multiplied at a time
SLACK = 1e-9  # above the rounding of the double precision products


def usable(vector: Column) -> Column:
    """Not null, not empty, finite components, not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array<double>), null if it can't link. Minus zero becomes zero, so that equal
    vectors are equal as values."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    return df.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector_col)), wide).alias("vector"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Quantised:
    """Unit vectors as 8-bit integers with scales, lengths and exact error lengths."""

    def __init__(self, m: np.ndarray) -> None:
        self.unit = unit(m)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.q = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        close = self.q * self.scale[:, None]
        self.length = np.linalg.norm(close, axis=1)
        self.error = np.linalg.norm(self.unit - close, axis=1)
        # Products of integers are exact in single precision up to 2**24.
        self.exact = np.float32 if m.shape[1] * 127**2 < 1 << 24 else np.float64


def linked(left: Quantised, right: Quantised, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Strips of the link matrix of two tiles: first row, booleans."""
    wide = right.q.astype(left.exact).T
    for start in range(0, len(left.q), STRIP):
        rows = slice(start, start + STRIP)
        near = (left.q[rows].astype(left.exact) @ wide) * left.scale[rows, None] * right.scale[None, :]
        bound = left.length[rows, None] * right.error[None, :] + left.error[rows, None] + SLACK
        yes = near - bound >= threshold
        i, j = np.nonzero((near + bound >= threshold) & ~yes)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            yes[a, b] = np.einsum("ij,ij->i", left.unit[rows][a], right.unit[b]) >= threshold
        yield start, yes


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """PIVOTS vectors far from each other, starting from the first."""
    if not len(sample):
        return sample
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < min(PIVOTS, len(sample)):
        at = int(best.argmin())
        chosen.append(at)
        best = np.maximum(best, sample @ sample[at])
    return sample[chosen]


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, n, vector of the distinct vectors: the smallest id and the number of rows. A vector that
    only rows without an id have gets a number above all ids: it links and bridges like any other,
    and is never the smallest of a component that has an id."""
    top = rows.agg(F.max("id")).first()[0]
    above = F.lit(max(top or 0, 0) + 1) + F.monotonically_increasing_id()
    nodes = rows.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    return nodes.select("vector", F.coalesce("node", above).alias("node"), "n")


def with_pivot(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the vector's length, its nearest pivot and the angle to it."""
    schema = arrow_schema(node=pa.int64(), n=pa.int64(), vector=pa.list_(pa.float64()), size=pa.int32(), pivot=pa.int32(), angle=pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                cosine = unit(matrix(part.column(2))) @ pivots[int(size)].T
                nearest = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(nearest)), nearest], -1, 1))
                yield record(schema, part.column(0), part.column(1), part.column(2), np.full(len(nearest), size, np.int32), nearest.astype(np.int32), angle)

    return map_arrow(nodes.select("node", "n", "vector"), run, "node long, n long, vector array<double>, size int, pivot int, angle double")


def tile_pairs(groups: list, pivots: dict[int, np.ndarray], threshold: float) -> tuple[dict, dict]:
    """Number of tiles of each (size, pivot) and the groups each must meet. Groups are bounded by
    the number of pivots for each length of vector."""
    parts = {(g["size"], g["pivot"]): -(-g["count"] // TILE) for g in groups}
    radius = {(g["size"], g["pivot"]): g["radius"] for g in groups}
    reach = float(np.arccos(threshold)) + 1e-6
    meets: dict = {}
    for a in parts:
        apart = np.arccos(np.clip(pivots[a[0]] @ pivots[a[0]][a[1]], -1, 1))
        meets[a] = [b for b in sorted(parts) if b[0] == a[0] and b >= a and (b == a or apart[b[1]] - radius[a] - radius[b] <= reach)]
    return parts, meets


def tiles(placed: DataFrame, parts: dict) -> DataFrame:
    """One row per tile: size, pivot, part, and its nodes, counts and vectors as arrays."""
    flat = [F.lit(x) for (size, pivot), n in parts.items() for x in (f"{size}/{pivot}", n)]
    group = F.concat_ws("/", "size", "pivot")
    part = F.pmod(F.xxhash64("node"), F.element_at(F.create_map(*flat), group))
    keyed = placed.select(F.xxhash64("size", "pivot", part).alias("key"), "size", "pivot", part.cast("int").alias("part"), "node", "n", "vector")
    schema = arrow_schema(size=pa.int32(), pivot=pa.int32(), part=pa.int32(), nodes=pa.binary(), counts=pa.binary(), data=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, rows=1):
            triple = np.stack([table.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
            for size, pivot, at in np.unique(triple, axis=0):
                mine = table.filter(pa.array((triple == (size, pivot, at)).all(axis=1))).combine_chunks()
                m = matrix(pa.concat_arrays(mine.column(6).chunks))
                yield record(schema, [size], [pivot], [at], [mine.column(4).to_numpy().astype("<i8").tobytes()], [mine.column(5).to_numpy().astype("<i8").tobytes()], [m.tobytes()])

    ordered = keyed.repartition("key").sortWithinPartitions("key", "node")
    return map_arrow(ordered, run, "size int, pivot int, part int, nodes binary, counts binary, data binary")


def meetings(tile: DataFrame, parts: dict, meets: dict) -> DataFrame:
    """Every pair of tiles that must meet, with what both hold. Both sides name the pair and meet
    in an equi-join on it."""
    orders: dict = {a: [] for a in parts}  # group: (group of the left tile, of the right tile)
    for a, others in meets.items():
        for b in others:
            orders[a].append((a, b, True))
            orders[b].append((a, b, False))
    label = lambda g: f"{g[0]}/{g[1]}"
    total = {label(g): n for g, n in parts.items()}

    def side(left: bool) -> DataFrame:
        group = F.concat_ws("/", "size", "pivot")
        others = {label(a): sorted({label(y if left else x) for x, y, is_left in orders[a] if is_left == left}) for a in parts}
        counts = F.create_map(*[F.lit(x) for kv in total.items() for x in kv])
        partners = F.element_at(F.create_map(*[y for k, v in others.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]).cast("array<string>"))]), group)
        named = tile.select(group.alias("own"), F.col("part").alias("own_part"), "nodes", "counts", "data", F.explode(partners).alias("other"))
        spread = named.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.element_at(counts, F.col("other")) - 1)))
        if left:
            spread = spread.filter((F.col("own") != F.col("other")) | (F.col("own_part") <= F.col("other_part")))
            return spread.select(F.concat_ws(":", "own", "own_part", "other", "other_part").alias("pair"), F.struct("nodes", "counts", "data").alias("l"))
        spread = spread.filter((F.col("own") != F.col("other")) | (F.col("own_part") >= F.col("other_part")))
        return spread.select(F.concat_ws(":", "other", "other_part", "own", "own_part").alias("pair"), F.struct("nodes", "counts", "data").alias("r"))

    return side(True).join(side(False), "pair").select("l", "r")


def block_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b: nodes of the forest, or b null and n: rows linked to a in a pair of tiles."""
    schema = arrow_schema(a=pa.int64(), b=pa.int64(), n=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (l_nodes, l_n, left), (r_nodes, r_n, right) = (unpacked(batch.column(k)[0].as_py()) for k in (0, 1))
            same = len(l_nodes) == len(r_nodes) and bool((l_nodes == r_nodes).all())
            l_links, r_links = np.zeros(len(l_nodes), np.int64), np.zeros(len(r_nodes), np.int64)

            def rows() -> Iterator[tuple[int, np.ndarray]]:
                for start, yes in linked(left, right, threshold):
                    k = np.arange(len(yes))
                    if same:
                        yes[k, k + start] = False
                    l_links[start : start + len(yes)] += yes @ r_n
                    if not same:
                        r_links[:] += l_n[start : start + len(yes)] @ yes
                    for r in np.flatnonzero(yes.any(axis=1)):
                        yield int(start + r), np.flatnonzero(yes[r])

            found = np.array(forest(rows(), len(r_nodes)), np.int64).reshape(-1, 2)
            i, j = np.flatnonzero(l_links), np.flatnonzero(r_links)
            a = np.concatenate([l_nodes[found[:, 0]], l_nodes[i], r_nodes[j]])
            b = pa.array(np.concatenate([r_nodes[found[:, 1]], l_nodes[i], r_nodes[j]]), mask=np.arange(len(a)) >= len(found))
            yield record(schema, a, b, np.concatenate([np.zeros(len(found), np.int64), l_links[i], r_links[j]]))

    return map_arrow(pairs, run, "a long, b long, n long")


def unpacked(side: dict) -> tuple[np.ndarray, np.ndarray, Quantised]:
    nodes, counts = np.frombuffer(side["nodes"], "<i8"), np.frombuffer(side["counts"], "<i8")
    return nodes, counts, Quantised(np.frombuffer(side["data"], np.float64).reshape(len(nodes), -1))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id it reaches), kept."""
    rows = vectors(df, id_col, vector_col)
    nodes = stored(nodes_of(rows), "vectors")
    few = nodes.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE_VECTORS).collect()
    sizes = [r["size"] for r in nodes.select(F.size("vector").alias("size")).distinct().collect()]
    samples = {s: np.array([r["vector"] for r in few if len(r["vector"]) == s], np.float64).reshape(-1, s) for s in sizes}
    pivots = {s: choose_pivots(unit(m)) if len(m) else np.eye(1, s) for s, m in samples.items()}
    placed = stored(with_pivot(nodes, pivots), "placed")
    groups = placed.groupBy("size", "pivot").agg(F.count("*").alias("count"), F.max("angle").alias("radius")).collect()
    if not groups:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    parts, meets = tile_pairs(groups, pivots, threshold)
    found = stored(block_links(meetings(stored(tiles(placed, parts), "tiles"), parts, meets), threshold), "links")
    joined = components(found.filter("b is not null").select("a", "b"))
    links = cut(found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")))
    known = nodes.join(links, "node", "left").join(joined, "node", "left")
    known = cut(known.select("vector", F.col("n"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    out = rows.join(known, "vector", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
