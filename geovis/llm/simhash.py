"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Two fingerprints link
if at most `radius` bits differ. The 64 bits are dealt into parts, bits that vary together into
the same part, as they carry less information apart. Part i gets its own threshold t_i (-1: not
probed) with the sum of (t_i + 1) equal to radius + 1: if a pair exceeded every t_i, it would
differ in more than `radius` bits. Dynamic programming over the parts picks the thresholds with
the smallest estimated work; the estimate comes from the balance of the bits and a bounded sample
of fingerprints, and has no influence on the result.

Each distinct fingerprint is stored under its own value of every probed part and probes all
values within that part's threshold. A bucket compares what is stored with what probes it and
returns a spanning forest of the links found, never all its pairs. A bucket that very many
fingerprints share is cut into blocks of its stored rows, each of which meets all its probes.

Defined results: texts without words (null, empty, white space) have fingerprint zero and link
like any other; fewer words than a shingle are one shingle; equal fingerprints are one node, so
repeated texts cost nothing; a row with a null doc_id has a fingerprint but no component; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, cut, id_and_text, map_arrow, record, same_bits, slices, stored
from geovis.llm.components import Forest, bounded_groups, components

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
SAMPLE_FINGERPRINTS = 2048
MOST_PARTS = 5
MOST_PROBES = 4096
VERIFY_COST = 0.05  # of moving a row, for comparing a pair
BLOCK = 4096
HELD = 50_000  # rows of buckets in memory at once
HOT_SHARE = 1000  # a part value of more than 1/1000 of all fingerprints (and a block) is cut


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles of lower-cased words; white space and case are ASCII's."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lower, upper = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(lower[at : at + (1 << 16)], upper[at : at + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long)."""
    schema = arrow_schema(doc_id=pa.int64(), bits=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield record(schema, batch.column(0), found.view(np.int64))

    return map_arrow(id_and_text(docs), run, "doc_id long, bits long")


def spread_bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them each two bits are both set."""
    schema = arrow_schema(i=pa.int32(), j=pa.int32(), n=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS + 1, BITS + 1))
        for batch in slices(batches, 50_000):
            bits = spread_bits(batch.column(0).to_numpy()).astype(np.float32)
            bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            both += bits.T @ bits
        i, j = np.indices(both.shape)
        yield record(schema, i.ravel().astype(np.int32), j.ravel().astype(np.int32), np.rint(both.ravel()).astype(np.int64))

    rows = map_arrow(nodes.select("bits"), run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS + 1, BITS + 1))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    return int(both[BITS, BITS]), both[:BITS, :BITS]


def correlated_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts of equal size; a part takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [min(left, key=lambda b: (-max((tied[b, c] for c in left if c != b), default=0), b))]
        left -= {group[0]}
        while len(group) < size:
            best = min(left, key=lambda b: (-float(tied[b, group].mean()), b))
            group.append(best)
            left -= {best}
        out.append(sorted(group))
    return out


def near_share(part: list[int], p: np.ndarray, sample: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most t bits of the part, for t = 0 to `most`."""
    chance = np.zeros(most + 2)
    chance[0] = 1
    for b in part:
        differ = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    expected = np.cumsum(chance[: most + 1])
    if len(sample) < 2:
        return expected
    bits = sample[:, part].astype(np.float32)
    ones = bits.sum(axis=1)
    apart = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
    pairs = apart[np.triu_indices(len(sample), 1)]
    return np.maximum(expected, [(pairs <= t).mean() for t in range(most + 1)])


def allocate(n: int, both: np.ndarray, sample: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, by the smallest estimated work."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (np.inf, [])
    for parts in range(1, min(MOST_PARTS, radius + 1) + 1):
        groups = correlated_parts(both, n, parts)
        # least[s]: smallest work of the parts so far that use s of the radius + 1 units
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (radius + 1)
        for group in groups:
            near, after = near_share(group, p, sample, radius), [(np.inf, [])] * (radius + 2)
            for used, (work, chosen) in enumerate(least):
                for t in range(-1, radius + 1 - used):
                    probes = sum(comb(len(group), r) for r in range(t + 1))
                    if work == np.inf or probes > MOST_PROBES:
                        continue
                    own = n * probes + VERIFY_COST * n * n / 2 * near[t] if t >= 0 else 0.0
                    if work + own < after[used + t + 1][0]:
                        after[used + t + 1] = (work + own, [*chosen, t])
            least = after
        if least[radius + 1][0] < best[0]:
            best = (least[radius + 1][0], list(zip(groups, least[radius + 1][1], strict=True)))
    return [(group, t) for group, t in best[1] if t >= 0]


def flips(part: list[int], threshold: int) -> np.ndarray:
    """Masks with at most `threshold` bits of the part set; the empty one comes first."""
    return np.array([sum(1 << b for b in some) for r in range(threshold + 1) for some in combinations(part, r)], np.uint64)


def mixed(values: np.ndarray, part: int) -> np.ndarray:
    """A bucket's key: part value and part, mixed to 64 bits. Buckets that share a key are
    compared with each other, which finds no wrong link, since links are verified."""
    h = values + np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]], hot: dict[int, int]) -> DataFrame:
    """key, stored (own value) or probing, bits and node; keys end in the number of their block.

    `hot` says how many blocks a shared key has: a stored row goes to one block as stored and
    probes the others, a probing row goes to all of them."""
    schema = arrow_schema(key=pa.int64(), probing=pa.bool_(), bits=pa.int64(), node=pa.int64())
    shared = np.array(sorted(hot), np.uint64) if hot else np.zeros(1, np.uint64)
    blocks = np.array([hot.get(int(k), 1) for k in shared], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            bits = batch.column(0).to_numpy().view(np.uint64)
            node = batch.column(1).to_numpy()
            for k, (part, threshold) in enumerate(plan):
                inside = np.uint64(sum(1 << b for b in part))
                for group in np.array_split(flips(part, threshold), max(1, comb(len(part), threshold) // 64)):
                    keys = mixed((bits[:, None] ^ group[None, :]) & inside, k)
                    rows, own = np.indices(keys.shape)[0].ravel(), np.broadcast_to(group == 0, keys.shape).ravel()
                    yield from dealt(keys.ravel(), ~own, bits[rows], node[rows])

    def dealt(keys: np.ndarray, probing: np.ndarray, bits: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        n = np.where(shared[at] == keys, blocks[at], 1)
        if (n > 1).any():
            rows = np.repeat(np.arange(len(keys)), n)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            home = (mixed(bits, 99) % n.astype(np.uint64)).astype(np.int64)[rows]
            keys, probing, bits, node = keys[rows], probing[rows] | (block != home), bits[rows], node[rows]
            keys = np.where(n[rows] > 1, mixed(keys + block.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 7), keys)
        yield record(schema, keys.view(np.int64), probing, bits.view(np.int64), node)

    return map_arrow(nodes.select("bits", "node"), run, "key long, probing boolean, bits long, node long")


def shared_keys(nodes: DataFrame, plan: list[tuple[list[int], int]], n: int) -> dict[int, int]:
    """Number of blocks of the keys under which more than a block and 1/HOT_SHARE of all
    fingerprints are stored: at most HOT_SHARE keys for each part."""
    least = max(BLOCK, n // HOT_SHARE)
    stored_rows = probes(nodes, [(part, 0) for part, _ in plan], {})
    counts = stored_rows.groupBy("key").count().filter(F.col("count") > least).collect()
    return {r["key"] % (1 << 64): -(-r["count"] // least) for r in counts}


class Bucket:
    """What is stored under a key; `meet` gives the links of some of the rows that probe it. Rows
    come in slices, so only the stored ones are held."""

    def __init__(self, bits: np.ndarray, node: np.ndarray, radius: int) -> None:
        self.bits, self.node, self.radius, self.forest = bits, node, radius, Forest()

    def meet(self, bits: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hits = ((r, np.flatnonzero(np.bitwise_count(bits ^ own) <= self.radius)) for r, own in enumerate(self.bits))
        found = np.array(self.forest.add(hits, len(bits)), np.int64).reshape(-1, 2)
        return self.node[found[:, 0]], node[found[:, 1]]


def bucket_links(rows: DataFrame, radius: int = RADIUS, held: int = HELD) -> DataFrame:
    """a, b: nodes of a spanning forest of the links of each bucket. About `held` rows are in memory
    at once, and the rows stored in one bucket."""
    schema = arrow_schema(a=pa.int64(), b=pa.int64())

    def whole_buckets(key: np.ndarray, probing: np.ndarray, bits: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        use = (sizes > 1) & ~probing[first]  # stored rows sort first
        small = use & (sizes <= 4)
        for d in range(1, 4):
            for at in range(0, 4 - d):
                i = first[small & (sizes > at + d)] + at
                i = i[~probing[i]]
                close = (np.bitwise_count(bits[i] ^ bits[i + d]) <= radius) & (node[i] != node[i + d])
                yield node[i[close]], node[i[close] + d]
        for start, size in zip(first[use & ~small].tolist(), sizes[use & ~small].tolist(), strict=True):
            inside = slice(start, start + size)
            own = slice(start, start + int(np.count_nonzero(~probing[inside])))
            yield Bucket(bits[own], node[own], radius).meet(bits[inside], node[inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, large_key = None, None  # a bucket whose rows are still coming
        for table, goes_on in bounded_groups(slices(batches, held), 0, 1, held):
            key, probing, bits, node = (c.to_numpy() for c in table.columns)
            bits, links, begin = bits.view(np.uint64), [], 0
            if large is not None and key[0] == large_key:
                begin = int(np.searchsorted(key, large_key, side="right"))
                links.append(large.meet(bits[:begin], node[:begin]))
            elif goes_on:
                own = slice(0, int(np.count_nonzero(~probing)))
                large, large_key, begin = Bucket(bits[own], node[own], radius), key[0], len(key)
                links.append(large.meet(bits, node))
            if not goes_on:
                large = None
            if begin < len(key):
                links += whole_buckets(key[begin:], probing[begin:], bits[begin:], node[begin:])
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            differ = a != b
            yield record(schema, a[differ], b[differ])

    ordered = rows.repartition("key").sortWithinPartitions("key", "probing")
    return map_arrow(ordered, run, "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of a written table of `fingerprints`."""
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("node")).filter("node is not null"), "fingerprints")
    n, both = together(nodes)
    few = nodes.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE_FINGERPRINTS).collect()
    sample = spread_bits(np.array([r["bits"] for r in few], np.int64))
    plan = allocate(n, both, sample, radius)
    found = bucket_links(probes(nodes, plan, shared_keys(nodes, plan, n)), radius)
    joined = components(found)
    node_of = cut(nodes.join(joined, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id")))
    out = prints.join(node_of, "bits", "left")
    return out.select("doc_id", same_bits(F.col("bits")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return groups(stored(fingerprints(docs), "prints"))
