import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from geovis.llm import simhash
from geovis.llm.components import bounded_groups, components, forest


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: node to bits; joins all pairs."""
    nodes = sorted(prints)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_equals_brute_force(documents, sf_texts):
    rows = list(sf_texts.items())
    rows += [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "One two"), (10_005, "one  TWO"), (10_006, "ÉÀ one two three É"), (10_007, rows[0][1])]
    prints = {i: slow_fingerprint(t) for i, t in rows}
    expected = slow_components(prints)
    got = simhash.near_duplicates(documents(rows, "'x' as bits")).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", expected[i]) for i, _ in rows}
    assert len(got) == len(rows)


def cluster(spark, seed, hot):
    """A dense cluster, a chain, and random fingerprints, as a written table would be read."""
    rng = random.Random(seed)
    center = rng.getrandbits(64)
    prints = [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)]
    chain = rng.getrandbits(64)
    for _ in range(15):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.append(chain)
    prints += [rng.getrandbits(64) for _ in range(300)]
    rows = {k: p for k, p in enumerate(prints)}
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in rows.items()], "doc_id long, bits long")
    return rows, df


@pytest.mark.parametrize("hot", [False, True])
def test_dense_clusters(spark, documents, monkeypatch, hot):
    if hot:  # many blocks for every shared value
        monkeypatch.setattr(simhash, "BLOCK", 10)
        monkeypatch.setattr(simhash, "HOT_SHARE", 1000)
    rows, df = cluster(spark, 7, hot)
    expected = slow_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert got == expected


def test_null_ids_and_empty_table(documents):
    got = simhash.near_duplicates(documents([(None, "a b c d e"), (5, "a b c d e"), (None, "z")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (5, 5)} and len(got) == 3
    assert simhash.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("n", [10, 10_000, 10_000_000])
def test_thresholds_suffice(n):
    """The thresholds use radius + 1 units, so no pair within the radius escapes every part."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    plan = simhash.allocate(n, bits.T @ bits * (n / 500), bits.astype(np.uint8))
    assert sum(t + 1 for _, t in plan) == simhash.RADIUS + 1
    seen = [b for part, _ in plan for b in part]
    assert len(seen) == len(set(seen))


def test_forest_keeps_connections():
    rng = np.random.default_rng(2)
    links = rng.random((30, 30)) < 0.06
    kept = forest(((r, np.flatnonzero(links[r])) for r in range(30)), 30)
    assert len(kept) < 60 and all(links[r, c] for r, c in kept)

    def parts(pairs):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r, c in pairs:
            root[find(r)] = find(30 + c)
        return [find(x) == find(y) for x in range(60) for y in range(60)]

    assert parts(kept) == parts(zip(*map(np.ndarray.tolist, np.nonzero(links)), strict=True))


def test_components_of_long_paths(spark, documents):
    rows = [(k, k + 1) for k in range(60)] + [(200, 199), (300, 300)] + [(500, 500 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 199} | {500 + k: 500 for k in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_parts_of_a_large_group_hold_all_that_is_stored():
    rows = [(k, flag, n) for k in range(6) for n, flag in enumerate([False] * (3 if k == 2 else 1) + [True] * (40 if k in (2, 4) else 2))]
    batches = pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "later", "n"]).to_batches(max_chunksize=2)
    seen, parts = [], 0
    for table, goes_on in bounded_groups(iter(batches), 0, 1, 2):
        keys = table.column(0).to_pylist()
        seen += zip(*(c.to_pylist() for c in table.columns))
        parts += goes_on
        if goes_on:
            assert len(set(keys)) == 1 and table.num_rows < 10
            assert table.column(1)[-1].as_py()
    assert seen == rows and parts > 20


@pytest.mark.parametrize("held", [2, 7, 50, 50_000])
def test_large_buckets_come_in_slices(spark, held):
    rows, df = cluster(spark, held, True)
    # Two thirds of all rows probe one key, under which a few are stored.
    keyed = [(7, k > 30, p - (1 << 64) if p >> 63 else p, k) for k, p in rows.items() if k < 120]
    keyed += [(k % 9 + 10, k % 3 > 0, p - (1 << 64) if p >> 63 else p, k) for k, p in rows.items()]
    table = spark.createDataFrame(keyed, "key long, probing boolean, bits long, node long")
    found = {(r["a"], r["b"]) for r in simhash.bucket_links(table, held=held).collect()}
    assert all((rows[a] ^ rows[b]).bit_count() <= simhash.RADIUS for a, b in found)
    joined = lambda pairs: slow_roots(sorted(rows), pairs)
    expected = [
        (a, b) for key, probing, bits, a in keyed if not probing for other, _, more, b in keyed
        if key == other and ((bits ^ more) & ((1 << 64) - 1)).bit_count() <= simhash.RADIUS
    ]
    assert joined(found) == joined(expected)


def slow_roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
