import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geovis.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"
SPACE = " \t\n\x0b\f\r"


def fails(text, again):
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), again)


def brute(docs, labels):
    """Every order applied to every document, filter by filter."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts, out = {}, {}
    for i, t, lang in docs:
        again = i is not None and i > smallest[t or ""]
        parts.setdefault(lang or "", []).append((fails(t or "", again), i in good, i in toxic))
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                bit = "ABCDE".index(name)
                gone, left = [r for r in left if r[0][bit]], [r for r in left if not r[0][bit]]
                failing = [r for r in rows if r[0][bit]]
                shapley[name] += len(gone)
                alone = sum(sum(r[0]) == 1 for r in failing)
                mine["".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (order, step), row in mine.items():
            out[part, order, step] = (*row, shapley[order[step - 1]])
    return out


def run(spark, docs, labels, **clashes):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({k: F.lit(v) for k, v in clashes.items()})
    rows = A.audit(table, spark.createDataFrame(labels, LABELS)).collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def random_docs(rng, n):
    out = []
    for i in range(n):
        words = [rng.choice(["a", "b", f"w{rng.randint(0, 400)}", "É"]) for _ in range(rng.choice([0, 5, 199, 200, 250]))]
        text = rng.choice([" ", "\n", "  ", "\x0b"]).join(words) + rng.choice(["", "", "#", "A" * 20, " |"])
        out.append((i, text, rng.choice(["en", "fr", None])))
    return out + [(n + i, rng.choice(out)[1], rng.choice(["en", "fr", "", None])) for i in range(n // 2)]


def test_equals_brute_force(spark, documents):
    rng = random.Random(2)
    docs = random_docs(rng, 80)
    docs += [(None, docs[0][1], "en"), (None, None, "xx"), (1000, None, None), (1001, "", "en"), docs[3], docs[3], (docs[3][0], "other", "en")]
    docs += [(2000, "word " * 60_000, "de")] + [(3000 + i, "copy", "en") for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(130)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    clashes = dict.fromkeys(("_text", "part", "mask", "sha", "n", "quality", "toxic", "first", "s"), "clash")
    assert run(spark, docs, labels, **clashes) == brute(docs, labels)


def test_empty_tables(spark, documents):
    assert run(spark, [], []) == {}
    docs = [(1, "a", "en")]
    assert run(spark, docs, []) == brute(docs, [])


@pytest.mark.parametrize("count", range(1, 7))
def test_swaps_meet_every_order_once(count):
    order = list(range(count))
    seen = {tuple(order)}
    for level in A.orders(count):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(count)))) == 1 + len(list(A.orders(count)))


@pytest.mark.parametrize("seed", range(20))
def test_a_swapped_diagram_equals_a_new_one(seed):
    """Same counts for every mask, same weights, and no more nodes in use than a fresh one has."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 3, (32, 3))
    diagram = A.Diagram(counts)
    for level in rng.integers(0, 4, 30):
        diagram.swap(int(level))
        for mask in range(32):
            node = diagram.root
            for bit in diagram.order:
                node = diagram.high[node] if mask >> bit & 1 else diagram.low[node]
            assert (diagram.weight[node] == counts[mask]).all()
        assert (diagram.weight[diagram.root] == counts.sum(0)).all()
    used, todo = set(), [diagram.root]
    while todo:
        node = todo.pop()
        if node not in used:
            used.add(node)
            todo += [x for x in (diagram.low[node], diagram.high[node]) if x >= 0]
    assert len({(diagram.low[n], diagram.high[n], *diagram.weight[n]) for n in used if diagram.low[n] >= 0}) <= 31
    assert len([n for n in used if diagram.low[n] < 0]) == len({tuple(c) for c in counts.tolist()})
