import math

import numpy as np
import pytest

from geovis.llm import embeddings


def brute(rows, threshold=embeddings.THRESHOLD):
    """(id, links, component, kept) by all pairs."""

    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine(v) else None for _, v in rows]
    linked = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold for j in range(n)] for i in range(n)]
    seen = [None] * n
    for start in range(n):
        if seen[start] is None:
            todo, part = [start], {start}
            while todo:
                for j in range(n):
                    if linked[todo[0]][j] and j not in part:
                        part.add(j)
                        todo.append(j)
                todo.pop(0)
            known = [rows[k][0] for k in part if rows[k][0] is not None]
            for k in part:
                seen[k] = min(known, default=None)
    return sorted(((key, sum(linked[k]), None if key is None else seen[k], key is not None and key == seen[k]) for k, (key, _) in enumerate(rows)), key=str)


def found(spark, rows, kind="float"):
    df = spark.createDataFrame([(k, v, 3, "c") for k, v in rows], f"vec_id long, embedding array<{kind}>, label int, component_id string")
    return sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)


def vectors(seed, n=150, size=16):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=size).astype(np.float32).tolist()) for k in range(n)]
    center = rng.normal(size=size)
    rows += [(1000 + k, (center + rng.normal(size=size) * 0.25).astype(np.float32).tolist()) for k in range(60)]
    return rows


ODD = [
    (2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15),
    (2006, [1.0] * 3), (2007, [2.0] * 3), (2008, [1e-30] * 16), (2009, [1e30] * 16), (2010, [1e30] * 16), (2011, [-0.0] * 15 + [1.0]), (2012, [0.0] * 15 + [1.0]),
]


def test_equals_brute_force(spark, documents):
    rows = vectors(1) + ODD
    assert found(spark, rows) == brute(rows)


def test_many_tiles(spark, documents, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 20)
    monkeypatch.setattr(embeddings, "STRIP", 7)
    rows = vectors(2)
    assert found(spark, rows) == brute(rows)


def test_common_vector_and_double_precision(spark, documents):
    rng = np.random.default_rng(3)
    rows = [(k, [0.1, 0.2, 0.3, 0.4]) for k in range(50)] + [(100 + k, rng.normal(size=4).tolist()) for k in range(30)] + [(7, [0.1, 0.2, 0.3, 0.4])]
    assert found(spark, rows, "double") == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])]])
def test_small_tables(spark, documents, rows):
    assert found(spark, rows) == brute(rows)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(4)
    a, b = (embeddings.Quantised(rng.normal(size=(200, 64))) for _ in range(2))
    near = (a.q.astype(float) @ b.q.astype(float).T) * a.scale[:, None] * b.scale[None, :]
    bound = a.length[:, None] * b.error[None, :] + a.error[:, None]
    assert (np.abs(near - a.unit @ b.unit.T) <= bound + 1e-12).all() and bound.max() < 0.05


def test_far_pivots_do_not_meet():
    pivots = {2: np.array([[1.0, 0.0], [0.0, 1.0]])}
    groups = [{"size": 2, "pivot": p, "count": 10, "radius": 0.1} for p in (0, 1)]
    parts, meets = embeddings.tile_pairs(groups, pivots, 0.9)
    assert parts == {(2, 0): 1, (2, 1): 1} and meets == {(2, 0): [(2, 0)], (2, 1): [(2, 1)]}


def test_rows_without_an_id_bridge(spark, documents):
    """The middle of a chain, a group of their own, copies of rows with an id, and many at once."""
    angle = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, angle(0)), (None, angle(20)), (2, angle(40)), (None, angle(120)), (None, angle(125)), (3, angle(200)), (None, angle(200))]
    assert found(spark, rows, "double") == brute(rows)
    assert [r[:3] for r in found(spark, rows, "double") if r[0] == 2] == [(2, 1, 1)]
    mixed = [(None if k % 3 else k, v) for k, v in vectors(5)]
    assert found(spark, mixed) == brute(mixed)
    assert found(spark, [(None, v) for _, v in vectors(6, 20)]) == brute([(None, v) for _, v in vectors(6, 20)])
