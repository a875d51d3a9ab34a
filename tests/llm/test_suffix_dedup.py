import hashlib
import random
import re

import numpy as np
import pytest

from geovis.llm import suffix_dedup


def brute(rows, length=suffix_dedup.LENGTH):
    """Per row: bytes, removed, runs, digest of what stays; every window of every row is counted."""
    seen, twice = set(), set()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, data in raw:
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            (twice if window in seen else seen).add(window)
    out = []
    for i, data in raw:
        gone, last = bytearray(len(data)), 0
        for p in range(len(data) - length + 1):
            if data[p : p + length] in twice:
                for x in range(max(p, last), p + length):
                    gone[x] = 1
                last = p + length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    rows = suffix_dedup.removals(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 9))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passage, line = prose(rng, 80), prose(rng, 12)
    rows = [(k, prose(rng, rng.randint(5, 120))) for k in range(20)]
    rows += [(100 + k, prose(rng, 30) + passage + prose(rng, rng.randint(0, 40))) for k in range(6)]
    rows += [(200 + k, prose(rng, 30) + "\n" + line + "\n" + prose(rng, 30)) for k in range(8)]
    base = prose(rng, 150).split()
    rows += [(300 + k, " ".join(w if rng.random() > 0.02 else "x" + w for w in base)) for k in range(6)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (401, None), (402, ""), (None, passage[:300]), (403, "ab" * 400), (404, "z" * 199), (405, "z" * 200), (406, "q" * 201)]
    rows += [(407, prose(rng, 90) + passage[40:245]), (408, "\x00" * 150 + prose(rng, 60) + "\x00" * 150), (409, "\x00" * 210)]
    return rows


def test_equals_brute_force(documents):
    rows = corpus()
    assert found(documents(rows, "'clash' as runs")) == brute(rows)


def test_hot_anchors(documents, monkeypatch):
    """With every shared anchor hot, blocks and windows give the same result."""
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1 << 40)
    rows = corpus(2)
    assert found(documents(rows)) == brute(rows)


def test_sorted_windows(documents, monkeypatch):
    """With every shared anchor taken as one of many runs, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "MANY", 0)
    levels = suffix_dedup.Levels
    rows = corpus(7)
    texts = [(t or "").encode() for _, t in dict.fromkeys(rows)]
    runs = suffix_dedup.Runs(texts)
    data = [texts[t][s : s + n + suffix_dedup.LENGTH - 1] for t, s, n in zip(runs.text, runs.start, runs.windows, strict=True)]

    def found(many, step):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        index = levels()
        for at in range(0, len(data), step):
            index.add(data[at : at + step], runs.left[at : at + step])
        run, least, most = index.spans()
        last = runs.left - runs.windows + 1
        out = set()
        for r, a, b in zip(run.tolist(), least.tolist(), most.tolist(), strict=True):
            out |= {(r, d) for d in (range(int(last[r]), int(runs.left[r]) + 1) if a < 0 else range(a, b + 1))}
        return out

    pairs = found(1 << 30, 50)
    assert pairs and found(0, 50) == pairs == found(0, len(data)) == found(3, 17)


def test_some_hot_anchors(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 5)
    rows = corpus(3)
    assert found(documents(rows)) == brute(rows)


def test_empty_table(documents):
    assert found(documents([])) == []


def test_texts_longer_than_the_buffer(monkeypatch):
    """Cut buffers give the same windows, keys and anchors as one large buffer."""
    text = prose(random.Random(4), 3000).encode()
    whole = suffix_dedup.Runs([text])
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 12)
    cut = suffix_dedup.Runs([text])

    def windows(runs):
        return {(int(s) + k, int(s + left)) for s, n, left in zip(runs.start, runs.windows, runs.left, strict=True) for k in range(int(n))}

    assert windows(whole) == windows(cut)
    assert {p for p, _ in windows(cut)} == set(range(len(text) - suffix_dedup.LENGTH + 1))


def test_sliding_least():
    values = np.random.default_rng(0).integers(0, 1 << 60, 1000).astype(np.uint64)
    assert suffix_dedup.sliding_least(values, 169).tolist() == [values[k : k + 169].min() for k in range(1000 - 168)]


def test_levels_are_logarithmic():
    rng = random.Random(5)
    levels = suffix_dedup.Levels()
    for _ in range(40):
        texts = [prose(rng, 60).encode()[:260] for _ in range(5)]
        levels.add(texts, np.full(len(texts), 30))
        sizes = [len(runs) for _, runs in levels.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(len(runs) for _, runs in levels.levels) == 200
    for entries, _ in levels.levels:
        keys = levels.as_keys(entries)
        assert (keys[1:] >= keys[:-1]).all()


def test_very_many_matches_of_one_run():
    """A run that 40 000 later runs match keeps its range."""
    window = prose(random.Random(8), 60).encode()[: suffix_dedup.LENGTH]
    levels = suffix_dedup.Levels()
    levels.add([b"\xff" * 8 + window], np.array([8]))
    levels.add([k.to_bytes(8, "little") + window for k in range(40_000)], np.full(40_000, 8))
    run, least, most = levels.spans()
    assert (least[run == 0].tolist(), most[run == 0].tolist()) == ([0], [0])
    assert set(run.tolist()) == set(range(40_001))


def test_trimmed_keeps_characters_and_columns(documents):
    rng = random.Random(6)
    passage = "é" * 150
    rows = [(1, prose(rng, 20) + passage + "è" + prose(rng, 5)), (2, prose(rng, 20) + passage + "ê" + prose(rng, 5)), (3, None), (4, "")]
    docs = documents(rows, "1 as spans")
    out = {r["doc_id"]: r for r in suffix_dedup.trimmed(docs).collect()}
    assert suffix_dedup.trimmed(docs).columns == docs.columns
    # The repeated string ends with the first byte of the character behind the passage.
    assert all(out[k]["text"] == rows[k - 1][1].replace(passage + "èê"[k - 1], "") for k in (1, 2))
    assert out[3]["text"] is None and out[4]["text"] == "" and out[1]["spans"] == 1


@pytest.mark.parametrize("data, gone, wide", [("aéb", [(2, 3)], [(1, 3)]), ("aéb", [(0, 2)], [(0, 3)]), ("éé", [(0, 1), (3, 4)], [(0, 2), (2, 4)])])
def test_whole_characters(data, gone, wide):
    got = suffix_dedup.whole_characters(data.encode(), gone)
    assert suffix_dedup.remaining(data.encode(), got) == suffix_dedup.remaining(data.encode(), wide)
