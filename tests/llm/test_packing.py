import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from geovis.llm import packing
from geovis.llm.queries import vocabulary
from geovis.llm.word_tokens import WordIds

PATH = vocabulary("word_bpe_49k.json")


def placed(plan):
    """Every sequence's (offset, length) list, from the plan's runs."""
    out = defaultdict(list)
    for r in plan.runs:
        for k in range(r.count):
            out[r.first + k // r.each].append((r.base + k % r.each * r.length, r.length))
    return out


def check(counts, capacity):
    plan = packing.Plan(counts, capacity)
    got = placed(plan)
    assert Counter(s for x in got.values() for _, s in x) == Counter({s: n for s, n in counts.items() if n})
    assert set(got) == set(range(plan.sequences))
    for pieces in got.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * s > capacity for _, s in pieces) <= 2
    return plan


@pytest.mark.parametrize("seed", range(20))
def test_plans_are_gapless_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = {s: rng.randint(0, 30) for s in range(1, capacity + 1) if rng.random() < 0.5}
    plan = check(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    large = sum(n for s, n in counts.items() if 2 * s > capacity)
    assert plan.sequences <= 11 / 9 * max(-(-total // capacity), large) + 1
    by_rank = defaultdict(list)
    for r in plan.runs:
        by_rank[r.length].append((r.rank, r.count))
    for runs in by_rank.values():
        at = 0
        for rank, count in sorted(runs):
            assert rank == at
            at += count


def test_large_pairs_are_matched_greedily():
    assert check({60: 5, 40: 5}, 100).sequences == 5
    assert check({50: 7}, 100).sequences == 4
    assert check({100: 3, 1: 1}, 100).sequences == 4
    assert check({}, 100).sequences == 0
    with pytest.raises(ValueError):
        packing.Plan({101: 1}, 100)


def test_words_equal_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0, 0x250), 0x3A3, 0x3C3, 0x130, 0x1C5, 0x212A, 0xFB01, 0x345, 0x301, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x660]]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(500)]
    texts += ["<|endoftext|> a<|startoftext|>b", "Don't, I'm. 's 'S", "x" * 3000, "", " ", "a...b,,", "Word, word. WORD! É.", "a\x1cb \x1f c"]
    words = WordIds(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_generations_keep_right_ids():
    small, large = WordIds(PATH, room=3), WordIds(PATH)
    texts = [f"word{k % 7} other, Other. {k % 5}x" for k in range(40)]
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)


def test_packed_documents(documents, sf_texts):
    rows = [*sf_texts.items(), (9001, None), (9002, ""), (9003, "a b"), (9003, "a b"), (None, "x"), (9004, "word " * 9000)]
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(documents(rows, "7 as split"), PATH, with_ids=True)
    pieces = got.collect()
    wanted = Counter()
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            wanted[key, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == wanted
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * -(-sum(r["length"] for r in pieces) // 2048) + 1
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(got).collect()}
    for key, members in by_sequence.items():
        assert joined[key] == b"".join(bytes(r["ids"]) for r in sorted(members, key=lambda r: r["offset"]))


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []
