import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from geovis.llm import conversation_repair as C

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"
SCHEMA_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by holding whole audits: state to its best way, row by row."""
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, kept) in list(out.items()):
                to = SCHEMA_NEXT[state]
                way = (cost + 3, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[to], "")))
                out[to] = min(out.get(to, way), way, key=lambda w: w[:2])
        return out

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, kept) in inserted(best).items():
            extra = 3 if fault == "truncated" else 0
            ways = [(state, (cost + 4, audit + "D", kept))]
            if fault in ("", "truncated"):
                to, initial = SCHEMA_NEXT[state], role[:1]
                if initial == to or (initial == "s" and state == "" and not kept):
                    ways.append((initial, (cost + extra, audit + "K", (*kept, (role, text)))))
                ways.append((to, (cost + 3 + extra, audit + "R", (*kept, ({"u": "user", "a": "assistant"}[to], text)))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        best = after
    return min((way for state, way in inserted(best).items() if state in ("", "a")), key=lambda w: w[:2])


def brute(rows):
    """All result rows by whole conversations in plain Python."""
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in mine:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(x[2] == f for x in judged)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, kept = cheapest(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def run(df):
    got = C.repaired_digests(C.damaged(df), df).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def random_rows(rng, convs, most):
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["ok.", "yes!", "cut off", "", " \n", None, "why? ", "user:x.", "é.", "a\nb."]
    return [
        (c, rng.choice([t, t, t, t // 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}{rng.choice('.!, ')}")
        for c in range(convs) for t in range(rng.randint(1, most))
    ]


def test_equals_brute_force(spark, documents):
    rng = random.Random(3)
    rows = random_rows(rng, 150, 9) + [(None, t, "user", f"q{t}.") for t in range(5)]
    rows += [(900, 0, "system", "x" * 300_000 + "."), (901, 3, "user", "same."), (901, 3, "user", "same.")] + [(902, None, None, None)] * 3
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in ("copies", "fault", "block", "place", "edit", "_said", "_first", "_kind")})
    assert run(df) == brute(rows)


def test_one_conversation_in_many_tasks(spark, documents):
    rng = random.Random(4)
    rows = [(7, *r[1:]) for r in random_rows(rng, 150, 9)] + random_rows(rng, 5, 9) + [(8, t, "assistant", f"n{t}.") for t in range(300)]
    rows += [(9, t, rng.choice(["user", "assistant"]), rng.choice(["alike.", f"n{t}."])) for t in range(300)]
    df = spark.createDataFrame(rows, TURNS)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert len(C.split_conversations(C.in_order(C.damaged(df)))) >= 2
        assert run(df) == brute(rows)
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(40))
def test_meeting_in_the_middle_equals_whole_audits(seed):
    """Whole, and cut into parts whose tables are chained."""
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "", rng.choice(["", "", "truncated"])) for _ in range(rng.randint(0, 40))]
    kinds = bytes(C.initial_class(r, C.CUT_OFF if f else C.NONE) for r, _, f in rows)
    found, end = C.solve(kinds)
    cost, audit, _ = cheapest(rows)
    assert "".join(e.audit for e in found) + "I" * (C.ENDING[end] // 3) == audit
    assert sum(e.cost for e in found) + C.ENDING[end] == cost
    cuts = sorted(rng.randint(0, len(kinds)) for _ in range(3))
    parts = []
    for block, (lo, hi) in enumerate(itertools.pairwise([0, *cuts, len(kinds)])):
        ways = [(C.at_state(s), 0) for s in C.STATES]
        for kind in kinds[lo:hi]:
            ways = [(v2, z + more) for v, z in ways for v2, more in [C.advance(v, kind)]]
        parts.append({"block": block, "lo": lo, "hi": hi, "costs": [c + z if c < C.FAR else C.FAR for v, z in ways for c in v.costs], "ranks": [r for v, _ in ways for r in v.ranks]})
    chained = {key[0]: span for key, span in C.chain(1, parts)}
    pieces = [C.solve(kinds[p["lo"]:p["hi"]], chained[p["block"]].start, chained[p["block"]].end) for p in parts]
    assert "".join(e.audit for es, _ in pieces for e in es) + "I" * (C.ENDING[pieces[-1][1]] // 3) == audit


def test_every_row_of_the_result_is_there(spark, documents):
    """The repaired conversation itself has the proper shape."""
    rows = random_rows(random.Random(5), 40, 8)
    edited = C.repair(spark.createDataFrame(rows, TURNS)).orderBy("block", "place").collect()
    shape = {}
    for r in edited:
        if r["role"] is not None:
            shape[r["conv_id"]] = shape.get(r["conv_id"], "") + r["role"][0]
    for initials in shape.values():
        rest = initials.removeprefix("s")
        assert rest and rest == "ua" * (len(rest) // 2)
    assert sum(r["times"] for r in edited if r["edit"] != "I") == len(rows)


def test_empty_table(spark, documents):
    assert run(spark.createDataFrame([], TURNS)) == {}
