import re
from collections import Counter

import numpy as np
import pytest

from geovis.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slow(text):
    text = text or ""
    words, seen, twice = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(marked)


def test_statistics_equal_brute_force(documents, sf_texts):
    rows = [*sf_texts.items(), (9001, None), (9002, ""), (9003, " \n\t\x0b "), (9004, "a b c d e f g h " * 3), (9005, "x " * 5000), (9006, "a\na\r\na\n a\na"), (9007, "#<é>|& \x1c z"), (9007, "w"), (None, "1 2 3 4 5 6 7 8")]
    got = quality.statistics(documents(rows).select("doc_id", "text")).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *slow(t)) for k, t in rows), key=str)


def test_words_of_several_alphabets_and_very_long_texts(documents):
    text = "\n".join(f"строка {k % 50} ééé 中文 {k % 7}" for k in range(20_000))
    got = quality.statistics(documents([(1, text)]).select("doc_id", "text")).select(*NAMES).first()
    assert tuple(got) == (1, *slow(text))


def test_learned_list(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(docs.select("doc_id", "text"), labels)
    rows = quality.judge(docs.select("doc_id", "text"), rules).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good if not r["base_failed"]) >= 0.99 * sum(not r["base_failed"] for r in good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    assert all(not r["kept"] for r in rows if r["base_failed"])


def planted(n=400, seed=1):
    rng = np.random.default_rng(seed)
    values = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    return values, (values["a"] > 0.8) & (values["b"] <= 0.5) | (values["c"] > 0.9)


def test_covering_finds_planted_rules():
    values, bad = planted()
    rules = quality.learn(values, bad)
    said = np.zeros(len(bad), bool)
    for rule in rules:
        said |= quality.covered(rule, values, len(bad))
    assert (said & bad).sum() >= 0.9 * bad.sum() and (said & ~bad).sum() <= 0.03 * (~bad).sum()


def test_noise_gives_no_rules():
    rng = np.random.default_rng(2)
    assert quality.learn({"a": rng.random(300)}, rng.random(300) < 0.1) == []
    assert quality.learn({"a": np.zeros(10)}, np.ones(10, bool) & False) == []


def test_first_rule_decides(spark):
    rules = [[quality.Condition("words", True, 5.0), quality.Condition("repeated", False, 0.5)], [quality.Condition("symbols", True, 0.1)]]
    df = spark.createDataFrame([(6, 0, 1, 0, 0), (6, 6, 0, 0, 0), (3, 0, 0, 0, 0), (3, 0, 1, 0, 0)], "n_words long, n_repeat_words long, n_symbols long, word_chars long, n_dup_lines long")
    assert [r[0] for r in df.select(quality.accepted(rules)).collect()] == [False, True, True, False]


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 0), (1, 1)], [(None, 0)], [(1, 0)] * 3])
def test_labels_that_teach_nothing(spark, documents, labels):
    docs = documents([(1, "w " * 30 + "x y z"), (2, " ".join(f"w{k}" for k in range(25)))]).select("doc_id", "text")
    rules = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules == []
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()} == {1: False, 2: True}


def test_no_python_in_the_plan(spark, documents):
    plan = quality.judge(documents([(1, "x")]).select("doc_id", "text"), [[quality.Condition("words", True, 1.0)]])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
