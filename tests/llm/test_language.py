import numpy as np
import pytest

from geovis.llm import language


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language.fit(known)
    rows = [(1, None), (2, ""), (3, "123 %&"), (4, "ж"), (5, "the the the of and"), (5, "the the the of and"), (None, "der die das und nicht"), (6, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = language.predict(docs, learned).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and [by[k]["score"] for k in (1, 2, 3)] == [0.0] * 3
    assert by[5]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and not by[None]["held_out"]
    assert by[4]["lang_pred"] in learned.languages and by[6]["lang_pred"] in learned.languages


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    learned = language.fit(docs)
    assert [tuple(r) for r in language.predict(docs, learned).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language.predict(docs.limit(0), learned).collect() == []


def test_rare_languages_are_learned(spark):
    """More languages than a word has bits, the last with few documents beside large ones."""
    rng = np.random.default_rng(2)
    spaced = [[chr(0x4E00 + 130 * k + j) for j in range(130)] for k in range(70)]  # own letters for each
    rows = []
    for k, own in enumerate(spaced):
        rows += [(f"l{k:02}", " ".join("".join(rng.choice(own[:8], 5)) for _ in range(40))) for _ in range(4 if k == 69 else 12)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    learned = language.fit(docs)
    assert len(learned.languages) == 70
    got = language.predict(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_ngrams_of_a_small_language_stay(spark):
    """A language whose n-grams are rarer than 300 000 of the others' keeps them."""
    rng = np.random.default_rng(3)
    wide = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 120_000))) for _ in range(3)]
    rows = [("zh", t) for t in wide for _ in range(10)] + [("zz", "bala kimo tuvo resa nopi")] * 5
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_probe_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    learned = language.LanguageFilter(["a", "b", "c"])
    own = [rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(3)]
    learned.add(0, own[0])
    learned.add(1, own[1])
    learned.add(2, np.concatenate([own[2], own[0]]))
    assert (learned.probe(own[0]) & np.uint64(5) == 5).all() and (learned.probe(own[1]) & np.uint64(2) == 2).all()
    strangers = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    seen = [np.mean(learned.probe(strangers) >> np.uint64(k) & np.uint64(1)) for k in range(3)]
    assert seen == pytest.approx(learned.false_positives(), abs=1e-4)


def test_grams_belong_to_their_text():
    hashes, owner, has_letter = language.grams(["ab cd", "", "AB  CD!", "12"])
    assert has_letter.tolist() == [True, False, True, False]
    assert hashes[owner == 0].tolist() == hashes[owner == 2].tolist() and len(hashes[owner == 0]) == 4
    assert not len(hashes[owner == 1]) and not len(hashes[owner == 3])
