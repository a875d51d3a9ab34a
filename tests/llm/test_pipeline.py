import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from geovis.llm import packing, pii, quality, simhash
from geovis.llm.common import stored, table
from .test_simhash import slow_components
from .test_suffix_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf, documents):
    """Every stage on its own input: rejected documents go, one of each group stays, repeated
    strings and personal data are gone, and all that is left is packed."""
    docs = table(spark, sf, "documents")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf), name.replace(" ", "-"))
        results.append((before, docs))
        if stage is not corpus_pipeline.packed:
            assert docs.columns == COLUMNS
            assert docs.filter("n_chars <> length(text)").count() == 0
    (source, kept), (_, single), (_, cut), (_, masked), (_, packed) = results
    rules = quality.fit(source, table(spark, sf, "labels"))
    said = {r["doc_id"] for r in quality.judge(source.select("doc_id", "text"), rules).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == said and kept.count() == len(said)
    prints = {r["doc_id"]: simhash.fingerprint(r["text"] or "") for r in kept.collect()}
    left = {r["doc_id"] for r in single.collect()}
    assert left <= set(prints) and len(left) == single.count()
    assert left == set(slow_components(prints).values())  # of each component its smallest id, and no other
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    digests = {i: (removed, sha) for i, _, removed, _, sha in brute(list(texts.items()))}
    for r in cut.collect():
        removed, sha = digests[r["doc_id"]]
        got = len(texts[r["doc_id"]].encode()) - len(r["text"].encode())
        assert removed <= got <= removed + 6 * bool(removed)
        if not removed or got == removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha
    assert cut.count() == single.count() == masked.count()
    for r in masked.collect():
        assert not pii.rule_spans(r["text"])
    lengths = Counter()
    for r in packed.collect():
        lengths[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= packing.CAPACITY
    assert set(lengths) == left


def test_odd_rows(spark, documents, sf, tmp_path):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, " ".join(f"v{k}" for k in range(40))), (5, " ".join(f"u{k}" for k in range(30)) + " bob.7@mail.example.com")]
    extra = ["_rest", "_text_hash", "id", "hash", "row", "_row", "kept", "component_id", "bits", "key", "spans", "verdict"]
    docs = documents(rows, "struct(1 as a) as _rest").withColumns({n: F.lit(f"own {n}") for n in extra[1:]})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == [*COLUMNS, *extra]
        assert all(r[n] == f"own {n}" for r in docs.collect() for n in extra[1:])
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.count() == 3 and set(got) == {3, 5, None} and got[5].endswith("[EMAIL]")


def test_empty_documents(spark, documents, sf):
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name.replace(" ", "-"))
    assert docs.count() == 0
