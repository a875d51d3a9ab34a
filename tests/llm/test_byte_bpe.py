import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from geovis.llm import byte_bpe
from geovis.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x250), 0x301, 0x1C5, 0x2003, 0x2028, 0x3000, 0x85, 0x4E2D, 0x1F600, 0x660, 0xB2, 0x2167]]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["".join(rng.choices(" \n\tab.,'s1", k=rng.randint(0, 30))) for _ in range(500)]
    return [*texts, "", " ", "\n", "a ", " a", "\na\n", "a\n\n b", "don't I'm 's", "x" * 3000, "ab" * 400, "<|endoftext|>", "a  b", "1234 567"]


def test_encoder_equals_the_library():
    texts = odd_texts()
    found = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN, room=50)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        assert [np.frombuffer(x, "<u4").tolist() for x in found.encode(some)] == [LIBRARY.encode_ordinary(t) for t in some]


def test_long_words_fold_alike():
    merges = byte_bpe.Merges(RANKS)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 90))).encode() for _ in range(200)]
    assert [merges.fold_long(w) for w in words] == [np.frombuffer(x, "<u4").tolist() for x in merges.fold_side_by_side(words)]


def test_round_trip_and_digests(documents, sf_texts):
    rows = [*list(sf_texts.items())[:60], (9001, None), (9002, ""), (9003, "é\n\n x"), (9003, "é\n\n x"), (None, "y")]
    encoded = byte_bpe.encode(documents(rows, "1 as ids"), PATH, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for key, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (text or "").encode()))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], bytes(r["decoded"])) for r in got), key=str) == sorted(want, key=str)
    assert byte_bpe.encode(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_fold_as_an_expression(spark):
    """The higher-order form over the first ranks gives what the library gives with them."""
    some = {word: rank for word, rank in RANKS.items() if rank < 600}
    library = tiktoken.Encoding("some", pat_str=r"(?s).+", mergeable_ranks=some, special_tokens={})
    words = ["", "a", "the", "thethe", "information", "étés", "aaaaaaa", "in the end"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["ids"] for r in rows.select("w", byte_bpe.fold_words(F.col("w").cast("binary"), some).alias("ids")).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words}


@pytest.mark.parametrize("line", [b"YQ== 0\n\nYg== 1\n"])
def test_rank_files_may_have_empty_lines(tmp_path, line):
    (tmp_path / "r").write_bytes(line)
    assert byte_bpe.read_ranks(str(tmp_path / "r")) == {base64.b64decode("YQ=="): 0, base64.b64decode("Yg=="): 1}
