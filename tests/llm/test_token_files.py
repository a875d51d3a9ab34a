import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from geovis.llm import token_files
from geovis.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def ids_of(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [(key, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]) for key, text in rows]


def expected(rows):
    """(doc_id, start, n, crc) in file order: null ids first, equal ids by the checksum of their
    16-bit ids."""
    coded = ids_of(rows)
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u2").tobytes()), len(r[1])))
    out, at = [], 0
    for key, ids in coded:
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def got(spark, folder):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, folder).collect()), key=str)


def test_read_back(spark, documents, sf_texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCUMENTS", 17)
    rows = [*sf_texts.items(), (9001, None), (9002, ""), (9003, "a b"), (9003, "c d"), (9003, "a b"), (None, "x"), (-5, "word " * 30_000)]
    folder = str(tmp_path / "ids")
    token_files.write(documents(rows, "1 as range"), PATH, folder)
    assert got(spark, folder) == expected(rows)
    for key, ids in ids_of(rows)[:3]:
        assert [x.tolist() for x in token_files.lookup(spark, folder, key)] == [ids]
    assert sorted(len(x) for x in token_files.lookup(spark, folder, 9003)) == [3, 3, 3]
    assert token_files.lookup(spark, folder, 123_456_789) == []
    whole = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in token_files.read(spark, folder, with_ids=True).collect()}
    assert whole[9001] == [2] and all(whole[k] == ids for k, ids in ids_of(rows)[:50])
    assert len(token_files.stored_dictionary(spark, folder)) > 256


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None)]])
def test_small_tables(spark, documents, tmp_path, rows):
    folder = str(tmp_path / "ids")
    token_files.write(documents(rows), PATH, folder)
    assert got(spark, folder) == expected(rows)


def test_blocks_know_their_dictionary():
    samples = [np.arange(k, k + 50, dtype="<u2").tobytes() for k in range(400)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    press = token_files.compressor(dictionary)
    sha = __import__("hashlib").sha256(dictionary).digest()
    data = token_files.encode_block([(5, 50, press.compress(samples[0])), (None, 50, press.compress(samples[9]))], 2, sha)
    block = token_files.Block(data, dictionary)
    opener = token_files.decompressor(dictionary)
    assert len(block) == 2 and block.ids(1, opener).tolist() == list(range(9, 59)) and block.nulls.tolist() == [0, 1]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Block(data, dictionary + b"x")


def test_wide_ids(spark, documents, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write(documents([(1, "some words"), (2, None)]), PATH, folder, vocabulary_size=100_000)
    assert [r[:3] for r in got(spark, folder)] == [r[:3] for r in expected([(1, "some words"), (2, None)])]
