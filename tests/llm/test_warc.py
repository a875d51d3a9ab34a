import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from geovis.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, min_bytes=0):
    top = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= min_bytes:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        response = top.get(html or "")
        other = response if response is not None and response != page else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def run(spark, rows, folder, min_bytes=0, **clashes):
    df = spark.createDataFrame(rows, PAGES).repartition(5).withColumns({k: F.lit(v) for k, v in clashes.items()})
    warc.write(df, folder, min_bytes)
    found = warc.histories(spark, folder)
    got = found.collect()
    assert [r["place"] for r in got] == list(range(len(rows)))
    keys = [warc.sort_key(r["url_key"], r["seconds"], r["page_id"]) for r in got]
    assert keys == sorted(keys)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str), got


def random_pages(rng, n):
    hosts = ["http://a.example", "https://www.B.example:443", "http://u:p@c.example:8080"]
    bodies = ["", None, "é" * 9, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\n", "same"]
    pick = lambda: rng.choice(bodies) if rng.random() < 0.5 else f"page {rng.random()}\x00\n"
    return [(i, rng.choice([None, "", "no url", f"{rng.choice(hosts)}/p{rng.randint(0, 9)}?q={rng.randint(0, 3)}#top"]), pick()) for i in range(n)]


def test_equals_brute_force(spark, documents, tmp_path, monkeypatch):
    """Small archives, blocks and ranges, so that every border is crossed."""
    for name, value in {"ARCHIVE_BYTES": 3000, "BLOCK": 7, "RANGE_ROWS": 40}.items():
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(6)
    rows = random_pages(rng, 400) + [(None, "http://a.example/", "same"), (None, None, None), (7, "x\r\nWARC-Type: y z\t", "line"), (7, "x", "line"), (7, "x", "line")]
    rows += [(-5, "http://[bad", "é" * 200_000), (2**62, "http://a.example", "big id")]
    rows += [(1000 + i, "http://hot.example/", f"v{i % 50}") for i in range(300)]
    rows += [(5000, "http://hot.example/", "one")] * 60
    names = ("payload", "digest", "bytes", "seconds", "_same", "_response", "archive", "record", "refers_to")
    got, _ = run(spark, rows, str(tmp_path / "w"), **dict.fromkeys(names, "clash"))
    assert got == brute(rows)


def test_payloads_below_the_limit_are_responses(spark, documents, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (5, "u", ""), (6, "u", None)]
    got, _ = run(spark, rows, str(tmp_path / "w"), min_bytes=3)
    assert got == brute(rows, 3)
    assert [r[3] for r in got] == ["response", "response", "revisit", "response", "response", "response"]


def test_empty_table(spark, documents, tmp_path):
    assert run(spark, [], str(tmp_path / "w"))[0] == []


def test_archives_are_whole_records(spark, documents, tmp_path):
    """The files hold what the index says, byte by byte, and nothing else."""
    rows = random_pages(random.Random(1), 30)
    _, got = run(spark, rows, str(tmp_path / "w"))
    files = {path.split("archive=")[1].split("/")[0]: open(path, "rb").read() for path in glob.glob(str(tmp_path / "w" / "archive=*" / "part*"))}
    assert sum(map(len, files.values())) == sum(r["length"] for r in got)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        text = files[r["archive"].split("/")[0]][r["offset"] : r["offset"] + r["length"]]
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
        body = text.split(b"\r\n\r\n", 2)[2][:-4]
        assert body == (html[r["page_id"]] if r["record_type"] == "response" else b"")


def test_damage_is_seen(spark, documents, tmp_path):
    record = warc.warc_record(1, "http://a.example", 0, "abc", "x" * 32, 3, None) + warc.RECORD_END
    at, length, fields, block = next(warc.parse(record.encode()))
    with pytest.raises(ValueError, match="damaged"):
        warc.capture("a", at, length, fields, block)
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse(record.encode()[:-2]))


def test_times_come_from_a_column(spark, documents, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example", "x", "2023-05-06 07:08:09"), (2, "http://a.example", "y", "2020-01-01 00:00:00")], f"{PAGES}, at string")
    warc.write(df, str(tmp_path / "w"), captured="at")
    got = warc.histories(spark, str(tmp_path / "w")).collect()
    assert [(r["page_id"], r["seconds"]) for r in got] == [(2, 1_577_836_800), (1, 1_683_356_889)]


@pytest.mark.parametrize("leaves", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(leaves):
    rng = random.Random(leaves)
    sources = [sorted((rng.randint(0, 20),) for _ in range(rng.choice([0, 1, 9]))) for _ in range(leaves)]
    heads, iterators = {}, [iter(s) for s in sources]

    def advance(leaf):
        heads[leaf] = next(iterators[leaf], None)
        return heads[leaf]

    got = [(heads[leaf], leaf) for leaf in warc.LoserTree(leaves, advance)]
    assert got == sorted((key, leaf) for leaf, s in enumerate(sources) for key in s)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("//x.org") == "org,x)/"
    assert warc.url_key("http://x.org:8080/") == "org,x:8080)/"
    assert warc.url_key("mailto:a") == "mailto:a"
