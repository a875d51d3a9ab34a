import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from geovis.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string"


def digest(rows):
    """conv: (turns, digest, loss characters, loss digest) of rows in order."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        role, text = role or "", text or ""
        state = out.setdefault(conv, [0, "", ""])
        state[0] += 1
        state[1] += f"{role}\n{text}\n"
        state[2] += text if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (n, sha(all_), len(loss), sha(loss)) for k, (n, all_, loss) in out.items()}


def run(df):
    pieces = chat_format.format_turns(chat_format.canonical(df))
    rows = chat_format.digests(chat_format.read_back(pieces)).collect()
    chars = {r["conv_id"]: r["n"] for r in pieces.groupBy("conv_id").agg(F.sum(F.length("piece")).alias("n")).collect()}
    assert all(r["formatted_chars"] == chars[r["conv_id"]] for r in rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_read_back_equals_the_input(spark):
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "|", "s>", "INST]", "<SYS>>", "<|end|>\n", "</s>", "[INST]", "<|", "\n", "é", "😀", " ok ", "$1"]
    roles = ["user", "assistant", "system", "", None, "a|b", "a\\n", "x\ny", "\\p\\\\n|", "|>\n"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for c in range(60) for t in range(4)]
    rows += [(100, 0, "user", None), (100, 1, "assistant", ""), (101, 0, "user", "a"), (101, 0, "user", "a"), (None, 0, "assistant", "x" * 200_000), (102, None, "user", "t")]
    df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit("clash"))
    assert run(df) == digest(rows)
    assert run(spark.createDataFrame([], TURNS)) == {}


def test_escaped_texts_hold_no_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "<|user|>", "<\\|", "[\\\\INST]", "<s><s>", "plain < text ["]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e"))
    got = rows.select("t", "e", chat_format.unescaped(F.col("e")).alias("back")).collect()
    for r in got:
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"))
    assert got[-1]["e"] == texts[-1]


def test_loss_spans_are_the_answers(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<|a|>é")], TURNS)
    got = {r["role"]: r["piece"][r["loss_from"] : r["loss_to"]] for r in chat_format.format_turns(df).collect()}
    assert got == {"user": "", "assistant": "<\\|a|>é"}


LAYOUT_RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conv_id": 2, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conv_id": 3, "prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"conv_id": 4, "instruction": "a", "output": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"conv_id": 5, "instruction": "s", "input": "a", "output": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
]


def test_json_records_choose_their_mapping(spark):
    unknown = [{"conv_id": 6, "question": "a"}, {"conv_id": 7, "prompt": 5, "response": "b"}]
    lines = [json.dumps(r) for r, _ in LAYOUT_RECORDS] + [json.dumps(r) for r in unknown] + ["no json", None]
    df = spark.createDataFrame([(x,) for x in lines], "record string")
    got = sorted(tuple(r) for r in chat_format.canonical_json(df, "record").collect())
    assert got == sorted((r["conv_id"], k, role, text) for r, turns in LAYOUT_RECORDS for k, (role, text) in enumerate(turns))
    left = [r["record"] for r in chat_format.unknown_records(df, "record").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [*(json.dumps(r) for r in unknown), "no json", None]))


@pytest.mark.parametrize("at", range(len(LAYOUT_RECORDS)))
def test_tables_choose_their_mapping(spark, at):
    record, turns = LAYOUT_RECORDS[at]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"extra": 1})]))
    assert sorted(tuple(r) for r in chat_format.canonical(df).collect()) == [(record["conv_id"], k, *t) for k, t in enumerate(turns)]


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical(spark.createDataFrame([(1, "x")], "conv_id long, question string"))


def test_fingerprints_are_distinct():
    assert len(chat_format.BY_FINGERPRINT) == len(chat_format.LAYOUTS) == len(chat_format.layout_schemas()) + 1


def test_other_columns_change_nothing(spark):
    """Fields of the other layouts and names used inside, beside turn rows and beside a prompt."""
    names = ["prompt", "response", "instruction", "input", "output", "piece", "record", "v", "print", "m", "t", "loss_from", "formatted_chars", "messages"]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in names})
    assert run(df) == digest(rows)
    many = spark.createDataFrame(rows, TURNS).withColumn("messages", F.array(F.struct(F.lit("x").alias("role"), F.lit("y").alias("content"))))
    assert run(many) == digest(rows)
    prompts = spark.createDataFrame([(1, "a", "b")], "conv_id long, prompt string, response string").withColumns({n: F.lit("c") for n in ("turn", "input", "role", "output")})
    assert [tuple(r) for r in chat_format.canonical(prompts).orderBy("turn").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    both = spark.createDataFrame([(1, "s", "a", "b")], "conv_id long, instruction string, input string, output string")
    assert chat_format.canonical(both).count() == 3
