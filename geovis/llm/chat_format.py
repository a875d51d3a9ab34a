"""Chat formatting: records of many layouts to canonical turns, and turns to a training text.

Layouts. The nested field paths of a record's schema, sorted and hashed, are its fingerprint. A
fingerprint selects a declarative mapping (`LAYOUTS`) that says where role and text are found:
rows that are turns already, a list of messages, a prompt with its answer, an instruction with an
input. Tables are fingerprinted by their schema, JSON records one by one. Records of an unknown
layout are returned by `unknown_records`, not dropped in silence.

Template. A turn is `<|role|>`, a line break, the text, `<|end|>` and a line break. Control
strings inside a text, this template's and other common ones, get a backslash after their first
character; a control string that already has backslashes there gets one more. Taking one away
gives the text back, so the escape is reversible for every text. Roles are escaped with their own
rule, because a role stands inside a marker.

The formatted text of a conversation is the concatenation of its turns' pieces in order; a piece
carries its loss span, so a conversation of any length is never gathered into one value.

Defined results: a null or empty text is the empty text; a null role is the empty role; turns are
ordered by turn, then role, then text, nulls first, and repeated rows stay; a null conv_id is one
conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geovis.llm.common import arrow_schema, map_arrow, record, slices

# Control strings, as first character, backslashes, rest.
CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|\|)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|</?SYS>>|/?INST\]|\|)"
PIECE = r"(?s)^<\|(.*?)\|>\n(.*)<\|end\|>\n$"


def nested_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves: `messages[].role:string`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'number' if isinstance(kind, T.NumericType) else kind.simpleString()}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


# Layouts: the paths of a record, and where its turns are. A turn is (role, path of the text), or
# for a list (path of the list, field of the role, field of the text).
LAYOUTS = [
    {"name": "turn rows", "paths": ["conv_id:number", "turn:number", "role:string", "text:string"], "rows": ("turn", "role", "text")},
    {"name": "messages", "paths": ["conv_id:number", "messages[].content:string", "messages[].role:string"], "list": ("messages", "role", "content")},
    {"name": "from and value", "paths": ["conv_id:number", "conversations[].from:string", "conversations[].value:string"], "list": ("conversations", "from", "value")},
    {"name": "prompt", "paths": ["conv_id:number", "prompt:string", "response:string"], "turns": [("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction", "paths": ["conv_id:number", "instruction:string", "output:string"], "turns": [("user", "instruction"), ("assistant", "output")]},
    {"name": "instruction and input", "paths": ["conv_id:number", "input:string", "instruction:string", "output:string"], "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
]
BY_FINGERPRINT = {fingerprint(x["paths"]): x for x in LAYOUTS}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def canonical(records: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table whose schema has the fingerprint of a layout, leaving its
    other columns out. Of several the rows that are turns already come first, then the layout with
    the most fields."""
    paths = nested_paths(records.schema)
    prints = [fingerprint([p for p in paths if p in x["paths"]]) for x in LAYOUTS]
    fitting = [x for x, found in zip(LAYOUTS, prints, strict=True) if BY_FINGERPRINT.get(found) is x]
    if not fitting:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    layout = max(fitting, key=lambda x: ("rows" in x, len(x["paths"])))
    field = lambda path: F.col(f"`{path}`")
    if "rows" in layout:
        turn, role, text = layout["rows"]
        return records.select(F.col("conv_id").cast("long"), field(turn).cast("long").alias("turn"), field(role).alias("role"), field(text).alias("text"))
    return unfolded(records.select(F.col("conv_id").cast("long"), turns_of(layout, lambda p: field(p), None).alias("t")))


def turns_of(layout: dict, text_at, list_at) -> Column:
    """The array of (role, text) that a mapping finds in a record."""
    if "turns" in layout:
        return F.array(*[F.struct(F.lit(role).alias("role"), text_at(path).alias("text")) for role, path in layout["turns"]])
    path, role, text = layout["list"]
    items = list_at(path, role, text) if list_at else text_at(path)
    return F.transform(items, lambda m: F.struct(renamed(m[role]).alias("role"), m[text].alias("text")))


def renamed(role: Column) -> Column:
    out = role
    for other, ours in ROLES.items():
        out = F.when(role == other, ours).otherwise(out)
    return out


def unfolded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("t").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def record_paths(record: Column) -> Column:
    """Schema text of one JSON record: objects list their fields in order of name."""
    return F.schema_of_variant(F.try_parse_json(record))


def layout_schemas() -> dict[str, dict]:
    """The schema text that a JSON record of each layout has, for the layouts of records."""
    out = {}
    for layout in LAYOUTS:
        if "rows" in layout:
            continue
        if "list" in layout:
            path, role, text = layout["list"]
            inner = ", ".join(f"{f}: STRING" for f in sorted((role, text)))
            fields = {"conv_id": "BIGINT", path: f"ARRAY<OBJECT<{inner}>>"}
        else:
            fields = {"conv_id": "BIGINT"} | {p: "STRING" for _, p in layout["turns"]}
        out["OBJECT<" + ", ".join(f"{k}: {v}" for k, v in sorted(fields.items())) + ">"] = layout
    return out


def canonical_json(records: DataFrame, column: str) -> DataFrame:
    """conv_id, turn, role, text of JSON records, each by the mapping its own schema selects."""
    shapes = layout_schemas()
    parsed = records.select(F.try_parse_json(column).alias("v"), F.sha2(record_paths(F.col(column)), 256).alias("print"))
    picked = F.lit(None).cast("array<struct<role:string,text:string>>")
    for shape, layout in shapes.items():
        text_at = lambda p: F.try_variant_get("v", f"$.{p}", "string")
        list_at = lambda p, a, b: F.try_variant_get("v", f"$.{p}", f"array<struct<`{a}`:string,`{b}`:string>>")
        mine = F.col("print") == hashlib.sha256(shape.encode()).hexdigest()
        picked = F.when(mine, turns_of(layout, text_at, list_at)).otherwise(picked)
    return unfolded(parsed.select(F.try_variant_get("v", "$.conv_id", "long").alias("conv_id"), picked.alias("t")))


def unknown_records(records: DataFrame, column: str) -> DataFrame:
    """JSON records that no mapping takes."""
    known = [hashlib.sha256(s.encode()).hexdigest() for s in layout_schemas()]
    return records.filter(~F.coalesce(F.sha2(record_paths(F.col(column)), 256).isin(known), F.lit(False)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def plain_role(role: Column) -> Column:
    """Undoes `escaped_role` by reading the backslash pairs from left to right."""
    pairs = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\])"), 1)
    one = lambda x: F.when(x == "\\n", "\n").when(x == "\\p", "|").when(x == "\\\\", "\\").otherwise(x)
    return F.array_join(F.transform(pairs, one), "")


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted piece per turn: conv_id, turn, role, text for its order, piece, and the loss
    span [loss_from, loss_to) in code points of the piece, empty if it has no loss."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", escaped(F.col("text"))).withColumn("head", F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n")))
    learned = F.col("role") == "assistant"
    start = F.length("head")
    return t.select(
        "conv_id", "turn", "role", "text", F.concat("head", "body", F.lit("<|end|>\n")).alias("piece"),
        F.when(learned, start).otherwise(0).alias("loss_from"), F.when(learned, start + F.length("body")).otherwise(0).alias("loss_to"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """role, text and the text under the loss mask, from the pieces alone."""
    p = formatted.select("conv_id", "turn", F.col("role").alias("by_role"), F.col("text").alias("by_text"), "piece", "loss_from", "loss_to")
    raw_role = F.regexp_extract("piece", PIECE, 1)
    role = F.when(raw_role.contains("\\"), plain_role(raw_role)).otherwise(raw_role)
    learned = F.col("piece").substr(F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))
    return p.select(
        "conv_id", "turn", "by_role", "by_text", role.alias("role"), unescaped(F.regexp_extract("piece", PIECE, 2)).alias("text"),
        unescaped(learned).alias("loss_text"), F.length("piece").alias("chars"),
    )


def digests(back: DataFrame) -> DataFrame:
    """One row per conversation. Its turns are streamed in order through two running hashes."""
    schema = arrow_schema(conv_id=pa.int64(), n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(), formatted_chars=pa.int64())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, state = none, None
        for batch in slices(batches, 2000):
            done = []
            for conv, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != at:
                    if at is not none:
                        done.append((at, *finished(state)))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield record(schema, *zip(*done, strict=True))
        if at is not none:
            yield record(schema, *([x] for x in (at, *finished(state))))

    def finished(state: list) -> tuple:
        return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "by_role", "by_text")
    return map_arrow(
        ordered.select("conv_id", "role", "text", "loss_text", "chars"), stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
