"""WARC archives of page captures, and a globally ordered index of them.

Writing. A capture is one WARC record: a response with the page's bytes, or, when another capture
has the same bytes, a revisit that names it. Spark's text writer writes the archives: a row is a
record, and the line separator is the end of a WARC record (two empty lines), so the files are plain
WARC files in whatever store Spark writes to, committed as all its output is. A task begins a new
archive after `ARCHIVE_BYTES`.

Reading. An archive is read whole (its size is bounded, up to one record) and parsed by the lengths
its headers state; the digest of every response is computed from the bytes read and compared.

External index merge. The captures of a read task, sorted by URL key, time and page, are a run, kept
as a table. Runs are cut into blocks at the bounds of key ranges, which come from a sample, so a URL
with a third of all captures spreads over several ranges. A task merges the runs of a range with a
loser tree: one leaf per run, a match per inner node, the overall winner leaves and its path is
replayed. Blocks reach it in the order in which they are needed: a run's next block is due when its
previous one ends, so sorting blocks by the last key of their predecessor forecasts them all, and a
task holds one block per run. The result is in global order, `place` counts from 0.

Defined results: a null html is the empty payload; a null url is the empty one; control characters
and spaces in a url are percent-encoded in the header; repeated rows are written once each, and all
rows with the largest page_id of their payload are responses; a null page_id is never the response
another one refers to; payloads below `min_bytes` are all responses; an empty table gives an empty
index. Captures have no time in `pages`: unless a timestamp column is named, the time is `EPOCH`
plus page_id seconds (within `PERIOD`). Columns other than page_id, url, html and that one are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, map_arrow, record, stored

ARCHIVE_BYTES = 16 << 20
EPOCH = 1_704_067_200  # 2024-01-01
PERIOD = 1_000_000_000

RECORD_END = "\r\n\r\n"
MARK = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BLOCK = 512
RANGE_ROWS = 20_000
SAMPLE = 100_000
"""Rows of the sample that the range bounds come from; it influences the sizes of ranges only."""


def base32(hexadecimal: Column) -> Column:
    """RFC 4648 base 32 of hexadecimal digits, five at a time."""
    plain, alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), plain, alphabet)


def captures_to_write(pages: DataFrame, min_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """page_id, url, seconds, payload, digest, bytes, refers_to: what each record has to say.

    The response of a payload is found from digests alone; only payloads that several rows have are
    joined back, so without many copies the pages are not shuffled.
    """
    seconds = F.unix_timestamp(F.col(captured).cast("timestamp")) if captured else F.lit(None).cast("long")
    derived = F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(PERIOD))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(seconds, derived).alias("seconds"), F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("_same", F.unhex(F.sha2("payload", 256)))
    size = F.octet_length("payload").cast("long")
    shared = rows.filter(size >= min_bytes).groupBy("_same").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    shared = stored(shared.filter("_n > 1").drop("_n"), "shared-payloads")
    # Equality with an unknown id is unknown; a row without an id refers to the response, if any.
    other = F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response"))
    return rows.join(shared, "_same", "left").select(
        "page_id", "url", "seconds", "payload", base32(F.sha1("payload")).alias("digest"), size.alias("bytes"), other.alias("refers_to")
    )


def percent_encoded(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def warc_record(page_id: int | None, url: str, seconds: int, payload: str, digest: str, size: int, refers_to: int | None) -> str:
    """One record without its end. The id of a record is its page's."""
    revisit = refers_to is not None
    name = lambda page: f"<urn:page:{'' if page is None else page}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", percent_encoded(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (0 if revisit else size)),
    ]
    head = "".join(f"{key}: {value}\r\n" for key, value in fields)
    return f"{MARK.decode()}{head}\r\n{http}{'' if revisit else payload}"


def write(pages: DataFrame, folder: str, min_bytes: int = 0, captured: str | None = None) -> None:
    """Write the archives of `pages` below `folder`, one file per `archive=` folder."""
    schema = arrow_schema(archive=pa.string(), record=pa.string())

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for values in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    text = warc_record(*values)
                    rows.append((f"{task:06}-{archive:06}", text))
                    size += len(text.encode()) + len(RECORD_END)
                    if size >= ARCHIVE_BYTES:
                        archive, size = archive + 1, 0
                yield record(schema, *zip(*rows, strict=True))

    out = map_arrow(captures_to_write(pages, min_bytes, captured), records, "archive string, record string")
    out.write.partitionBy("archive").option("lineSep", RECORD_END).text(folder)


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of every record of an archive."""
    at = 0
    while at < len(archive):
        head_end = archive.find(b"\r\n\r\n", at)
        if not archive.startswith(MARK, at) or head_end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = archive[at + len(MARK) : head_end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        if archive[end : end + 4] != RECORD_END.encode():
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, end + 4 - at, fields, archive[start:end]
        at = end + 4


URL = re.compile(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^?#]*)(\?[^#]*)?")


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host, `)`, path and query, so that a site's captures are together.
    Scheme, user, `www.` and fragment are left out; what is no such URL is its own key."""
    found = URL.match(url)
    if not found:
        return url
    host, port, path, query = found.groups(default="")
    labels = host.lower().removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}{'' if port in (':80', ':443') else port}){path or '/'}{query}"


CAPTURE = "url_key string, seconds long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
CAPTURE_ARROW = arrow_schema(
    url_key=pa.string(), seconds=pa.int64(), page_id=pa.int64(), record_type=pa.string(), payload_digest=pa.string(),
    payload_bytes=pa.int64(), refers_to=pa.int64(), archive=pa.string(), offset=pa.int64(), length=pa.int64(),
)


def capture(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record. A response's digest and length are those of the bytes read."""
    page = lambda name: int(number) if (number := name.removeprefix("<urn:page:").removesuffix(">")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    if kind == "response":
        read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (read, len(payload)) != (digest, size):
            raise ValueError(f"record at byte {offset} of {archive} is damaged")
    seconds = int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%S%z").timestamp())
    refers_to = fields.get("WARC-Refers-To")
    return (
        url_key(fields["WARC-Target-URI"]), seconds, page(fields["WARC-Record-ID"]), kind, digest, size,
        page(refers_to) if refers_to else None, archive, offset, length,
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives below `folder`."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                path, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                rows = [capture(path.rsplit("archive=", 1)[-1], *found) for found in parse(content)]
                if rows:
                    yield record(CAPTURE_ARROW, *zip(*rows, strict=True))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return map_arrow(files.select("path", "content"), captures, CAPTURE)


ORDER = ["url_key", "seconds", "page_id"]
Key = tuple[str, int, bool, int]


def sort_key(url: str, seconds: int, page: int | None) -> Key:
    """As Spark sorts: by bytes of the text (code points, in Python), unknown ids first."""
    return url, seconds, page is not None, page or 0


def runs(captures: DataFrame) -> DataFrame:
    """The captures of each task in order: locally sorted runs, written to the shared folder."""
    return stored(captures.sortWithinPartitions(*ORDER), "capture-runs")


def range_bounds(sorted_runs: DataFrame) -> list[Key]:
    """Keys that begin a new range, from a bounded sample taken by hash."""
    ranges = -(-sorted_runs.count() // RANGE_ROWS)
    if ranges < 2:
        return []
    sample = sorted_runs.select(*ORDER).orderBy(F.xxhash64(*ORDER)).limit(min(SAMPLE, 100 * ranges))
    keys = sorted({sort_key(*row) for row in sample.collect()})
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)})


class LoserTree:
    """Merges sorted sources. `advance(leaf)` gives a leaf's next key, None at its end; every inner
    node keeps the loser of its match, and only the winner's path is played again."""

    def __init__(self, leaves: int, advance: Callable[[int], tuple | None]) -> None:
        self.leaves, self.advance = leaves, advance
        self.keys = [advance(leaf) for leaf in range(leaves)]
        self.losers = [0] * leaves
        self.winner = self.play(1) if leaves else 0

    def play(self, node: int) -> int:
        """Winner of the matches below a node; node n has the children 2n and 2n + 1, leaf l is node
        `leaves + l`."""
        if node >= self.leaves:
            return node - self.leaves
        winner, loser = self.play(2 * node), self.play(2 * node + 1)
        if self.beats(loser, winner):
            winner, loser = loser, winner
        self.losers[node] = loser
        return winner

    def beats(self, a: int, b: int) -> bool:
        """Equal keys: the lower leaf first."""
        left, right = self.keys[a], self.keys[b]
        return left is not None and (right is None or (left, a) < (right, b))

    def __iter__(self) -> Iterator[int]:
        """The leaf whose key is next, until all are at their end."""
        while self.leaves and self.keys[self.winner] is not None:
            winner = self.winner
            yield winner
            self.keys[winner] = self.advance(winner)
            node = (winner + self.leaves) // 2
            while node:
                if self.beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.winner = winner


BLOCKS = (
    "range int, run long, seq int, n int, after struct<url_key string, seconds long, known boolean, page_id long>, "
    "entries array<struct<" + ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in CAPTURE.split(", ")) + ">>"
)
BLOCKS_ARROW = arrow_schema(
    range=pa.int32(), run=pa.int64(), seq=pa.int32(), n=pa.int32(),
    after=pa.struct([("url_key", pa.string()), ("seconds", pa.int64()), ("known", pa.bool_()), ("page_id", pa.int64())]),
    entries=pa.list_(pa.struct(list(CAPTURE_ARROW))),
)


def blocks(sorted_runs: DataFrame, bounds: list[Key]) -> DataFrame:
    """The runs cut into blocks of at most `BLOCK` captures that do not cross a bound. `after` is the
    last key of the run's block before, null for its first one in a range. A new run begins where
    keys fall, so it does not matter how the files of the runs are dealt to tasks."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seq, at, last, after = TaskContext.get().partitionId() << 32, 0, -1, None, None
        for batch in batches:
            entries = pa.StructArray.from_arrays(batch.columns, fields=list(CAPTURE_ARROW))
            keys = [sort_key(*key) for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            rows, starts = [], []
            for place, key in enumerate(keys):
                here = bisect_right(bounds, key)
                if last is not None and key < last:
                    run, seq, at = run + 1, 0, -1
                if here != at:
                    seq, after = 0, None
                if here != at or not place or place - starts[-1] == BLOCK:
                    rows.append((here, run, seq, after))
                    starts.append(place)
                    seq += 1
                at, last = here, key
                after = dict(zip(("url_key", "seconds", "known", "page_id"), key, strict=True))
            if rows:
                ends = [*starts[1:], len(keys)]
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), entries)
                ranges, runs_, seqs, afters = zip(*rows, strict=True)
                sizes = [end - start for start, end in zip(starts, ends, strict=True)]
                yield record(BLOCKS_ARROW, ranges, runs_, seqs, sizes, pa.array(afters, BLOCKS_ARROW.field("after").type), lists)

    return map_arrow(sorted_runs.select(*CAPTURE_ARROW.names), cut_up, BLOCKS)


def merge(sorted_runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and page, with their `place`; a range is within
    one task, and tasks are in order of ranges."""
    bounds = range_bounds(sorted_runs)
    pieces = stored(blocks(sorted_runs, bounds), "capture-blocks")
    sizes = dict(pieces.groupBy("range").agg(F.sum("n")).collect())  # one number per range
    offsets, total = {}, 0
    for key in sorted(sizes):
        offsets[key], total = total, total + sizes[key]
    schema = pa.schema([("place", pa.int64()), *CAPTURE_ARROW])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(batches)
        while stream.row is not None:
            at, rows = stream.row["range"], []
            place = offsets[at]
            for entry in merge_range(stream, at):
                rows.append((place, *entry.values()))
                place += 1
                if len(rows) == 1000:
                    yield record(schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield record(schema, *zip(*rows, strict=True))

    ordered = pieces.repartitionByRange(len(bounds) + 1, "range").sortWithinPartitions("range", "after", "run", "seq")
    return map_arrow(ordered.select("range", "run", "after", "entries"), merged, f"place long, {CAPTURE}")


class Stream:
    """One block after the other, with a look at the next one."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = (row for batch in batches for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist())
        self.row = next(self.rows, None)

    def take(self) -> dict:
        row, self.row = self.row, next(self.rows, None)
        return row


def merge_range(stream: Stream, at: int) -> Iterator[dict]:
    """The captures of one range in order. Its blocks without a predecessor come first and open the
    leaves; a further block belongs to the leaf that has just run out."""
    opened = []
    while stream.row is not None and stream.row["range"] == at and stream.row["after"] is None:
        opened.append(stream.take())
    held = [iter(block["entries"]) for block in opened]
    heads: list[dict | None] = [None] * len(opened)
    fields = itemgetter(*ORDER)

    def advance(leaf: int) -> Key | None:
        entry = next(held[leaf], None)
        if entry is None and stream.row is not None and stream.row["range"] == at and stream.row["run"] == opened[leaf]["run"]:
            held[leaf] = iter(stream.take()["entries"])
            entry = next(held[leaf])
        heads[leaf] = entry
        return None if entry is None else sort_key(*fields(entry))

    for leaf in LoserTree(len(opened), advance):
        yield heads[leaf]
    if stream.row is not None and stream.row["range"] == at:
        raise AssertionError("a block was not due in its range")


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """The capture history of every URL key, read from the archives below `folder`."""
    return merge(runs(read(spark, folder)))
