"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else.

Which suffixes. Of the strings of GRAM bytes inside a window of LENGTH bytes, the one with the
smallest hash is the window's anchor. Equal windows have equal anchors at the same place, so it is
enough to index the suffixes that start at anchors, about one in 85 bytes. Neighbouring windows
with the same anchor are a `run`; its text reaches at most LENGTH + GRAMS - 1 bytes. A run whose
anchor string occurs nowhere else has no repeated window and is dropped by a count.

The index. The other runs are dealt by anchor, so all runs that can match meet in one task, in
record batches. A batch gets a suffix array: its anchored suffixes in sorted order. It is
merge-scanned against every existing level: runs with the same anchor string are neighbours there,
and are extended to both sides to their longest match. Matches of LENGTH bytes or more mark both
runs. The batch then becomes a level, and while the last two levels are of like size they
merge, so there are logarithmically many. A run equal to an indexed one is marked and left out.
Anchors with more than MANY different runs in a level are not matched pair by pair: once all
batches are in, their windows are sorted, all that stand at the same distance from the anchor at
a time, so the work stays close to linear.

An anchor that more than LEAST_HOT runs and more than 1/HOT_SHARE of all runs have (a common line,
a large group of near copies) would be too much for one task. Its runs are first cut into blocks of BLOCK windows that count again by
the bytes that all windows of the block share, which clears short common strings; what is left is
compared window by window by 128-bit hashes, as counts that Spark combines before it shuffles.

Equal texts are indexed once: a text of LENGTH bytes or more with a copy goes as a whole.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; bytes are those of
UTF-8, and a removed string may begin or end inside a character (`trimmed` then drops the whole
character); repeated rows are copies of each other, whatever their ids; a null doc_id is kept as
null; an empty table gives no rows; other columns are ignored by `removals` and kept by `trimmed`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, map_arrow, record, slices, stored

LENGTH = 200
GRAM = 32
GRAMS = LENGTH - GRAM + 1  # anchors' places in a window
LEFT = GRAMS - 1  # most bytes of a window before its anchor
HOT_SHARE = 2_000_000  # bounds the keys to tell all tasks: 16 MB
LEAST_HOT = 100_000  # runs that one task takes in any case: 30 MB of text, 106 MB indexed
MANY = 512
BLOCK = 24
CORE = LENGTH - BLOCK + 1  # bytes that all windows of a block share
TASK_RUNS = 50_000
PLACE_BITS = 18
BUFFER = 1 << PLACE_BITS
BASE = 0x9E3779B97F4A7C15  # odd


class Powers:
    """Powers of BASE and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def load(cls) -> None:
        if len(cls.up) < BUFFER + 1:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(BUFFER + 1, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima inside blocks of that size."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """The runs of some texts. text: which text; start: of the first window in it; windows: their
    number; left: bytes from start to the anchor; key: hash of the anchor string."""

    def __init__(self, texts: list[bytes]) -> None:
        Powers.load()
        found = [self.of_buffer(*b) for b in self.buffers(texts)]
        empty = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
        self.text, self.start, self.windows, self.left, self.key = (np.concatenate(c) for c in zip(*(found or empty), strict=True))

    @staticmethod
    def buffers(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
        """Texts joined up to the buffer's size; a longer text is cut so that its parts share all
        but one byte of a window. With each part: text, its offset there, its length."""
        parts: list[bytes] = []
        places: list[tuple[int, int, int]] = []
        held = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text) - LENGTH + 1, BUFFER - LENGTH + 1):
                part = text[at : at + BUFFER]
                if held + len(part) > BUFFER:
                    yield b"".join(parts), places
                    parts, places, held = [], [], 0
                parts.append(part)
                places.append((k, at, len(part)))
                held += len(part)
        if parts:
            yield b"".join(parts), places

    @staticmethod
    def of_buffer(data: bytes, places: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * Powers.up[:n], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * Powers.down[: n - GRAM + 1])
        low = np.uint64(BUFFER - 1)
        least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), GRAMS)
        anchor = (least & low).astype(np.int64)
        text, offset, length = (np.array(c, np.int64) for c in zip(*places, strict=True))
        ends = np.cumsum(length)
        inside = np.ones(n - LENGTH + 1, bool)  # windows that do not cross into the next text
        for end in ends[:-1]:
            inside[end - LENGTH + 1 : end] = False
        at = np.flatnonzero(inside)
        first = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
        start = at[first]
        windows = np.diff(np.append(first, len(at)))
        own = np.searchsorted(ends, start, side="right")
        a = anchor[start]
        return text[own], start - (ends - length)[own] + offset[own], windows, a - start, grams[a]


def blocks(texts: list[bytes], runs: Runs, picked: np.ndarray) -> tuple[np.ndarray, ...]:
    """The picked runs cut by the windows' distance from the anchor into blocks: index of the run,
    first window's start in its text, windows, hash of the bytes all windows of such a block share."""
    from xxhash import xxh3_64_intdigest

    out = []
    for r in picked.tolist():
        text, start, left, n = texts[runs.text[r]], int(runs.start[r]), int(runs.left[r]), int(runs.windows[r])
        for c in range((left - n + 1) // BLOCK, left // BLOCK + 1):
            first, last = min(left, c * BLOCK + BLOCK - 1), max(left - n + 1, c * BLOCK)
            shared = start + left - c * BLOCK
            out.append((r, start + left - first, first - last + 1, xxh3_64_intdigest(text[shared : shared + CORE], c)))
    index, starts, windows, keys = zip(*out, strict=True) if out else ((), (), (), ())
    return np.array(index, np.int64), np.array(starts, np.int64), np.array(windows, np.int64), np.array(keys, np.uint64)


class Levels:
    """The logarithmic family of suffix arrays of one task. An entry is a run's text from its
    anchor on, then its text before the anchor backwards, then both lengths; sorted as bytes."""

    LEFT_WORD = LENGTH // 8  # an entry in 64-bit words: after the anchor, before it, lengths
    SIZE_WORD = (LENGTH + LEFT) // 8
    ENTRY = LENGTH + LEFT + 8

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # entries in order, their runs
        self.whole = np.zeros(0, bool)  # of each run
        self.marks = np.zeros((0, GRAMS + 1), np.int32)  # of each run: changes along the distances
        self.many: set[bytes] = set()  # anchors whose windows are to be sorted

    @classmethod
    def entries(cls, texts: list[bytes], left: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), cls.ENTRY), np.uint8)
        size = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum(size) - size
        ahead = np.arange(LENGTH)[None, :]
        on = ahead < (size - left)[:, None]
        out[:, :LENGTH][on] = flat[((at + left)[:, None] + ahead)[on]]
        back = np.arange(LEFT)[None, :]
        on = back < left[:, None]
        out[:, LENGTH : LENGTH + LEFT][on] = flat[((at + left - 1)[:, None] - back)[on]]
        out[:, LENGTH + LEFT], out[:, LENGTH + LEFT + 1] = size - left, left
        return out

    @classmethod
    def sizes(cls, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from the anchor on, and before it."""
        return entries[:, LENGTH + LEFT].astype(np.int64), entries[:, LENGTH + LEFT + 1].astype(np.int64)

    @classmethod
    def as_keys(cls, entries: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(entries).view(f"S{cls.ENTRY}").ravel()

    @staticmethod
    def anchors(entries: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(entries[:, :GRAM]).view(f"S{GRAM}").ravel()

    def add(self, texts: list[bytes], left: np.ndarray) -> None:
        """Index a batch of runs; they are numbered in the order of adding."""
        base = len(self.whole)
        self.whole = np.concatenate([self.whole, np.zeros(len(texts), bool)])
        self.marks = np.concatenate([self.marks, np.zeros((len(texts), GRAMS + 1), np.int32)])
        entries = self.entries(texts, left)
        order = np.argsort(self.as_keys(entries), kind="stable")
        entries, runs = entries[order], order + base
        again = np.concatenate([[False], (entries[1:] == entries[:-1]).all(axis=1)])
        self.whole[runs[again]] = True
        self.whole[runs[:-1][again[1:]]] = True
        entries, runs = entries[~again], runs[~again]
        for level, level_runs in self.levels:
            if not len(runs):
                return
            keys = self.as_keys(level)
            at = np.minimum(np.searchsorted(keys, self.as_keys(entries)), len(keys) - 1)
            known = (level[at] == entries).all(axis=1)
            self.whole[runs[known]] = True
            self.whole[level_runs[at[known]]] = True
            entries, runs = entries[~known], runs[~known]
        if not len(runs):
            return
        for level, level_runs in self.levels:
            self.scan(entries, runs, level, level_runs)
        self.scan(entries, runs, entries, runs)
        self.levels.append((entries, runs))
        while len(self.levels) > 1 and len(self.levels[-2][1]) <= 2 * len(self.levels[-1][1]):
            (a, a_runs), (b, b_runs) = self.levels[-2:]
            entries, runs = np.concatenate([a, b]), np.concatenate([a_runs, b_runs])
            order = np.argsort(self.as_keys(entries), kind="stable")
            self.levels[-2:] = [(entries[order], runs[order])]

    def scan(self, new: np.ndarray, new_runs: np.ndarray, old: np.ndarray, old_runs: np.ndarray) -> None:
        """Mark the long matches between a sorted batch and a level, or within the batch."""
        anchors, theirs = self.anchors(new), self.anchors(old)
        low, high = np.searchsorted(theirs, anchors, side="left"), np.searchsorted(theirs, anchors, side="right")
        if new is old:
            low = np.arange(len(new)) + 1  # each pair once
        count = np.maximum(high - low, 0)
        many = count > MANY
        self.many.update(anchors[many].tolist())
        count[many] = 0
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(new):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + 100_000, side="right")) - 1)
            n = count[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            k = np.arange(len(i)) - np.repeat(total[at:stop] - total[at], n) + np.repeat(low[at:stop], n)
            self.extend(new, new_runs, i, old, old_runs, k)
            at = stop

    def extend(self, a: np.ndarray, a_runs: np.ndarray, i: np.ndarray, b: np.ndarray, b_runs: np.ndarray, k: np.ndarray) -> None:
        (a_ahead, a_back), (b_ahead, b_back) = self.sizes(a), self.sizes(b)
        a, b = a.view(np.uint64), b.view(np.uint64)
        ahead = np.minimum(common(a[:, : self.LEFT_WORD], i, b[:, : self.LEFT_WORD], k), np.minimum(a_ahead[i], b_ahead[k]))
        back = slice(self.LEFT_WORD, self.SIZE_WORD)
        back = np.minimum(common(a[:, back], i, b[:, back], k), np.minimum(a_back[i], b_back[k]))
        long = ahead + back >= LENGTH
        for runs in (a_runs[i[long]], b_runs[k[long]]):
            np.add.at(self.marks, (runs, LENGTH - ahead[long]), 1)  # from this distance to the anchor
            np.add.at(self.marks, (runs, back[long] + 1), -1)  # up to this one

    def sort_windows(self) -> None:
        """Mark the repeated windows of anchors with many runs."""
        if not self.many:
            return
        entries, runs = (np.concatenate(c) for c in zip(*self.levels, strict=True))
        anchors = self.anchors(entries)
        mine = np.isin(anchors, np.array(sorted(self.many), anchors.dtype))
        entries, runs, anchors = entries[mine], runs[mine], anchors[mine]
        ahead, back = self.sizes(entries)
        _, group = np.unique(anchors, return_inverse=True)
        weights = np.random.default_rng(1).integers(0, 1 << 63, LENGTH // 8 + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for distance in range(GRAMS):
            rows = np.flatnonzero((back >= distance) & (ahead >= LENGTH - distance))
            if not len(rows):
                continue
            window = np.empty((len(rows), LENGTH + 8), np.uint8)
            window[:, :8] = group[rows].astype(">u8")[:, None].view(np.uint8)
            window[:, 8 : 8 + LENGTH - distance] = entries[rows, : LENGTH - distance]
            window[:, 8 + LENGTH - distance :] = entries[rows, LENGTH : LENGTH + distance]
            words = window.view(np.uint64)
            hashes = mixed((words * weights).sum(axis=1, dtype=np.uint64))
            order = np.argsort(hashes, kind="stable")
            alike = hashes[order[1:]] == hashes[order[:-1]]
            same = alike.copy()
            at = np.flatnonzero(alike)
            same[at] = (words[order[at + 1]] == words[order[at]]).all(axis=1)
            if (same != alike).any():  # different windows of one hash: sort the windows themselves
                order = np.argsort(window.view(f"S{LENGTH + 8}").ravel(), kind="stable")
                same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
            hit = runs[rows[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]]
            self.marks[hit, distance] += 1
            self.marks[hit, distance + 1] -= 1
        self.many = set()

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, and the range of window distances [least, most] from its anchor that repeat; a
        range of -1 stands for the whole run."""
        self.sort_windows()
        whole = np.flatnonzero(self.whole)
        none = np.full(len(whole), -1)
        found = [(whole, none, none)]
        for at in range(0, len(self.marks), 8192):
            on = np.cumsum(self.marks[at : at + 8192], axis=1, dtype=np.int32)[:, :GRAMS] > 0
            on[self.whole[at : at + 8192]] = False
            edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            run, least = np.nonzero(edge == 1)
            found.append((run + at, least, np.nonzero(edge == -1)[1] - 1))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of rows i of a and k of b, both in 64-bit words."""
    differ = a[i] ^ b[k]
    word = (differ != 0).argmax(axis=1)
    first = differ[np.arange(len(i)), word]
    low = np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
    return np.where(first == 0, 8 * a.shape[1], 8 * word + low)


def identified(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with _a, _b (a 128-bit identity of the text) and _sha, _bytes."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    return docs.withColumn("_sha", sha).withColumns({"_a": F.xxhash64("_sha"), "_b": F.xxhash64(F.lit(7), F.col("_sha")), "_bytes": F.octet_length(text).cast("long")})


def long_texts(docs: DataFrame) -> DataFrame:
    rows = docs.select("text").filter(F.octet_length("text") >= LENGTH)
    return identified(rows).select("_a", "_b", "text")


def packed_place(start: np.ndarray, left: np.ndarray, windows: np.ndarray, fine: bool) -> np.ndarray:
    """A run's place in its text as one number: start, bytes before the anchor, windows, fine."""
    return (start.astype(np.int64) << 17) | (left.astype(np.int64) << 9) | (windows.astype(np.int64) << 1) | int(fine)


def place() -> Column:
    """A number for a place in the corpus; copies of a text share their places."""
    return F.xxhash64("a", "b", "place")


def run_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, a, b, place of the runs of all texts; runs with a hot key are replaced by their fine
    blocks."""
    schema = arrow_schema(key=pa.int64(), a=pa.int64(), b=pa.int64(), place=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 400):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            runs = Runs(texts)
            is_hot = np.isin(runs.key, hot) if len(hot) else np.zeros(len(runs.key), bool)
            cold = ~is_hot
            t = runs.text[cold]
            yield record(schema, runs.key[cold].view(np.int64), a[t], b[t], packed_place(runs.start[cold], runs.left[cold], runs.windows[cold], False))
            if is_hot.any():
                index, start, windows, key = blocks(texts, runs, np.flatnonzero(is_hot))
                t = runs.text[index]
                yield record(schema, key.view(np.int64), a[t], b[t], packed_place(start, np.zeros(len(t)), windows, True))

    return map_arrow(long_texts(docs), run, "key long, a long, b long, place long")


def repeated(rows: DataFrame) -> DataFrame:
    """key, n of the keys that stand in more than one place."""
    seen = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(place()).alias("least"), F.max(place()).alias("most"))
    return seen.filter("least <> most").select("key", "n")


def selected(docs: DataFrame) -> DataFrame:
    """a, b, runs: for every text with runs that may repeat, these runs as (key, place)."""
    counted = stored(repeated(run_rows(docs, np.zeros(0, np.uint64))), "repeated-anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST_HOT, total // HOT_SHARE)  # so there are at most HOT_SHARE hot keys
    hot = np.sort(counted.filter(F.col("n") > most).select("key").toArrow()["key"].to_numpy().view(np.uint64))
    keys = counted.filter(F.col("n") <= most).select("key")
    rows = run_rows(docs, hot)
    if len(hot):
        fine = repeated(rows.filter(F.col("place").bitwiseAND(F.lit(1)) == 1)).select("key")
        keys = stored(keys.unionByName(fine).distinct(), "keys")
    kept = rows.join(keys, "key")
    return kept.groupBy("a", "b").agg(F.collect_set(F.struct("key", "place")).alias("runs"))


def packed_texts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` and the text compressed, which halves what a shuffle moves."""
    at = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 1000):
            data = pa.array([None if t is None else press.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], data], names=[*columns, "packed"])

    rows = docs.select(*columns, "text")
    return map_arrow(rows, run, rows.drop("text").schema.add("packed", "binary"))


def with_texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The selected runs of every text with the text itself, taken from one of its rows."""
    known = identified(docs.select("doc_id", "text")).filter(F.col("_bytes") >= LENGTH)
    number = F.coalesce("doc_id", F.lit(-(1 << 63)))
    one = known.groupBy("_a", "_b").agg(F.min(number).alias("_one"))
    chosen = runs.join(one, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("a", "b", "_one", "runs")
    texts = packed_texts(known.withColumn("_one", number), ["_a", "_b", "_one"])
    texts = texts.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "_one", "packed")
    return chosen.join(texts, ["a", "b", "_one"]).select("a", "b", "packed", "runs")


def unpacked_runs(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, dict[str, np.ndarray]]:
    """The texts, and for all runs of a batch the row they belong to and their parts."""
    opener = zstandard.ZstdDecompressor()
    texts = [opener.decompress(x) for x in batch.column(2).to_pylist()]
    lists = batch.column(3)
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    key, place = (lists.flatten().field(c).to_numpy() for c in ("key", "place"))
    parts = {"key": key, "start": place >> 17, "left": (place >> 9) & 255, "windows": (place >> 1) & 255, "fine": (place & 1).astype(bool)}
    return texts, owner, parts


def indexed_spans(texts: DataFrame, partitions: int) -> DataFrame:
    """a, b, from_byte, to_byte of what the suffix arrays find."""
    moved = arrow_schema(key=pa.int64(), a=pa.int64(), b=pa.int64(), start=pa.int64(), left_bytes=pa.int32(), data=pa.binary())

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 400):
            whole, owner, runs = unpacked_runs(batch)
            use = np.flatnonzero(~runs["fine"])
            t = owner[use]
            start, stop = runs["start"][use], runs["start"][use] + runs["windows"][use] + LENGTH - 1
            data = [whole[k][s:e] for k, s, e in zip(t.tolist(), start.tolist(), stop.tolist(), strict=True)]
            yield record(moved, runs["key"][use], batch.column(0).to_numpy()[t], batch.column(1).to_numpy()[t], start, runs["left"][use].astype(np.int32), data)

    out = arrow_schema(a=pa.int64(), b=pa.int64(), from_byte=pa.int64(), to_byte=pa.int64())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held = Levels(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            _, a, b, start, left = (c.to_numpy() for c in batch.columns[:5])
            data = batch.column(5).to_pylist()
            left = left.astype(np.int64)
            held.append((a, b, start, left, np.array([len(d) for d in data])))
            levels.add(data, left)
        if held:
            a, b, start, left, size = (np.concatenate(c) for c in zip(*held, strict=True))
            run, least, most = levels.spans()
            whole = least < 0
            first = np.where(whole, start[run], (start + left)[run] - most)
            last = np.where(whole, start[run] + size[run], (start + left)[run] - least + LENGTH)
            yield record(out, a[run], b[run], first, last)

    rows = map_arrow(texts, cut_out, "key long, a long, b long, start long, left_bytes int, data binary")
    return map_arrow(rows.repartition(partitions, "key"), index, "a long, b long, from_byte long, to_byte long")


def window_spans(texts: DataFrame) -> DataFrame:
    """a, b, from_byte, to_byte of the repeated windows of fine blocks."""
    schema = arrow_schema(w=pa.int64(), v=pa.int64(), a=pa.int64(), b=pa.int64(), start=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, 100):
            whole, owner, runs = unpacked_runs(batch)
            use = np.flatnonzero(runs["fine"])
            n = runs["windows"][use]
            t = np.repeat(owner[use], n)
            start = np.repeat(runs["start"][use], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = b"".join([xxh3_128_digest(whole[k][s : s + LENGTH]) for k, s in zip(t.tolist(), start.tolist(), strict=True)])
            pairs = np.frombuffer(hashes, np.int64).reshape(-1, 2)
            yield record(schema, pairs[:, 0], pairs[:, 1], batch.column(0).to_numpy()[t], batch.column(1).to_numpy()[t], start)

    rows = stored(map_arrow(texts, run, "w long, v long, a long, b long, start long"), "windows")
    where = F.xxhash64("a", "b", "start")
    seen = rows.groupBy("w", "v").agg(F.min(where).alias("least"), F.max(where).alias("most")).filter("least <> most")
    seen = stored(seen.select("w", "v"), "repeated-windows")
    return rows.join(seen, ["w", "v"]).select("a", "b", F.col("start").alias("from_byte"), (F.col("start") + LENGTH).alias("to_byte"))


def spans(docs: DataFrame) -> DataFrame:
    """a, b, spans: per distinct text of LENGTH bytes or more, the byte ranges that go (they may
    overlap); texts that lose nothing are not listed."""
    runs = stored(selected(docs), "runs")
    is_fine = lambda r: r["place"].bitwiseAND(F.lit(1)) == 1
    shape = runs.agg(F.sum(F.size("runs")), F.max(F.exists("runs", is_fine))).first()
    total, any_fine = shape[0] or 0, bool(shape[1])
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_RUNS))
    texts = with_texts(docs, runs)
    found = indexed_spans(texts, partitions)
    if any_fine:
        found = found.unionByName(window_spans(texts.filter(F.exists("runs", is_fine))))
    copies = identified(docs.select("text")).filter(F.col("_bytes") >= LENGTH).groupBy("_a", "_b", "_bytes").count().filter("count > 1")
    found = found.unionByName(copies.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(0).cast("long").alias("from_byte"), F.col("_bytes").alias("to_byte")))
    return stored(found.groupBy("a", "b").agg(F.collect_set(F.struct("from_byte", "to_byte")).alias("spans")), "spans")


def joined_spans(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[list[int]] = []
    for first, last in sorted((r["from_byte"], r["to_byte"]) for r in ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def remaining(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans as (from_byte, to_byte)."""
    schema = arrow_schema(
        doc_id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string(),
        spans=pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())])),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1000):
            rows = []
            for doc_id, size, sha, data, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = joined_spans(ranges or [])
                if gone:
                    sha = hashlib.sha256(remaining(opener.decompress(data), gone)).hexdigest()
                rows.append((doc_id, size, sum(b - a for a, b in gone), len(gone), sha, [{"from_byte": a, "to_byte": b} for a, b in gone]))
            yield record(schema, *zip(*rows, strict=True))

    found = spans(docs)
    rows = packed_texts(identified(docs.select("doc_id", "text")), ["doc_id", "_a", "_b", "_bytes", "_sha"])
    rows = rows.join(found, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select("doc_id", "_bytes", "_sha", "packed", "spans")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from_byte:long,to_byte:long>>")


def trimmed(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated strings cut out of the text. A character goes if any of its bytes
    does, so the text stays well-formed; a null text stays null."""
    names = docs.columns
    at = names.index("text")
    kept = [n for n in names if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1000):
            texts = []
            for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = None if data is None else opener.decompress(data)
                texts.append(raw if raw is None else remaining(raw, whole_characters(raw, joined_spans(ranges or []))).decode())
            columns = batch.column(0).flatten()
            columns.insert(at, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = spans(docs)
    rows = packed_texts(identified(docs.select(F.struct(*kept).alias("_rest"), "text")), ["_rest", "_a", "_b"])
    rows = rows.join(found, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select("_rest", "packed", "spans")
    return map_arrow(rows, run, docs.schema)


def whole_characters(data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans widened to the characters they cut."""
    out: list[tuple[int, int]] = []
    for first, last in gone:
        while first and data[first] & 0xC0 == 0x80:
            first -= 1
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out
