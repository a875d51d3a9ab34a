"""Byte-level BPE by ranked merges: text to ids, and ids back to bytes.

A text is split by a pattern; each match is folded on its own: of all neighbouring parts the pair
whose joined bytes have the lowest rank is merged, the leftmost if ranks tie, until no pair has a
rank. Equal words give equal ids, so a word is folded once per worker and kept; all new words of
a batch are folded side by side, one merge each per step, over flat arrays. Decoding joins the
binary pieces of the ids.

`fold_words` is the same fold as Spark higher-order functions over the byte arrays of words, with
the rank map as a literal. It is right, but Spark looks a key of a map up by walking its entries,
and a corpus repeats its words too often to shuffle every occurrence to its word, so the query
uses the fold inside the tasks (see README for the figures).

Defined results: a null or empty text has no ids; repeated rows are encoded once each; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, id_and_text, map_arrow, record, slices

LONG_WORD = 96  # bytes; longer words are folded one by one with a heap
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """The ranked merges of a rank file as pairs of ids: (left, right) to the id of both."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces = {rank: word for word, rank in ranks.items()}
        self.span = max(ranks.values()) + 1
        self.pairs = {}
        for word, rank in ranks.items():
            for at in range(1, len(word)):
                left, right = ranks.get(word[:at]), ranks.get(word[at:])
                if left is not None and right is not None:
                    self.pairs[left * self.span + right] = rank
        self.keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.values = np.array([self.pairs.get(int(k), NO_RANK) for k in self.keys], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.values[at], NO_RANK)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(words)
        side = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                out[k] = np.array(self.fold_long(word), "<u4").tobytes()
            elif word:
                side.append(k)
        if side:
            for k, ids in zip(side, self.fold_side_by_side([words[k] for k in side]), strict=True):
                out[k] = ids
        return out

    def fold_side_by_side(self, words: list[bytes]) -> list[bytes]:
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NO_RANK, np.int32)  # of the pair that starts at each part
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(ids)))
            open_words = best != NO_RANK
            if not open_words.all():
                stay = np.repeat(open_words, sizes)
                done.append((owner[~stay], ids[~stay]))
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                if not len(ids):
                    break
                best, sizes = best[open_words], sizes[open_words]
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]  # the leftmost of each word
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # their places once the right parts are gone
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = NO_RANK
            inner = changed[changed + 1 < len(ids)]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
        owners, parts = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        flat = parts[order].astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(owners[order], np.arange(len(words) + 1))).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def fold_long(self, word: bytes) -> list[int]:
        """The same fold for one word, with a heap of pairs: n log n steps for n bytes."""
        ids = [int(self.single[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] * self.span + ids[k + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or get(ids[k] * self.span + ids[j]) != r:
                continue
            ids[k], alive[j] = r, False
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (found := get(ids[a] * self.span + ids[after[a]])) is not None:
                    heapq.heappush(heap, (found, a))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


# White space other than space and line feed, and pairs of white space. Without
# these, the pattern's matches never cross from a word to the space or line feed behind it.
RARE_SPACE = [chr(c) for c in (0x9, 0xB, 0xC, 0xD, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SPACE_PAIRS = ["  ", " \n", "\n ", "\n\n"]


class Encoder:
    """Texts to ids, keeping the ids of words in two generations of bounded size.

    In a text whose white space is single spaces and line feeds, every word with the space before
    it is split by the pattern on its own, so whole words are looked up; other texts are split by
    the pattern first."""

    def __init__(self, path: str, pattern: str, room: int = 200_000) -> None:
        import regex

        self.merges, self.split, self.room = Merges(read_ranks(path)), regex.compile(pattern).findall, room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """Parts of the text that the pattern splits as it splits the text."""
        rare = RARE_SPACE[:8] if text.isascii() else RARE_SPACE
        if any(pair in text for pair in SPACE_PAIRS) or any(c in text for c in rare):
            return self.split(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            head, *rest = line.split(" ")
            if head:
                out.append(head)
            out += [" " + word for word in rest]
        return out

    def learn(self, units: list[str]) -> None:
        split = [self.split(u) for u in units]
        matches = list(set().union(*split))
        ids = dict(zip(matches, self.merges.fold([m.encode() for m in matches]), strict=True))
        for unit, parts in zip(units, split, strict=True):
            self.young[unit] = b"".join([ids[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.units(t) for t in texts]
        new = []
        for unit in set().union(*split) - self.young.keys():
            if unit in self.old:
                self.young[unit] = self.old[unit]
            else:
                new.append(unit)
        self.learn(new)
        get = self.young.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        return out


KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in KEPT:
        KEPT[path, pattern] = Encoder(path, pattern)
    return KEPT[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    schema = arrow_schema(doc_id=pa.int64(), ids=pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 300):
            found = encoder(path, pattern).encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), "<i4"))
            yield record(schema, batch.column(0), ids)

    return map_arrow(id_and_text(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, a digest of the ids, and the decoded bytes with their digest."""
    schema = arrow_schema(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path, pattern).merges
        shown = {rank: str(rank) for rank in merges.pieces}
        for batch in slices(batches, 300):
            ids = batch.column(1).to_pylist()
            digests = [hashlib.sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids]
            yield record(schema, batch.column(0), [len(x) for x in ids], digests, [merges.decode(x) for x in ids])

    return map_arrow(encoded, run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word (binary) as one Spark expression: each byte is a part, and every step
    merges the neighbours whose joined bytes rank lowest in the literal map, until none has a
    rank. There are at most as many steps as bytes."""
    table = F.create_map(*[F.lit(x) for word_, rank in ranks.items() for x in (bytearray(word_), rank)])
    parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(now: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(now, 2, F.size(now)), lambda right, i: F.struct(F.try_element_at(table, F.concat(F.get(now, i), right)).alias("rank"), i.alias("at")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        merged = lambda b: F.concat(F.slice(now, F.lit(1), b["at"]), F.array(F.concat(F.get(now, b["at"]), F.get(now, b["at"] + 1))), F.slice(now, b["at"] + 3, F.size(now)))
        return F.get(F.transform(F.array(best), lambda b: F.when(b.isNull(), now).otherwise(merged(b))), F.lit(0))

    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), parts, step)
    return F.when(F.length(word) > 0, F.transform(folded, lambda p: F.try_element_at(table, p))).otherwise(F.array().cast("array<int>"))
