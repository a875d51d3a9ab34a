"""Ids of a word-level BPE vocabulary of the tokenizers library, one white-space word at a time.

The vocabulary drops white space and never merges across it, so a text's ids are the ids of its
words one after the other. Every worker keeps the ids of the words it met, which saves most of
the work: a corpus repeats its words. The store has two generations of bounded size.

A word of letters with punctuation behind it, the usual case, is two pieces for the vocabulary's
own splitting rule, so its letters go straight to the merges, in lower case and once for all their
spellings. Every other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import struct

# White space as the vocabulary's `\s` has it, and the characters that only
# Python's str.split takes for white space.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = re.compile("[" + "".join(map(chr, SPACES)) + "]+")
ONLY_PYTHON = re.compile("[\x1c-\x1f]")


# Punctuation that the splitting rule always parts from the letters before it, and
# the end of the range of characters that lower-case one by one and are in normal form.
TAIL = ".,;:!?%$&*#)"
PLAIN = chr(0x250)
NOT_PLAIN = chr(0x130)


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes inside the vocabulary: visible Latin-1 ones stand for
    themselves, the others for those from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """The ids of words, held as little-endian unsigned integers of `width` bytes; a word that is
    not there yet is encoded when it is first asked for."""

    def __init__(self, path: str, width: int = 4, room: int = 300_000) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.code = {2: "H", 4: "I"}[width]
        self.room, self.letters = room, byte_letters()
        self.tails: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(TAIL)
            if stem.isalpha() and (stem.isascii() or max(stem) < PLAIN and NOT_PLAIN not in stem):
                ids = self.of_stem(stem.lower())
                tail = word[len(stem) :]
                if tail:
                    if tail not in self.tails:
                        self.tails[tail] = self.whole(tail)
                    ids += self.tails[tail]
            else:
                ids = self.whole(word)
        self[word] = ids
        return ids

    def of_stem(self, low: str) -> bytes:
        ids = self.stems.get(low)
        if ids is None:
            coded = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            self.stems[low] = ids = self.packed([t.id for t in self.merge(coded)])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        if len(self) > self.room:  # the words of now become the older generation
            self.old = dict(self)
            self.clear()
        for store in (self.stems, self.tails):
            if len(store) > self.room // 2:
                store.clear()
        get = self.__getitem__
        return [b"".join(map(get, words(text))) for text in texts]


def words(text: str) -> list[str]:
    if ONLY_PYTHON.search(text):
        return [w for w in WHITE.split(text) if w]
    return text.split()


KEPT: dict[tuple, WordIds] = {}


def word_ids(path: str, width: int = 4) -> WordIds:
    """This worker process's encoder for the vocabulary."""
    if (path, width) not in KEPT:
        KEPT[path, width] = WordIds(path, width)
    return KEPT[path, width]
