"""Text functions. All take and return Columns and run inside the JVM.

Text lengths and whitespace follow the UTF-16 / ECMAScript rules that the scores are
defined on: Java's `\\s` misses the no-break space, and Spark's `length` counts code points.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from geovis.functions.core import let

# ECMAScript white space, as a Java character class.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# The same characters, for trimming, and those other than the plain space.
WS_CHARS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_NOT_SPACE = WS_CHARS.replace(" ", "")

# ASCII word edges: Java's \b is Unicode-aware and would miss "qui" in "équi".
EDGE_L = r"(?<![0-9A-Za-z_])"
EDGE_R = r"(?![0-9A-Za-z_])"

# Interrogative words (French, English) that mark an implicit question.
QUESTION_WORDS = [
    "qui", "que", "quoi", "quand", "comment", "pourquoi", "combien", "ou",
    "est-ce", "peut-on", "peut-il", "peut-elle", "what", "how", "why", "when",
    "where", "who", "which", "can", "do", "does", "is", "are",
]
QUESTION_MIN_LENGTH = 20

# Openings of a direct answer.
ANSWER_OPENINGS = (
    "oui", "non", "le", "la", "les", "notre", "nous", "c'est", "il s'agit", "cela", "pour",
    "en", "si", "quand", "nos", "cette",
)
ANSWER_MAX_LENGTH = 250

# Separators between words for the tolerant name search.
WORD_SEPARATORS = r"""[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff.,;:!?'"()\[\]/\\-]+"""


def words_pattern(words, flags: str = "(?i)") -> str:
    """A pattern that finds any of `words` between ASCII word edges; the first letters are tested
    first, because most places in a text fail there."""
    first = "".join(sorted({w[0] for w in words}))
    return f"{flags}(?=[{first}]){EDGE_L}(?:{'|'.join(words)}){EDGE_R}"


def holds_any(text: Column, words) -> Column:
    """Whether any of the words stands in the text. Much cheaper than a pattern, so it goes before one
    that cannot match without them."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def js_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def js_round(value: Column) -> Column:
    """Round half up, also below zero: floor(x + 0.5)."""
    return F.floor(value + F.lit(0.5)).cast("int")


def collapse_space(text: Column) -> Column:
    """White space runs as one space, none at the ends. Plain single spaces, by far the most
    common, are never rewritten, and common letters are told apart in one step."""
    plain = F.regexp_replace(text, rf"(?![ -~\u00a1-\u167f])[{_WS_NOT_SPACE}]+", " ")
    single = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    return F.btrim(let(plain, single), F.lit(" "))


def count_words(collapsed: Column) -> Column:
    """Number of words of a text whose white space is already collapsed and trimmed."""
    return let(
        collapsed,
        lambda t: F.when(t == "", F.lit(0)).otherwise(
            F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        ),
    )


def is_question(text: Column) -> Column:
    """Ends with a question mark, or is long enough and holds an interrogative word."""
    return let(
        js_trim(F.coalesce(text, F.lit(""))),
        lambda t: t.endswith("?")
        | ((js_length(t) > QUESTION_MIN_LENGTH) & t.rlike(words_pattern(QUESTION_WORDS))),
    )


def opens_like_answer(text: Column) -> Column:
    return let(
        js_trim(F.coalesce(text, F.lit(""))),
        lambda t: (t != "")
        & (js_length(t) < ANSWER_MAX_LENGTH)
        & t.rlike(f"(?i)^(?:{'|'.join(ANSWER_OPENINGS)}){EDGE_R}"),
    )


def count_mentions(haystack: Column, needle: Column) -> Column:
    """Case-insensitive count of non-overlapping literal occurrences."""

    def count(pair):
        removed = F.length(pair.low) - F.length(F.replace(pair.low, pair.word, F.lit("")))
        return F.when((pair.low == "") | (pair.word == ""), F.lit(0)).otherwise(
            (removed / F.length(pair.word)).cast("int")
        )

    empty = F.lit("")
    return let(
        F.struct(
            F.lower(F.coalesce(haystack, empty)).alias("low"),
            F.lower(F.coalesce(needle, empty)).alias("word"),
        ),
        count,
    )


def strip_fences(text: Column) -> Column:
    """Remove a Markdown code fence that wraps the whole text."""
    fence = r"(?s)\A```(?:json|javascript|js)?\s*\n?(.*?)\n?```\s*\z"
    return let(
        js_trim(text),
        lambda t: F.when(t.rlike(fence), js_trim(F.regexp_extract(t, fence, 1))).otherwise(t),
    )


def tokens(text: Column) -> Column:
    """Words for the tolerant name search."""
    return F.filter(F.split(text, WORD_SEPARATORS), lambda t: t != "")


def fuzzy_threshold(size: Column) -> Column:
    """Tolerated edits by name length: below 5 none, below 8 one, else two."""
    return F.when(size < 5, 0).when(size < 8, 1).otherwise(2)


def edit_distance(a: Column, b: Column) -> Column:
    """Case-insensitive edit distance, -1 above two edits."""
    return F.levenshtein(F.lower(a), F.lower(b), 2)


def readability(text: Column) -> Column:
    """struct(sentences, words, chars) of a collapsed visible text."""

    # A text has at least as many code units as code points.
    long = lambda s: F.when(F.length(s) > 5, F.lit(True)).otherwise(js_length(s) > 5)

    def measure(t):
        # The text is collapsed: its only white space is the plain space.
        sentences = F.filter(F.split(t, r"[.!?]+"), lambda s: let(F.btrim(s), long))
        return F.struct(
            F.size(sentences).alias("sentences"),
            count_words(t).alias("words"),
            js_length(F.replace(t, F.lit(" "), F.lit(""))).alias("chars"),
        )

    return let(text, measure)


def excerpt(text: Column, size: int) -> Column:
    """The first `size` characters, for display columns and snippets only."""
    return F.substring(text, 1, size)


def geo_suffix(question: Column, place: Column) -> Column:
    """Add the place to a question unless it is empty or already named."""
    named = F.instr(F.lower(question), F.lower(place)) > 0
    return F.when(
        place.isNotNull() & (place != "") & ~named, F.concat(question, F.lit(" (depuis "), place, F.lit(")"))
    ).otherwise(question)
