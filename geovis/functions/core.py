"""Helpers for building expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body uses it. Without
    it, a long expression is repeated at every use."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def part(items: Column, start: Column, end: Column) -> Column:
    """The items at `start` to `end` - 1. Taken one by one, because `slice` copies the whole array."""
    places = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.get(items, at))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after every item of an array, for a fold `step(state, item)` from `start`.

    Appending to an array copies all of it, so the array is cut into short pieces. A first fold finds
    the state before each piece, a second one, piece by piece, all states in it; the length of the
    pieces makes the copies of both the fewest.
    """
    last = lambda array: F.get(array, F.size(array) - 1)

    def over(found):
        size = F.size(found)
        width = F.greatest(F.ceil(F.cbrt(2 * size)).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), width)
        return let(F.transform(starts, lambda at: part(found, at, F.least(at + width, size))), states)

    def states(pieces):
        before = F.aggregate(pieces, F.array(start), lambda seen, piece: F.array_append(seen, F.aggregate(piece, last(seen), step)))
        return let(before, lambda b: F.flatten(F.transform(pieces, lambda piece, i: within(F.get(b, i), piece))))

    def within(state, piece):
        seen = F.aggregate(piece, F.array(state), lambda seen, item: F.array_append(seen, step(last(seen), item)))
        return let(seen, lambda s: part(s, F.lit(1), F.size(s)))

    return let(items, over)


def whole_json(text: Column) -> Column:
    """The text as a variant, null if it is not one JSON value from its first to its last
    character. Spark's parser stops behind the first value; so the text is read as the first item of
    an array that must end with the text's own digest."""

    def read(t):
        listed = F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]'))
        items = F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")
        ends = lambda pair: (F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == F.md5(t))
        return let(items, lambda pair: F.when(ends(pair), F.get(pair, F.lit(0))))

    return let(text, read)


def unfold(df: DataFrame, keys: str | list[str], items: Column, name: str) -> DataFrame:
    """Long table (keys, ord, name) of a computed array; `ord` counts from 0.

    The outer form is used because Spark puts a "not empty" filter under the inner one, which
    would compute the array a second time.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return df.select(*keys, F.posexplode_outer(items).alias("ord", name)).filter(F.col("ord").isNotNull())


def built_once(build: Callable) -> Callable:
    """Keep the Columns that `build` returns for its (plain text) arguments. Building a long
    expression takes thousands of calls into the JVM, and it is the same for every table."""
    kept: dict = {}

    @functools.wraps(build)
    def cached(*names: str):
        key = (id(SparkContext._active_spark_context), *names)
        if key not in kept:
            kept[key] = build(*names)
        return kept[key]

    return cached
