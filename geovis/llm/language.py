"""Language identification with bit-sliced Bloom filters.

All languages share one Bloom filter whose cells are bitmasks: bit l of a cell belongs to language
l, and a cell has as many 64-bit words as the languages need. The AND of an n-gram's cells is the set of all languages that have it, so one probe answers for
every language at once. A document's score for a language is the number of its n-grams found
there, corrected for the false positives that the filling of that language's bits predicts.

N-grams are those of NGRAM code points over the lower-cased text in which every run of other
characters than letters is one space; an n-gram whose middle is a space says nothing and is left
out. An n-gram belongs to a language if its share there is at least KEEP_SHARE of its largest
share in any language and it was seen LEAST_COUNT times there. The filter is fitted on about
SAMPLE_DOCUMENTS labelled documents per language, chosen by a hash of the id; its cells are put
together by Spark, from all n-grams that belong to a language.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if
nothing was learned; ties go to the language that sorts first; very short texts are decided by
the n-grams they have; repeated rows are judged once each; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geovis.llm.common import arrow_schema, map_arrow, record, slices, stored

NGRAM = 3
SAMPLE_DOCUMENTS = 2000
LEAST_COUNT = 3
KEEP_SHARE = 0.1
CELLS_LOG2 = 20
PROBES = 3
WORD = 64  # languages in a word of a cell
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text each belongs to, and which texts have a letter."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64) + 1
    owner = np.concatenate([[0], np.repeat(np.arange(len(lowered)), sizes)])
    is_letter = letters()[points]
    has_letter = np.zeros(len(lowered), bool)
    has_letter[owner[is_letter]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of each run of others the first stays, as a space
    keep[0] = True
    points, owner, is_letter = np.where(is_letter, points, 32)[keep].astype(np.uint64), owner[keep], is_letter[keep]
    middle = np.flatnonzero(is_letter[1:-1]) + 1
    mixed = (points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32)), owner[middle], has_letter


class LanguageFilter:
    """The cells of all languages. `probe` returns the bitmask of languages per n-gram, for the
    languages of one word."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.cells = np.zeros((-(-len(languages) // WORD), 1 << CELLS_LOG2), np.uint64)

    def at(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (hashes >> np.uint64(k * CELLS_LOG2)) & np.uint64((1 << CELLS_LOG2) - 1)

    def add(self, language: int, hashes: np.ndarray) -> None:
        for k in range(PROBES):
            np.bitwise_or.at(self.cells[language // WORD], self.at(hashes, k), np.uint64(1 << language % WORD))

    def probe(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        cells = self.cells[word]
        found = cells[self.at(hashes, 0)]
        for k in range(1, PROBES):
            found &= cells[self.at(hashes, k)]
        return found

    def false_positives(self) -> np.ndarray:
        filled = [np.count_nonzero(self.cells[k // WORD] & np.uint64(1 << k % WORD)) / (1 << CELLS_LOG2) for k in range(len(self.languages))]
        return np.array(filled) ** PROBES

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        hashes, owner, has_letter = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        hits = np.empty((len(self.languages), len(texts)))
        for word in range(len(self.cells)):
            found = self.probe(hashes, word)
            for k in range(word * WORD, min(len(hits), (word + 1) * WORD)):
                hits[k] = np.bincount(owner, (found >> np.uint64(k % WORD)) & np.uint64(1), minlength=len(texts))
        wrong = self.false_positives()[:, None]
        true = np.clip((hits - n * wrong) / (1 - wrong), 0, None) if len(hits) else hits
        total = true.sum(axis=0)
        known = has_letter & (total > 0)
        best = true.argmax(axis=0) if len(hits) else np.zeros(len(texts), int)
        score = np.where(known, true.max(axis=0, initial=0) / np.where(total > 0, total, 1), 0.0)
        fallback = self.languages[0] if self.languages else UNDETERMINED
        names = [self.languages[b] if k else fallback if x else UNDETERMINED for b, k, x in zip(best, known, has_letter, strict=True)]
        return names, score


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn from the text and lang of documents that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    learned = LanguageFilter(languages)
    if not languages:
        return learned
    spark = docs.sparkSession
    codes = F.broadcast(spark.createDataFrame([(lang, k, sizes[lang]) for k, lang in enumerate(languages)], "lang string, code int, size long"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(codes, "lang").filter(draw < SAMPLE_DOCUMENTS / F.col("size")).select("text", "code")
    schema = arrow_schema(lang=pa.int32(), gram=pa.int64(), n=pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            langs = batch.column(1).to_numpy()
            hashes, owner, _ = grams(batch.column(0).to_pylist())
            for k in np.unique(langs):
                gram, n = np.unique(hashes[langs[owner] == k], return_counts=True)
                yield record(schema, np.full(len(gram), k, np.int32), gram.view(np.int64), n)

    counted = map_arrow(chosen, count, "lang int, gram long, n long")
    often = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "language-ngrams")
    totals = often.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = often.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").over(Window.partitionBy("gram"))  # a row per language
    own = shares.withColumn("most", most).filter(F.col("share") >= KEEP_SHARE * F.col("most"))
    low = F.lit((1 << CELLS_LOG2) - 1)
    cells = F.explode(F.array(*[F.shiftrightunsigned("gram", k * CELLS_LOG2).bitwiseAND(low) for k in range(PROBES)]))
    bit = F.expr(f"shiftleft(1L, lang % {WORD})")
    filled = own.select(F.expr(f"lang div {WORD}").alias("word"), cells.alias("cell"), bit.alias("bit"))
    rows = filled.groupBy("word", "cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most one per cell and word
    word, cell, bits = (rows.column(c).to_numpy() for c in ("word", "cell", "bits"))
    learned.cells[word, cell] = bits.view(np.uint64)
    return learned


def predict(docs: DataFrame, learned: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Only the text is an input of the prediction."""
    schema = arrow_schema(doc_id=pa.int64(), held_out=pa.bool_(), lang_pred=pa.string(), score=pa.float64())
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # 8 MB per 64 languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            names, score = shared.value.judge(batch.column(2).to_pylist())
            yield record(schema, batch.column(0), batch.column(1), names, score)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
