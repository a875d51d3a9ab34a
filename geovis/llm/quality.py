"""Quality rules: statistics of a text, and a decision list learned from labelled ones.

Statistics are expressions over one row. A word window is known by the hash of its words, so
windows are compared within their document, without a shuffle and in time linear in the text but
for one sort of the windows of documents that do repeat.

The list is learned by sequential covering: a rule, a conjunction of thresholds, is grown on two
thirds of the labelled rows for the best gain in purity, its last conditions are pruned on the
other third, it is kept if it is nearly always right, its rows are taken away, and the next rule
is grown. The rules become one ordered CASE expression, so judging stays in Spark's native code.
The learner sees the numbers of at most SAMPLE_ROWS labelled documents, those whose id has the
smallest hash; the statistics and the judgement cover every document.

Defined results: a null or empty text has no words and fails the base rule; a document with
labels that disagree, or a null label, teaches nothing; without labels the list is empty and keeps
what the base keeps; ties between candidate conditions go to the first feature and the smallest
threshold; repeated rows are judged once each; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

SAMPLE_ROWS = 8000
MOST_RULES = 12
MOST_CONDITIONS = 3
LEAST_SUPPORT = 5
LEAST_PRECISION = 0.95


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of `docs` that are named, and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words of `text`."""
    kept = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *kept, F.array_remove(F.split(text, SPACE), "").alias("_words"), lines.alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = first.select(
        *kept, "n_symbols", F.size("_words").cast("long").alias("n_words"), F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), window))
    seen = counted.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", windows.alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(repeats, F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    seen = seen.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", ordered.alias("_ordered"))
    near = lambda w, k: F.coalesce(F.get("_ordered", k)["w"] == w, F.lit(False))
    twice = F.filter("_ordered", lambda x, k: near(x["w"], k - 1) | near(x["w"], k + 1))
    seen = seen.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    step = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda n, x: n + x)
    numbers = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # Unfolding one struct keeps later filters above: pushed down, a filter would be written out
    # in terms of the text, and evaluate the arrays once for every element.
    return seen.select(*kept, F.inline_outer(F.array(numbers)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def share(n: str, of: str) -> Column:
    return F.col(n).cast("double") / F.greatest(F.col(of), F.lit(1)).cast("double")


def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_lines_share": share("n_dup_lines", "n_words"),
        "repeated": share("n_repeat_words", "n_words"),
    }


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


def covered(rule: list[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for c in rule:
        mask &= c.holds(values)
    return mask


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain in information, of all thresholds halfway between
    neighbouring values of a feature, and its gain."""
    most, best = 1e-9, None
    n, p = len(bad), int(bad.sum())
    before = np.log2(p / n) if p else 0.0
    for name, column in values.items():
        order = np.argsort(column, kind="stable")
        ordered = column[order]
        ends = np.flatnonzero(ordered[1:] != ordered[:-1])
        below = np.cumsum(bad[order])[ends]
        for above, hit, size in ((False, below, ends + 1), (True, p - below, n - ends - 1)):
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1) / size) - before), -np.inf)
            if len(gain) and gain.max() > most:
                at = int(gain.argmax())
                most, best = float(gain[at]), Condition(name, above, float((ordered[ends[at]] + ordered[ends[at] + 1]) / 2))
    return most, best


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition with the largest gain until the rule covers no good row."""
    rule: list[Condition] = []
    mask = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (mask & ~bad).any():
        _, best = best_condition({k: v[mask] for k, v in values.items()}, bad[mask])
        if best is None:
            break
        rule.append(best)
        mask &= best.holds(values)
    return rule


def prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The prefix of the rule that is worth most on rows it was not grown on."""

    def worth(k: int) -> float:
        hit = covered(rule[:k], values, len(bad))
        return float((hit & bad).sum() - (hit & ~bad).sum()) / max(1, int(hit.sum()))

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules that reject. Every third row is held back for pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    held = np.arange(len(bad)) % 3 == 2
    while len(rules) < MOST_RULES:
        part = lambda mask: ({k: v[mask] for k, v in values.items()}, bad[mask])
        growing, pruning = part(left & ~held), part(left & held)
        if not growing[1].any():
            break
        rule = prune(grow(*growing), *pruning)
        hit = covered(rule, values, len(bad)) & left
        right = int((hit & bad).sum())
        if not rule or right < LEAST_SUPPORT or right < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """The decision list for labelled documents that pass the base rule."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"), F.count("*").alias("_n"), F.count("quality").alias("_known"))
    agreed = agreed.filter("doc_id is not null and quality = _most and _n = _known and quality in (0, 1)").select("doc_id", "quality")
    few = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # the bound of the broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    numbers = statistics(labelled).filter(~base_failed()).select("doc_id", "quality", *[c.alias(n) for n, c in features().items()])
    rows = sorted(numbers.distinct().collect())
    if not rows:
        return []
    rows = [rows[k] for k in np.random.default_rng(7).permutation(len(rows))]
    values = {n: np.array([r[n] for r in rows]) for n in features()}
    return learn(values, np.array([r["quality"] == 0 for r in rows]))


def accepted(rules: list[list[Condition]]) -> Column:
    """The list as one expression: the first rule that holds rejects, else the text is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The named columns of `docs` but the text, its statistics, base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & accepted(rules))
