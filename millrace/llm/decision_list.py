"""Quality rules: a decision list learned by sequential covering.

Statistics of every document are Spark expressions. Rules are learned on the
driver from the statistics of at most SAMPLE labelled documents: a conjunction
of thresholds grows by information gain on two thirds of them, is pruned on the
rest, and is added if it is precise enough; what it covers is set aside, and the
next rule grows. The list becomes one CASE expression, in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, SPACE, computed

#: Labelled documents that rules are learned from, at most: those of least hash.
SAMPLE = 20_000
#: Words in a repeated window.
WINDOW = 5
#: Rejecting needs this share of covered labelled documents to be bad, and so many of them.
PRECISION, SUPPORT = 0.97, 3
CONDITIONS, RULES = 4, 16

FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats")


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _covered(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more, from the hashes of all windows in order."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    same = lambda e, k: F.coalesce(F.get(F.col("_pairs"), k)["g"] == e["g"], F.lit(False))
    found = F.sort_array(F.transform(F.filter(F.col("_pairs"), lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    return pairs, found


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long; columns of those names are replaced.

    A null text has no words, as an empty one. Windows are compared by 64-bit
    hashes of their words.
    """
    words, grams = F.col("_words"), F.col("_grams")
    pairs, found = _covered(grams)
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    covered = F.aggregate(
        F.transform(F.col("_found"), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_found"), k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, x: total + x
    )
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: _trimmed(line) != "")
    steps = (
        docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        .withColumn("_trimmed", _trimmed(F.col("_text")))
        .withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE)))
        .withColumn("_lines", lines)
        .withColumn(
            "_grams",
            F.when(
                F.size(words) > WINDOW,
                F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW)))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("_pairs", F.when(repeated, pairs))
        .withColumn("_found", F.when(F.col("_pairs").isNotNull(), found))
    )
    return computed(
        steps,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.array_join(words, "")).cast("long"),
        n_symbols=F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=F.when(F.col("_found").isNull(), 0).otherwise(covered).cast("long"),
    ).drop("_text", "_trimmed", "_words", "_lines", "_grams", "_pairs", "_found")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules test, by name: n_words, and the other statistics for each word."""
    per_word = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double"))
    return {"n_words": F.col("n_words").cast("double"), "word_length": per_word("word_chars"), "symbols": per_word("n_symbols"), "dup_lines": per_word("n_dup_lines"), "repeats": per_word("n_repeat_words")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _best(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition of most information gain for the bad ones."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    if not p0 or not n0:
        return None
    base, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for k, feature in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        values, marks = x[order, k], bad[order]
        border = np.nonzero(values[1:] > values[:-1])[0]
        below = np.cumsum(marks)[border]
        sizes = border + 1
        for above, p, n in ((False, below, sizes - below), (True, p0 - below, n0 - (sizes - below))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
            if len(gain) and gain.max() > best:
                at = int(gain.argmax())
                best, found = float(gain[at]), Condition(feature, above, float((values[border[at]] + values[border[at] + 1]) / 2))
    return found


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Rules for the bad rows of x, one column for each of FEATURES; fold (0, 1, 2) 0 is for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < RULES:
        grow, prune = left & (fold != 0), left & (fold == 0)
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < CONDITIONS and (condition := _best(x[inside], bad[inside])):
            rule += (condition,)
            inside &= condition.holds(x)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = prune) -> float:
            hit = covers(r, x) & rows
            return (2 * (hit & bad).sum() - hit.sum()) / max(1, hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = covers(rule, x) & left
        if (hit & bad).sum() < SUPPORT or (hit & bad).sum() < PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learns from labels (doc_id, quality): 0 is bad, 1 is good, anything else is ignored.

    At most SAMPLE labelled ids are used, those of least hash; of several rows
    with one id the least label and statistics. No labels, or none that are
    bad, give no rules. What the base rules reject is not learned from.
    """
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    marked = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "_quality", "text")
    kept = statistics(marked).filter(~base_failed())
    rows = kept.groupBy("doc_id").agg(F.min(F.struct(*(v.alias(k) for k, v in features().items()), "_quality", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"))).alias("r")).select("r.*").collect()
    if not rows:
        return []
    rows.sort()
    x = np.array([r[: len(FEATURES)] for r in rows], float)
    return learn(x, np.array([r[-2] == 0 for r in rows]), np.array([r[-1] for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """True for documents to keep: the first rule that holds rejects, else they stay."""
    kept = F.when(base_failed(), False)
    for rule in rules:
        kept = kept.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), False)
    return kept.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the statistics, base_failed and kept; one row for each row.

    A null or empty text fails the base rules. Repeated rows are judged alike.
    Columns that have the names of those added are replaced. Empty tables give
    an empty table.
    """
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(fit(docs, labels)))
