"""Operator 2: quality rules as a learned decision list.

Statistics of every whole text come from built-in functions alone, one row at a
time, without a shuffle. The list is learned from the labelled rows' statistics
by sequential covering: a conjunction of threshold conditions is grown on two
thirds of the rows by information gain, pruned on the other third, and accepted
if it is precise enough there; the rows it covers are set aside and the next
conjunction is grown. Each step is one aggregation over all labelled rows that
returns a count per feature and bin. The list comes out as one ordered
``when ... when ... otherwise`` expression.

Cases: a null or empty text has no words and fails the base rules; ties between
conditions go to the first in (feature, threshold) order; rows without a label
take no part in learning; without labels the list is empty and the base rules
decide; repeated rows count as often as they occur; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import WS_CHARS, WS_CLASS, let, split_words, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 32, 10, 3, 0.8, 10

#: Features of the rules, as expressions over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "marks_per_char": "n_marks / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
}


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice, all occurrences included.

    Windows are sorted by hash, so equal ones are neighbours; the starts of
    those are sorted again and each adds up to 3 words not yet covered.
    """
    def starts(h):
        ws = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(
            F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))))
        return let(ws, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(
            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
            F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, b: a + b)

    n = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= 4, let(starts(h), covered)).otherwise(0))
    return n.cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def dup_lines(t):
        return let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{WS_CLASS}]")),
                   lambda x: F.size(x) - F.size(F.array_distinct(x)))

    words = let(split_words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    return docs.select(
        "doc_id", words.alias("w"), F.char_length(F.translate(text, WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(text).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.char_length(text) - F.char_length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
    ).select("doc_id", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
             F.col("w.r").alias("n_repeat_words"), "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bin: int
    threshold: float

    def on_bins(self) -> Column:
        b = F.col(f"b_{self.feature}")
        return b > self.bin if self.above else b <= self.bin

    def on_stats(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


def _all(conditions, on: str) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & getattr(c, on)()
    return out


def _gain(p, n, p0, n0):
    """Information gained about the positive class, times positives covered."""
    if p <= 0 or p0 <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[list[Condition]]:
    """Ordered conjunctions that mark a document as low quality (label 0)."""
    y = labels.select(F.col("doc_id").alias("l_doc"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull())
    rows = stats.join(y, F.col("doc_id") == F.col("l_doc")).filter(~base_failed()).select(
        "doc_id", "y", *[F.expr(e).cast("double").alias(f"f_{f}") for f, e in FEATURES.items()])
    rows = stored(rows, "labelled-statistics")
    probs = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(f"f_{f}", probs, 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    binned = stored(rows.select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"), *[
        sum((F.when(F.col(f"f_{f}") > F.lit(e), 1).otherwise(0) for e in edges[f]), F.lit(0)).alias(f"b_{f}")
        for f in FEATURES]), "binned-statistics")
    rules: list[list[Condition]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule = _grow(binned.filter(left & F.col("grow")), edges)
        rule = _prune(binned.filter(left & ~F.col("grow")), rule) if rule else rule
        if not rule:
            break
        rules.append(rule)
        left = left & ~_all(rule, "on_bins")
    return rules


def _grow(rows: DataFrame, edges) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        counts = rows.filter(_all(rule, "on_bins")).select("bad", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])).alias("x")).groupBy(
            "x.f", "x.b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("m")).collect()
        by = {f: {} for f in FEATURES}
        for r in counts:  # at most features x bins rows
            by[r["f"]][r["b"]] = (r["p"], r["m"] - r["p"])
        first = by[next(iter(FEATURES))]
        p0, n0 = sum(x[0] for x in first.values()), sum(x[1] for x in first.values())
        best, best_gain = None, 0.0
        for f in FEATURES:
            p = n = 0
            for k, e in enumerate(edges[f]):
                bp, bn = by[f].get(k, (0, 0))
                p, n = p + bp, n + bn  # bins <= k: at or below the edge
                for above, cp, cn in ((True, p0 - p, n0 - n), (False, p, n)):
                    gain = _gain(cp, cn, p0, n0) if cp >= MIN_COVER else 0.0
                    if gain > best_gain + 1e-9:
                        best, best_gain = Condition(f, above, k, e), gain
        if best is None:
            break
        rule.append(best)
        if n0 == 0:
            break
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the conjunction that is best on the held-back rows, or none."""
    aggs = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], "on_bins")
        aggs += [F.sum((hit & F.col("bad")).cast("long")).alias(f"p{k}"), F.sum(hit.cast("long")).alias(f"m{k}")]
    c = rows.agg(*aggs).first()
    best, value = [], 0.0
    for k in range(1, len(rule) + 1):
        p, m = c[f"p{k}"] or 0, c[f"m{k}"] or 0
        if m and p / m >= MIN_PRECISION and (v := (2 * p - m) / m + p / 1e12) > value:
            best, value = rule[:k], v
    return best


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional expression: false for low quality."""
    out = None
    for rule in rules:
        hit = _all(rule, "on_stats")
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs`` (doc_id, text)."""
    stats = stored(statistics(docs), "text-statistics")
    rules = learn(stats, labels)
    return stats.select("*", base_failed().alias("base_failed")).select(
        "*", (~F.col("base_failed") & verdict(rules)).alias("kept"))
