"""Operator 5: mixing sources to target weights by iterative proportional fitting.

Documents are counted into (source, language, topic) cells of token weight. A
sweep scales the cells so that the source, then the language, then the topic
sums meet their targets; sweeps repeat until the marginals are met to
``TOLERANCE``. The cell table has one row per combination of categories however
many documents there are; its codes and weights are fitted on the driver.

The fitted over the observed weight of a cell is its ratio, and the sampling
probability of every document of the cell is min(1, ratio x rate). The rate is
such that the cells held at 1 have at most ``WHOLE`` of all tokens, so that a
few rare documents do not decide how much of the rest is kept. Where cells are
held at 1, the others are raked again for the same sample size: a category
whose target exceeds what it holds is kept whole and the targets of the others
of its margin grow in proportion. ``residual`` gives the largest difference
between expected and wanted share of any category that is left. A
document is kept when the draw from its key falls below its probability, so
runs agree.

Cases: null categories are a category of their own; a null or empty text has
weight 0 and topic ``empty`` and, like every weightless cell, probability 0;
repeated rows draw alike; targets named for absent categories are ignored and
the others scaled to 1; a category without a target gets probability 0; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import WS_CLASS, key_text, let, stored, unit_draw

MARGINS = ("source", "lang", "topic")
SWEEPS, TEMPER, RATE = 12, 0.85, 1.0
#: Largest difference of shares at which the marginals count as met; looks at it, each after SWEEPS sweeps.
TOLERANCE, LOOKS = 1e-9, 200
#: Largest share of all tokens in the cells that are kept whole.
WHOLE = 0.01


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS_CLASS}]+")).cast("long")


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.translate(text, ch, ""))


def topic_of(text: Column, words: Column) -> Column:
    """The kind of content: empty, table, shout, marked, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(words == 0, "empty").when(_count_char(t, "|") * 4 >= words, "table")
            .when(_count_char(t, "!") * 2 >= words, "shout").when(_count_char(t, "#*$%&<>") >= words, "marked")
            .when(words < 150, "note").when(words < 700, "article").otherwise("longform"))


def cells_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every row, nulls named."""
    words = docs.select("doc_id", F.coalesce("source", F.lit("<null>")).alias("source"),
                        F.coalesce("lang", F.lit("<null>")).alias("lang"), "text", n_words(F.col("text")).alias("n_tokens"))
    return words.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def tempered(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """Target shares of a margin: its observed token shares to the power ``temper``, scaled to 1."""
    w = cells.groupBy(margin).agg(F.sum("n").cast("double").alias("w")).filter(F.col("w") > 0)
    return w.select(margin, F.pow("w", F.lit(temper)).alias("target"))


class Cells:
    """The cells that have weight and targets, as codes per margin, with the target shares among the categories present."""

    def __init__(self, cells: DataFrame, targets: dict[str, DataFrame]):
        self.margins = list(targets)
        rows = cells.filter(F.col("n") > 0)
        for m, t in targets.items():
            t = t.select(F.col(m), F.col("target").cast("double").alias(f"__t_{m}"))
            rows = rows.join(t.filter(F.col(f"__t_{m}") > 0), m)
        self.table = rows.select(*targets, "n", *[f"__t_{m}" for m in targets]).orderBy(*targets).toArrow()
        self.n = self.table["n"].to_numpy().astype(np.float64)
        self.codes, self.shares = [], []
        for m in targets:
            codes = self.table[m].combine_chunks().dictionary_encode()
            share = np.zeros(len(codes.dictionary))
            share[codes.indices.to_numpy()] = self.table[f"__t_{m}"].to_numpy()
            self.codes.append(codes.indices.to_numpy())
            self.shares.append(share / share.sum() if len(share) else share)

    def sums(self, weight: np.ndarray):
        return [np.bincount(c, weight, len(s)) for c, s in zip(self.codes, self.shares)]

    def residual(self, weight: np.ndarray) -> float:
        """The largest difference between a category's share of ``weight`` and its target."""
        total = weight.sum()
        return max((float(np.abs(w / total - s).max()) for w, s in zip(self.sums(weight), self.shares)), default=0.0) if total else 0.0

    def fitted(self, sweeps: int) -> np.ndarray:
        fit = self.n.copy()
        for _ in range(LOOKS if len(fit) else 0):
            for _ in range(sweeps):
                for c, s in zip(self.codes, self.shares):
                    fit *= (s * self.n.sum() / np.bincount(c, fit, len(s)))[c]
            if self.residual(fit) <= TOLERANCE:
                break
        return fit

    def probabilities(self, fit: np.ndarray, rate: float, sweeps: int) -> np.ndarray:
        """min(1, ratio x rate), the cells below 1 raked again for what those at 1 leave of the targets."""
        if not len(fit):
            return fit
        ratio = fit / self.n
        down = np.argsort(-ratio, kind="stable")
        top = ratio[down[np.searchsorted(np.cumsum(self.n[down]), WHOLE * self.n.sum(), "right")]]
        p = ratio / top * rate
        if p.max() <= 1:
            return p
        size = min(1.0, rate / top) * self.n.sum()
        targets = [_within(s * size, held) for s, held in zip(self.shares, self.sums(self.n))]
        p = np.minimum(p, 1)
        for _ in range(LOOKS):
            before = p
            for _ in range(sweeps):
                for c, t in zip(self.codes, targets):
                    whole = p >= 1
                    left = t - np.bincount(c, self.n * whole, len(t))
                    free = np.bincount(c, self.n * p * ~whole, len(t))
                    scale = np.where((free > 0) & (left > 0), left / np.where(free > 0, free, 1), 1)
                    p = np.minimum(np.where(whole, 1, p * scale[c]), 1)
            if np.abs(p - before).max() <= TOLERANCE:
                break
        return p

    def frame(self, spark, **columns: np.ndarray) -> DataFrame:
        out = self.table.select([*self.margins, "n"])
        for name, values in columns.items():
            out = out.append_column(name, pa.array(values, pa.float64()))
        return spark.createDataFrame(out)


def _within(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``wanted`` bounded by ``held``, what is cut off dealt to the others in proportion."""
    total, full = wanted.sum(), np.zeros(len(wanted), bool)
    while True:
        free = wanted[~full].sum()
        out = np.where(full, held, wanted * ((total - held[full].sum()) / free if free else 1))
        more = ~full & (out > held)
        if not more.any():
            return out
        full |= more


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (the margins, n) with ``fitted`` weights whose sums meet the target shares of the total."""
    c = Cells(cells, targets)
    return c.frame(cells.sparkSession, fitted=c.fitted(sweeps))


def sampling(docs: DataFrame, rate: float = RATE, sweeps: int = SWEEPS,
             targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of ``docs`` and the cells with their probability ``p`` and the ``residual`` of all.

    ``rate`` is the share of the largest calibrated sample to draw (1: the cells
    that must grow most, up to ``WHOLE`` of the tokens, and the next are kept whole).
    """
    rows = stored(cells_of(docs), "cell-rows")  # narrow; the texts are read once
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "cells")
    targets = targets or {m: tempered(cells, m) for m in MARGINS}
    c = Cells(cells, targets)
    fit = c.fitted(sweeps)
    p = c.probabilities(fit, rate, sweeps)
    found = c.frame(docs.sparkSession, fitted=fit, p=p, residual=np.full(len(p), c.residual(c.n * p)))
    return rows, stored(found.select(*targets, "fitted", "p", "residual"), "cell-probabilities")


def mix_documents(docs: DataFrame, rate: float = RATE, sweeps: int = SWEEPS,
                  targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p, kept for every row of ``docs``."""
    rows, cells = sampling(docs, rate, sweeps, targets)
    p = F.coalesce(F.col("p"), F.lit(0.0))
    return rows.join(cells.drop("fitted", "residual"), list(MARGINS), "left").select(
        "doc_id", *MARGINS, "n_tokens", F.round(p, 6).alias("p"), (sample_draw() < p).alias("kept"))


def sample_draw() -> Column:
    return unit_draw(F.lit("mix"), key_text(F.col("doc_id")))


def keep_sampled(docs: DataFrame, rate: float = RATE, sweeps: int = SWEEPS) -> DataFrame:
    """The sampled rows of ``docs``, all its columns as they were."""
    _, cells = sampling(docs, rate, sweeps)
    own = let(n_words(F.col("text")), lambda n: topic_of(F.col("text"), n))
    c = cells.select(*[F.col(m).alias(f"__c_{m}") for m in MARGINS], F.col("p").alias("__p"))
    hit = ((F.coalesce("source", F.lit("<null>")) == F.col("__c_source"))
           & (F.coalesce("lang", F.lit("<null>")) == F.col("__c_lang")) & (F.col("__topic") == F.col("__c_topic")))
    return docs.withColumn("__topic", own).join(c, hit).filter(sample_draw() < F.col("__p")).select(
        *[F.col(f"`{n}`") for n in docs.columns])
