"""Small hand-made document tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and river stone house light water green walking morning people garden window".split(),
    "de": "der die und nicht schön straße wasser grün morgen menschen garten fenster übung zeit".split(),
    "fr": "le la les et être rivière maison lumière eau vert matin jardin fenêtre très".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "e"]) for _ in range(n)]
    out, line = [], []
    for i, w in enumerate(words):
        line.append(w)
        if i % 11 == 10:
            out.append(" ".join(line) + ".")
            line = []
    return "\n".join([*out, " ".join(line)]) if line else "\n".join(out)


def documents(spark, n: int = 60, seed: int = 5, extra=()):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        t = prose(rng, lang, rng.randint(60, 140))
        rows.append((i, t, lang, f"src{i % 4}", len(t)))
    rows += list(extra)
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, one very long text."""
    rng = random.Random(9)
    t = prose(rng, "en", 90)
    long = prose(rng, "de", 30_000)
    rows = [
        (None, t, "en", "src0", 1), (1, None, "en", "src0", 1), (2, "", "en", "src0", 1), (3, " \n\t\r ", None, None, None),
        (4, t, "en", "src0", 1), (4, t, "en", "src0", 1), (5, t, "en", None, 1), (6, long, "de", "src1", 1),
        (7, "12 34 !!", "fr", "src1", 1), (8, "one", "en", "src1", 1), (9, "a\x00b \U0001F600 é ß", None, "src2", 1),
        (10, "x" * 70_000, "en", "src2", 1), (None, None, None, None, None),
        (11, prose(rng, "fr", 100), "fr", "src2", 1), (12, prose(rng, "de", 100), "de", "src2", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ("shard", "size", "n_words", "n", "key", "d", "th", "id", "a", "b", "u", "v", "p", "c", "pos", "block", "rep", "bands",
           "topic", "kept", "runs", "w", "n_tokens", "item_id", "score", "label", "class_id", "lines", "joined", "h")


def with_clashes(docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
