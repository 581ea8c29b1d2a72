"""Operator 10: line dedup by a sorted hash index and per-document keep bitmaps.

1. Every line whose key has at least ``min_chars`` code points becomes one
   narrow index row (128-bit key hash, document, position). The index is range
   partitioned on (hash, document, position), sorted the same way and written
   once to the shared folder. The document is part of the range key, so a line
   that a third of all documents hold spreads over many partitions.
2. The stream of first occurrences is one row per (hash, document), counted map
   side and merged: the keys found in at least ``min_docs`` documents, and the
   largest document of each.
3. Index rows of such keys in any other document are dropped lines. They come
   back as a sparse bitmap per document: for every 64 lines with a dropped one,
   a word whose set bits are the kept lines. Documents that keep all have none.

Cases: null and empty texts are one empty line; null doc_ids count as one
document that never keeps a shared line; rows repeated with the same doc_id and text share one
bitmap and count as one document; ties go to the largest doc_id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import LOWER, UPPER, WS_CHARS, let, stored

MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def line_index(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    lines = docs.select(*_row_key(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).filter(
        F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(40), "key").alias("k2"), "doc_id", "pos", "th")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th (hash of the text), n_dropped, keep_words of the documents that lose a line."""
    order = ["k1", "k2", "doc_id", "pos"]
    lines = stored(line_index(docs, min_chars), "lines")  # the range bounds are sampled from this, not from the texts
    index = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order), "line-index")
    first = index.select("k1", "k2", "doc_id").distinct()
    shared = stored(first.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc")).filter(F.col("n_docs") >= min_docs), "shared-lines")
    dropped = index.join(shared, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = dropped.groupBy("doc_id", "th", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("keep_words"))


def kept_text(text: Column, keep_words: Column) -> Column:
    """The kept lines joined by newlines."""
    dropped = F.flatten(F.transform(keep_words, lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(
            F.call_function("getbit", w["keep"], b) == 0, w["word"] * 64 + b)), lambda p: p.isNotNull())))
    joined = let(_lines(text), lambda lines: F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.get(lines, i))))
    return F.when(keep_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_words, kept_text for every row of ``docs``."""
    d = docs.select(*_row_key(), F.coalesce("text", F.lit("")).alias("text"))
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("th").alias("b_th"), "n_dropped", "keep_words")
    j = d.join(b, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("th") == F.col("b_th")), "left")
    return j.select("doc_id", (F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1).cast("long")
                    .alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep_words",
                    kept_text(F.col("text"), F.col("keep_words")).alias("kept_text"))
