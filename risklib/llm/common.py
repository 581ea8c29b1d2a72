"""Shared helpers: table access, row keys, hash draws, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklib.session import scratch_path

#: The white space of the contracts, as a class body for Java regular expressions and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Arrow batches by size as well as by rows: long texts must not fill a worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_text(c: Column) -> Column:
    """A document key as text; a null key has a text of its own."""
    return F.coalesce(c.cast("string"), F.lit("<null>"))


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by '|' (52 bits; any SQL engine can repeat it)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(2 ** 52))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+"), lambda w: w != "")
