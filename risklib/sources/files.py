"""CSV / Parquet readers (SRC1, SRC2) with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from risklib.schema import REQUIRED_COLUMNS, TRANSACTIONS


def validate_schema(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Fail at plan time when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def schema_for(columns, base: T.StructType = TRANSACTIONS) -> T.StructType:
    """The declared schema restricted to ``columns`` in file order (CSV columns bind by position)."""
    by_name = {f.name: f for f in base.fields}
    return T.StructType([by_name.get(c, T.StructField(c, T.StringType(), True)) for c in columns])


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTIONS,
                          columns=None) -> DataFrame:
    """SRC1: header CSV with a declared schema (no inference pass over the data).

    ``columns`` gives the file's column order when it holds a subset of the
    canonical columns.
    """
    if columns is not None:
        schema = schema_for(columns, schema)
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return validate_schema(df)


def read_upload_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """SRC2: ad-hoc upload; malformed rows are kept with the raw text in ``_corrupt_record``."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    return (spark.read.schema(s).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return validate_schema(spark.read.parquet(path))
