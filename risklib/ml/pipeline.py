"""Preparation jobs (PRP1, PRP2, CLN7): fit every statistic on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.functions.fitted import most_frequent
from risklib.operators import prep as PR
from risklib.operators.keyed import written
from risklib.operators.neighbours import adasyn, smote
from risklib.operators.quantiles import fit_quantiles
from risklib.schema import LABEL


@dataclass(frozen=True)
class Preprocessing:
    """CLN7, fitted: fill values, population mean and sd of the numeric columns, levels of the categorical ones."""

    numerical: Sequence[str]
    categorical: Sequence[str]
    out: str
    medians: dict
    frequent: dict
    moments: dict
    levels: dict

    @property
    def names(self) -> list[str]:
        """Names of the places of the feature vector."""
        return [*self.numerical, *[f"{c}_{v}" for c in self.categorical for v in self.levels[c]]]

    def transform(self, df: DataFrame) -> DataFrame:
        cells = []
        for c in self.numerical:
            mean, sd = self.moments[c]
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]).cast("double"))
            cells.append(F.coalesce((x - F.lit(mean).cast("double")) / F.lit(sd or 1.0), F.lit(0.0)))
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.frequent[c]).cast("string"))
            cells += [F.when(v == level, 1.0).otherwise(0.0) for level in self.levels[c]]
        return df.withColumn(self.out, array_to_vector(F.array(*cells)))


@dataclass(frozen=True)
class PreprocessingPipeline:
    categorical: Sequence[str]
    numerical: Sequence[str]
    out: str
    max_levels: int

    def fit(self, df: DataFrame) -> Preprocessing:
        num, cat = list(self.numerical), list(self.categorical)
        medians = _medians(df, num)
        frequent = most_frequent(df, cat)
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")).alias(c) for c in num])
        st = filled.agg(F.count(F.lit(1)), *[F.avg(c).alias(f"m_{c}") for c in num],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in num]).first() if num else {}
        levels = {}
        for c in cat:
            found = df.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(self.max_levels + 1)
            levels[c] = sorted(r["v"] for r in found.collect())
            if len(levels[c]) > self.max_levels:
                raise ValueError(f"{c} has more than {self.max_levels} levels; use label or target encoding")
        return Preprocessing(num, cat, self.out, medians, frequent, {c: (st[f"m_{c}"], st[f"s_{c}"]) for c in num}, levels)


def create_preprocessing_pipeline(categorical: Sequence[str], numerical: Sequence[str], out: str = "features",
                                  max_levels: int = 1000) -> PreprocessingPipeline:
    """CLN7: median fill and population z-score of the numeric columns, most frequent fill and one-hot of the others.

    The one-hot places follow the sorted levels and are not scaled; an unseen level has none of them set.
    A column with more than ``max_levels`` levels raises.
    """
    return PreprocessingPipeline(tuple(categorical), tuple(numerical), out, max_levels)


def _medians(df: DataFrame, cols: Sequence[str]) -> dict:
    return {c: q[0] if q else None for c, q in fit_quantiles(df, cols, [0.5]).items()}


def _fill_values(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """Fitted fill values: exact medians and most frequent values, from grouped counts."""
    medians, top = _medians(train, numeric), most_frequent(train, categorical)
    return {f"n{i}": medians[c] for i, c in enumerate(numeric)} | {f"s{i}": top[c] for i, c in enumerate(categorical)}


def prepare_data(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                 label: str = LABEL, test_size: float = 0.2, seed: int = 42, encoding: str = "label",
                 scale: bool = True, balance: str | None = None) -> tuple[DataFrame, DataFrame]:
    """PRP1: stratified split -> impute / encode / scale fitted on train -> ``features``, ``label``.

    ``balance`` ('random', 'undersample', 'weights', 'smote', 'adasyn') applies to the training rows only.
    """
    numeric, categorical = list(numeric), list(categorical)
    # read by every fit below
    d = written(PR.stratified_split(df, key, label, test_size, seed).select(*dict.fromkeys([key, label, "is_test", *numeric, *categorical])), "split")
    train = d.where("is_test = 0")
    one = _fill_values(train, numeric, categorical)
    sel = [F.col(key), F.col(label).cast("double").alias("label"), "is_test"]
    for i, c in enumerate(numeric):
        sel.append(F.coalesce(F.col(c).cast("double"), F.lit(one[f"n{i}"]).cast("double")).alias(c))
    for i, c in enumerate(categorical):
        sel.append(F.coalesce(F.col(c).cast("string"), F.lit(one[f"s{i}"]).cast("string")).alias(c))
    d = d.select(*sel)
    train = d.where("is_test = 0")
    cat_out = []
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}__idx" for c in categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        if encoding == "onehot":
            stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=False, handleInvalid="keep"))
            cat_out = [f"{c}__ohe" for c in categorical]
        else:
            cat_out = [f"{c}__idx" for c in categorical]
    if scale and numeric:
        st = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        for i, c in enumerate(numeric):
            sd = st[f"s{i}"] if st[f"s{i}"] else 1.0
            d = d.withColumn(c, (F.col(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(sd))
    stages.append(VectorAssembler(inputCols=numeric + cat_out, outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(d.where("is_test = 0"))
    out = model.transform(d).select(key, "label", "is_test", "features")
    train, test = out.where("is_test = 0").drop("is_test"), out.where("is_test = 1").drop("is_test")
    if balance == "random":
        train = PR.random_oversample(train, key, "label").drop("copy")
    elif balance == "undersample":
        train = PR.random_undersample(train, key, "label")
    elif balance == "weights":
        train = PR.class_weights(train, "label")
    elif balance in ("smote", "adasyn"):
        train = between_neighbours(train, key, balance, seed)
    elif balance is not None:
        raise ValueError(f"Unrecognized balancing method: {balance}")
    return train, test


def between_neighbours(train: DataFrame, key: str, method: str, seed: int = 42, label: str = "label") -> DataFrame:
    """BAL1/BAL2 on prepared rows: the coordinates are the places of ``features``."""
    first = train.first()
    if first is None:
        return train
    names = [f"_x{i}" for i in range(first["features"].size)]
    x = vector_to_array("features")
    wide = train.select(key, label, *[x[i].alias(n) for i, n in enumerate(names)])
    out = (smote if method == "smote" else adasyn)(wide, names, key, label, seed=seed)
    return out.select(key, label, array_to_vector(F.array(*names)).alias("features"))
