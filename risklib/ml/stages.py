"""Preparation, balancing and model as stages of one Spark pipeline that saves and loads (PRP2, REG2).

``Preparation`` is an estimator whose model holds the fitted fill values, moments and levels as one
JSON parameter and builds the feature vector from built-in expressions, so it transforms batches and streams
alike. ``BalancedClassifier`` is an estimator around a classifier: it balances the rows it is
fitted on and returns the classifier's own model, so balancing acts in fitting only and the fitted pipeline is
a plain ``PipelineModel`` of the preparation and a Spark model.
"""

from __future__ import annotations

import json
import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.ml.pipeline import Preprocessing, create_preprocessing_pipeline
from risklib.operators import neighbours as N
from risklib.operators import prep as PR
from risklib.operators.keyed import spread
from risklib.schema import LABEL

METHODS = ("none", "random", "undersample", "smote", "adasyn")


class _Columns(Params):
    numerical = Param(Params._dummy(), "numerical", "numeric columns: median fill, population z-score", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "other columns: most frequent fill, one-hot", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column of the features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 column, copied as a double into 'label' where rows have it", TypeConverters.toString)


class Preparation(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """CLN7 as an estimator."""

    maxLevels = Param(Params._dummy(), "maxLevels", "a categorical column with more levels raises", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numerical=(), categorical=(), outputCol="features", labelCol=LABEL, maxLevels=1000):
        super().__init__()
        self._setDefault(numerical=[], categorical=[], outputCol="features", labelCol=LABEL, maxLevels=1000)
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> "PreparationModel":
        g = self.getOrDefault
        fitted = create_preprocessing_pipeline(g("categorical"), g("numerical"), g("outputCol"), g("maxLevels")).fit(dataset)
        state = {"medians": fitted.medians, "frequent": fitted.frequent, "moments": fitted.moments, "levels": fitted.levels}
        model = PreparationModel()._set(fitted=json.dumps(state))
        return self._copyValues(model)


class PreparationModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted preparation; ``fitted`` is its whole state."""

    fitted = Param(Params._dummy(), "fitted", "fill values, moments and levels as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numerical=[], categorical=[], outputCol="features", labelCol=LABEL, fitted="{}")

    @property
    def names(self) -> list[str]:
        return self._state().names

    def _state(self) -> Preprocessing:
        g = self.getOrDefault
        return Preprocessing(tuple(g("numerical")), tuple(g("categorical")), g("outputCol"), **json.loads(g("fitted")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label = self.getOrDefault("labelCol")
        out = self._state().transform(dataset)
        return out.withColumn("label", F.col(label).cast("double")) if label in dataset.columns else out


class BalancedClassifier(Estimator, MLReadable, MLWritable):
    """PRP2: balance the prepared training rows (``features``, ``label``, ``keyCol``), then fit the classifier on them."""

    method = Param(Params._dummy(), "method", f"one of {', '.join(METHODS)}", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key; hashes of it make the draws", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    def __init__(self, classifier=None, method: str = "none", keyCol: str = "transaction_id", seed: int = 42):
        super().__init__()
        if method not in METHODS:
            raise ValueError(f"Unrecognized balancing method: {method}")
        self.classifier = classifier
        self._set(method=method, keyCol=keyCol, seed=seed)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.classifier = self.classifier.copy(extra)
        return that

    def balanced(self, rows: DataFrame) -> DataFrame:
        method, key, seed = (self.getOrDefault(p) for p in ("method", "keyCol", "seed"))
        rows = rows.select(key, "label", "features")
        if method == "random":
            return PR.random_oversample(rows, key, "label", seed)
        if method == "undersample":
            return PR.random_undersample(rows, key, "label", seed)
        if method in ("smote", "adasyn"):
            first = rows.first()
            names = [f"_x{i}" for i in range(first["features"].size)] if first else []
            x = vector_to_array("features")
            wide = rows.select(key, "label", *[x[i].alias(n) for i, n in enumerate(names)])
            out = (N.smote if method == "smote" else N.adasyn)(wide, names, key, "label", seed=seed)
            return out.select(key, "label", array_to_vector(F.array(*names)).alias("features"))
        return rows

    def _fit(self, dataset: DataFrame):
        return self.classifier.fit(spread(self.balanced(dataset.where(F.col("label").isNotNull())), self.getOrDefault("keyCol"), "balanced"))

    def write(self) -> "_BalancedWriter":
        return _BalancedWriter(self)

    @classmethod
    def read(cls) -> "_BalancedReader":
        return _BalancedReader(cls)


class _BalancedWriter(MLWriter):
    def __init__(self, instance: BalancedClassifier):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        c = self.instance.classifier
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={
            "classifier": f"{type(c).__module__}.{type(c).__name__}"})
        c.write().save(os.path.join(path, "classifier"))


class _BalancedReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BalancedClassifier:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        module, name = meta["classifier"].rsplit(".", 1)
        inner = getattr(__import__(module, fromlist=[name]), name).load(os.path.join(path, "classifier"))
        out = self.cls(inner)
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


def training_pipeline(classifier, numerical, categorical=(), balance: str = "none", key: str = "transaction_id", label: str = LABEL) -> Pipeline:
    """Preparation, balancing and model in one estimator; fitted, a ``PipelineModel`` that scores raw rows."""
    return Pipeline(stages=[Preparation(numerical=list(numerical), categorical=list(categorical), labelCol=label),
                            BalancedClassifier(classifier, balance, key)])


def score_rows(model: PipelineModel, df: DataFrame, threshold: float = 0.5, out: str = "fraud_probability") -> DataFrame:
    """SCO8/STR5 in model form: the rows with probability, decision and recommendation; batches and streams."""
    from risklib.operators.scores import decide
    p = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return decide(p.select(*df.columns, out), threshold, out)
