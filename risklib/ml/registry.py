"""Model registry as an append-only parquet table (REG1-REG5) next to Spark ML model folders."""

from __future__ import annotations

import datetime as _dt
import hashlib
import os

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("model_class", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("deleted", T.BooleanType()),
    T.StructField("event_ts", T.TimestampType()),
])


class ModelRegistry:
    """Rows are appended (register, delete tombstone); the current view keeps the latest row per id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.table = os.path.join(root, "registry")

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(self.table)

    def register_model(self, model, model_name: str, model_type: str, metrics: dict | None = None,
                       features: list | None = None, params: dict | None = None, description: str = "") -> str:
        now = _dt.datetime.now(_dt.timezone.utc)
        stamp = now.strftime("%Y%m%d_%H%M%S_%f")
        mid = f"{model_type}_{stamp}_{hashlib.md5((model_name + stamp).encode()).hexdigest()[:8]}"
        path = os.path.join(self.root, "models", mid)
        model.write().overwrite().save(path)
        cls = f"{type(model).__module__}.{type(model).__name__}"
        self._append((mid, model_name, model_type, now.isoformat(), description, path, cls,
                      {k: float(v) for k, v in (metrics or {}).items()},
                      {k: str(v) for k, v in (params or {}).items()}, list(features or []), False, now))
        return mid

    def current(self) -> DataFrame:
        t = self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.table)
        w = Window.partitionBy("id").orderBy(F.desc("event_ts"))
        latest = t.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        return latest.where(~F.col("deleted"))

    def load_model(self, model_id: str):
        row = self.current().where(F.col("id") == model_id).select("file_path", "model_class").first()
        if row is None:
            raise ValueError(f"Model {model_id} not found in the registry")
        mod, cls = row["model_class"].rsplit(".", 1)
        klass = getattr(__import__(mod, fromlist=[cls]), cls)
        if not issubclass(klass, MLReadable):
            klass = PipelineModel
        return klass.load(row["file_path"])

    def get_best_model(self, metric: str = "roc_auc", model_type: str | None = None) -> DataFrame:
        """REG3: id with the highest metric (missing metric counts as 0), optionally of one type."""
        c = self.current()
        if model_type:
            c = c.where(F.col("type") == model_type)
        return c.agg(F.max_by("id", F.struct(F.coalesce(F.col("metrics")[metric], F.lit(0.0)), F.col("timestamp"))).alias("id"),
                     F.max(F.coalesce(F.col("metrics")[metric], F.lit(0.0))).alias(metric))

    def list_models(self, model_type: str | None = None) -> DataFrame:
        """REG4: one row per model with ``metric_<name>`` columns (metric names known from the table)."""
        c = self.current()
        if model_type:
            c = c.where(F.col("type") == model_type)
        names = sorted(r[0] for r in c.select(F.explode(F.map_keys("metrics"))).distinct().collect())
        return c.select("id", "name", "type", "timestamp", "description",
                        *[F.col("metrics")[n].alias(f"metric_{n}") for n in names])

    def delete_model(self, model_id: str) -> bool:
        row = self.current().where(F.col("id") == model_id).first()
        if row is None:
            return False
        d = row.asDict()
        d["deleted"], d["event_ts"] = True, _dt.datetime.now(_dt.timezone.utc)
        self._append(tuple(d[f.name] for f in REGISTRY_SCHEMA.fields))
        return True
