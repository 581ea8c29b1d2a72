"""risklib: transaction-risk analytics as Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame. Heavy work runs
as Spark joins, aggregations, windows and ML estimators; nothing is
collected to the driver except one-row metrics and fitted models.
"""

from risklib.session import checkpoint_root, get_spark

__all__ = ["get_spark", "checkpoint_root"]
