"""Entry points under the names a user of the original pandas application calls.

Each name maps onto the DataFrame operator that implements it; where the
original took (X, y) arrays, the Spark version takes one DataFrame with
named columns. Nothing here adds computation of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.schema import numeric_columns as _numeric_columns
from risklib.schema import string_columns as _string_columns
from risklib.ml.models import (create_model, permutation_importance, soft_vote, hard_vote, stacking,  # noqa: F401
                               train_model, tune_all_models, tune_hyperparameters)
from risklib.ml.pipeline import create_preprocessing_pipeline, prepare_data  # noqa: F401
from risklib.ml.registry import ModelRegistry  # noqa: F401
from risklib.ml.selection import model_importance as select_features_model_based  # noqa: F401
from risklib.ml.selection import pca_reduce as apply_pca  # noqa: F401
from risklib.ml.selection import rfe_cv as select_features_rfe  # noqa: F401
from risklib.operators import advanced as _A
from risklib.operators import clean as _C
from risklib.operators import evaluate as _E
from risklib.operators import features as _F
from risklib.operators import neighbours as _N
from risklib.operators import prep as _P
from risklib.operators import select as _S
from risklib.operators.keyed import attach_stats
from risklib.sources import generate_transactions as generate_synthetic_data  # noqa: F401
from risklib.sources import read_transactions_csv as load_data  # noqa: F401

# basic features
create_amount_features = _F.amount_features
create_temporal_features = _F.temporal_features
create_location_features = _F.location_features
create_customer_behavior_features = _F.customer_behavior_features
create_merchant_features = _F.merchant_features
create_payment_method_features = _F.payment_method_features
create_velocity_features = _F.velocity_features
create_fraud_pattern_features = _F.fraud_pattern_features
create_all_features = _F.create_all_features

# advanced features
create_transaction_velocity_features = _A.transaction_velocity_features
create_behavioral_pattern_features = _A.behavioral_pattern_features
create_temporal_pattern_features = _A.temporal_pattern_features
create_fraud_detection_score = _A.fraud_detection_score
create_all_advanced_features = _A.create_all_advanced_features

# cleaning / preparation
clean_data = _C.clean_data
scale_numeric_features = _P.standard_scale

# evaluation
compare_models = _E.compare_models
evaluate_model_on_custom_segments = _E.segment_metrics
generate_classification_report = _E.class_report
plot_roc_curve = _E.roc_points
plot_precision_recall_curve = _E.pr_points
plot_calibration_curve = _E.calibration
plot_threshold_metrics = _E.threshold_sweep


def encode_categorical_features(df: DataFrame, encoding_method: str = "label", cols=None) -> DataFrame:
    if encoding_method == "label":
        return _P.label_encode(df, cols)
    if encoding_method == "onehot":
        for c in cols or _string_columns(df):
            df = _P.one_hot(df, c, max_levels=_P.MAX_ONE_HOT_LEVELS)
        return df
    if encoding_method == "target":
        raise ValueError("use target_encode_oof(df, col, fold_col) with a fold column from kfold()")
    raise ValueError(f"Unrecognized encoding method: {encoding_method}")


def handle_class_imbalance(df: DataFrame, key: str, label: str = "fraud_indicator", method: str = "random", cols=None,
                           seed: int = 42) -> DataFrame:
    """Balanced rows; ``smote`` and ``adasyn`` take the numeric columns (or ``cols``) as coordinates."""
    if method == "none":
        return df
    if method == "random":
        return _P.random_oversample(df, key, label, seed)
    if method == "undersample":
        return _P.random_undersample(df, key, label, seed)
    if method == "weights":
        return _P.class_weights(df, label)
    if method in ("smote", "adasyn"):
        cols = list(cols or [c for c in _numeric_columns(df) if c not in (key, label)])
        return (_N.smote if method == "smote" else _N.adasyn)(df, cols, key, label, seed=seed)
    raise ValueError(f"Unrecognized balancing method: {method}")


def calculate_metrics(scored: DataFrame, threshold: float = 0.5, group_cols=()) -> DataFrame:
    """Confusion counts, threshold metrics and costs, joined with AUC / AP / Brier per group."""
    g = list(group_cols) or None
    m = _E.classification_metrics(scored, threshold, group_cols)
    r = _E.ranking_metrics(scored, group_cols)
    if g:
        return attach_stats(m, r, g, null_safe=True)
    one = r.first()  # a single row of three metrics
    return m.withColumns({k: F.lit(one[k]).cast("double") for k in ("roc_auc", "average_precision", "brier_score")})


def remove_highly_correlated_features(df: DataFrame, cols, threshold: float = 0.95, target_col: str | None = None) -> DataFrame:
    keep = [r[0] for r in _S.correlated_to_drop(df, cols, threshold, target_col).where("dropped = 0").collect()]
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def select_features_univariate(df: DataFrame, cols, label: str = "fraud_indicator", method: str = "f_classif", k: int = 20,
                               key: str | None = None):
    """``mutual_info`` estimates from nearest neighbours where rows have a ``key``, and from deciles otherwise."""
    if method == "f_classif":
        return _S.anova_f(df, cols, label, k)
    if method == "chi2":
        return _S.chi2(df, cols, label, k)
    if method == "mutual_info":
        return _S.neighbour_mutual_information(df, cols, key, label, k=k) if key else _S.mutual_information(df, cols, label, k=k)
    raise ValueError(f"Unrecognized method: {method}")
