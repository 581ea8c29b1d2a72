import random

from pyspark.sql import functions as F

from risklib.operators import evaluate as EV


def _brute_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(pairs):
    P = sum(y for _, y in pairs)
    ap = 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        tp = sum(1 for p, y in pairs if p >= t and y == 1)
        fp = sum(1 for p, y in pairs if p >= t and y == 0)
        pos_here = sum(1 for p, y in pairs if p == t and y == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def test_tied_scores_auc_ap(spark):
    pairs = [(0.2, 0), (0.2, 1), (0.5, 0), (0.5, 1), (0.5, 1), (0.9, 1), (0.1, 0)]
    df = spark.createDataFrame(pairs, "fraud_probability double, true_label int")
    r = EV.ranking_metrics(df).first()
    assert abs(r.roc_auc - _brute_auc(pairs)) < 1e-12
    assert abs(r.average_precision - _brute_ap(pairs)) < 1e-12


def test_random_auc_matches_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "fraud_probability double, true_label int")
    r = EV.ranking_metrics(df).first()
    assert abs(r.roc_auc - _brute_auc(pairs)) < 1e-9
    assert abs(r.average_precision - _brute_ap(pairs)) < 1e-9


def test_one_class_segment(spark):
    df = spark.createDataFrame([(0.3, 0, "a"), (0.7, 0, "a"), (0.6, 1, "b"), (0.2, 0, "b")],
                               "fraud_probability double, true_label int, seg string")
    r = {x.seg: x for x in EV.segment_metrics(df, "seg").collect()}
    assert r["a"].roc_auc is None and r["a"].precision == 0.0 and r["a"].recall == 0.0
    assert r["b"].roc_auc == 1.0


def test_sweep_equals_direct_filters(spark):
    rnd = random.Random(5)
    pairs = [(round(rnd.random(), 6), rnd.randint(0, 1)) for _ in range(300)] + [(0.07, 1), (0.5, 0), (1.0, 1), (0.0, 0)]
    df = spark.createDataFrame(pairs, "fraud_probability double, true_label int")
    sw = {round(r.threshold, 2): r for r in EV.threshold_sweep(df).collect()}
    assert len(sw) == 99
    for k in (1, 7, 50, 99):
        t = k / 100
        tp = sum(1 for p, y in pairs if p >= t and y == 1)
        fp = sum(1 for p, y in pairs if p >= t and y == 0)
        assert sw[t].tp == tp and sw[t].fp == fp


def test_calibration_right_closed(spark):
    df = spark.createDataFrame([(0.1, 0), (0.3, 1), (0.30001, 1), (0.0, 0), (1.0, 1)], "fraud_probability double, true_label int")
    bins = {r["bin"]: r["count"] for r in EV.calibration(df, 10).collect()}
    assert bins[0] == 2 and bins[2] == 1 and bins[3] == 1 and bins[9] == 1
