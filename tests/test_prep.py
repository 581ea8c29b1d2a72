from pyspark.sql import functions as F

from risklib.operators import prep as PR
from risklib.operators.keyed import hash_rank
from risklib.sources.tables import tx_events
from tests.conftest import SF001


def test_split_sizes_exact_and_disjoint(spark):
    t = tx_events(spark, SF001).select("transaction_id", "fraud_indicator")
    s = PR.stratified_split(t, "transaction_id", test_size=0.2)
    c = {(r.fraud_indicator, r.is_test): r["count"] for r in s.groupBy("fraud_indicator", "is_test").count().collect()}
    n = {r.fraud_indicator: r["count"] for r in t.groupBy("fraud_indicator").count().collect()}
    for y in n:
        assert c[(y, 1)] == int(n[y] * 0.2 + 0.5)
    assert s.count() == t.count() == s.select("transaction_id").distinct().count()


def test_hash_rank_is_row_number(spark):
    from pyspark.sql import Window
    t = tx_events(spark, SF001).select("transaction_id", "fraud_indicator")
    r = hash_rank(t, ["fraud_indicator"], "transaction_id", buckets=64)
    h = F.md5(F.concat(F.col("transaction_id").cast("string"), F.lit("42")))
    ref = t.withColumn("rn", F.row_number().over(Window.partitionBy("fraud_indicator").orderBy(h, "transaction_id")) - 1)
    assert r.join(ref, ["transaction_id", "fraud_indicator"]).where("hash_rank <> rn").count() == 0


def test_balancing_parity(spark):
    t = tx_events(spark, SF001).select("transaction_id", "fraud_indicator")
    o = PR.random_oversample(t, "transaction_id")
    c = {r.fraud_indicator: r["count"] for r in o.groupBy("fraud_indicator").count().collect()}
    assert c[0] == c[1]
    u = PR.random_undersample(t, "transaction_id")
    c = {r.fraud_indicator: r["count"] for r in u.groupBy("fraud_indicator").count().collect()}
    assert c[0] == c[1]


def test_kfold_balanced(spark):
    t = tx_events(spark, SF001).select("transaction_id", "fraud_indicator")
    f = PR.kfold(t, "transaction_id", 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_label_encode_prefix_buckets_keep_lexicographic_order(spark):
    vals = ["b", "a", "ab", "abc", "B", "zz", "z", None, "nana", "a", "Zeta", "é", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, s string")
    got = {r.id: r.s for r in PR.label_encode(df, ["s"]).collect()}
    vocab = sorted({("nan" if v is None else v) for v in vals}, key=lambda x: x.encode("utf-8"))
    want = {i: vocab.index("nan" if v is None else v) for i, v in enumerate(vals)}
    assert got == want
