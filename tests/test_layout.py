"""How rows lie over tasks where later steps read them many times."""

from pyspark.sql import functions as F

from risklib.operators import prep as PR
from risklib.operators.keyed import spread


def _sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_split_deals_no_class_to_one_task(spark):
    rows = spark.range(20_000).select(F.col("id").alias("transaction_id"), (F.col("id") % 5 == 0).cast("int").alias("fraud_indicator"))
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        split = PR.stratified_split(rows, "transaction_id").checkpoint()
        weighted = PR.class_weights(rows.repartition(32), "fraud_indicator").checkpoint()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for out in (split, weighted):
        assert sum(_sizes(out)) == 20_000 and max(_sizes(out)) < 5_000
    assert {r["fraud_indicator"]: r["n"] for r in split.where("is_test = 1").groupBy("fraud_indicator").agg(
        F.count(F.lit(1)).alias("n")).collect()} == {0: 3200, 1: 800}


def test_spread_bounds_partitions_and_repeats_itself(spark):
    rows = spark.range(9_000).select((F.col("id") * 7 % 9_000).alias("k"), F.rand(3).alias("v"))
    a, b = (spread(d, "k", rows_per_part=1_000, least=500) for d in (rows, rows.repartition(5)))
    assert a.rdd.getNumPartitions() == 9 and max(_sizes(a)) < 2_000
    assert a.rdd.glom().map(lambda p: [r["k"] for r in p]).collect() == b.rdd.glom().map(lambda p: [r["k"] for r in p]).collect()
    assert spread(rows.limit(0), "k").count() == 0


def _held(spark, **conf):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", **conf}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    return old


def test_rows_without_a_neighbour_do_not_meet_in_one_task(spark):
    from risklib.plans.q_neighbours import _checked
    t = spark.range(8_000).select(F.col("id").alias("transaction_id"), (F.col("id") % 5 == 0).cast("int").alias("fraud_indicator"),
                                  F.col("id").cast("double").alias("amount"), F.lit(1).alias("mcc"), F.lit(2).alias("hour"))
    kept = t.select("*", F.lit(0).alias("copy"), F.lit(None).cast("long").alias("neighbour"), F.lit(None).cast("double").alias("gap"))
    new = kept.where("transaction_id in (0, 5)").withColumns({
        "copy": F.lit(1), "neighbour": F.lit(10).cast("long"), "gap": F.lit(0.5), "amount": F.when(F.col("transaction_id") == 0, 5.0).otherwise(9.0)})
    old = _held(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    try:
        out = _checked(t, kept.unionByName(new)).checkpoint()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(_sizes(out)) < 2_000
    assert sorted((r["transaction_id"], r["on_segment"]) for r in out.where("copy = 1").collect()) == [(0, 1), (5, 0)]
    assert out.where("copy = 0 and on_segment = 1").count() == 8_000


def test_state_streams_have_as_many_parts_as_cores_or_rows_need(spark):
    from risklib.streaming import ops as S
    few, many = S.state_session(spark, 10), S.state_session(spark, 10_000, rows_per_part=100)
    assert int(few.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
    assert int(many.conf.get("spark.sql.shuffle.partitions")) == 100
    assert few.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert few.conf.get("spark.sql.streaming.stateStore.providerClass") == spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_row_is_in_little_more_than_one_group_per_projection(spark):
    from risklib.operators import neighbours as N
    placed = spark.range(40_960).select(F.lit(0).alias("p"), F.col("id").alias("place"))
    groups = N.half_block_groups(placed, 256)
    assert groups.count() < 1.2 * 40_960
    # each half block meets the two beside it: all three are in the group of the middle one
    of = {}
    for r in groups.select((F.col("place") / 256).cast("int").alias("h"), "g").distinct().collect():
        of.setdefault(r["h"], set()).add(r["g"])
    assert all({h // N.HALVES} <= of[h] & of.get(h - 1, {h // N.HALVES}) & of.get(h + 1, {h // N.HALVES}) for h in range(160))
