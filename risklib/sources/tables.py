"""Adapters from the supplied parquet tables to the transaction schema.

Each adapter is a lazy projection (plus dimension joins); Catalyst prunes
columns and pushes filters into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> transactions (time-of-day, velocity, streaming, scoring).

    card = user_id, amount = value, category = event_type, mcc = props.k,
    label = (event_type = 'error'). ``ts`` is timestamp_ntz; it is cast to a
    session-zone timestamp (UTC) so that unix_micros and watermarks work.
    """
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("card_number"),
        F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("transaction_ts"),
        F.col("event_type").alias("merchant_category"),
        F.get_json_object("props", "$.k").try_cast("int").alias("mcc"),
        (F.col("event_type") == "error").cast("int").alias("fraud_indicator"),
    )


def tx_orders(spark: SparkSession, sf_dir: str, with_location: bool = True) -> DataFrame:
    """orders x customer x nation x region -> transactions (location, payment).

    ``with_location=False`` reads orders alone (for time/label-only queries:
    Catalyst cannot drop a left join it cannot prove unique, so not asking
    for it saves a shuffle join).

    nation (25 rows) and region (5 rows) are fixed-size dimensions, so they
    are broadcast. customer grows with the data and is left to the planner
    (AQE turns it into a broadcast only if its measured size is small).
    """
    o = read_table(spark, sf_dir, "orders")
    if not with_location:
        return o.select(
            F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("card_number"),
            F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp").alias("transaction_ts"),
            F.col("o_orderpriority").alias("payment_method"),
            (F.col("o_orderstatus") == "F").cast("int").alias("fraud_indicator"))
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    cust = c.join(F.broadcast(dims), c.c_nationkey == dims.n_nationkey).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name")
    return o.join(cust, o.o_custkey == cust.c_custkey, "left").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("card_number"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_ts"),
        F.col("n_name").alias("merchant_city"),
        F.col("r_name").alias("merchant_state"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("c_mktsegment").alias("issuer_bank"),
        (F.col("o_orderstatus") == "F").cast("int").alias("fraud_indicator"),
    )


def tx_orders_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_orders with a merchant and all five payment columns.

    merchant = supplier, capture method = line status and card brand = part brand of the order's first
    line (least line number, then supplier, part and status, as line numbers repeat); issuer country =
    the customer's nation. The first lines are one partial aggregate on the order key; orders without
    lines keep nulls. part grows with the data and is left to the planner.
    """
    first = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_linestatus")).alias("line"))
    brands = read_table(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_brand").alias("card_brand"))
    o = tx_orders(spark, sf_dir)
    return (o.join(first, o.transaction_id == first.l_orderkey, "left")
             .join(brands, F.col("line.l_partkey") == F.col("p_partkey"), "left")
             .select(o["*"], F.col("line.l_suppkey").alias("merchant_id"), F.col("line.l_linestatus").alias("capture_method"),
                     "card_brand", F.col("merchant_city").alias("issuer_country")))


def tx_lines(spark: SparkSession, sf_dir: str, with_location: bool = True) -> DataFrame:
    """lineitem x supplier x nation -> merchant-level rows (group operators only).

    ``with_location=False`` reads lineitem alone (merchant, amount, time, label)."""
    li = read_table(spark, sf_dir, "lineitem")
    if not with_location:
        return li.select(F.col("l_suppkey").alias("merchant_id"), F.col("l_extendedprice").alias("amount"),
                         F.col("l_shipdate").cast("timestamp").alias("transaction_ts"),
                         F.col("l_linestatus").alias("capture_method"),
                         (F.col("l_returnflag") == "R").cast("int").alias("fraud_indicator"))
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    sup = s.join(F.broadcast(n.select("n_nationkey", "n_name")), s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", "n_name")
    return li.join(sup, li.l_suppkey == sup.s_suppkey, "left").select(
        F.col("l_suppkey").alias("merchant_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("transaction_ts"),
        F.col("n_name").alias("merchant_city"),
        F.col("l_linestatus").alias("capture_method"),
        (F.col("l_returnflag") == "R").cast("int").alias("fraud_indicator"),
    )


# Fixed scoring rule used to build the deterministic ``scored`` evaluation input.
def _score_a(amount: Column, mcc: Column) -> Column:
    z = (F.log1p(F.greatest(amount, F.lit(0.0))) - F.lit(4.0)) * F.lit(1.2) + (mcc - F.lit(49.5)) / F.lit(49.5) * F.lit(0.3)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def _score_b(amount: Column, ts: Column) -> Column:
    h = F.hour(ts)
    return F.round(F.least(F.lit(0.99), F.lit(0.05) + F.lit(0.15) * (
        (amount > 300).cast("int") + (h < 5).cast("int") + (h > 22).cast("int"))
        + (amount % 7) / F.lit(100.0)), 6)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation input: (transaction_id, true_label, fraud_probability, ...)."""
    t = tx_events(spark, sf_dir)
    return t.select(
        "transaction_id",
        F.col("fraud_indicator").alias("true_label"),
        _score_a(F.col("amount"), F.col("mcc")).alias("fraud_probability"),
        F.col("amount").alias("transaction_amount"),
        "transaction_ts",
        "merchant_category",
    )


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (model, transaction_id, true_label, fraud_probability) for comparisons."""
    t = tx_events(spark, sf_dir)
    base = ["transaction_id", F.col("fraud_indicator").alias("true_label"),
            F.col("amount").alias("transaction_amount"), "transaction_ts", "merchant_category"]
    a = t.select(F.lit("amount_mcc").alias("model"), *base,
                 _score_a(F.col("amount"), F.col("mcc")).alias("fraud_probability"))
    b = t.select(F.lit("amount_hour").alias("model"), *base,
                 _score_b(F.col("amount"), F.col("transaction_ts")).alias("fraud_probability"))
    return a.unionByName(b)


def tx_line_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows with the customer's nation (via orders) and the supplier's nation as
    customer / merchant location codes (the zip pair of the different-location flag)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey, "left")
    x = li.join(oc, li.l_orderkey == oc.o_orderkey, "left").join(s, li.l_suppkey == s.s_suppkey, "left")
    return x.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
                    F.col("l_extendedprice").alias("amount"),
                    F.col("c_nationkey").cast("string").alias("customer_zip"),
                    F.col("s_nationkey").cast("string").alias("merchant_zip"))
