"""Fill values of cleaning: counted per value, ties, all-null columns, ids untouched."""

from risklib.functions.fitted import most_frequent
from risklib.operators.clean import clean_data, impute


def test_most_frequent_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "x", None), ("b", None, None), ("a", "y", None), (None, None, None)],
                               "s string, `t.u` string, none string")
    assert most_frequent(df, ["s", "t.u", "none"]) == {"s": "a", "t.u": "x", "none": None}
    assert most_frequent(df, []) == {}
    assert most_frequent(df.limit(0), ["s"]) == {"s": None}


def test_ids_are_not_imputed(spark):
    df = spark.createDataFrame([("1", "c", "m", 1.0, 0), (None, None, "m", None, None), ("3", "c", None, 3.0, 1)],
                               "transaction_id string, card_number string, merchant_city string, amount double, fraud_indicator int")
    out = clean_data(df).collect()
    assert len(out) == 3
    assert sorted((r["transaction_id"] or "", r["card_number"] or "", r["merchant_city"], r["amount"], r["fraud_indicator"])
                  for r in out if r["fraud_indicator"] is None)[0][:4] == ("", "", "m", 2.0)
    assert [r["fraud_indicator"] for r in out].count(None) == 1
    only = impute(df.select("merchant_city"))
    assert [r[0] for r in only.collect()] == ["m"] * 3
