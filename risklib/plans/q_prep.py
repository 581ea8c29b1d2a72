"""Preparation and selection queries (ENC1-4, SCA1, SPL1-2, BAL3-5, SEL1-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.operators import prep as PR
from risklib.operators import select as SE
from risklib.plans.common import rounded
from risklib.plans.sqlviews import EV, ORD
from risklib.sources.tables import tx_events, tx_orders

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _feat(spark, sf):
    t = tx_events(spark, sf)
    return t.select("transaction_id", "amount", F.log1p("amount").alias("amount_log"), (F.col("amount") * 2).alias("amount_x2"),
                    "mcc", F.hour("transaction_ts").alias("hour"), "fraud_indicator")


FEATS = ["amount", "amount_log", "amount_x2", "mcc", "hour"]
_FEAT_SQL = EV + """, feat AS (SELECT transaction_id, amount, ln(1 + amount) AS amount_log, amount * 2 AS amount_x2, mcc,
   CAST(hour(transaction_ts) AS INTEGER) AS hour, fraud_indicator FROM tx_events)
"""
_FOLD = """(row_number() OVER (PARTITION BY fraud_indicator ORDER BY md5(CAST(transaction_id AS VARCHAR) || '42'), transaction_id) - 1)"""


# ---------------------------------------------------------------- ENC1
@reg("enc1_label_encode", ORD + """SELECT transaction_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(merchant_city, 'nan')) - 1 AS INTEGER) AS merchant_city,
  CAST(dense_rank() OVER (ORDER BY coalesce(payment_method, 'nan')) - 1 AS INTEGER) AS payment_method FROM tx_orders""")
def enc1_label_encode(spark, sf):
    t = tx_orders(spark, sf).select("transaction_id", "merchant_city", "payment_method")
    return PR.label_encode(t, ["merchant_city", "payment_method"])


# ---------------------------------------------------------------- ENC2
_CATS = ["click", "error", "purchase", "signup", "view"]


@reg("enc2_one_hot", EV + "SELECT transaction_id, " + ", ".join(
    f"CAST(coalesce(merchant_category = '{v}', false) AS DOUBLE) AS merchant_category_{v}" for v in _CATS) + " FROM tx_events")
def enc2_one_hot(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "merchant_category")
    return PR.one_hot(t, "merchant_category")


# ---------------------------------------------------------------- ENC3/ENC4
def _te_sql(col: str, src: str) -> str:
    return f""", f AS (SELECT *, CAST({_FOLD} % 5 AS INTEGER) AS fold FROM {src}),
pr AS (SELECT avg(CAST(fraud_indicator AS DOUBLE)) AS p FROM f),
per AS (SELECT {col}, fold, sum(fraud_indicator) AS sf, count(fraud_indicator) AS nf FROM f GROUP BY 1, 2),
tot AS (SELECT {col}, sum(sf) AS sa, sum(nf) AS na FROM per GROUP BY 1)
SELECT f.transaction_id, f.fold, ROUND(coalesce((tot.sa - per.sf + 10 * pr.p) / (tot.na - per.nf + 10), pr.p), 6) AS {col}_te
FROM f JOIN per ON f.{col} = per.{col} AND f.fold = per.fold JOIN tot ON f.{col} = tot.{col}, pr"""


@reg("enc3_target_encode_oof", ORD + _te_sql("issuer_bank", "tx_orders"))
def enc3_target_encode_oof(spark, sf):
    t = PR.kfold(tx_orders(spark, sf), "transaction_id", 5)
    return rounded(PR.target_encode_oof(t, "issuer_bank").select("transaction_id", "fold", "issuer_bank_te"))


@reg("enc4_merchant_rate_oof", EV + _te_sql("mcc", "tx_events"))
def enc4_merchant_rate_oof(spark, sf):
    t = PR.kfold(tx_events(spark, sf), "transaction_id", 5)
    return rounded(PR.target_encode_oof(t, "mcc").select("transaction_id", "fold", "mcc_te"))


# ---------------------------------------------------------------- SCA1
@reg("sca1_standard_scale", EV + """SELECT transaction_id,
  ROUND((amount - (SELECT avg(amount) FROM tx_events)) / (SELECT CASE WHEN stddev_pop(amount) = 0 THEN 1 ELSE stddev_pop(amount) END FROM tx_events), 6) AS amount,
  ROUND((mcc - (SELECT avg(mcc) FROM tx_events)) / (SELECT CASE WHEN stddev_pop(mcc) = 0 THEN 1 ELSE stddev_pop(mcc) END FROM tx_events), 6) AS mcc,
  fraud_indicator FROM tx_events""")
def sca1_standard_scale(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "amount", F.col("mcc").cast("double").alias("mcc"), "fraud_indicator")
    return rounded(PR.standard_scale(t, ["amount", "mcc"]))


# ---------------------------------------------------------------- SPL1/SPL2
SPLIT_SQL = f""", r AS (SELECT transaction_id, fraud_indicator, {_FOLD} AS rk,
   count(*) OVER (PARTITION BY fraud_indicator) AS n FROM tx_events),
split AS (SELECT transaction_id, fraud_indicator, CAST(rk < round(n * 0.2) AS INTEGER) AS is_test FROM r)"""


@reg("spl1_stratified_split", EV + SPLIT_SQL + " SELECT * FROM split")
def spl1_stratified_split(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "fraud_indicator")
    return PR.stratified_split(t, "transaction_id", test_size=0.2)


@reg("spl2_kfold", EV + f"SELECT transaction_id, fraud_indicator, CAST({_FOLD} % 5 AS INTEGER) AS fold FROM tx_events")
def spl2_kfold(spark, sf):
    return PR.kfold(tx_events(spark, sf).select("transaction_id", "fraud_indicator"), "transaction_id", 5)


# ---------------------------------------------------------------- BAL3/BAL4/BAL5
_CNT = """, c AS (SELECT sum(fraud_indicator) AS pos, sum(1 - fraud_indicator) AS neg FROM tx_events),
m AS (SELECT CASE WHEN pos <= neg THEN 1 ELSE 0 END AS minority, least(pos, neg) AS n_min, greatest(pos, neg) AS n_maj FROM c)
"""


@reg("bal3_random_oversample", EV + _CNT + """, mi AS (SELECT t.transaction_id, t.fraud_indicator,
   row_number() OVER (ORDER BY md5(CAST(t.transaction_id AS VARCHAR) || '42'), t.transaction_id) - 1 AS rk,
   CAST(floor(m.n_maj / m.n_min) AS INTEGER) AS reps, m.n_maj - floor(m.n_maj / m.n_min) * m.n_min AS rem
   FROM tx_events t, m WHERE t.fraud_indicator = m.minority)
SELECT transaction_id, fraud_indicator, 0 AS copy FROM tx_events, m WHERE fraud_indicator <> m.minority
UNION ALL SELECT transaction_id, fraud_indicator, CAST(unnest(generate_series(0, CASE WHEN rk < rem THEN reps ELSE reps - 1 END)) AS INTEGER)
FROM mi""")
def bal3_random_oversample(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "fraud_indicator")
    return PR.random_oversample(t, "transaction_id")


@reg("bal4_random_undersample", EV + _CNT + """, mj AS (SELECT t.transaction_id, t.fraud_indicator,
   row_number() OVER (ORDER BY md5(CAST(t.transaction_id AS VARCHAR) || '42'), t.transaction_id) - 1 AS rk
   FROM tx_events t, m WHERE t.fraud_indicator <> m.minority)
SELECT transaction_id, fraud_indicator FROM tx_events, m WHERE fraud_indicator = m.minority
UNION ALL SELECT transaction_id, fraud_indicator FROM mj, m WHERE rk < m.n_min""")
def bal4_random_undersample(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "fraud_indicator")
    return PR.random_undersample(t, "transaction_id")


@reg("bal5_class_weights", EV + """SELECT transaction_id, fraud_indicator,
  ROUND((SELECT count(*) FROM tx_events) / (2.0 * count(*) OVER (PARTITION BY fraud_indicator)), 6) AS weight FROM tx_events""")
def bal5_class_weights(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "fraud_indicator")
    return rounded(PR.class_weights(t))


# ---------------------------------------------------------------- SEL1
@reg("sel1_variance_threshold", _FEAT_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(var_pop(CAST({c} AS DOUBLE)), 6) AS variance, CAST(var_pop(CAST({c} AS DOUBLE)) > 0.01 AS INTEGER) AS selected FROM feat"
    for c in FEATS))
def sel1_variance_threshold(spark, sf):
    return rounded(SE.variance_threshold(_feat(spark, sf), FEATS))


# ---------------------------------------------------------------- SEL2
def _sel2_sql() -> str:
    hits = []
    for j, b in enumerate(FEATS):
        conds = [f"abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) > 0.95" for a in FEATS[:j]]
        if not conds:
            hits.append(f"SELECT '{b}' AS feature, 0 AS dropped")
            continue
        e = "(" + " OR ".join(conds) + ")"
        hits.append(f"SELECT '{b}' AS feature, CAST(coalesce({e}, false) AS INTEGER) AS dropped FROM feat")
    return _FEAT_SQL + " UNION ALL ".join(hits)


@reg("sel2_correlation_filter", _sel2_sql())
def sel2_correlation_filter(spark, sf):
    return SE.correlated_to_drop(_feat(spark, sf), FEATS, 0.95, "fraud_indicator")


# ---------------------------------------------------------------- SEL3
def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (ssb / (K - 1)) / ((sst - ssb) / (N - K)) AS score FROM (
  SELECT sum(n) AS N, count(*) AS K, sum(q) - sum(s) * sum(s) / sum(n) AS sst, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb
  FROM (SELECT fraud_indicator, count(*) AS n, sum(CAST({c} AS DOUBLE)) AS s, sum(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)) AS q
        FROM feat GROUP BY 1))"""


_RANKED = """SELECT feature, ROUND(score, 6) AS score, CAST(row_number() OVER (ORDER BY ROUND(score, 9) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM sc"""


@reg("sel3_anova_f", _FEAT_SQL + ", sc AS (" + " UNION ALL ".join(_anova_sql(c) for c in FEATS) + ") " + _RANKED)
def sel3_anova_f(spark, sf):
    return rounded(SE.anova_f(_feat(spark, sf), FEATS))


# ---------------------------------------------------------------- SEL4
CHI_FEATS = ["amount", "mcc", "hour"]


def _chi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum((o - e) * (o - e) / e) AS score FROM (
  SELECT o, n / sum(n) OVER () * sum(o) OVER () AS e FROM (
    SELECT fraud_indicator, count(*) AS n, sum(CAST({c} AS DOUBLE)) AS o FROM feat GROUP BY 1))"""


@reg("sel4_chi2", _FEAT_SQL + ", sc AS (" + " UNION ALL ".join(_chi_sql(c) for c in CHI_FEATS) + ") " + _RANKED)
def sel4_chi2(spark, sf):
    return rounded(SE.chi2(_feat(spark, sf), CHI_FEATS))


# ---------------------------------------------------------------- SEL5
def _mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(n / NN * ln(n * NN / (pb * py))) AS score FROM (
  SELECT n, sum(n) OVER (PARTITION BY b) AS pb, sum(n) OVER (PARTITION BY y) AS py, sum(n) OVER () AS NN FROM (
    SELECT len(list_filter(e, lambda t: CAST({c} AS DOUBLE) > t)) AS b, fraud_indicator AS y, count(*) AS n
    FROM feat, (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM feat)
    WHERE {c} IS NOT NULL GROUP BY 1, 2))"""


@reg("sel5_mutual_information", _FEAT_SQL + ", sc AS (" + " UNION ALL ".join(_mi_sql(c) for c in FEATS) + ") " + _RANKED)
def sel5_mutual_information(spark, sf):
    return rounded(SE.mutual_information(_feat(spark, sf), FEATS))


def _psi_sql(n: str) -> str:
    x = f"(CAST({n} AS DOUBLE) + 6)"
    series = f"ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8)"
    return f"({series} - " + " - ".join(f"1 / (CAST({n} AS DOUBLE) + {i})" for i in range(6)) + ")"


_NEAR = 3


@reg("sel5_neighbour_mutual_information", _FEAT_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, transaction_id, fraud_indicator AS y, CAST({c} AS DOUBLE) AS x0 FROM feat WHERE {c} IS NOT NULL" for c in FEATS) + f"""),
size AS (SELECT feature, 2e-10 * pow(2, ceil(log2(greatest(1, avg(abs(x0)))))) AS size FROM long GROUP BY 1),
v AS (SELECT feature, y, x0 + (CAST('0x' || substr(md5(concat_ws('|', transaction_id, feature)), 1, 13) AS BIGINT) / 4503599627370496.0 - 0.5) * size AS x,
  count(*) AS n FROM long JOIN size USING (feature) GROUP BY ALL),
s AS (SELECT feature, y, sum(n) AS ny FROM v GROUP BY ALL HAVING sum(n) > 1),
w AS (SELECT v.*, ny, least({_NEAR}, ny - 1) AS kk, list(struct_pack(x := x, n := n)) OVER (
  PARTITION BY v.feature, v.y ORDER BY x ROWS BETWEEN {_NEAR} PRECEDING AND {_NEAR} FOLLOWING) AS near FROM v JOIN s USING (feature, y)),
e AS (SELECT feature, y, x, n, ny, kk, unnest(near) AS q FROM w),
c AS (SELECT feature, y, x, n, ny, kk, abs(q.x - x) AS d, q.x AS v, CASE WHEN q.x = x THEN q.n - 1 ELSE q.n END AS m FROM e),
u AS (SELECT *, sum(m) OVER (PARTITION BY feature, y, x ORDER BY d, v) AS upto FROM c WHERE m > 0),
d AS (SELECT feature, y, x, n, ny, kk, d, v, CASE WHEN v > x THEN v ELSE x + d END AS top, CASE WHEN v < x THEN v ELSE x - d END AS low FROM u
  WHERE upto >= kk QUALIFY row_number() OVER (PARTITION BY feature, y, x ORDER BY d, v) = 1),
cum AS (SELECT feature, x, sum(n) OVER (PARTITION BY feature ORDER BY x) AS le, sum(n) OVER (PARTITION BY feature ORDER BY x) - n AS lt
  FROM (SELECT feature, x, sum(n) AS n FROM v JOIN s USING (feature, y) GROUP BY ALL)),
hi AS (SELECT d.*, coalesce(a.le, 0) AS below_top FROM d ASOF LEFT JOIN cum a ON a.feature = d.feature AND d.top > a.x),
lo AS (SELECT hi.*, coalesce(b.le, 0) AS upto_low FROM hi ASOF LEFT JOIN cum b ON b.feature = hi.feature AND hi.low >= b.x),
m AS (SELECT lo.feature, n, kk, ny, CASE WHEN d = 0 THEN same.le - same.lt ELSE below_top - upto_low END AS m
  FROM lo JOIN cum same ON same.feature = lo.feature AND same.x = lo.x),
sc AS (SELECT feature, greatest({_psi_sql('sum(n)')} + sum(n * ({_psi_sql('kk')} - {_psi_sql('ny')} - {_psi_sql('m')})) / sum(n), 0) AS score
  FROM m GROUP BY 1) """ + _RANKED)
def sel5_neighbour_mutual_information(spark, sf):
    return rounded(SE.neighbour_mutual_information(_feat(spark, sf), FEATS, "transaction_id"))
