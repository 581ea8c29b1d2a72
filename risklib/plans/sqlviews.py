"""SQL text of the adapters, for the DuckDB oracles (same mapping as risklib.sources.tables)."""

TX_EVENTS = """tx_events AS (
  SELECT event_id AS transaction_id, user_id AS card_number, value AS amount,
         ts AS transaction_ts, event_type AS merchant_category,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS mcc,
         CAST(event_type = 'error' AS INTEGER) AS fraud_indicator
  FROM events)"""

TX_ORDERS = """tx_orders AS (
  SELECT o.o_orderkey AS transaction_id, o.o_custkey AS card_number, o.o_totalprice AS amount,
         o.o_orderdate AS transaction_ts, cu.n_name AS merchant_city, cu.r_name AS merchant_state,
         o.o_orderpriority AS payment_method, cu.c_mktsegment AS issuer_bank,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS fraud_indicator
  FROM orders o LEFT JOIN (
    SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey) cu
  ON o.o_custkey = cu.c_custkey)"""

TX_ORDERS_FULL = """tx_orders_full AS (
  SELECT o.*, l.l_suppkey AS merchant_id, l.l_linestatus AS capture_method, p.p_brand AS card_brand,
         o.merchant_city AS issuer_country
  FROM tx_orders o LEFT JOIN (
    SELECT l_orderkey, l_suppkey, l_partkey, l_linestatus FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_linestatus) = 1) l
  ON o.transaction_id = l.l_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

TX_LINES = """tx_lines AS (
  SELECT l.l_suppkey AS merchant_id, l.l_extendedprice AS amount, l.l_shipdate AS transaction_ts,
         sn.n_name AS merchant_city, l.l_linestatus AS capture_method,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS fraud_indicator
  FROM lineitem l LEFT JOIN (
    SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) sn
  ON l.l_suppkey = sn.s_suppkey)"""

SCORE_A = ("ROUND(1.0 / (1.0 + exp(-((ln(1 + greatest(amount, 0.0)) - 4.0) * 1.2 "
           "+ (mcc - 49.5) / 49.5 * 0.3))), 6)")
SCORE_B = ("ROUND(least(0.99, 0.05 + 0.15 * (CAST(amount > 300 AS INTEGER) "
           "+ CAST(hour(transaction_ts) < 5 AS INTEGER) + CAST(hour(transaction_ts) > 22 AS INTEGER)) "
           "+ fmod(amount, 7) / 100.0), 6)")

SCORED = f"""scored AS (
  SELECT transaction_id, fraud_indicator AS true_label, {SCORE_A} AS fraud_probability,
         amount AS transaction_amount, transaction_ts, merchant_category
  FROM tx_events)"""

SCORED_MODELS = f"""scored_models AS (
  SELECT 'amount_mcc' AS model, transaction_id, fraud_indicator AS true_label, amount AS transaction_amount,
         transaction_ts, merchant_category, {SCORE_A} AS fraud_probability FROM tx_events
  UNION ALL
  SELECT 'amount_hour' AS model, transaction_id, fraud_indicator AS true_label, amount AS transaction_amount,
         transaction_ts, merchant_category, {SCORE_B} AS fraud_probability FROM tx_events)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV = with_(TX_EVENTS)
ORD = with_(TX_ORDERS)
ORD_FULL = with_(TX_ORDERS, TX_ORDERS_FULL)
LINES = with_(TX_LINES)
SC = with_(TX_EVENTS, SCORED)
SCM = with_(TX_EVENTS, SCORED_MODELS)
