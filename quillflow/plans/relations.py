"""Queries over joins, aggregations and staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import evaluation as E, graph as R, publish as P, staging as G
from ..sources import tables as T
from . import sql as Q
from .registry import query

_KEYS = ("ts_s", "from_bank", "from_account", "to_bank", "to_account", "amount_paid")
#: Stand-in for a pattern table: some payments, with line numbers, some keys twice.
_PATTERNS = "pat AS (SELECT ts_s, from_bank, from_account, to_bank, to_account, amount_paid, transaction_id % 37 AS chain_id, transaction_id AS line_no FROM tx WHERE is_laundering = 1 AND transaction_id % 2 = 0)"


def _patterns(tx):
    return tx.where("is_laundering = 1 AND transaction_id % 2 = 0").select(*_KEYS, (F.col("transaction_id") % 37).alias("chain_id"), F.col("transaction_id").alias("line_no"))


_COLLAPSED = "SELECT min(transaction_id) AS transaction_id, count(*) AS copies, sum(amount_received) AS received_amount, sum(amount_paid) AS sent_amount, max(is_laundering) AS is_laundering FROM tx GROUP BY ts_s, from_bank, from_account, to_bank, to_account, receiving_currency, payment_currency, payment_format"


@query("ag01_collapse_duplicates", Q.tx(_COLLAPSED))
def ag01(spark, sf_dir):
    return G.collapse_duplicates(T.transactions(spark, sf_dir)).select("transaction_id", F.size("transaction_ids").cast("long").alias("copies"), "received_amount", "sent_amount", "is_laundering")


@query("jn01_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jn01(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return T.table(spark, sf_dir, "customer", "c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("cp02_jn02_cases", Q.tx("SELECT p.transaction_id, p.transaction_id % 37 AS chain_id, c.transaction_id AS staged_id FROM tx p JOIN (SELECT min(transaction_id) AS transaction_id, list(transaction_id) AS ids FROM tx GROUP BY ts_s, from_bank, from_account, to_bank, to_account, receiving_currency, payment_currency, payment_format) c ON list_contains(c.ids, p.transaction_id) WHERE p.is_laundering = 1"))
def cp02(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    patterns = tx.where("is_laundering = 1").select("transaction_id", (F.col("transaction_id") % 37).alias("chain_id"))
    return G.cases(patterns, G.collapse_duplicates(tx)).select("transaction_id", "chain_id", "staged_id")


@query("jn03_split_rows", Q.tx("SELECT t.transaction_id, t.amount_paid FROM (SELECT transaction_id FROM tx WHERE transaction_id % 5 = 0) s LEFT JOIN tx t USING (transaction_id)"))
def jn03(spark, sf_dir):
    return T.transactions(spark, sf_dir).where("transaction_id % 5 = 0").select("transaction_id", "amount_paid")


@query("jn06_composite_join", Q.edges("SELECT e.transaction_id, t.amount AS pair_total FROM e LEFT JOIN tot t ON e.source = t.source AND e.target = t.target"))
def jn06(spark, sf_dir):
    edges = R.as_edges(T.transactions(spark, sf_dir))
    return edges.select("transaction_id", F.sum("amount").over(W.Window.partitionBy("source", "target")).alias("pair_total"))


@query("jn07_temporal_join", Q.edges("SELECT a.source AS dispense, count(*) AS pairs FROM e a JOIN e b ON a.target = b.source AND a.ts_s <= b.ts_s WHERE a.source < 300 GROUP BY a.source"))
def jn07(spark, sf_dir):
    e = R.as_edges(T.transactions(spark, sf_dir))
    left = e.where("source < 300").select(F.col("source").alias("dispense"), F.col("target").alias("via"), F.col("ts_s").alias("t"))
    return left.join(e, (F.col("via") == F.col("source")) & (F.col("t") <= F.col("ts_s"))).groupBy("dispense").agg(F.count(F.lit(1)).alias("pairs"))


@query("jn07_temporal_all_payments")
def jn07_all(spark, sf_dir):
    """jn07_temporal_join over all payments: an account's later payments are counted once per second, then looked up."""
    e = R.as_edges(T.transactions(spark, sf_dir))
    ends = e.select(F.inline(F.array(F.struct(F.col("source").alias("via"), "ts_s", F.lit(1).alias("n")), F.struct(F.col("target").alias("via"), "ts_s", F.lit(0).alias("n")))))
    later = F.sum("n").over(W.Window.partitionBy("via").orderBy(F.col("ts_s").desc()).rowsBetween(W.PRECEDING, W.CURRENT))
    counts = ends.groupBy("via", "ts_s").agg(F.sum("n").alias("n")).select("via", "ts_s", later.alias("later"))
    paid = e.groupBy(F.col("source").alias("dispense"), F.col("target").alias("via"), "ts_s").agg(F.count(F.lit(1)).alias("payments"))
    return paid.join(counts, ["via", "ts_s"]).groupBy("dispense").agg(F.sum(F.col("payments") * F.col("later")).alias("pairs")).where("pairs > 0")


@query("jn11_node_features_on_edges", Q.edges("SELECT t.source, t.target, s.total AS source_total, r.total AS target_total FROM tot t LEFT JOIN (SELECT source AS k, sum(amount) AS total FROM tot GROUP BY ALL) s ON s.k = t.source LEFT JOIN (SELECT source AS k, sum(amount) AS total FROM tot GROUP BY ALL) r ON r.k = t.target"))
def jn11(spark, sf_dir):
    totals = R.edge_totals(R.as_edges(T.transactions(spark, sf_dir)))
    nodes = R.node_totals(totals, "source").withColumnRenamed("node", "key")
    return R.with_node_features(totals, nodes).select("source", "target", "source_total", "target_total")


@query("jn12_merged_groups", Q.edges("SELECT coalesce(a.k, b.k) AS key, a.total AS total_sent, b.total AS total_received FROM (SELECT source AS k, sum(amount) AS total FROM tot GROUP BY ALL) a FULL JOIN (SELECT target AS k, sum(amount) AS total FROM tot GROUP BY ALL) b ON a.k = b.k"))
def jn12(spark, sf_dir):
    totals = R.edge_totals(R.as_edges(T.transactions(spark, sf_dir)))
    side = lambda s: R.node_totals(totals, s).withColumnRenamed("node", "key")
    return R.merged_features({"sent": side("source"), "received": side("target")})


@query("jn13_credit_minus_debit", Q.edges("SELECT coalesce(a.k, b.k) AS account, coalesce(b.t, 0) - coalesce(a.t, 0) AS delta FROM (SELECT source AS k, sum(amount) AS t FROM e GROUP BY ALL) a FULL JOIN (SELECT target AS k, sum(amount) AS t FROM e GROUP BY ALL) b ON a.k = b.k"))
def jn13(spark, sf_dir):
    e = R.as_edges(T.transactions(spark, sf_dir))
    legs = e.select(F.inline(F.array(F.struct(F.col("target").alias("account"), F.col("amount").alias("d")), F.struct(F.col("source").alias("account"), (-F.col("amount")).alias("d")))))
    return legs.groupBy("account").agg(F.sum("d").alias("delta"))


@query("jn15_first_seen", Q.tx("SELECT account, min(ts_s) AS first_seen FROM (SELECT from_account AS account, ts_s FROM tx UNION ALL SELECT to_account, ts_s FROM tx) GROUP BY account"))
def jn15(spark, sf_dir):
    return G.endpoints(T.transactions(spark, sf_dir)).groupBy("account").agg(F.min("ts_s").alias("first_seen"))


_LEGS = "legs AS (SELECT transaction_id, ts_s, from_account AS account, -amount_paid AS d FROM tx UNION ALL SELECT transaction_id, ts_s, to_account, amount_paid FROM tx), one AS (SELECT account, ts_s, transaction_id, sum(d) AS d FROM legs GROUP BY ALL), run AS (SELECT account, ts_s, transaction_id, sum(d) OVER (PARTITION BY account ORDER BY ts_s, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS net, ts_s - min(ts_s) OVER (PARTITION BY account) AS active FROM one)"


@query("wn03_running_totals", Q.tx("SELECT transaction_id, sum(amount_paid) OVER (PARTITION BY from_account ORDER BY ts_s, transaction_id) AS source_dispensation, sum(amount_paid) OVER (PARTITION BY to_account ORDER BY ts_s, transaction_id) AS target_accumulation FROM tx"))
def wn03(spark, sf_dir):
    return G.running_totals(T.transactions(spark, sf_dir))


@query("wn04_wn05_jn18_balances", f"WITH {Q.TX}, {_LEGS} SELECT t.transaction_id, greatest(s.net, 0) AS source_positive_balance, greatest(-s.net, 0) AS source_negative_balance, greatest(r.net, 0) AS target_positive_balance, greatest(-r.net, 0) AS target_negative_balance, s.active AS source_active_for, r.active AS target_active_for FROM tx t JOIN run s ON s.account = t.from_account AND s.transaction_id = t.transaction_id JOIN run r ON r.account = t.to_account AND r.transaction_id = t.transaction_id")
def wn04(spark, sf_dir):
    df = G.balances(T.transactions(spark, sf_dir))
    return df.select("transaction_id", *((F.col(c) + F.lit(0.0)).alias(c) if c.endswith("balance") else c for c in df.columns[1:]))


@query("cp05_transaction_features", f"WITH {Q.TX}, {_LEGS} SELECT t.transaction_id, sum(amount_paid) OVER (PARTITION BY from_account ORDER BY t.ts_s, t.transaction_id) AS source_dispensation, greatest(s.net, 0) AS source_positive_balance, 0.0::DOUBLE AS source_balance_ratio, payment_currency <> receiving_currency AS inter_currency FROM tx t JOIN run s ON s.account = t.from_account AND s.transaction_id = t.transaction_id")
def cp05(spark, sf_dir):
    df = G.transaction_features(T.transactions(spark, sf_dir))
    return df.select("transaction_id", "source_dispensation", (F.col("source_positive_balance") + F.lit(0.0)).alias("source_positive_balance"), (F.col("source_balance_ratio") + F.lit(0.0)).alias("source_balance_ratio"), "inter_currency")


@query("jn19_entity_lookup", "SELECT o_orderkey, c_name AS entity FROM orders LEFT JOIN customer ON lpad(o_custkey::VARCHAR, 9, '0') = lpad(c_custkey::VARCHAR, 9, '0')")
def jn19(spark, sf_dir):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    accounts = T.table(spark, sf_dir, "customer", "c_custkey", "c_name").select(pad("c_custkey").alias("account"), F.col("c_name").alias("entity"))
    orders = T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("number", F.concat(pad("o_custkey"), F.lit("-x")))
    return G.with_entities(orders, accounts, "number", "entity").select("o_orderkey", "entity")


@query("jn20_currency_lookup", Q.tx(f"SELECT transaction_id, code, rate AS usd_rate FROM tx JOIN {Q.RATES} ON name = payment_currency"))
def jn20(spark, sf_dir):
    tx, dim = T.transactions(spark, sf_dir), T.currencies(spark)
    return tx.join(F.broadcast(dim), tx.payment_currency == dim.name).select("transaction_id", "code", "usd_rate")


@query("jn21_chain_ids", f"WITH {Q.TX}, {_PATTERNS} SELECT t.transaction_id, coalesce(c, -1) AS chain_id FROM tx t LEFT JOIN (SELECT ts_s, from_bank, from_account, to_bank, to_account, amount_paid, arg_max(chain_id, line_no) AS c FROM pat GROUP BY ALL) p USING (ts_s, from_bank, from_account, to_bank, to_account, amount_paid)")
def jn21(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return G.chain_ids(tx, _patterns(tx), _KEYS).select("transaction_id", "chain_id")


@query("jn22_line_join", "SELECT o_orderpriority AS value, max(o_orderkey) AS transaction_id FROM orders GROUP BY ALL")
def jn22(spark, sf_dir):
    lines = T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("value"))
    return G.matched_lines(lines, lines.select("value").distinct()).select("value", "transaction_id")


@query("jn23_match_rate", Q.tx("SELECT count(*) AS rows, count(f.k) AS matched FROM tx LEFT JOIN (SELECT transaction_id AS k FROM tx WHERE transaction_id % 7 <> 0) f ON f.k = transaction_id"))
def jn23(spark, sf_dir):
    tx = T.transactions(spark, sf_dir).select("transaction_id")
    flags = tx.where("transaction_id % 7 <> 0").withColumn("is_kept", F.lit(True))
    return tx.join(flags, "transaction_id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("is_kept").alias("matched"))


@query("jn27_membership_flags", Q.edges("SELECT k AS key, k IN (SELECT source FROM tot) AS has_credits, k IN (SELECT target FROM tot) AS has_debits FROM (SELECT source AS k FROM tot UNION SELECT target FROM tot)"))
def jn27(spark, sf_dir):
    totals = R.edge_totals(R.as_edges(T.transactions(spark, sf_dir)))
    keys = totals.select(F.col("source").alias("key")).union(totals.select("target")).distinct()
    return R.membership_flags(keys, totals)


@query("ag02_edge_totals", Q.edges("SELECT source, target, amount FROM tot"))
def ag02(spark, sf_dir):
    return R.edge_totals(R.as_edges(T.transactions(spark, sf_dir)))


@query("ag03_node_totals", Q.edges("SELECT source AS node, sum(amount) AS total FROM tot GROUP BY source"))
def ag03(spark, sf_dir):
    return R.node_totals(R.edge_totals(R.as_edges(T.transactions(spark, sf_dir))), "source")


@query("ag05_first_time", Q.tx("SELECT min(ts_s) - 60 AS first_ts FROM tx"))
def ag05(spark, sf_dir):
    return T.transactions(spark, sf_dir).agg((F.min("ts_s") - 60).alias("first_ts"))


@query("ag14_distinct_currencies", Q.tx("SELECT from_account, count(DISTINCT payment_format) AS formats FROM tx GROUP BY from_account"))
def ag14(spark, sf_dir):
    return T.transactions(spark, sf_dir).groupBy("from_account").agg(F.count_distinct("payment_format").alias("formats"))


@query("ag17_weighted_quantile_steps", Q.tx("SELECT from_bank::BIGINT AS key, min(ts_s) AS q FROM (SELECT from_bank, ts_s, sum(amount_paid) OVER (PARTITION BY from_bank ORDER BY ts_s, amount_paid ROWS UNBOUNDED PRECEDING) AS c, sum(amount_paid) OVER (PARTITION BY from_bank) AS t FROM tx) WHERE c >= 0.5 * t GROUP BY from_bank"))
def ag17(spark, sf_dir):
    rows = T.transactions(spark, sf_dir).select(F.col("from_bank").cast("long").alias("key"), "ts_s", "amount_paid")
    return R.weighted_quantile(rows, "ts_s", "amount_paid", 0.5, "q", interpolate=False)


@query("ag20_or_combined", Q.obs("SELECT transaction_id, max(score) AS score, max(is_laundering) AS label FROM (SELECT transaction_id, is_laundering, score * (1 - 0.25 * role_ord) AS score FROM obs) GROUP BY transaction_id"))
def ag20(spark, sf_dir):
    from ..operators.features import observations

    o = observations(T.transactions(spark, sf_dir)).withColumns({"score": F.col("score") * (1 - 0.25 * F.col("role_ord")), "label": F.col("is_laundering")})
    return E.or_combined(o)


_BINS = "CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' ELSE '10+' END"


@query("ag21_cp15_bin_summary", Q.tx(f"SELECT bin, count(*) AS rows, sum(is_laundering)::BIGINT AS illicit, round(100.0 * avg(is_laundering), 6) AS illicit_rate_pct, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(100.0 * avg((score >= 0.6)::INT), 6) AS kept_pct, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS row_share_pct, round(100.0 - 100.0 * avg((score >= 0.6)::INT), 6) AS dropped_pct FROM (SELECT *, {_BINS} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY from_bank, from_account, amount_paid ORDER BY ts_s, transaction_id) - 1 AS n FROM tx)) GROUP BY bin"))
def ag21(spark, sf_dir):
    from ..functions.scalars import amount_bin

    n = W.prev_count(("from_bank", "from_account", "amount_paid"), ("ts_s", "transaction_id"))
    rows = T.transactions(spark, sf_dir).withColumn("n", n).withColumns({"bin": amount_bin("n"), "kept": F.col("score") >= 0.6})
    df = E.bin_summary(rows, "bin", "is_laundering")
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else c for c, k in df.dtypes))


@query("ag22_value_counts", Q.tx("SELECT is_laundering, count(*) AS rows FROM tx GROUP BY is_laundering"))
def ag22(spark, sf_dir):
    return P.value_counts(T.transactions(spark, sf_dir), "is_laundering")


@query("ag22_null_counts", "SELECT * FROM (SELECT 'doc_id' AS name, count(*) - count(doc_id) AS nulls FROM documents UNION ALL SELECT 'text', count(*) - count(text) FROM documents UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents)")
def ag22b(spark, sf_dir):
    return P.null_counts(T.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("ag23_exact_quantiles", Q.tx("SELECT quantile_cont(ts_s::DOUBLE, 0.6) AS t60, quantile_cont(score, 0.05) AS s05 FROM tx"))
def ag23(spark, sf_dir):
    return T.transactions(spark, sf_dir).agg(F.percentile("ts_s", F.lit(0.6)).alias("t60"), F.percentile("score", F.lit(0.05)).alias("s05"))


@query("ag24_order_statistic", Q.tx("SELECT (list_sort(list(ts_s)))[floor(count(*) * 0.6)::BIGINT + 1] AS t_train, (list_sort(list(ts_s)))[floor(count(*) * 0.8)::BIGINT + 1] AS t_valid FROM tx"))
def ag24(spark, sf_dir):
    return E.order_cuts(T.transactions(spark, sf_dir))


@query("ag30_value_summary", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def ag30(spark, sf_dir):
    return T.table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("wn39_occurrences", Q.tx("SELECT transaction_id, row_number() OVER (PARTITION BY ts_s, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format ORDER BY transaction_id) - 1 AS occurrence FROM tx"))
def wn39(spark, sf_dir):
    return P.payment_references(T.transactions(spark, sf_dir)).select("transaction_id", "occurrence")


@query("wn40_chain_first_time", Q.tx("SELECT transaction_id, min(ts_s) OVER (PARTITION BY chain_id) AS first_ts FROM tx WHERE chain_id >= 0"))
def wn40(spark, sf_dir):
    from ..operators.features import fill_by_group

    return fill_by_group(T.transactions(spark, sf_dir).where("chain_id >= 0"), ("chain_id",), "ts_s").select("transaction_id", F.col("time_first").alias("first_ts"))


@query("wn41_gain_curve", Q.tx("SELECT score, sum(sum(is_laundering)) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(count(*)) OVER (ORDER BY score DESC)::BIGINT AS kept FROM tx GROUP BY score"))
def wn41(spark, sf_dir):
    return E.by_score(T.transactions(spark, sf_dir), "is_laundering").select("score", "tp", "kept")
