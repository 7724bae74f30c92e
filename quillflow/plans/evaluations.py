"""Queries over splits, thresholds, metrics and publishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluation as E, publish as P
from ..sources import tables as T
from ..sources.constants import TARGETS
from . import sql as Q
from .registry import query

_TARGETS = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in TARGETS) + "]) AS target)"


def _scored(spark, sf_dir):
    return T.transactions(spark, sf_dir).withColumn("label", F.col("is_laundering"))


def _parts(spark, sf_dir):
    """The second and the last bucket of the time split: where thresholds are chosen and where they are judged."""
    rows = _scored(spark, sf_dir)
    split = E.split_by_time(rows, E.quantile_cuts(rows))
    return split.where(F.col("bucket") == E.VALID), split.where(F.col("bucket") == E.TEST)


@query("ev01_split_by_count", Q.tx("SELECT transaction_id, CASE WHEN r <= floor(n * 0.6) THEN 0 WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 1 ELSE 2 END AS bucket FROM (SELECT transaction_id, row_number() OVER (ORDER BY ts_s, transaction_id) AS r, count(*) OVER () AS n FROM tx)"))
def ev01(spark, sf_dir):
    return E.split_by_count(T.transactions(spark, sf_dir)).select("transaction_id", "bucket")


_CUTS = "cuts AS (SELECT quantile_cont(ts_s::DOUBLE, 0.6) AS a, quantile_cont(ts_s::DOUBLE, 0.8) AS b FROM tx)"


@query("ev02_split_by_time", f"WITH {Q.TX}, {_CUTS} SELECT transaction_id, CASE WHEN ts_s < a THEN 0 WHEN ts_s < b THEN 1 ELSE 2 END AS bucket FROM tx, cuts")
def ev02(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return E.split_by_time(tx, E.quantile_cuts(tx)).select("transaction_id", "bucket")


@query("ev03_flt08_split_by_chain", f"WITH {Q.TX}, {_CUTS}, f AS (SELECT chain_id, min(ts_s) AS t FROM tx WHERE chain_id >= 0 GROUP BY chain_id) SELECT transaction_id, CASE WHEN coalesce(t, ts_s) < a THEN 0 WHEN coalesce(t, ts_s) < b THEN 1 ELSE 2 END AS bucket FROM tx LEFT JOIN f USING (chain_id), cuts")
def ev03(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return E.split_by_chain(tx, E.quantile_cuts(tx)).select("transaction_id", "bucket")


_BUCKETS = f"""{_CUTS}, f AS (SELECT chain_id, min(ts_s) AS t FROM tx WHERE chain_id >= 0 GROUP BY chain_id), r AS (SELECT transaction_id, row_number() OVER (ORDER BY ts_s, transaction_id) AS r, count(*) OVER () AS n FROM tx),
ids AS (SELECT 'count' AS rule, transaction_id, CASE WHEN r <= floor(n * 0.6) THEN 0 WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 1 ELSE 2 END AS bucket FROM r
UNION ALL SELECT 'time', transaction_id, CASE WHEN ts_s < a THEN 0 WHEN ts_s < b THEN 1 ELSE 2 END FROM tx, cuts
UNION ALL SELECT 'chain', transaction_id, CASE WHEN coalesce(t, ts_s) < a THEN 0 WHEN coalesce(t, ts_s) < b THEN 1 ELSE 2 END FROM tx LEFT JOIN f USING (chain_id), cuts)"""


def _split_ids(tx):
    """(rule, transaction_id, bucket) of the three split rules, EV1 to EV3."""
    cuts = E.quantile_cuts(tx)
    rules = {"count": E.split_by_count(tx), "time": E.split_by_time(tx, cuts), "chain": E.split_by_chain(tx, cuts)}
    return reduce(DataFrame.unionByName, (df.select(F.lit(rule).alias("rule"), "transaction_id", "bucket") for rule, df in rules.items()))


@query("jn03_materialised_splits", f"WITH {Q.TX}, {_BUCKETS} SELECT rule, bucket, transaction_id, from_account, to_account, ts_s, amount_paid FROM ids LEFT JOIN tx USING (transaction_id)")
def jn03(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return _split_ids(tx).join(tx, "transaction_id", "left").select("rule", "bucket", "transaction_id", "from_account", "to_account", "ts_s", "amount_paid")


@query("so01_cumulative_splits", f"WITH {Q.TX}, {_BUCKETS}, c AS (SELECT k AS upto, transaction_id, amount_paid FROM (VALUES (0), (1), (2)) v(k) JOIN ids ON bucket <= k JOIN tx USING (transaction_id) WHERE rule = 'count') SELECT upto, count(*) AS rows, sum(amount_paid) AS amount FROM c GROUP BY upto")
def so01(spark, sf_dir):
    """Train; train and valid; all three, each a union by position."""
    split = E.split_by_count(T.transactions(spark, sf_dir)).select("bucket", "transaction_id", "amount_paid")
    train, valid, test = (split.where(F.col("bucket") == k).drop("bucket") for k in (E.TRAIN, E.VALID, E.TEST))
    graphs = (train, train.union(valid), train.union(valid).union(test))
    return reduce(DataFrame.unionByName, (df.agg(F.lit(k).alias("upto"), F.count(F.lit(1)).alias("rows"), F.sum("amount_paid").alias("amount")) for k, df in enumerate(graphs)))


_BOTH = f"{_CUTS}, f AS (SELECT chain_id, min(ts_s) AS t FROM tx WHERE chain_id >= 0 GROUP BY chain_id), s AS (SELECT transaction_id, is_laundering, CASE WHEN ts_s < a THEN 0 WHEN ts_s < b THEN 1 ELSE 2 END AS x, CASE WHEN coalesce(t, ts_s) < a THEN 0 WHEN coalesce(t, ts_s) < b THEN 1 ELSE 2 END AS y FROM tx LEFT JOIN f USING (chain_id), cuts)"


@query("ev04_moved_rows", f"WITH {Q.TX}, {_BOTH} SELECT count(*) FILTER (x <> y) AS moved FROM s")
def ev04(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    cuts = E.quantile_cuts(tx)
    return E.moved(E.split_by_time(tx, cuts), E.split_by_chain(tx, cuts))


@query("ev04_split_summary", f"WITH {Q.TX}, {_BOTH} SELECT y AS bucket, count(*) AS rows, sum(is_laundering)::BIGINT AS illicit, round(avg(is_laundering), 8) AS rate FROM s GROUP BY y")
def ev04b(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return E.split_summary(E.split_by_chain(tx, E.quantile_cuts(tx))).withColumn("rate", F.round("rate", 8))


_CURVE = "curve AS (SELECT score, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS kept, sum(sum(label)) OVER () AS p, sum(count(*)) OVER () AS n, sum(label) AS pos, count(*) AS c FROM {} GROUP BY score)"
_SC = Q.SPLIT + ", " + _CURVE.format("scored")


@query("ev05_retention_thresholds", f"WITH {_SC} SELECT target, max(score) AS threshold FROM curve, {_TARGETS} WHERE tp::DOUBLE / p >= target GROUP BY target")
def ev05(spark, sf_dir):
    return E.retention_thresholds(_scored(spark, sf_dir))


@query("ev06_quantile_threshold", Q.tx("SELECT quantile_cont(score, 1 - 0.95) AS threshold FROM tx WHERE is_laundering = 1"))
def ev06(spark, sf_dir):
    return E.quantile_threshold(_scored(spark, sf_dir), 0.95)


_SPLIT = f"{Q.TX}, {_CUTS}, b AS (SELECT score, is_laundering AS label, CASE WHEN ts_s < a THEN 0 WHEN ts_s < b THEN 1 ELSE 2 END AS bucket FROM tx, cuts), va AS (SELECT * FROM b WHERE bucket = 1), te AS (SELECT * FROM b WHERE bucket = 2)"
_REPORT = "round({k}::DOUBLE / greatest({p}, 1), 8) AS actual_illicit_retained, round(100.0 * ({n} - {r}) / {n}, 8) AS transactions_dropped_pct, ({r})::BIGINT AS transactions_remained_count, ({p} - {k})::BIGINT AS illicit_missed_count"


@query("ev07_retention_table", f"WITH {_SPLIT}, {_CURVE.format('va')}, th AS (SELECT target, max(score) AS threshold FROM curve, {_TARGETS} WHERE tp::DOUBLE / p >= target GROUP BY target), x AS (SELECT target, threshold, count(*) AS n, sum(label) AS p, count(*) FILTER (score >= threshold) AS r, coalesce(sum(label) FILTER (score >= threshold), 0) AS k FROM te, th GROUP BY ALL) SELECT target AS target_retention, printf('%.1f%%', 100 * target) || CASE WHEN target = 0.95 THEN ' (recommended)' ELSE '' END AS label, threshold, {_REPORT.format(k='k', p='p', n='n', r='r')} FROM x")
def ev07(spark, sf_dir):
    return _eight(E.retention_table(*_parts(spark, sf_dir)))


def _eight(df):
    return df.select(*(F.round(c, 8).alias(c) if k == "double" and c not in ("threshold", "target", "target_retention") else F.col(c) for c, k in df.dtypes))


@query("ev08_fixed_recall_table", f"WITH {_SPLIT}, {_CURVE.format('te')}, th AS (SELECT target, max(score) AS threshold FROM curve, {_TARGETS} WHERE tp >= ceil(target * p) GROUP BY target) SELECT target, threshold, {_REPORT.format(k='tp', p='p', n='n', r='kept')} FROM th JOIN curve ON score = threshold")
def ev08(spark, sf_dir):
    return _eight(E.gain_table(_parts(spark, sf_dir)[1]))


@query("ev09_ev11_precision_at_recall", f"WITH {_SC}, th AS (SELECT target, max(score) AS threshold FROM curve, {_TARGETS} WHERE tp::DOUBLE / p >= target GROUP BY target) SELECT target, threshold, round(tp::DOUBLE / kept, 8) AS precision FROM th JOIN curve ON score = threshold")
def ev11(spark, sf_dir):
    return _eight(E.precision_at_recall(_scored(spark, sf_dir), TARGETS))


_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1"


@query("ag25_ag26_confusion", f"WITH {Q.SPLIT}, c AS (SELECT count(*) FILTER (score < 0.7 AND label = 0) AS tn, count(*) FILTER (score >= 0.7 AND label = 0) AS fp, count(*) FILTER (score < 0.7 AND label = 1) AS fn, count(*) FILTER (score >= 0.7 AND label = 1) AS tp FROM scored) SELECT *, {_RATES} FROM c")
def ag25(spark, sf_dir):
    return _eight(E.rates(E.confusion(_scored(spark, sf_dir), 0.7)))


_AUC = "(SELECT sum(pos * ((n - p) - (kept - tp) + (c - pos) / 2.0)) / (max(p) * (max(n) - max(p))) FROM curve)"
_AP = "(SELECT sum(pos * (tp / kept)) / max(p) FROM curve)"


@query("ev10_operating_point", f"WITH {_SC}, c AS (SELECT count(*) FILTER (score < 0.7 AND label = 0) AS tn, count(*) FILTER (score >= 0.7 AND label = 0) AS fp, count(*) FILTER (score < 0.7 AND label = 1) AS fn, count(*) FILTER (score >= 0.7 AND label = 1) AS tp FROM scored) SELECT *, tn + fp + fn + tp AS rows, tp + fn AS illicit, 0.7::DOUBLE AS threshold, tn + fn AS dropped, round((tn + fn) / (tn + fp + fn + tp), 8) AS drop_rate, fp + tp AS kept, round(tp / greatest(tp + fn, 1), 8) AS illicit_retention, round(tp / greatest(tp + fp, 1), 8) AS precision_among_kept, round({_AUC}, 8) AS roc_auc, round({_AP}, 8) AS pr_auc FROM c")
def ev10(spark, sf_dir):
    return _eight(E.operating_point(_scored(spark, sf_dir), 0.7))


_GRID = "g AS (SELECT t AS threshold, count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score >= t AND label = 1) AS tp FROM scored, (SELECT unnest([{}]) AS t) GROUP BY t), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM g)"
_POINTS = ", ".join(f"{p}::DOUBLE" for p in E.SWEEP)


@query("ev12_ev16_best_threshold", f"WITH {Q.SPLIT}, {_GRID.format(_POINTS)} SELECT round(f, 8) AS f1, threshold, round(pr, 8) AS precision, round(re, 8) AS recall FROM r ORDER BY f DESC, threshold LIMIT 1")
def ev12(spark, sf_dir):
    return _eight(E.best_threshold(_scored(spark, sf_dir)))


@query("ev13_pr_auc_on_grid", f"WITH {Q.SPLIT}, {_GRID.format(', '.join(f'{k}::DOUBLE / 200' for k in range(201)))}, q AS (SELECT threshold, round(pr, 6) AS p, round(re, 6) AS r FROM r), s AS (SELECT r - lag(r) OVER (ORDER BY r, threshold) AS d, p + lag(p) OVER (ORDER BY r, threshold) AS b FROM q) SELECT round(sum(d * b / 2), 5) AS auc_pr FROM s")
def ev13(spark, sf_dir):
    return E.grid_pr_auc(_scored(spark, sf_dir)).select(F.round("auc_pr", 5).alias("auc_pr"))


@query("ev14_roc_auc", f"WITH {_SC} SELECT round({_AUC}, 9) AS roc_auc")
def ev14(spark, sf_dir):
    return E.roc_auc(_scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("ev15_average_precision", f"WITH {_SC} SELECT round({_AP}, 9) AS pr_auc")
def ev15(spark, sf_dir):
    return E.average_precision(_scored(spark, sf_dir)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query("ev17_split_gap", f"WITH {Q.TX}, {_BOTH} SELECT round(100.0 * (avg(is_laundering) FILTER (x = 2) - avg(is_laundering) FILTER (y = 2)), 8) AS gap_pp FROM s")
def ev17(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    cuts = E.quantile_cuts(tx)
    rate = lambda split: E.split_summary(split).where("bucket = 2").select("rate")
    return E.leakage_gap(rate(E.split_by_time(tx, cuts)), rate(E.split_by_chain(tx, cuts)), "rate").select(F.round("gap_pp", 8).alias("gap_pp"))


@query("ev18_parity", Q.tx("SELECT * FROM (SELECT 'rows' AS measure, count(*)::VARCHAR AS \"left\", count(*)::VARCHAR AS \"right\", true AS equal FROM tx UNION ALL SELECT 'columns', 'score,transaction_id', 'score,transaction_id', true UNION ALL SELECT 'nulls', '0', '0', true)"))
def ev18(spark, sf_dir):
    a = T.transactions(spark, sf_dir).select("transaction_id", "score")
    return P.parity(a, a.repartition(3)).where("measure IN ('rows', 'columns', 'nulls')")


@query("ev19_savings", f"WITH {_SPLIT}, {_CURVE.format('va')}, th AS (SELECT target, max(score) AS threshold FROM curve, {_TARGETS} WHERE tp::DOUBLE / p >= target GROUP BY target) SELECT target AS target_retention, count(*) FILTER (score < threshold) * 839168 AS saved_bytes, round((count(*) FILTER (score < threshold) * 4.31)::DOUBLE, 2) AS saved_seconds FROM te, th GROUP BY ALL")
def ev19(spark, sf_dir):
    valid, test = _parts(spark, sf_dir)
    return E.savings(E.retention_table(valid, test), test.count()).select("target_retention", F.col("saved_bytes").cast("long").alias("saved_bytes"), F.round("saved_seconds", 2).alias("saved_seconds"))


@query("ag27_match_rate", Q.tx("SELECT label, round(100.0 * avg((a = b)::INT), 8) AS match_pct, count(*) AS rows FROM (SELECT is_laundering AS label, (score >= 0.6)::INT AS a, (score >= 0.7)::INT AS b FROM tx) GROUP BY label"))
def ag27(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"a": (F.col("score") >= 0.6).cast("int"), "b": (F.col("score") >= 0.7).cast("int")})
    return _eight(E.match_rate(rows, "a", "b", "label"))


@query("ag28_bootstrap_f1")
def ag28(spark, sf_dir):
    return E.bootstrap_f1(_scored(spark, sf_dir), 0.7)


@query("ag29_class_weight", Q.tx("SELECT round(count(*) FILTER (is_laundering = 0) / greatest(count(*) FILTER (is_laundering = 1), 1), 8) AS weight FROM tx"))
def ag29(spark, sf_dir):
    return E.class_weight(_scored(spark, sf_dir)).select(F.round("weight", 8).alias("weight"))


@query("cp13_flag_table", Q.tx("SELECT transaction_id + 1 AS transaction_id, score >= (SELECT quantile_cont(score, 1 - 0.95) FROM tx WHERE is_laundering = 1) AS is_kept, score::FLOAT AS risk_score, transaction_id + 1 AS staging_transaction_id, from_account FROM tx"))
def cp13(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    (threshold,) = E.quantile_threshold(rows, 0.95).first()
    return P.flag_table(rows, threshold, 1, ("from_account",))


_REF = "'sha256:' || sha256('tx-ref-v1' || concat_ws('|', 'pay-v1', ts_s, from_bank, from_account, to_bank, to_account, printf('%.1f', amount_paid), payment_currency, payment_format, row_number() OVER (PARTITION BY ts_s, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format ORDER BY transaction_id) - 1))"


@query("cp14_flt09_snapshot_flags", Q.tx(f"SELECT printf('e%09d', transaction_id) AS edge_id, score >= 0.6 AS inference_flag, '7' AS flag_source_bank, 'm2_lr_p95_v1' AS selection_policy_id FROM tx WHERE from_bank = 7"))
def cp14(spark, sf_dir):
    from ..functions.scalars import policy_id

    tx = P.payment_references(T.transactions(spark, sf_dir))
    edges = tx.select(F.format_string("e%09d", "transaction_id").alias("edge_id"), "tx_ref_hash", F.col("from_bank").cast("string").alias("reporting_bank"))
    flags = tx.select("tx_ref_hash", (F.col("score") >= 0.6).alias("is_kept"))
    return P.snapshot_flags(edges, flags, "7", policy_id(0.95))


@query("sc05_payment_references", Q.tx(f"SELECT transaction_id, {_REF} AS tx_ref_hash FROM tx"))
def sc05(spark, sf_dir):
    return P.payment_references(T.transactions(spark, sf_dir)).select("transaction_id", "tx_ref_hash")


@query("sc07_content_fingerprint")
def sc07(spark, sf_dir):
    return P.fingerprint(T.table(spark, sf_dir, "orders"))
