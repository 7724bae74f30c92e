"""Queries for the steps that larger queries are made of: file sources, lookups, pruning, shares of aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S, windows as W
from ..functions.workers import shared_path
from ..operators import evaluation as E, features as X, graph as R, ml as M, publish as P, staging as G
from ..sources import tables as T
from ..sources.constants import RAW_TIMESTAMP
from . import sql as Q
from .graphs import _TEMPORAL, _TEMPORAL_WHOLE, _edges
from .registry import query
from .scans import _raw_text


def _written(spark, sf_dir, name, df, text=True):
    path = shared_path(spark, name)
    if text:
        df.write.mode("overwrite").text(path)
    else:
        P.write_csv(df, path)
    return path


_RAW = "SELECT ts_s, from_bank::VARCHAR AS from_bank, from_account::VARCHAR AS from_account, to_bank::VARCHAR AS to_bank, to_account::VARCHAR AS to_account, amount_paid FROM tx"


@query("src01_csv_explicit_schema", Q.tx("SELECT ts_s, amount_received, payment_format, is_laundering FROM tx"))
def src01(spark, sf_dir):
    path = _written(spark, sf_dir, "src01", T.transactions(spark, sf_dir).select(_raw_text(None)))
    return T.read_raw(spark, path, header=False).select(F.unix_seconds("timestamp").alias("ts_s"), "amount_received", "payment_format", "is_laundering")


@query("src03_coded_scan", Q.tx("SELECT ts_s::INT AS ts_s, amount_paid::FLOAT AS amount_paid, (dense_rank() OVER (ORDER BY payment_format) - 1)::TINYINT AS format_code FROM tx"))
def src03(spark, sf_dir):
    """The compact scan: narrow types and coded values; splits take the place of chunks."""
    path = _written(spark, sf_dir, "src03", T.transactions(spark, sf_dir).select(_raw_text(None)))
    raw = T.read_raw(spark, path, header=False)
    coded = S.encoded(raw, "payment_format", S.label_codes(raw, "payment_format"), "format_code")
    return coded.select(F.unix_seconds("timestamp").cast("int").alias("ts_s"), F.col("amount_paid").cast("float").alias("amount_paid"), F.col("format_code").cast("byte").alias("format_code"))


@query("src05_src06_string_identifiers", Q.tx(_RAW))
def src05(spark, sf_dir):
    """Identifiers stay strings; only the key columns are read."""
    path = _written(spark, sf_dir, "src05", T.transactions(spark, sf_dir).select(_raw_text(None)))
    return T.read_raw(spark, path, header=False).select(F.unix_seconds("timestamp").alias("ts_s"), "from_bank", "from_account", "to_bank", "to_account", "amount_paid")


@query("src07_src08_pattern_blocks", Q.tx("SELECT k AS chain_id, CASE WHEN k % 2 = 0 THEN 'cycle' ELSE 'fan-out' END AS type, CASE WHEN k % 2 = 0 THEN 'max 3 hops' ELSE 'fan-out' END AS sub_type, ts_s, from_account::VARCHAR AS from_account FROM (SELECT *, row_number() OVER (ORDER BY transaction_id) - 1 AS k FROM tx WHERE is_laundering = 1)"))
def src07(spark, sf_dir):
    """One block per labelled payment, written as a pattern file and parsed again."""
    tx = T.transactions(spark, sf_dir).where("is_laundering = 1").withColumn("k", F.row_number().over(W.Window.orderBy("transaction_id")) - 1)
    title = F.when(F.col("k") % 2 == 0, F.lit("CYCLE:  Max 3 hops")).otherwise(F.lit("FAN-OUT"))
    lines = F.array(F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), title), _raw_text(None), F.concat(F.lit("END LAUNDERING ATTEMPT - "), title), F.lit(""))
    text = tx.select("k", F.posexplode(lines).alias("p", "line")).orderBy("k", "p").select("line").coalesce(1)
    found = T.read_patterns(spark, _written(spark, sf_dir, "src07", text))
    return found.select("chain_id", "type", "sub_type", F.unix_seconds(F.to_timestamp("timestamp", RAW_TIMESTAMP)).alias("ts_s"), "from_account")


@query("src11_account_lookup", "SELECT lpad(c_custkey::VARCHAR, 9, '0') AS account, c_name AS entity FROM customer")
def src11(spark, sf_dir):
    accounts = T.table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("Account Number"), F.col("c_name").alias("Entity ID"))
    return T.read_accounts(spark, _written(spark, sf_dir, "src11", accounts, text=False))


@query("src13_local_rows", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, 'b')) AS t(k, v)")
def src13(spark, sf_dir):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")


@query("snk02_checkpoint", Q.tx("SELECT count(*) AS rows, sum(amount_paid) AS amount FROM tx"))
def snk02(spark, sf_dir):
    """The lineage is cut by a written copy in the shared folder."""
    path = shared_path(spark, "snk02")
    P.write_parquet(T.transactions(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_paid").alias("amount"))


@query("snk05_json_metadata", "SELECT '{\"rows\": 25, \"target_retention\": 0.95}' AS value")
def snk05(spark, sf_dir):
    nation, path = T.table(spark, sf_dir, "nation"), shared_path(spark, "snk05")
    P.write_json_row({"target_retention": 0.95, "rows": nation.count()}, nation, path)
    return spark.read.text(path)


@query("snk07_matrix_files", Q.tx("SELECT transaction_id, is_laundering, amount_paid::FLOAT AS amount_paid, score::FLOAT AS score FROM tx"))
def snk07(spark, sf_dir):
    path = shared_path(spark, "snk07")
    P.write_matrix(T.transactions(spark, sf_dir), path, ("amount_paid", "score"), 3)
    return spark.read.parquet(path)


@query("prj11_sorted_columns", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def prj11(spark, sf_dir):
    df = T.table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey", "n_name")
    return df.select(sorted(df.columns))


@query("flt03_jn17_cycles", f"WITH {Q.EDGES}, {_TEMPORAL} SELECT dispense, passthrough, amount FROM f WHERE dispense = sink")
def flt03(spark, sf_dir):
    return R.temporal_flows(_edges(spark, sf_dir), 10).where("dispense = sink").select("dispense", "passthrough", "amount")


@query("flt03_jn17_cycles_whole", f"WITH {Q.EDGES}, {_TEMPORAL_WHOLE} SELECT dispense, passthrough, amount FROM f WHERE dispense = sink")
def flt03_whole(spark, sf_dir):
    return R.temporal_flows(_edges(spark, sf_dir)).where("dispense = sink").select("dispense", "passthrough", "amount")


@query("flt05_positive_groups", Q.edges("SELECT n, d FROM (SELECT n, sum(d) AS d FROM (SELECT target AS n, amount AS d FROM e UNION ALL SELECT source, -amount FROM e) GROUP BY n) WHERE d > 0"))
def flt05(spark, sf_dir):
    legs = _edges(spark, sf_dir).select(F.inline(F.array(F.struct(F.col("target").alias("n"), F.col("amount").alias("d")), F.struct(F.col("source").alias("n"), (-F.col("amount")).alias("d")))))
    return legs.groupBy("n").agg(F.sum("d").alias("d")).where("d > 0")


@query("flt06_wn01_wn02_top_n", Q.edges("SELECT source, target, amount FROM tot QUALIFY row_number() OVER (PARTITION BY target ORDER BY amount DESC, source) <= 3"))
def flt06(spark, sf_dir):
    return R._top(R.edge_totals(_edges(spark, sf_dir)), "target", "source", 3)


@query("jn04_anchor_join", Q.edges("SELECT t.source, t.target, least(t.amount, c.total) AS amount FROM tot t JOIN (SELECT source AS k, sum(amount) AS total FROM tot GROUP BY ALL) c ON c.k = t.source WHERE t.source % 5 = 0"))
def jn04(spark, sf_dir):
    totals = R.edge_totals(_edges(spark, sf_dir))
    anchors = R.node_totals(totals, "source").where("node % 5 = 0")
    return totals.join(anchors, F.col("source") == F.col("node")).select("source", "target", F.least("amount", "total").alias("amount"))


def _anchor_sql(variant: str, side: str, cap: str, both: bool) -> str:
    anchors = f"WHERE {cap} IN (SELECT {side} FROM tot)" if both else ""
    return f"SELECT '{variant}' AS variant, source, target, least(t.amount, c.total) AS amount FROM tot t JOIN (SELECT {cap} AS k, sum(amount) AS total FROM tot {anchors} GROUP BY {cap}) c ON c.k = t.{side}"


@query("jn04_all_anchors", Q.edges(" UNION ALL ".join(_anchor_sql(v, *x) for v, x in R.FLOW_VARIANTS.items())))
def jn04_all(spark, sf_dir):
    """jn04 with the real anchors of each flow variant: all accounts of a side, or those on both sides."""
    totals = R.edge_totals(_edges(spark, sf_dir))
    parts = []
    for variant, (side, cap, both) in R.FLOW_VARIANTS.items():
        anchors = R.node_totals(totals, cap)
        if both:
            anchors = anchors.join(totals.select(F.col(side).alias("node")).distinct(), "node", "left_semi")
        parts.append(totals.join(anchors, F.col(side) == F.col("node")).select(F.lit(variant).alias("variant"), "source", "target", F.least("amount", "total").alias("amount")))
    return reduce(DataFrame.unionByName, parts)


@query("jn05_sc18_two_hop_bottleneck", Q.edges("SELECT a.source, b.target, sum(least(a.amount, b.amount)) AS amount FROM (SELECT * FROM tot WHERE source < 100) a JOIN tot b ON a.target = b.source WHERE a.source <> b.target GROUP BY ALL"))
def jn05(spark, sf_dir):
    totals = R.edge_totals(_edges(spark, sf_dir))
    left = totals.where("source < 100").select(F.col("source").alias("first"), F.col("target").alias("via"), F.col("amount").alias("a"))
    joined = left.join(totals, F.col("via") == F.col("source")).where("first <> target")
    return joined.groupBy(F.col("first").alias("source"), "target").agg(F.sum(F.least("a", "amount")).alias("amount"))


@query("jn05_two_hop_all_edges")
def jn05_all(spark, sf_dir):
    """jn05_sc18 over all edges; parallel payments are summed first, so a middle account pairs relations, not payments."""
    totals = R.edge_totals(_edges(spark, sf_dir))
    left = totals.select(F.col("source").alias("first"), F.col("target").alias("via"), F.col("amount").alias("a"))
    joined = left.join(totals, F.col("via") == F.col("source")).where("first <> target")
    return joined.groupBy(F.col("first").alias("source"), "target").agg(F.sum(F.least("a", "amount")).alias("amount"))


@query("jn08_jn10_weights_on_edges", Q.edges("SELECT e.transaction_id, round(w.weight, 8) AS weight FROM e LEFT JOIN (SELECT source, target, amount / sum(amount) OVER (PARTITION BY source) + amount / sum(amount) OVER (PARTITION BY target) AS weight FROM tot) w USING (source, target)"))
def jn08(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return e.join(R.edge_weights(R.edge_totals(e)).select("source", "target", "weight"), ["source", "target"], "left").select("transaction_id", F.round("weight", 8).alias("weight"))


@query("jn16_features_on_totals", Q.edges("SELECT s.k AS key, s.total, f.amount AS largest FROM (SELECT source AS k, sum(amount) AS total FROM tot GROUP BY ALL) s LEFT JOIN (SELECT source AS k, max(amount) AS amount FROM tot WHERE amount > 6000 GROUP BY ALL) f USING (k)"))
def jn16(spark, sf_dir):
    totals = R.edge_totals(_edges(spark, sf_dir))
    largest = totals.where("amount > 6000").groupBy(F.col("source").alias("node")).agg(F.max("amount").alias("largest"))
    return R.node_totals(totals, "source").join(largest, "node", "left").select(F.col("node").alias("key"), "total", "largest")


@query("jn25_gather_by_id", Q.tx("SELECT f.transaction_id, t.from_account, t.ts_s FROM (SELECT transaction_id FROM tx WHERE score >= 0.9) f JOIN tx t USING (transaction_id)"))
def jn25(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return tx.where("score >= 0.9").select("transaction_id").join(tx.select("transaction_id", "from_account", "ts_s"), "transaction_id")


@query("ag08_pair_flow_sums", f"WITH {Q.EDGES}, {_TEMPORAL} SELECT passthrough, count(*) AS flows, sum(amount) AS amount FROM f GROUP BY passthrough")
def ag08(spark, sf_dir):
    return R.temporal_flows(_edges(spark, sf_dir), 10).groupBy("passthrough").agg(F.count(F.lit(1)).alias("flows"), F.sum("amount").alias("amount"))


@query("ag08_pair_flow_sums_whole", f"WITH {Q.EDGES}, {_TEMPORAL_WHOLE} SELECT passthrough, count(*) AS flows, sum(amount) AS amount FROM f GROUP BY passthrough")
def ag08_whole(spark, sf_dir):
    return R.temporal_flows(_edges(spark, sf_dir)).groupBy("passthrough").agg(F.count(F.lit(1)).alias("flows"), F.sum("amount").alias("amount"))


@query("ag10_edge_counts", Q.edges("SELECT source, target, count(*) AS payments FROM e GROUP BY ALL"))
def ag10(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("source", "target").agg(F.count(F.lit(1)).alias("payments"))


@query("ag11_hop_arrays", Q.edges("SELECT source, array_to_string(list(target ORDER BY target), ',') AS nodes, list_sum(list(amount)) AS total FROM tot GROUP BY source"))
def ag11(spark, sf_dir):
    arrays = R.edge_totals(_edges(spark, sf_dir)).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("target", "amount"))).alias("a"))
    return arrays.select("source", F.array_join(F.col("a.target").cast("array<string>"), ",").alias("nodes"), F.aggregate("a.amount", F.lit(0.0), lambda x, y: x + y).alias("total"))


_SIDED = "per AS (SELECT source_bank::BIGINT AS key, target, sum(amount) AS a FROM e GROUP BY ALL)"


@query("ag12_ag13_sided_amounts", f"WITH {Q.EDGES}, {_SIDED} SELECT key, max(a) AS max_credit_edges, round(avg(a), 4) AS mean_credit_edges, median(a) AS median_credit_edges, round(stddev_pop(a), 4) AS std_credit_edges FROM per GROUP BY key")
def ag12(spark, sf_dir):
    members = _edges(spark, sf_dir).withColumns({"key": F.col("source_bank").cast("long"), "amount_weighted": F.col("amount")})
    df = R.sided_amounts(members)
    return df.select("key", "max_credit_edges", F.round("mean_credit_edges", 4).alias("mean_credit_edges"), "median_credit_edges", F.round("std_credit_edges", 4).alias("std_credit_edges"))


@query("ag15_segments", Q.edges("SELECT key, count(*) FILTER (s) AS num_sources, count(*) FILTER (t) AS num_targets, count(*) AS num_source_or_target, count(*) FILTER (s AND t) AS num_source_and_target, count(*) FILTER (s AND NOT t) AS num_source_only, count(*) FILTER (t AND NOT s) AS num_target_only FROM (SELECT key, n, bool_or(s) AS s, bool_or(t) AS t FROM (SELECT source_bank::BIGINT AS key, source AS n, true AS s, false AS t FROM e UNION ALL SELECT source_bank::BIGINT, target, false, true FROM e) GROUP BY ALL) GROUP BY key"))
def ag15(spark, sf_dir):
    return R.segments(_edges(spark, sf_dir).withColumn("key", F.col("source_bank").cast("long")), "source", "target")


@query("ag18_ag19_time_spread", Q.tx("SELECT from_account, min(ts_s) AS first_trx, max(ts_s) - min(ts_s) AS ts_range, round(stddev_samp(ts_s), 4) AS ts_std FROM tx GROUP BY from_account"))
def ag18(spark, sf_dir):
    return T.transactions(spark, sf_dir).groupBy("from_account").agg(F.min("ts_s").alias("first_trx"), (F.max("ts_s") - F.min("ts_s")).alias("ts_range"), F.round(F.stddev_samp("ts_s"), 4).alias("ts_std"))


@query("wn27_amount_against_past", Q.obs(f"SELECT p.transaction_id, round(s / (coalesce(coalesce(before, 0) / nullif(own_n, 0), 0) + 1.0), 6) AS sender_amount_24h_vs_prev_mean FROM (SELECT transaction_id, greatest({Q.trailing('sum(amount_paid)', Q.OWN, 86400)} - amount_paid, 0) AS s, sum(amount_paid) OVER ownp AS before FROM pay WINDOW {Q.WINDOWS}) p JOIN (SELECT transaction_id, role_ord, row_number() OVER own - 1 AS own_n FROM obs WINDOW {Q.WINDOWS}) n ON n.transaction_id = p.transaction_id AND n.role_ord = 0"))
def wn27(spark, sf_dir):
    payers = X.payer_rows(X.bursts(X.base(X.observations(T.transactions(spark, sf_dir)), ())))
    return X.behaviour_shift(payers).select("transaction_id", F.round("sender_amount_24h_vs_prev_mean", 6).alias("sender_amount_24h_vs_prev_mean"))


@query("st04_output_order", Q.tx("SELECT transaction_id, score::FLOAT AS risk_score FROM tx ORDER BY transaction_id"))
def st04(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", F.col("score").cast("float").alias("risk_score")).orderBy("transaction_id")


@query("so02_union_of_views", Q.obs("SELECT role_ord::BIGINT AS role_ord, count(*) AS rows, count(DISTINCT own_account) AS accounts FROM obs GROUP BY role_ord"))
def so02(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    views = tx.select(F.lit(0).cast("long").alias("role_ord"), F.col("from_account").alias("own_account")).unionByName(tx.select(F.lit(1).cast("long").alias("role_ord"), F.col("to_account").alias("own_account")))
    return views.groupBy("role_ord").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("own_account").alias("accounts"))


@query("cp08_cp09_pooled_features", Q.obs(f"SELECT transaction_id, role_ord::BIGINT AS role_ord, row_number() OVER own - 1 AS own_account_prev_count, row_number() OVER same - 1 AS same_amount_cnt, ({Q.trailing('count(*)', Q.OWN, 86400)})::BIGINT AS tx_24h FROM obs WINDOW {Q.WINDOWS}"))
def cp08(spark, sf_dir):
    df = X.bursts(X.base(X.observations(T.transactions(spark, sf_dir)), ()))
    return df.select("transaction_id", F.col("role_ord").cast("long").alias("role_ord"), "own_account_prev_count", "same_amount_cnt", "tx_24h")


@query("ml08_encoded_matrix", Q.tx("SELECT transaction_id, is_laundering, (dense_rank() OVER (ORDER BY payment_format) - 1)::FLOAT AS payment_format, amount_paid::FLOAT AS amount_paid FROM tx"))
def ml08(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    coded = S.encoded(tx, "payment_format", S.label_codes(tx, "payment_format"), "code").drop("payment_format").withColumnRenamed("code", "payment_format")
    return coded.select("transaction_id", "is_laundering", S.clean("payment_format").alias("payment_format"), S.clean("amount_paid").alias("amount_paid"))


@query("ml03_snk08_saved_model", Q.tx("SELECT count(*) AS rows, 0::BIGINT AS different FROM tx"))
def ml03(spark, sf_dir):
    """Boosted trees, saved and loaded again: both score alike."""
    from pyspark.ml import PipelineModel

    names = ("log_amount_paid", "own_account_prev_count")
    rows = M.prepared(X.sender_features(T.transactions(spark, sf_dir), "old", formats=()), names).persist()
    model, path = M.boosted_pipeline(rows, names, trees=2), shared_path(spark, "model")
    model.write().overwrite().save(path)
    a, b = M.scored(model, rows), M.scored(PipelineModel.load(path), rows).select("transaction_id", F.col("score").alias("again"))
    return a.join(b, "transaction_id").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("score") != F.col("again")).cast("long")).alias("different"))


@query("ev05_unreached_target", "SELECT 1.0::DOUBLE AS target, 0.0::DOUBLE AS threshold")
def ev05b(spark, sf_dir):
    """Without positives no score reaches a target: the threshold is 0."""
    rows = T.transactions(spark, sf_dir).withColumn("label", F.lit(0))
    return E.retention_thresholds(rows, (1.0,))


@query("jn22_unmatched_lines_skipped", "SELECT o_orderpriority AS value FROM orders WHERE o_orderkey = 0")
def jn22b(spark, sf_dir):
    lines = T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where("o_orderkey = 0").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("value"))
    wanted = lines.select("value").union(spark.createDataFrame([("no such line",)], "value string"))
    return G.matched_lines(lines, wanted, "skip").select("value")
