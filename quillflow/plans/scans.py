"""Queries over sources, projections, filters, sorts, sampling, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, windows as W
from ..functions.workers import shared_path
from ..operators import evaluation as E, features as X, publish as P, staging as G
from ..sources import tables as T
from ..sources.constants import RAW_COLUMNS
from . import sql as Q
from .registry import query


@query("src09_parquet_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src09(spark, sf_dir):
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")


@query("src10_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def src10(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")


@query("src12_schema", "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) AS t(ordinal, name, type)")
def src12(spark, sf_dir):
    return T.schema_of(spark, f"{sf_dir}/orders.parquet")


@query("src14_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def src14(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return T.with_position(orders, ("o_orderkey",), F.floor(F.col("o_orderkey") / 4096), "position", limit=100).drop("position")


def _raw_text(tx, *extra):
    """Transactions in the raw file's columns, as one line of text each."""
    stamp = F.date_format(F.timestamp_seconds("ts_s"), "yyyy/MM/dd HH:mm")
    columns = {"timestamp": stamp}
    return F.concat_ws(",", *(columns.get(c, F.col(c).cast("string")) if c != "is_laundering" else F.col(c).cast("string") for c in RAW_COLUMNS), *extra)


@query("src02_raw_file_round_trip", Q.tx(f"SELECT ts_s, from_bank::VARCHAR AS from_bank, from_account::VARCHAR AS from_account, round(amount_paid * rate, 4) AS usd_paid, is_laundering FROM tx JOIN {Q.RATES} ON name = payment_currency"))
def src02(spark, sf_dir):
    """Writes raw transaction files to the shared folder and reads them under the explicit schema, amounts in US dollars."""
    path = shared_path(spark, "raw")
    T.transactions(spark, sf_dir).select(_raw_text(None)).write.mode("overwrite").text(path)
    raw = T.read_raw(spark, path, header=False)
    return raw.select(F.unix_seconds("timestamp").alias("ts_s"), "from_bank", "from_account", F.round(S.in_usd("amount_paid", "payment_currency"), 4).alias("usd_paid"), "is_laundering")


@query("src04_numbered_lines", "SELECT (o_orderkey + 0)::BIGINT AS line_no, o_orderkey::VARCHAR || '|' || o_orderpriority AS value FROM orders")
def src04(spark, sf_dir):
    """Lines of sorted text files, numbered in file order; the key of the n-th order is n."""
    path = shared_path(spark, "lines")
    orders = T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").orderBy("o_orderkey")
    orders.select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")).coalesce(1).write.mode("overwrite").text(path)
    return T.read_lines(spark, path, header=False).select("line_no", "value")


@query("prj01_select_alias", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def prj01(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("prj02_rename_all", "SELECT n_nationkey AS g_n_nationkey, n_name AS g_n_name, n_regionkey AS g_n_regionkey FROM nation")
def prj02(spark, sf_dir):
    df = T.table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return df.withColumnsRenamed({c: f"g_{c}" for c in df.columns})


@query("prj03_drop_columns", "SELECT n_nationkey, n_name FROM nation")
def prj03(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").drop("n_regionkey")


@query("prj04_cast_label", Q.tx("SELECT transaction_id, is_laundering = 1 AS is_laundering FROM tx"))
def prj04(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", F.col("is_laundering").cast("boolean").alias("is_laundering"))


@query("prj05_downcast", "SELECT l_orderkey::INT AS l_orderkey, l_quantity::FLOAT AS l_quantity FROM lineitem")
def prj05(spark, sf_dir):
    df = T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
    smaller = {"bigint": "int", "double": "float"}
    return df.select(*(F.col(c).cast(smaller.get(k, k)).alias(c) for c, k in df.dtypes))


@query("prj06_literals", "SELECT n_nationkey, 'bank007' AS flag_source_bank, 'm2_lr_p95_v1' AS selection_policy_id FROM nation")
def prj06(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").select("n_nationkey", F.lit("bank007").alias("flag_source_bank"), F.lit(S.policy_id(0.95)).alias("selection_policy_id"))


@query("prj07_inter_currency", Q.tx("SELECT transaction_id, payment_currency <> receiving_currency AS inter_currency FROM tx"))
def prj07(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", (F.col("payment_currency") != F.col("receiving_currency")).alias("inter_currency"))


@query("prj08_feature_groups", "SELECT * FROM (VALUES (0, 'log_amount_paid'), (1, 'log_amount_received'), (2, 'same_currency'), (3, 'own_account_prev_count'), (4, 'counterparty_prev_count'), (5, 'same_amount_cnt')) AS t(ordinal, name)")
def prj08(spark, sf_dir):
    """The compact core without formats and times between payments: groups and single features left out."""
    names = X.choose(X.feature_sets(("payment_format_wire",))["compact_core"][0], (), ("payment_format_", "time_since_last_tx_own", "time_since_last_tx_counterparty"))
    return spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")


@query("prj09_common_columns", "SELECT * FROM (VALUES ('a'), ('b')) AS t(name)")
def prj09(spark, sf_dir):
    frames = [spark.range(1).selectExpr(*(f"id AS {c}" for c in cs)) for cs in ("abc", "bad", "abe")]
    return spark.createDataFrame([(c,) for c in sorted(set.intersection(*(set(f.columns) for f in frames)))], "name string")


@query("prj10_drop_constants", "SELECT n_nationkey AS key, n_name, n_regionkey FROM nation")
def prj10(spark, sf_dir):
    from ..operators.graph import varying_columns

    df = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey", "n_name", F.lit(7).alias("constant"), F.lit(None).cast("int").alias("empty"))
    return varying_columns(df)


@query("flt01_no_self_payments", Q.tx("SELECT count(*) AS rows FROM tx WHERE from_account <> to_account"))
def flt01(spark, sf_dir):
    return T.transactions(spark, sf_dir).where("from_account <> to_account").agg(F.count(F.lit(1)).alias("rows"))


@query("flt02_label_filter", Q.tx("SELECT transaction_id, amount_paid FROM tx WHERE is_laundering = 1"))
def flt02(spark, sf_dir):
    return T.transactions(spark, sf_dir).where("is_laundering = 1").select("transaction_id", "amount_paid")


@query("flt07_threshold_filter", Q.tx("SELECT transaction_id, score >= 0.7 AS is_kept FROM tx"))
def flt07(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", (F.col("score") >= 0.7).alias("is_kept"))


@query("flt11_unique_ids", Q.tx("SELECT count(*) = count(DISTINCT transaction_id) AS is_unique FROM tx"))
def flt11(spark, sf_dir):
    return T.transactions(spark, sf_dir).agg((F.count(F.lit(1)) == F.count_distinct("transaction_id")).alias("is_unique"))


@query("st01_sort_by_time", Q.tx("SELECT transaction_id, ts_s FROM tx ORDER BY ts_s, transaction_id"))
def st01(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", "ts_s").orderBy("ts_s", "transaction_id")


@query("st05_top_edges", Q.edges("SELECT source, target, amount FROM tot QUALIFY row_number() OVER (PARTITION BY source ORDER BY amount DESC, target) <= 5"))
def st05(spark, sf_dir):
    from ..operators import graph as R

    return R._top(R.edge_totals(R.as_edges(T.transactions(spark, sf_dir))), "source", "target", 5)


@query("st06_head", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def st06(spark, sf_dir):
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey")


@query("st07_train_subsample", Q.tx("SELECT label, CASE WHEN label = 1 THEN n ELSE least(n, 500) END AS rows FROM (SELECT is_laundering AS label, count(*) AS n FROM tx GROUP BY ALL)"))
def st07(spark, sf_dir):
    rows = T.transactions(spark, sf_dir).withColumn("label", F.col("is_laundering"))
    return E.train_subsample(rows, 500).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("st08_random_rows", Q.tx("SELECT 300::BIGINT AS rows, 300::BIGINT AS ids, count(*) AS every FROM tx"))
def st08(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    some = E.random_rows(tx, 300).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("transaction_id").alias("ids"))
    return some.crossJoin(E.random_rows(tx, 0).agg(F.count(F.lit(1)).alias("every")))


@query("st10_by_absolute_value", "SELECT * FROM (SELECT n_nationkey, (n_nationkey - 10)::DOUBLE AS c, row_number() OVER (ORDER BY abs(n_nationkey - 10) DESC, n_nationkey)::INT AS rank FROM nation) WHERE n_nationkey < 10")
def st10(spark, sf_dir):
    df = T.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") - 10).cast("double").alias("c"))
    ranked = df.withColumn("rank", F.row_number().over(W.Window.orderBy(F.abs("c").desc(), "n_nationkey")))
    return ranked.where("n_nationkey < 10")


@query("so01_union_all", Q.tx("SELECT count(*) AS rows FROM tx WHERE transaction_id % 3 < 2"))
def so01(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    return tx.where("transaction_id % 3 = 0").unionByName(tx.where("transaction_id % 3 = 1")).agg(F.count(F.lit(1)).alias("rows"))


@query("so03_distinct", Q.tx("SELECT DISTINCT from_bank, to_bank FROM tx"))
def so03(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("from_bank", "to_bank").distinct()


@query("so04_node_sets", Q.tx("SELECT (SELECT count(*) FROM (SELECT from_account FROM tx UNION SELECT to_account FROM tx)) AS either, (SELECT count(*) FROM (SELECT from_account FROM tx INTERSECT SELECT to_account FROM tx)) AS both_sides, (SELECT count(*) FROM (SELECT from_account FROM tx EXCEPT SELECT to_account FROM tx)) AS senders_only"))
def so04(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    a, b = tx.select(F.col("from_account").alias("n")), tx.select(F.col("to_account").alias("n"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a.union(b).distinct(), "either").crossJoin(n(a.intersect(b), "both_sides")).crossJoin(n(a.subtract(b), "senders_only"))


@query("so05_schema_difference", "SELECT * FROM (VALUES ('l_comment', 'missing'), ('l_tax', 'extra')) AS t(name, side)")
def so05(spark, sf_dir):
    have, want = {"l_orderkey", "l_tax"}, {"l_orderkey", "l_comment"}
    return spark.createDataFrame([*((c, "missing") for c in sorted(want - have)), *((c, "extra") for c in sorted(have - want))], "name string, side string")


@query("sc01_concat_currency", Q.tx(f"SELECT transaction_id, from_account::VARCHAR || '-' || code AS source FROM tx JOIN {Q.RATES} ON name = payment_currency"))
def sc01(spark, sf_dir):
    return G.with_currency_nodes(T.transactions(spark, sf_dir)).select("transaction_id", "source")


@query("sc02_substring", "SELECT c_custkey, substring(c_name, 1, 9) AS prefix FROM customer")
def sc02(spark, sf_dir):
    return T.table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.substring("c_name", 1, 9).alias("prefix"))


@query("sc03_string_functions", "SELECT o_orderkey, lower(replace(trim(split_part(o_orderpriority, '-', 2)), ' ', '_')) AS slug, o_orderpriority LIKE '1%' AS is_first, regexp_full_match(split_part(o_orderpriority, '-', 1), '[0-9]+') AS is_number FROM orders")
def sc03(spark, sf_dir):
    parts = F.split("o_orderpriority", "-")
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.lower(F.replace(F.trim(parts[1]), F.lit(" "), F.lit("_"))).alias("slug"), F.col("o_orderpriority").startswith("1").alias("is_first"), parts[0].rlike("^[0-9]+$").alias("is_number"))


@query("sc04_joined_key", Q.tx("SELECT transaction_id, concat_ws('|', ts_s, from_bank, from_account, to_bank, to_account) AS payment_key FROM tx"))
def sc04(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", F.concat_ws("|", *(F.col(c).cast("string") for c in ("ts_s", "from_bank", "from_account", "to_bank", "to_account"))).alias("payment_key"))


@query("sc05_reference_digest", "SELECT o_orderkey, 'sha256:' || sha256('tx-ref-v1' || o_orderkey::VARCHAR || '|' || o_orderpriority) AS ref FROM orders")
def sc05(spark, sf_dir):
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", S.payment_reference(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("ref"))


@query("sc06_row_hashes")
def sc06(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.xxhash64("o_custkey", "o_orderpriority").alias("h"))


@query("sc08_parse_timestamp", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s FROM orders")
def sc08(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")
    return T.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.unix_seconds(F.to_timestamp(text, "yyyy/MM/dd HH:mm")).alias("s"))


@query("sc10_time_differences", "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) AS gap_us FROM events")
def sc10(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return T.table(spark, sf_dir, "events", "event_id", "ts", "user_id").select("event_id", (us - F.lag(us).over(W.over(("user_id",), ("ts",)))).alias("gap_us"))


@query("sc13_usd_amounts", Q.tx(f"SELECT transaction_id, round(amount_paid * rate, 4) AS usd_paid FROM tx JOIN {Q.RATES} ON name = payment_currency"))
def sc13(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", F.round(S.in_usd("amount_paid", "payment_currency"), 4).alias("usd_paid"))


@query("sc14_safe_ratio", "SELECT l_orderkey, l_linenumber, l_quantity, coalesce(round(l_tax / nullif(l_discount, 0), 6), 0) AS r FROM lineitem")
def sc14(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount").select("l_orderkey", "l_linenumber", "l_quantity", F.round(S.safe_ratio("l_tax", "l_discount"), 6).alias("r"))


@query("sc15_nested_when", Q.tx("SELECT transaction_id, CASE WHEN score < 0.3 THEN 0 WHEN score < 0.6 THEN 1 ELSE 2 END AS band FROM tx"))
def sc15(spark, sf_dir):
    return T.transactions(spark, sf_dir).select("transaction_id", F.when(F.col("score") < 0.3, 0).when(F.col("score") < 0.6, 1).otherwise(2).alias("band"))


@query("sc16_null_handling", "SELECT doc_id, coalesce(nullif(n_chars, 0), -1) AS n_chars, text IS NULL AS no_text FROM documents")
def sc16(spark, sf_dir):
    return T.table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select("doc_id", F.coalesce(F.nullif("n_chars", F.lit(0)), F.lit(-1)).alias("n_chars"), F.col("text").isNull().alias("no_text"))


@query("sc17_pair_statistics", Q.tx("SELECT transaction_id, least(amount_paid, amount_received) AS lo, greatest(amount_paid, amount_received) AS hi, (amount_paid + amount_received) / 2 AS mean, amount_paid - amount_received AS diff FROM tx"))
def sc17(spark, sf_dir):
    a, b = F.col("amount_paid"), F.col("amount_received")
    return T.transactions(spark, sf_dir).select("transaction_id", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), ((a + b) / 2).alias("mean"), (a - b).alias("diff"))


@query("sc19_array_functions", Q.edges("SELECT source, len(list(amount))::BIGINT AS n, list_sum(list(amount)) AS total, list_max(list(amount)) AS largest, round(stddev_pop(amount), 6) AS std FROM tot GROUP BY source"))
def sc19(spark, sf_dir):
    from ..operators import graph as R

    arrays = R.edge_totals(R.as_edges(T.transactions(spark, sf_dir))).groupBy("source").agg(F.collect_list("amount").alias("a"))
    add = lambda x, y: x + y
    n, mean = F.size("a"), F.aggregate("a", F.lit(0.0), add) / F.size("a")
    var = F.aggregate(F.transform("a", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), add) / n
    return arrays.withColumn("m", mean).select("source", n.cast("long").alias("n"), F.aggregate("a", F.lit(0.0), add).alias("total"), F.array_max("a").alias("largest"), F.round(F.sqrt(var), 6).alias("std"))


@query("sc20_explode", "SELECT o_orderkey, unnest([1, 2, 3]) AS k FROM orders")
def sc20(spark, sf_dir):
    return T.table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))


@query("sc21_normalised_map", Q.tx("SELECT from_account, payment_format, round(a / sum(a) OVER (PARTITION BY from_account), 6) AS share FROM (SELECT from_account, payment_format, sum(amount_paid) AS a FROM tx GROUP BY ALL)"))
def sc21(spark, sf_dir):
    per = T.transactions(spark, sf_dir).groupBy("from_account", "payment_format").agg(F.sum("amount_paid").alias("a"))
    maps = per.groupBy("from_account").agg(F.map_from_entries(F.collect_list(F.struct("payment_format", "a"))).alias("m"), F.sum("a").alias("t"))
    shares = F.transform_values("m", lambda k, v: F.round(v / F.col("t"), 6))
    return maps.select("from_account", F.explode(shares).alias("payment_format", "share"))


@query("sc22_json", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def sc22(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    again = F.from_json(F.to_json(parsed), "k bigint")
    return T.table(spark, sf_dir, "events", "event_id", "props").select("event_id", again["k"].alias("k"))


@query("sc23_amount_bins", Q.tx("SELECT transaction_id, CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' ELSE '10+' END AS bin FROM (SELECT transaction_id, row_number() OVER (PARTITION BY from_bank, from_account, amount_paid ORDER BY ts_s, transaction_id) - 1 AS n FROM tx)"))
def sc23(spark, sf_dir):
    n = W.prev_count(("from_bank", "from_account", "amount_paid"), ("ts_s", "transaction_id"))
    return T.transactions(spark, sf_dir).withColumn("n", n).select("transaction_id", S.amount_bin("n").alias("bin"))


@query("sc25_inverse_one_hot", Q.tx("SELECT transaction_id, 'payment_format_' || trim(regexp_replace(lower(payment_format), '[^0-9a-z]', '_', 'g'), '_') AS f FROM tx"))
def sc25(spark, sf_dir):
    hot = S.one_hot(T.transactions(spark, sf_dir), "payment_format", "payment_format")
    return hot.select("transaction_id", S.inverse_one_hot([c for c in hot.columns if c.startswith("payment_format_")]).alias("f"))


@query("sc26_label_encoding", Q.tx("SELECT transaction_id, coalesce(code, 0) AS code FROM tx LEFT JOIN (SELECT payment_currency AS v, (row_number() OVER (ORDER BY payment_currency) - 1)::INT AS code FROM (SELECT DISTINCT payment_currency FROM tx WHERE from_bank < 6)) ON v = payment_currency"))
def sc26(spark, sf_dir):
    tx = T.transactions(spark, sf_dir)
    codes = S.label_codes(tx.where("from_bank < 6"), "payment_currency")
    return S.encoded(tx, "payment_currency", codes, "code").select("transaction_id", "code")


@query("sc27_policy_ids", "SELECT * FROM (VALUES (0.95::DOUBLE, 'm2_lr_p95_v1'), (0.9::DOUBLE, 'm2_lr_p90_v1'), (0.999::DOUBLE, 'm2_lr_p100_v1')) AS t(retention, policy)")
def sc27(spark, sf_dir):
    return spark.createDataFrame([(r, S.policy_id(r)) for r in (0.95, 0.9, 0.999)], "retention double, policy string")


@query("dim_currencies", "SELECT name, code, rate AS usd_rate FROM " + Q.RATES)
def dim_currencies(spark, sf_dir):
    return T.currencies(spark)


@query("snk01_parquet_round_trip", Q.tx("SELECT transaction_id, amount_paid FROM tx"))
def snk01(spark, sf_dir):
    path = shared_path(spark, "sink")
    P.write_parquet(T.transactions(spark, sf_dir).select("transaction_id", "amount_paid"), path, 4)
    return spark.read.parquet(path)


@query("snk03_strict_round_trip", Q.tx("SELECT transaction_id, score::FLOAT AS risk_score FROM tx"))
def snk03(spark, sf_dir):
    path = shared_path(spark, "strict")
    rows = T.transactions(spark, sf_dir).select("transaction_id", F.col("score").alias("risk_score"), "ts_s")
    P.write_strict(rows, path, {"transaction_id": "long", "risk_score": "float"}, "transaction_id")
    return spark.read.parquet(path)


@query("snk04_csv_round_trip", "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def snk04(spark, sf_dir):
    path = shared_path(spark, "csv")
    P.write_csv(T.table(spark, sf_dir, "nation", "n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


