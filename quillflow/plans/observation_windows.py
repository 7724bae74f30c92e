"""Queries over local observations: base features, bursts, relation history (both roles see their past)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..sources.constants import DAY
from ..sources.tables import transactions
from . import sql as Q
from .registry import query

SIX = 6


def _rounded(df, names):
    kinds = dict(df.dtypes)
    return [F.round(n, SIX).alias(n) if kinds[n] == "double" else F.col(n).cast("long").alias(n) for n in names]


def _observed(build, *names):
    def run(spark, sf_dir):
        df = build(transactions(spark, sf_dir))
        return df.select("transaction_id", F.col("role_ord").cast("long").alias("role_ord"), *_rounded(df, names))

    return run


def _sql(**columns: str) -> str:
    return Q.obs(f"SELECT transaction_id, role_ord::BIGINT AS role_ord, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM obs WINDOW {Q.WINDOWS}")


def _base(tx):
    return X.base(X.observations(tx), ())


def _bursts(tx):
    return X.bursts(_base(tx))


def _compact(tx):
    return X.compact_graph(_bursts(tx))


def _repeated(tx):
    return X.repeated_amounts(_bursts(tx))


def _log(x: str) -> str:
    return f"round(ln(1 + {x}), 6)"


LOCAL = "CASE WHEN role_ord = 0 THEN amount_paid ELSE amount_received END"
_sum = lambda x, w: f"coalesce(sum({x}) OVER {w}p, 0)"
DEBIT, CREDIT = "(CASE WHEN role_ord = 0 THEN 1 ELSE 0 END)", "(CASE WHEN role_ord = 0 THEN 0 ELSE 1 END)"
PAIR_N, PAIR_S = "(row_number() OVER pair - 1)", f"coalesce(sum({LOCAL}) OVER pairp, 0)"

#: The SQL of each window column, for the oracles of whole feature sets.
COLUMNS: dict[str, str] = {"edge_tx_count": PAIR_N}
for name, build, columns in (
    ("wn06_own_account_prev_count", _base, {"own_account_prev_count": "row_number() OVER own - 1"}),
    ("wn07_time_since_last_tx_own", _base, {"time_since_last_tx_own": "coalesce(ts_s - lag(ts_s) OVER own, -1)"}),
    ("wn08_counterparty_prev_count", _base, {"counterparty_prev_count": "row_number() OVER pair - 1"}),
    ("wn09_time_since_last_tx_counterparty", _base, {"time_since_last_tx_counterparty": "coalesce(ts_s - lag(ts_s) OVER pair, -1)"}),
    ("wn10_tx_24h", _bursts, {"tx_24h": f"{Q.trailing('count(*)', Q.OWN, DAY)}::BIGINT"}),
    ("wn12_same_amount_cnt", _bursts, {"same_amount_cnt": "row_number() OVER same - 1"}),
    ("wn13_amt_vs_prevmean", _bursts, {"amt_vs_prevmean": _log("coalesce(amount_paid / nullif(avg(amount_paid) OVER ownp, 0), 1.0)")}),
    ("wn14_same_amount_24h", _repeated, {"same_amount_24h_cnt": f"{Q.trailing('count(*)', Q.SAME, DAY)}::BIGINT - 1"}),
    ("wn15_same_amount_counterparty", _repeated, {"same_amount_counterparty_cnt": "row_number() OVER pairamt - 1"}),
    ("wn21_debit_credit_counts", _compact, {
        "own_prev_debit_count": f"{_sum(DEBIT, 'own')}::BIGINT", "own_prev_credit_count": f"{_sum(CREDIT, 'own')}::BIGINT", "own_activity_total_prev": "row_number() OVER own - 1",
        "own_debit_credit_count_ratio": f"round(ln(1 + {_sum(DEBIT, 'own')}) - ln(1 + {_sum(CREDIT, 'own')}), 6)"}),
    ("wn22_debit_credit_amounts", _compact, {
        "own_prev_debit_amount_sum_log": _log(_sum(f"amount_paid * {DEBIT}", "own")), "own_prev_credit_amount_sum_log": _log(_sum(f"amount_received * {CREDIT}", "own")),
        "own_debit_credit_amount_logratio": f"round(ln(1 + {_sum(f'amount_paid * {DEBIT}', 'own')}) - ln(1 + {_sum(f'amount_received * {CREDIT}', 'own')}), 6)",
        "own_flow_balance_abs_logratio": f"round(abs(ln(1 + {_sum(f'amount_paid * {DEBIT}', 'own')}) - ln(1 + {_sum(f'amount_received * {CREDIT}', 'own')})), 6)"}),
    ("wn23_bilateral_amounts", _compact, {
        "bilateral_prev_amount_sum_log": _log(PAIR_S), "bilateral_prev_amount_mean_log": _log(f"coalesce({PAIR_S} / nullif({PAIR_N}, 0), 0)"),
        "bilateral_amount_vs_prevmean": _log(f"coalesce(({LOCAL}) / nullif({PAIR_S} / nullif({PAIR_N}, 0), 0), 1.0)")}),
    ("wn24_bilateral_time_span", _compact, {"bilateral_time_span_hours": "round((ts_s - first_value(ts_s) OVER pair) / 3600.0, 6)"}),
    ("sc09_hour_weekday", _base, {"hour": "extract(hour FROM make_timestamp(ts_s * 1000000))::BIGINT", "dayofweek": "(isodow(make_timestamp(ts_s * 1000000)) - 1)::BIGINT"}),
    ("sc11_log_amounts", _base, {"log_amount_paid": _log("amount_paid"), "log_amount_received": _log("amount_received")}),
    ("sc12_round_amounts", _repeated, {f"amount_round{k}k": f"(amount_paid % {k}000 = 0)::BIGINT" for k in (1, 10, 100)}),
    ("sc28_flags", _bursts, {
        "same_currency": "(payment_currency = receiving_currency)::BIGINT", "is_sender": "(role_ord = 0)::BIGINT", "internal_transfer": "(own_bank = cp_bank)::BIGINT",
        "self_account": "(own_account = cp_account AND own_bank = cp_bank)::BIGINT", "is_new_cp": "(row_number() OVER pair = 1)::BIGINT"}),
):
    COLUMNS |= columns
    query(name, _sql(**columns))(_observed(build, *columns))

query("wn11_new_cp_24h", Q.obs(f"SELECT transaction_id, role_ord::BIGINT AS role_ord, {Q.trailing('sum(n)', Q.OWN, DAY)}::BIGINT AS new_cp_24h FROM (SELECT *, (row_number() OVER pair = 1)::INT AS n FROM obs WINDOW {Q.WINDOWS})"))(_observed(_bursts, "new_cp_24h"))
query("wn25_unique_counterparties_prev", Q.obs(f"SELECT transaction_id, role_ord::BIGINT AS role_ord, coalesce(sum(n) OVER (PARTITION BY {Q.OWN} ORDER BY ts_s, transaction_id, role_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS own_unique_counterparties_prev FROM (SELECT *, (row_number() OVER pair = 1)::INT AS n FROM obs WINDOW {Q.WINDOWS})"))(_observed(_compact, "own_unique_counterparties_prev"))


@query("cp07_local_observations", Q.obs("SELECT transaction_id, role, role_ord::BIGINT AS role_ord, own_bank::BIGINT AS own_bank, own_account, cp_bank::BIGINT AS cp_bank, cp_account, amount_paid FROM obs"))
def cp07(spark, sf_dir):
    o = X.observations(transactions(spark, sf_dir))
    return o.select("transaction_id", "role", F.col("role_ord").cast("long").alias("role_ord"), F.col("own_bank").cast("long").alias("own_bank"), "own_account", F.col("cp_bank").cast("long").alias("cp_bank"), "cp_account", "amount_paid")


@query("flt04_payer_roles", Q.obs("SELECT role, count(*) AS rows FROM pay GROUP BY role"))
def flt04(spark, sf_dir):
    return X.payer_rows(X.observations(transactions(spark, sf_dir))).groupBy("role").agg(F.count(F.lit(1)).alias("rows"))


@query("sc24_one_hot_formats", Q.obs("SELECT transaction_id, role_ord::BIGINT AS role_ord, " + ", ".join(f"(payment_format = '{v}')::BIGINT AS {n}" for v, n in (("1-URGENT", "payment_format_1_urgent"), ("2-HIGH", "payment_format_2_high"), ("3-MEDIUM", "payment_format_3_medium"), ("4-NOT SPECIFIED", "payment_format_4_not_specified"), ("5-LOW", "payment_format_5_low"))) + " FROM obs"))
def sc24(spark, sf_dir):
    df = X.base(X.observations(transactions(spark, sf_dir)))
    names = [c for c in df.columns if c.startswith("payment_format_")]
    return df.select("transaction_id", F.col("role_ord").cast("long").alias("role_ord"), *(F.col(n).cast("long").alias(n) for n in names))
