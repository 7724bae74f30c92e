"""Queries over payer rows: sender windows, spreads, decay, behaviour shifts and whole feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import features as X
from ..sources.constants import DAY, HALF_LIFE, HOUR
from ..sources.tables import transactions
from . import observation_windows as O, sql as Q
from .registry import query


def _payers(tx):
    return X.payer_rows(X.bursts(X.base(X.observations(tx), ())))


def _kept(df, names):
    kinds = dict(df.dtypes)
    return df.select("transaction_id", *(F.round(n, 6).alias(n) if kinds[n] == "double" else F.col(n).cast("long").alias(n) for n in names))


def _run(build, names):
    return lambda spark, sf_dir: _kept(build(_payers(transactions(spark, sf_dir))), names)


def _sql(**columns: str) -> str:
    return Q.obs(f"SELECT transaction_id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM pay WINDOW {Q.WINDOWS}")


T24, T1 = Q.trailing("count(*)", Q.OWN, DAY), Q.trailing("count(*)", Q.OWN, HOUR)
S24 = f"greatest({Q.trailing('sum(amount_paid)', Q.OWN, DAY)} - amount_paid, 0)"
DISTINCT = "count(DISTINCT {}) OVER (PARTITION BY " + Q.SAME + " ORDER BY ts_s, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

for name, build, columns in (
    ("wn16_sender_tx_windows", X.sender_candidates, {"sender_tx_1h": f"({T1})::BIGINT - 1", "sender_tx_24h": f"({T24})::BIGINT - 1"}),
    ("wn17_sender_amount_24h", X.sender_candidates, {"sender_amount_sum_24h_log": f"round(ln(1 + {S24}), 6)", "sender_amount_mean_24h_log": f"round(ln(1 + coalesce({S24} / nullif({T24} - 1, 0), 0)), 6)"}),
    ("wn18_same_amount_spread", X.sender_candidates, {"same_amount_receivers_prev": f"({DISTINCT.format('cp_account')})::BIGINT", "same_amount_receiver_banks_prev": f"({DISTINCT.format('cp_bank')})::BIGINT"}),
):
    query(name, _sql(**columns))(_run(build, columns))


def _recent(what: str) -> str:
    """Distinct values of the payer's rows of the last day, the bound included, before each row."""
    return f"(SELECT a.transaction_id, count(DISTINCT b.{what}) AS n FROM pay a LEFT JOIN pay b ON a.own_bank = b.own_bank AND a.own_account = b.own_account AND b.ts_s >= a.ts_s - {DAY} AND (b.ts_s < a.ts_s OR b.ts_s = a.ts_s AND b.transaction_id < a.transaction_id) GROUP BY a.transaction_id)"


query("wn19_receiver_bank_count_24h", Q.obs(f"SELECT transaction_id, n::BIGINT AS receiver_bank_count_24h FROM {_recent('cp_bank')}"))(_run(X.sender_candidates, ["receiver_bank_count_24h"]))
_DECAY = "SELECT a.transaction_id, a.role_ord, coalesce(sum(pow(0.5, (a.ts_s - b.ts_s) / 43200.0)), 0) AS d FROM obs a LEFT JOIN obs b ON a.own_bank = b.own_bank AND a.own_account = b.own_account AND (b.ts_s, b.transaction_id, b.role_ord) < (a.ts_s, a.transaction_id, a.role_ord) GROUP BY ALL"


@query("wn20_decay_count_12h", Q.obs(f"SELECT transaction_id, role_ord::BIGINT AS role_ord, round(d, 6) AS own_decay_count_12h FROM ({_DECAY})"))
def wn20(spark, sf_dir):
    """Over all observations; in the payer sets the same operator runs over payer rows."""
    df = W.with_decayed_count(X.observations(transactions(spark, sf_dir)), "own_decay_count_12h", "ts_s", HALF_LIFE, X.OWN, X.ORDER)
    return df.select("transaction_id", F.col("role_ord").cast("long").alias("role_ord"), F.round("own_decay_count_12h", 6).alias("own_decay_count_12h"))


_OWN_N = f"p AS (SELECT pay.*, own_n FROM pay JOIN (SELECT transaction_id, role_ord, row_number() OVER own - 1 AS own_n FROM obs WINDOW {Q.WINDOWS}) USING (transaction_id, role_ord))"
_SHIFT = f"""SELECT transaction_id,
  round(({T24} - 1) / (own_n / greatest((ts_s - first_value(ts_s) OVER own) / 86400.0, 1.0) + 1.0), 6) AS sender_tx_24h_vs_prev_mean,
  round({S24} / (coalesce(coalesce(sum(amount_paid) OVER ownp, 0) / nullif(own_n, 0), 0) + 1.0), 6) AS sender_amount_24h_vs_prev_mean,
  ({Q.trailing('count(*)', Q.SAME, DAY)})::BIGINT - 1 AS same_amount_24h_cnt,
  round((row_number() OVER fmt - 1) / (own_n + 1.0), 6) AS sender_format_ratio_prev FROM p WINDOW {Q.WINDOWS}"""
query("wn26_wn28_behaviour_shift", f"WITH {Q.OBS}, {_OWN_N} {_SHIFT}")(_run(X.behaviour_shift, ["sender_tx_24h_vs_prev_mean", "sender_amount_24h_vs_prev_mean", "same_amount_24h_cnt", "sender_format_ratio_prev"]))
query(
    "wn29_counterparty_unique_ratio",
    f"WITH {Q.OBS}, c AS {_recent('cp_account')}, t AS (SELECT transaction_id, {T24} - 1 AS k FROM pay) SELECT transaction_id, round(n / (k + 1.0), 6) AS counterparty_unique_24h_ratio FROM c JOIN t USING (transaction_id)",
)(_run(X.behaviour_shift, ["counterparty_unique_24h_ratio"]))


def _set(name):
    def run(spark, sf_dir):
        df = X.sender_features(transactions(spark, sf_dir), name)
        return _kept(df, [c for c in df.columns if c not in X.IDS])

    return run


_FORMATS = {n: f"(payment_format = '{v}')::BIGINT" for v, n in (("1-URGENT", "payment_format_1_urgent"), ("2-HIGH", "payment_format_2_high"), ("3-MEDIUM", "payment_format_3_medium"), ("4-NOT SPECIFIED", "payment_format_4_not_specified"), ("5-LOW", "payment_format_5_low"))}
_listed = lambda columns: ", ".join(f"{e} AS {n}" for n, e in columns.items())
_PAYER = {
    "sender_tx_1h": f"({T1})::BIGINT - 1", "sender_tx_24h": f"({T24})::BIGINT - 1", "sender_amount_sum_24h_log": f"round(ln(1 + {S24}), 6)", "sender_amount_mean_24h_log": f"round(ln(1 + coalesce({S24} / nullif({T24} - 1, 0), 0)), 6)",
    "same_amount_receivers_prev": f"({DISTINCT.format('cp_account')})::BIGINT", "same_amount_receiver_banks_prev": f"({DISTINCT.format('cp_bank')})::BIGINT",
}
_SHIFTED = {
    "sender_tx_24h_vs_prev_mean": f"round(({T24} - 1) / (own_account_prev_count / greatest((ts_s - first_value(ts_s) OVER own) / 86400.0, 1.0) + 1.0), 6)",
    "sender_amount_24h_vs_prev_mean": f"round({S24} / (coalesce(coalesce(sum(amount_paid) OVER ownp, 0) / nullif(own_account_prev_count, 0), 0) + 1.0), 6)",
    "same_amount_24h_cnt": f"({Q.trailing('count(*)', Q.SAME, DAY)})::BIGINT - 1",
    "sender_format_ratio_prev": "round((row_number() OVER fmt - 1) / (own_account_prev_count + 1.0), 6)",
    "counterparty_unique_24h_ratio": f"round(accounts.n / ({T24} - 1 + 1.0), 6)",
}
_PAY_DECAY = "(SELECT a.transaction_id, round(coalesce(sum(pow(0.5, (a.ts_s - b.ts_s) / 43200.0)), 0), 6) AS d FROM pay a LEFT JOIN pay b ON a.own_bank = b.own_bank AND a.own_account = b.own_account AND (b.ts_s, b.transaction_id) < (a.ts_s, a.transaction_id) GROUP BY ALL)"


def _set_sql(names, families) -> str:
    """A set from its columns' SQL: windows over both roles, then over payer rows."""
    seen = {n: e for n, e in (O.COLUMNS | _FORMATS).items() if n in names or n in ("own_account_prev_count", "is_new_cp")}
    late = {"new_cp_24h": f"({Q.trailing('sum(is_new_cp)', Q.OWN, DAY)})::BIGINT", "own_unique_counterparties_prev": "coalesce(sum(is_new_cp) OVER ownp, 0)::BIGINT"}
    late = {n: e for n, e in late.items() if n in names}
    payer = dict(_PAYER) if "candidates" in families or "shift" in families else {}
    payer |= _SHIFTED if "shift" in families else {}
    payer = {n: e for n, e in payer.items() if n in names}
    if "shift" in families:
        seen.pop("same_amount_24h_cnt", None)
    joins = ""
    if "receiver_bank_count_24h" in names:
        payer["receiver_bank_count_24h"], joins = "banks.n::BIGINT", joins + f" JOIN {_recent('cp_bank')} banks USING (transaction_id)"
    if "counterparty_unique_24h_ratio" in names:
        joins += f" JOIN {_recent('cp_account')} accounts USING (transaction_id)"
    if "own_decay_count_12h" in names:
        payer["own_decay_count_12h"], joins = "decays.d", joins + f" JOIN {_PAY_DECAY} decays USING (transaction_id)"
    stages = f"x AS (SELECT *, {_listed(seen)} FROM obs WINDOW {Q.WINDOWS}), y AS (SELECT *{', ' + _listed(late) if late else ''} FROM x WINDOW {Q.WINDOWS}), z AS (SELECT y.*{', ' + _listed(payer) if payer else ''} FROM (SELECT * FROM y WHERE role_ord = 0) y{joins} WINDOW {Q.WINDOWS})"
    return f"WITH {Q.OBS}, {stages} SELECT transaction_id, {', '.join(names)} FROM z"


for name, (names, families) in X.feature_sets(tuple(_FORMATS)).items():
    query(f"cp10_set_{name}", _set_sql(names, families))(_set(name))


@query("prj12_feature_matrix", Q.obs(f"SELECT transaction_id, round(ln(1 + amount_paid), 4) AS log_amount_paid, (row_number() OVER own - 1)::DOUBLE AS own_account_prev_count FROM obs WINDOW {Q.WINDOWS} QUALIFY role_ord = 0"))
def prj12(spark, sf_dir):
    df = X.matrix(X.sender_features(transactions(spark, sf_dir), "old"), ["log_amount_paid", "own_account_prev_count"])
    return df.select("transaction_id", F.round(F.col("log_amount_paid").cast("double"), 4).alias("log_amount_paid"), F.col("own_account_prev_count").cast("double").alias("own_account_prev_count"))
