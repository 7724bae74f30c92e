"""Queries of the large-data feature family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import snake
from ..operators import scale_features as Z
from ..sources.constants import DAY, NAMES
from ..sources.tables import transactions
from . import sql as Q
from .registry import query

_SRC, _DST, _PAIR, _AMT = "from_bank, from_account", "to_bank, to_account", "from_bank, from_account, to_bank, to_account", "from_bank, from_account, amount_paid"


def _stats_sql(keys: str, prefix: str, source: str = "tx", tie: str = "transaction_id") -> str:
    w = f"(PARTITION BY {keys} ORDER BY ts_s, {tie})"
    return (
        f"row_number() OVER {w} - 1 AS {prefix}_prev, coalesce(ts_s - lag(ts_s) OVER {w}, -1) AS {prefix}_since, ({Q.trailing_closed('count(*)', keys, DAY, tie)})::BIGINT AS {prefix}_count, "
        f"({Q.trailing_closed('sum(trunc(amount_paid)::BIGINT)', keys, DAY, tie)})::BIGINT AS {prefix}_sum"
    )


def _four(prefix):
    return [F.col(f"{prefix}_{x}").cast("long").alias(f"{prefix}_{x}") for x in ("prev", "since", "count", "sum")]


for name, keys, sql_keys in (("wn30_group_stats_sender", Z.SRC, _SRC), ("wn32_receiver_history", Z.DST, _DST), ("wn36_pair_flow", Z.PAIR, _PAIR)):
    query(name, Q.tx(f"SELECT transaction_id, {_stats_sql(sql_keys, 'k')} FROM tx"))(lambda spark, sf_dir, keys=keys: Z.group_stats(transactions(spark, sf_dir), "k", keys).select("transaction_id", *_four("k")))

_DISTINCT = "(count(DISTINCT {}) OVER (PARTITION BY {} ORDER BY ts_s, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT"
_RECEIVER = "to_bank::VARCHAR || '|' || to_account::VARCHAR"
_SENDER = "from_bank::VARCHAR || '|' || from_account::VARCHAR"
for name, keys, sql_keys, value, sql_value in (
    ("wn31_same_amount_receivers", Z.AMOUNT, _AMT, list(Z.DST), _RECEIVER),
    ("wn33_receiver_unique_senders", Z.DST, _DST, list(Z.SRC), _SENDER),
    ("wn33_receiver_unique_sender_banks", Z.DST, _DST, "from_bank", "from_bank"),
    ("wn38_same_amount_senders", Z.AMOUNT, _AMT, list(Z.SRC), _SENDER),
):
    query(name, Q.tx(f"SELECT transaction_id, {_DISTINCT.format(sql_value, sql_keys)} AS n FROM tx"))(
        lambda spark, sf_dir, keys=keys, value=value: W.with_prev_distinct(transactions(spark, sf_dir), "n", keys, value, Z.ORDER).select("transaction_id", "n")
    )


@query("wn34_receiver_bank_context", Q.tx(f"SELECT transaction_id, {_stats_sql('to_bank', 'bank')}, {_DISTINCT.format(_SENDER, 'to_bank')} AS bank_senders FROM tx"))
def wn34(spark, sf_dir):
    return Z.bank_history(transactions(spark, sf_dir)).select("transaction_id", *_four("bank"), "bank_senders")


@query("wn35_sender_ratios", Q.tx(f"""SELECT transaction_id, round((row_number() OVER (PARTITION BY {_PAIR} ORDER BY ts_s, transaction_id) - 1) / greatest(row_number() OVER (PARTITION BY {_SRC} ORDER BY ts_s, transaction_id) - 1, 1), 6) AS pair_to_sender_ratio,
  round((row_number() OVER (PARTITION BY {_AMT} ORDER BY ts_s, transaction_id) - 1) / greatest(row_number() OVER (PARTITION BY {_SRC} ORDER BY ts_s, transaction_id) - 1, 1), 6) AS same_amount_to_sender_ratio FROM tx"""))
def wn35(spark, sf_dir):
    df = Z.scale_features(transactions(spark, sf_dir), "mainline_receiver_bank_role", "strict_sender", ())
    return df.select("transaction_id", F.round("pair_to_sender_ratio", 6).alias("pair_to_sender_ratio"), F.round("same_amount_to_sender_ratio", 6).alias("same_amount_to_sender_ratio"))


for mode, source in (("bank_local", "obs"), ("strict_sender", "pay")):
    tie = "role_ord, transaction_id"
    body = f"SELECT transaction_id, own_prev, own_since, own_count, own_sum FROM (SELECT transaction_id, role_ord, {_stats_sql(Q.OWN, 'own', source, tie)} FROM {source}) WHERE role_ord = 0"
    query(f"wn37_own_history_{mode}", Q.obs(body))(lambda spark, sf_dir, mode=mode: Z.own_history(transactions(spark, sf_dir), mode).select("transaction_id", *_four("own")))


def _set(name, mode):
    def run(spark, sf_dir):
        df = Z.scale_features(transactions(spark, sf_dir), name, mode)
        kinds = dict(df.dtypes)
        return df.select("transaction_id", *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) for c in df.columns[3:]))

    return run


_W = lambda keys: f"(PARTITION BY {keys} ORDER BY ts_s, transaction_id)"
_PREV = lambda keys: f"(PARTITION BY {keys} ORDER BY ts_s, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _decay_sql(keys: str, source: str, tie: str) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    order = lambda t: ", ".join(f"{t}.{c}" for c in ("ts_s", *tie.split(", ")))
    return f"SELECT a.transaction_id{', a.role_ord' if 'role_ord' in tie else ''}, coalesce(sum(pow(0.5, (a.ts_s - b.ts_s) / 43200.0)), 0) AS d FROM {source} a LEFT JOIN {source} b ON {same} AND ({order('b')}) < ({order('a')}) GROUP BY ALL"


def _flow_sql(prefix: str, name: str) -> dict[str, str]:
    return {f"{name}_amount_24h_sum": f"round(ln(1 + greatest({prefix}_sum, 0)), 6)", f"{name}_amount_24h_mean": f"round(ln(1 + greatest({prefix}_sum, 0) / greatest({prefix}_count, 1)), 6)"}


_FMT = {n: f"(payment_format = '{v}')::BIGINT" for v, n in (("1-URGENT", "payment_format_1_urgent"), ("2-HIGH", "payment_format_2_high"), ("3-MEDIUM", "payment_format_3_medium"), ("4-NOT SPECIFIED", "payment_format_4_not_specified"), ("5-LOW", "payment_format_5_low"))}
_COLUMNS = {
    "log_amount_paid": "round(ln(1 + amount_paid), 6)", "log_amount_received": "round(ln(1 + amount_received), 6)", "same_currency": "(payment_currency = receiving_currency)::BIGINT",
    "own_account_prev_count": "own_prev", "time_since_last_tx_own": "own_since", "counterparty_prev_count": "pair_prev", "time_since_last_tx_counterparty": "pair_since", **_FMT,
    "same_amount_cnt": f"row_number() OVER {_W(_AMT)} - 1",
    "same_amount_receivers_prev": _DISTINCT.format(_RECEIVER, _AMT), "same_amount_receiver_banks_prev": _DISTINCT.format("to_bank", _AMT), "same_amount_senders_prev": _DISTINCT.format(_SENDER, _AMT), "same_amount_sender_banks_prev": _DISTINCT.format("from_bank", _AMT),
    "own_decay_count_12h": "round(own_d, 6)", "receiver_decay_count_12h": "round(recv_d, 6)",
    "receiver_account_prev_count": "recv_prev", "time_since_last_tx_receiver": "recv_since", "receiver_unique_senders_prev": _DISTINCT.format(_SENDER, _DST), "receiver_unique_sender_banks_prev": _DISTINCT.format("from_bank", _DST),
    "receiver_fanin_ratio": f"round({_DISTINCT.format(_SENDER, _DST)} / greatest(recv_prev, 1), 6)", "receiver_bank_prev_count": "bank_prev", "time_since_last_tx_receiver_bank": "bank_since",
    "receiver_bank_unique_senders_prev": _DISTINCT.format(_SENDER, "to_bank"), "receiver_bank_fanin_ratio": f"round({_DISTINCT.format(_SENDER, 'to_bank')} / greatest(bank_prev, 1), 6)",
    "pair_to_sender_ratio": "round(pair_prev / greatest(own_prev, 1), 6)", "same_amount_to_sender_ratio": f"round((row_number() OVER {_W(_AMT)} - 1) / greatest(own_prev, 1), 6)",
    "hour": "extract(hour FROM make_timestamp(ts_s * 1000000))::BIGINT", "dayofweek": "(isodow(make_timestamp(ts_s * 1000000)) - 1)::BIGINT", "internal_transfer": "(from_bank = to_bank)::BIGINT",
    "self_account": "(from_bank = to_bank AND from_account = to_account)::BIGINT", "tx_24h": "own_count", "new_cp_24h": f"({Q.trailing_closed('sum((pair_prev = 0)::INT)', _SRC, DAY)})::BIGINT", "is_new_cp": "(pair_prev = 0)::BIGINT",
    "amt_vs_prevmean": f"round(ln(1 + coalesce(amount_paid / nullif(avg(amount_paid) OVER {_PREV(_SRC)}, 0), 1.0)), 6)", **{f"amount_round{k}k": f"(amount_paid % {k}000 = 0)::BIGINT" for k in (1, 10, 100)},
    **_flow_sql("own", "own"), **_flow_sql("pair", "counterparty"), **_flow_sql("recv", "receiver"), **_flow_sql("bank", "receiver_bank"),
}


def _set_sql(wanted, mode: str) -> str:
    source, tie = ("obs", "role_ord, transaction_id") if mode == "bank_local" else ("pay", "role_ord, transaction_id")
    names = []
    for x in wanted:
        names += list(_FMT) if x == "payment_format_" else [f"{x}{snake(n)}" for n in sorted(NAMES, key=snake)] if x in Z.CURRENCY else [x]
    columns = _COLUMNS | {f"{x}_{snake(n)}": f"({x} = '{n}')::BIGINT" for x in ("payment_currency", "receiving_currency") for n in NAMES}
    own = f"own AS (SELECT * FROM (SELECT transaction_id, role_ord, {_stats_sql(Q.OWN, 'own', source, tie)} FROM {source}) WHERE role_ord = 0), od AS (SELECT transaction_id, d AS own_d FROM ({_decay_sql(Q.OWN, source, tie)}) WHERE role_ord = 0)"
    receiver = f"rd AS (SELECT transaction_id, d AS recv_d FROM ({_decay_sql(_DST, 'tx', 'transaction_id')}))" if "receiver_decay_count_12h" in wanted else "rd AS (SELECT transaction_id, 0.0 AS recv_d FROM tx)"
    base = f"b AS (SELECT *, {_stats_sql(_PAIR, 'pair')}, {_stats_sql(_DST, 'recv')}, {_stats_sql('to_bank', 'bank')} FROM tx)"
    return f"WITH {Q.OBS}, {own}, {receiver}, {base} SELECT transaction_id, {', '.join(f'{columns[n]} AS {n}' for n in names)} FROM b JOIN own USING (transaction_id) JOIN od USING (transaction_id) JOIN rd USING (transaction_id)"


for mode in Z.MODES:
    for name in Z.SETS:
        query(f"cp11_{name}_{mode}", _set_sql(Z.SETS[name], mode))(_set(name, mode))
