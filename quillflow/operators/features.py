"""Causal payer-side features: local observations, and the feature families built on them.

Every feature is a lazy window expression; a feature set is a list of names, and Catalyst drops the windows that
the chosen set doesn't need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S, windows as W
from ..sources.constants import DAY, HALF_LIFE, HOUR

OWN = ("own_bank", "own_account")
PAIR = (*OWN, "cp_bank", "cp_account")
SAME = (*OWN, "amount_paid")
ORDER = ("ts_s", "transaction_id", "role_ord")
PAYER_ROLES = ("sender", "internal_debit")


def observations(tx: DataFrame) -> DataFrame:
    """Two rows per transaction, the payer's view and the payee's, from one scan."""
    internal = F.col("from_bank") == F.col("to_bank")

    def view(own: str, other: str, across: str, inside: str, order: int) -> Column:
        return F.struct(
            F.when(internal, inside).otherwise(across).alias("role"), F.lit(order).alias("role_ord"),
            F.col(f"{own}_bank").alias("own_bank"), F.col(f"{own}_account").alias("own_account"), F.col(f"{other}_bank").alias("cp_bank"), F.col(f"{other}_account").alias("cp_account"),
        )

    both = F.array(view("from", "to", "sender", "internal_debit", 0), view("to", "from", "receiver", "internal_credit", 1))
    kept = [c for c in tx.columns if c not in ("from_bank", "from_account", "to_bank", "to_account")]
    return tx.select(*kept, F.inline(both))


def is_payer() -> Column:
    return F.col("role").isin(*PAYER_ROLES)


def payer_rows(obs: DataFrame) -> DataFrame:
    return obs.where(is_payer())


# The names of features, groups and sets here and below.
BASE = (
    "hour", "dayofweek", "log_amount_paid", "log_amount_received", "same_currency", "self_account", "is_sender", "internal_transfer",
    "own_account_prev_count", "time_since_last_tx_own", "counterparty_prev_count", "time_since_last_tx_counterparty",
)


def base(obs: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """The pooled base features and one column per payment format."""
    internal = F.col("own_bank") == F.col("cp_bank")
    out = obs.withColumns({
        "hour": S.hour_of("ts_s"),
        "dayofweek": S.weekday_of("ts_s"),
        "log_amount_paid": F.log1p("amount_paid"),
        "log_amount_received": F.log1p("amount_received"),
        "same_currency": (F.col("payment_currency") == F.col("receiving_currency")).cast("int"),
        "is_sender": is_payer().cast("int"),
        "internal_transfer": internal.cast("int"),
        "self_account": ((F.col("own_account") == F.col("cp_account")) & internal).cast("int"),
        "own_account_prev_count": W.prev_count(OWN, ORDER),
        "time_since_last_tx_own": W.since_prev("ts_s", OWN, ORDER),
        "counterparty_prev_count": W.prev_count(PAIR, ORDER),
        "time_since_last_tx_counterparty": W.since_prev("ts_s", PAIR, ORDER),
    })
    return S.one_hot(out, "payment_format", "payment_format", formats)


NEW = ("tx_24h", "new_cp_24h", "is_new_cp", "same_amount_cnt", "amt_vs_prevmean", "amount_round1k")


def _against_mean(x: str, total: Column, count: Column) -> Column:
    """log1p of x over the mean so far; without a mean the ratio is 1."""
    return F.log1p(F.greatest(S.safe_ratio(F.col(x), F.try_divide(total, count), 1.0), F.lit(0.0)))


def bursts(df: DataFrame) -> DataFrame:
    """Day windows of the own account, repeated amounts and the amount against the account's mean so far."""
    new = df.withColumn("is_new_cp", (F.col("counterparty_prev_count") == 0).cast("int"))
    return new.withColumns({
        "tx_24h": W.trailing_count("ts_s", DAY, OWN, ORDER),
        "new_cp_24h": W.trailing_sum(F.col("is_new_cp"), "ts_s", DAY, OWN, ORDER),
        "same_amount_cnt": W.prev_count(SAME, ORDER),
        "amt_vs_prevmean": _against_mean("amount_paid", W.prev_sum(F.col("amount_paid"), OWN, ORDER), W.prev_count(OWN, ORDER)),
        "amount_round1k": S.round_amount("amount_paid", 1000),
    })


EDGE = ("edge_tx_count", "bilateral_prev_amount_sum_log", "bilateral_prev_amount_mean_log", "bilateral_amount_vs_prevmean", "bilateral_time_span_hours")
NODE_FLOW = (
    "own_prev_debit_count", "own_prev_credit_count", "own_debit_credit_count_ratio", "own_prev_debit_amount_sum_log", "own_prev_credit_amount_sum_log",
    "own_debit_credit_amount_logratio", "own_unique_counterparties_prev", "own_activity_total_prev", "own_flow_balance_abs_logratio",
)


def compact_graph(df: DataFrame) -> DataFrame:
    """What the account and the relation have seen so far, both roles together."""
    local = df.withColumn("local_amount", F.when(is_payer(), F.col("amount_paid")).otherwise(F.col("amount_received")))
    debit, credit = F.when(is_payer(), 1).otherwise(0), F.when(is_payer(), 0).otherwise(1)
    counted = local.withColumns({
        "edge_tx_count": W.prev_count(PAIR, ORDER),
        "_pair_sum": W.prev_sum(F.col("local_amount"), PAIR, ORDER),
        "bilateral_time_span_hours": (F.col("ts_s") - F.first("ts_s").over(W.over(PAIR, ORDER))) / 3600.0,
        "own_prev_debit_count": W.prev_sum(debit, OWN, ORDER),
        "own_prev_credit_count": W.prev_sum(credit, OWN, ORDER),
        "own_prev_debit_amount_sum_log": F.log1p(W.prev_sum(F.col("local_amount") * debit, OWN, ORDER)),
        "own_prev_credit_amount_sum_log": F.log1p(W.prev_sum(F.col("local_amount") * credit, OWN, ORDER)),
    })
    mean = F.try_divide(F.col("_pair_sum"), F.col("edge_tx_count"))
    told = counted.withColumns({
        "bilateral_prev_amount_sum_log": F.log1p("_pair_sum"),
        "bilateral_prev_amount_mean_log": F.log1p(F.coalesce(mean, F.lit(0.0))),
        "bilateral_amount_vs_prevmean": _against_mean("local_amount", F.col("_pair_sum"), F.col("edge_tx_count")),
        "own_debit_credit_count_ratio": F.log1p("own_prev_debit_count") - F.log1p("own_prev_credit_count"),
        "own_debit_credit_amount_logratio": F.col("own_prev_debit_amount_sum_log") - F.col("own_prev_credit_amount_sum_log"),
        "own_activity_total_prev": F.col("own_prev_debit_count") + F.col("own_prev_credit_count"),
        "own_unique_counterparties_prev": W.prev_sum((F.col("edge_tx_count") == 0).cast("long"), OWN, ORDER),
    })
    return told.withColumn("own_flow_balance_abs_logratio", F.abs("own_debit_credit_amount_logratio")).drop("_pair_sum")


REPEATED = ("same_amount_24h_cnt", "same_amount_counterparty_cnt", "amount_round10k", "amount_round100k")


def repeated_amounts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "same_amount_24h_cnt": W.trailing_count("ts_s", DAY, SAME, ORDER) - 1,
        "same_amount_counterparty_cnt": W.prev_count((*PAIR, "amount_paid"), ORDER),
        "amount_round10k": S.round_amount("amount_paid", 10_000),
        "amount_round100k": S.round_amount("amount_paid", 100_000),
    })


WINDOW_AMOUNT = ("sender_tx_1h", "sender_tx_24h", "sender_amount_sum_24h_log", "sender_amount_mean_24h_log")
SPREAD = ("same_amount_receivers_prev", "same_amount_receiver_banks_prev")
BANK_BURST = ("receiver_bank_count_24h",)


def _sender_windows(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sender_tx_1h": W.trailing_count("ts_s", HOUR, OWN, ORDER) - 1,
        "sender_tx_24h": W.trailing_count("ts_s", DAY, OWN, ORDER) - 1,
        "_sum_24h": F.greatest(W.trailing_sum(F.col("amount_paid"), "ts_s", DAY, OWN, ORDER) - F.col("amount_paid"), F.lit(0.0)),
    }).withColumn("sender_amount_sum_24h_log", F.log1p("_sum_24h"))


def _spread(df: DataFrame) -> DataFrame:
    """Distinct receivers, and their banks, that were paid the same amount before; a receiver is its account."""
    return W.with_prev_distincts(df, {"same_amount_receivers_prev": "cp_account", "same_amount_receiver_banks_prev": "cp_bank"}, SAME, ORDER)


def sender_candidates(payers: DataFrame) -> DataFrame:
    """Windows over payer rows alone: apply after payer_rows."""
    out = W.with_trailing_distinct(_spread(_sender_windows(payers)), "receiver_bank_count_24h", "cp_bank", "ts_s", DAY, OWN, ORDER)
    mean = F.coalesce(F.try_divide(F.col("_sum_24h"), F.col("sender_tx_24h")), F.lit(0.0))
    return out.withColumn("sender_amount_mean_24h_log", F.log1p(mean)).drop("_sum_24h")


DECAY = ("own_decay_count_12h",)


def account_decay(df: DataFrame) -> DataFrame:
    return W.with_decayed_count(df, "own_decay_count_12h", "ts_s", HALF_LIFE, OWN, ORDER)


SHIFT_V2 = ("sender_tx_1h", "sender_tx_24h", "sender_amount_sum_24h_log", "same_amount_24h_cnt", *SPREAD)
SHIFT = (
    "sender_tx_1h", "sender_tx_24h", "sender_amount_sum_24h_log", "sender_tx_24h_vs_prev_mean", "sender_amount_24h_vs_prev_mean", "same_amount_24h_cnt", *SPREAD,
    "sender_format_ratio_prev", "counterparty_unique_24h_ratio",
)


def behaviour_shift(payers: DataFrame) -> DataFrame:
    """Recent payer behaviour against the account's past; own_account_prev_count still counts both roles."""
    days = F.greatest((F.col("ts_s") - F.first("ts_s").over(W.over(OWN, ORDER))) / 86400.0, F.lit(1.0))
    past_mean = F.coalesce(F.try_divide(W.prev_sum(F.col("amount_paid"), OWN, ORDER), F.col("own_account_prev_count")), F.lit(0.0))
    out = W.with_trailing_distinct(_spread(_sender_windows(payers)), "_receivers_24h", "cp_account", "ts_s", DAY, OWN, ORDER)
    return out.withColumns({
        "sender_tx_24h_vs_prev_mean": F.col("sender_tx_24h") / (F.col("own_account_prev_count") / days + 1.0),
        "sender_amount_24h_vs_prev_mean": F.col("_sum_24h") / (past_mean + 1.0),
        "same_amount_24h_cnt": W.trailing_count("ts_s", DAY, SAME, ORDER) - 1,
        "sender_format_ratio_prev": W.prev_count((*OWN, "payment_format"), ORDER) / (F.col("own_account_prev_count") + 1.0),
        "counterparty_unique_24h_ratio": F.col("_receivers_24h") / (F.col("sender_tx_24h") + 1.0),
    }).drop("_sum_24h", "_receivers_24h")


TIME, INTERNAL = ("hour", "dayofweek"), ("self_account", "is_sender", "internal_transfer")
#: Groups of features that a set can be told to leave out; a name ending in _ is a prefix.
GROUPS: dict[str, tuple[str, ...]] = {
    "time": TIME,
    "amount": ("log_amount_paid", "log_amount_received"),
    "currency_format": ("same_currency", "payment_format_"),
    "internal_self": INTERNAL,
    "own_history": ("own_account_prev_count", "time_since_last_tx_own"),
    "counterparty_history": ("counterparty_prev_count", "time_since_last_tx_counterparty"),
    "burst": ("tx_24h", "new_cp_24h", "is_new_cp"),
    "amount_pattern": ("same_amount_cnt", "amt_vs_prevmean", "amount_round1k"),
    "new_all": NEW,
    "repeated_extended": REPEATED,
    "candidate_window_amount": WINDOW_AMOUNT,
    "candidate_same_amount_spread": SPREAD,
    "candidate_receiver_bank_burst": BANK_BURST,
    "account_decay": DECAY,
    "behavior_shift": SHIFT,
    "behavior_shift_v2": SHIFT_V2,
}
TOP10 = (
    "tx_24h", "new_cp_24h", "is_new_cp", "same_amount_cnt", "amt_vs_prevmean", "counterparty_prev_count", "time_since_last_tx_counterparty", "edge_tx_count",
    "own_unique_counterparties_prev", "own_debit_credit_amount_logratio",
)
#: Families that are added before and after the payer filter.
POOLED, PAYER = {"compact": compact_graph, "repeated": repeated_amounts}, {"candidates": sender_candidates, "decay": account_decay, "shift": behaviour_shift}


def feature_sets(format_columns: Sequence[str]) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """Each set's features and the families that make them."""
    old = (*BASE, *format_columns)
    core = tuple(c for c in (*old, "same_amount_cnt") if c not in (*TIME, *INTERNAL))
    return {
        "old": (old, ()),
        "old_new": ((*old, *NEW), ()),
        "old_same_amount": ((*old, "same_amount_cnt"), ()),
        "old_amount_core": ((*old, "same_amount_cnt", "amount_round1k"), ()),
        "old_repeated_extended": ((*old, "same_amount_cnt", "amount_round1k", *REPEATED), ("repeated",)),
        "compact_core": (core, ()),
        "compact_core_edge": ((*core, *EDGE), ("compact",)),
        "compact_core_node_flow": ((*core, *NODE_FLOW), ("compact",)),
        "compact_core_graph": ((*core, *EDGE, *NODE_FLOW), ("compact",)),
        "compact_core_window_amount": ((*core, *WINDOW_AMOUNT), ("candidates",)),
        "compact_core_same_amount_spread": ((*core, *SPREAD), ("candidates",)),
        "compact_core_same_amount_spread_decay12h": ((*core, *SPREAD, *DECAY), ("candidates", "decay")),
        "compact_core_receiver_bank_burst": ((*core, *BANK_BURST), ("candidates",)),
        "compact_core_candidates_all": ((*core, *WINDOW_AMOUNT, *SPREAD, *BANK_BURST), ("candidates",)),
        "compact_core_behavior_shift": ((*core, *SHIFT), ("shift",)),
        "compact_core_behavior_shift_v2": ((*core, *SHIFT_V2), ("shift",)),
        "top10_compact": (TOP10, ("compact",)),
        "compact_h": ((*old, *NEW, *EDGE, *NODE_FLOW), ("compact",)),
    }


def choose(names: Sequence[str], drop_groups: Sequence[str] = (), drop_features: Sequence[str] = ()) -> list[str]:
    """The names of a set without some groups and features."""
    gone = {*drop_features, *(x for g in drop_groups for x in GROUPS[g])}
    prefixes = tuple(x for x in gone if x.endswith("_"))
    return [n for n in dict.fromkeys(names) if n not in gone and not (prefixes and n.startswith(prefixes))]


IDS = ("transaction_id", "ts_s", "own_bank", "own_account", "cp_bank", "cp_account", "is_laundering", "chain_id", "score")


def sender_features(tx: DataFrame, feature_set: str, drop_groups: Sequence[str] = (), drop_features: Sequence[str] = (), formats: Sequence[str] | None = None, share: tuple[int, int] | None = None) -> DataFrame:
    """One payer row per transaction with its identifiers and the features of a set.

    share, (k, n), leaves the rows whose own account lies in the k-th of n shares: no feature looks beyond an account.
    """
    obs = observations(tx)
    if share:
        obs = obs.where(F.pmod(F.xxhash64(*OWN, F.lit(share[1])), F.lit(share[1])) == share[0])
    df = bursts(base(obs, formats))
    sets = feature_sets([c for c in df.columns if c.startswith("payment_format_")])
    if feature_set not in sets:
        raise ValueError(f"unknown feature set {feature_set}; known: {', '.join(sets)}")
    names, families = sets[feature_set]
    for f in families:
        df = POOLED[f](df) if f in POOLED else df
    df = payer_rows(df)
    for f in families:
        df = PAYER[f](df) if f in PAYER else df
    return df.select(*(c for c in IDS if c in df.columns), *choose(names, drop_groups, drop_features))


def matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features as finite single-precision columns, identifiers as they are."""
    return df.select(*(c for c in df.columns if c not in names), *(S.clean(n).alias(n) for n in names))


def fill_by_group(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows with the first time of their group, as time_first."""
    return df.withColumn("time_first", F.min(ts).over(Window.partitionBy(*keys)))
