"""The large-data feature family: inclusive windows, truncated amounts, and two ways to see an account's history.

An account is (bank, account) here, and windows are [t - w, t].  With ``bank_local`` history an account sees both
its payments and its receipts (payments first among ties); with ``strict_sender`` it sees payments alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S, windows as W
from ..sources.constants import DAY, HALF_LIFE, NAMES
from .features import OWN, observations, payer_rows

SRC, DST, PAIR = ("from_bank", "from_account"), ("to_bank", "to_account"), ("from_bank", "from_account", "to_bank", "to_account")
AMOUNT, BANK = (*SRC, "amount_paid"), ("to_bank",)
ORDER = ("ts_s", "transaction_id")
MODES = ("bank_local", "strict_sender")

# The names of features and sets.
MAINLINE = (
    "log_amount_paid", "log_amount_received", "same_currency", "own_account_prev_count", "time_since_last_tx_own", "counterparty_prev_count", "time_since_last_tx_counterparty",
    "payment_format_", "same_amount_cnt", "same_amount_receivers_prev", "same_amount_receiver_banks_prev", "own_decay_count_12h",
)
PAIR_RECEIVER = ("counterparty_amount_24h_sum", "counterparty_amount_24h_mean", "receiver_amount_24h_sum", "receiver_amount_24h_mean")
FANIN = ("receiver_account_prev_count", "time_since_last_tx_receiver", "receiver_unique_senders_prev", "receiver_unique_sender_banks_prev")
BANK_ROLE = (
    "receiver_account_prev_count", "time_since_last_tx_receiver", "receiver_unique_senders_prev", "receiver_fanin_ratio", "receiver_bank_prev_count", "time_since_last_tx_receiver_bank",
    "receiver_bank_amount_24h_sum", "receiver_bank_amount_24h_mean", "receiver_bank_unique_senders_prev", "receiver_bank_fanin_ratio", "pair_to_sender_ratio", "same_amount_to_sender_ratio",
)
HISTORY = ("receiver_account_prev_count", "time_since_last_tx_receiver", "receiver_decay_count_12h", "same_amount_senders_prev", "same_amount_sender_banks_prev")
SCALE24 = ("hour", "dayofweek", "internal_transfer", "self_account", "tx_24h", "new_cp_24h", "is_new_cp", "amt_vs_prevmean", "amount_round1k")
CONTEXT = ("hour", "dayofweek", "internal_transfer", "amount_round1k", "amount_round10k", "amount_round100k")
SMALL = tuple(x for x in MAINLINE if x not in ("same_amount_receivers_prev", "same_amount_receiver_banks_prev", "own_decay_count_12h"))
CURRENCY = ("payment_currency_", "receiving_currency_")
SETS: dict[str, tuple[str, ...]] = {
    "mainline_decay12h": MAINLINE,
    "mainline_receiver_history": (*MAINLINE, *HISTORY),
    "mainline_currency": (*MAINLINE, *CURRENCY),
    "mainline_light_context": (*MAINLINE, *CURRENCY, *CONTEXT),
    "mainline_flow_amounts": (*MAINLINE, "own_amount_24h_sum", "own_amount_24h_mean", *PAIR_RECEIVER),
    "mainline_pair_receiver_flow": (*MAINLINE, *PAIR_RECEIVER),
    "mainline_receiver_fanin_flow": (*MAINLINE, *FANIN, *PAIR_RECEIVER),
    "mainline_receiver_bank_role": (*MAINLINE, *BANK_ROLE),
    "mainline_plus_scale24": (*MAINLINE, *SCALE24),
    "scale24": (*SMALL, *SCALE24),
}


def truncated(x: str | Column) -> Column:
    """Window sums add whole amounts only."""
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def group_stats(df: DataFrame, prefix: str, keys: Sequence[str], order: Sequence = ORDER, extra: str = "amount_paid", seconds: int = DAY) -> DataFrame:
    """prefix_prev, prefix_since, prefix_count and prefix_sum of a key: rows before, seconds since, and what the window holds.

    Running values come first and what is too old second: the second window finds the first one's sort.
    """
    running = df.withColumns({
        f"{prefix}_prev": W.prev_count(keys, order),
        f"{prefix}_since": W.since_prev("ts_s", keys, order),
        "_run": F.sum(truncated(extra)).over(W.over(keys, order).rowsBetween(W.PRECEDING, W.CURRENT)),
    })
    old = W.too_old(keys, "ts_s", seconds, True)
    return running.withColumns({
        f"{prefix}_count": F.col(f"{prefix}_prev") + 1 - F.count(F.lit(1)).over(old),
        f"{prefix}_sum": F.col("_run") - F.coalesce(F.sum(truncated(extra)).over(old), F.lit(0)),
    }).drop("_run")


def own_history(tx: DataFrame, mode: str) -> DataFrame:
    """tx with the own account's own_prev, own_since, own_count, own_sum and own_decay_count_12h."""
    if mode not in MODES:
        raise ValueError(f"history mode must be one of {MODES}")
    if mode == "strict_sender":
        return W.with_decayed_count(group_stats(tx, "own", SRC), "own_decay_count_12h", "ts_s", HALF_LIFE, SRC, ORDER)
    order = ("ts_s", "role_ord", "transaction_id")
    seen = W.with_decayed_count(group_stats(observations(tx), "own", OWN, order), "own_decay_count_12h", "ts_s", HALF_LIFE, OWN, order)
    names = {"own_bank": "from_bank", "own_account": "from_account", "cp_bank": "to_bank", "cp_account": "to_account"}
    return payer_rows(seen).withColumnsRenamed(names).drop("role", "role_ord")


def with_arrivals(df: DataFrame) -> DataFrame:
    """_new: 1 for a sender's first payment to a bank, else 0."""
    return df.withColumn("_new", (F.row_number().over(W.over((*SRC, *BANK), ORDER)) == 1).cast("long"))


def bank_history(df: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """bank_prev, bank_since, bank_count, bank_sum and bank_senders of the receiving bank.

    Banks are few and large, so rows are summed to (bank, second) first: only seconds meet in a bank's window,
    and ties are ranked within their second.  The sums start from tx, the plain payments that df's rows come
    from, so that no feature of df is computed for them.
    """
    tx = df if tx is None else tx
    rows = df if "_new" in df.columns else with_arrivals(df)
    tied = W.over((*BANK, "ts_s"), ("transaction_id",)).rowsBetween(W.PRECEDING, W.CURRENT)
    rows = rows.withColumns({"_k": F.row_number().over(W.over((*BANK, "ts_s"), ("transaction_id",))), "_a": F.sum(truncated("amount_paid")).over(tied), "_s": F.sum("_new").over(tied)})
    plain = with_arrivals(tx.select(*BANK, *SRC, *ORDER, "amount_paid"))
    seconds = plain.groupBy(*BANK, "ts_s").agg(F.count(F.lit(1)).alias("n"), F.sum(truncated("amount_paid")).alias("a"), F.sum("_new").alias("s"))
    before = W.over(BANK, ("ts_s",)).rowsBetween(W.PRECEDING, -1)
    recent = W.over(BANK, ("ts_s",)).rangeBetween(-DAY, -1)
    zero = F.lit(0)
    told = seconds.select(
        F.col("to_bank").alias("_bank"), F.col("ts_s").alias("_ts"), F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("s").over(before), zero).alias("s0"),
        F.coalesce(F.sum("n").over(recent), zero).alias("nr"), F.coalesce(F.sum("a").over(recent), zero).alias("ar"), F.lag("ts_s").over(W.over(BANK, ("ts_s",))).alias("t0"),
    )
    joined = rows.join(told, (F.col("to_bank") == F.col("_bank")) & (F.col("ts_s") == F.col("_ts")))
    return joined.withColumns({
        "bank_prev": F.col("n0") + F.col("_k") - 1,
        "bank_since": F.when(F.col("_k") > 1, F.lit(0)).otherwise(F.coalesce(F.col("ts_s") - F.col("t0"), F.lit(-1))).cast("long"),
        "bank_count": F.col("nr") + F.col("_k"),
        "bank_sum": F.col("ar") + F.col("_a"),
        "bank_senders": F.col("s0") + F.col("_s") - F.col("_new"),
    }).drop("_bank", "_ts", "n0", "s0", "nr", "ar", "t0", "_k", "_a", "_s", "_new")


def _flow(df: DataFrame, prefix: str, name: str) -> DataFrame:
    mean = F.greatest(F.col(f"{prefix}_sum"), F.lit(0)) / F.greatest(F.col(f"{prefix}_count"), F.lit(1))
    return df.withColumns({f"{name}_amount_24h_sum": F.log1p(F.greatest(F.col(f"{prefix}_sum"), F.lit(0)).cast("double")), f"{name}_amount_24h_mean": F.log1p(mean)})


def scale_features(tx: DataFrame, feature_set: str, mode: str = "bank_local", formats: Sequence[str] | None = None, names: Sequence[str] = NAMES) -> DataFrame:
    """One payer row per transaction with its identifiers and the features of a set under a history mode."""
    if feature_set not in SETS:
        raise ValueError(f"unknown feature set {feature_set}; known: {', '.join(SETS)}")
    wanted = SETS[feature_set]
    chosen_of = lambda *names: {n: v for n, v in names if n in wanted}
    # all that a payer's rows tell first, then all that a receiver's do: keys that begin alike need one exchange
    df = group_stats(own_history(tx, mode), "pair", PAIR).withColumn("is_new_cp", (F.col("pair_prev") == 0).cast("int"))
    df = df.withColumns({"_paid_before": W.prev_sum(F.col("amount_paid"), SRC, ORDER), "_sent_before": W.prev_count(SRC, ORDER), "_new_run": F.sum("is_new_cp").over(W.over(SRC, ORDER).rowsBetween(W.PRECEDING, W.CURRENT))})
    df = df.withColumn("new_cp_24h", F.col("_new_run") - F.coalesce(F.sum("is_new_cp").over(W.too_old(SRC, "ts_s", DAY, True)), F.lit(0)))
    df = W.with_prev_distincts(df, chosen_of(("same_amount_receivers_prev", DST), ("same_amount_receiver_banks_prev", "to_bank")), AMOUNT, ORDER)
    df = W.with_prev_distincts(df, chosen_of(("same_amount_senders_prev", SRC), ("same_amount_sender_banks_prev", "from_bank")), AMOUNT, ORDER)
    df = df.withColumn("same_amount_cnt", W.prev_count(AMOUNT, ORDER))
    banks = any(x.startswith("receiver_bank") for x in wanted)
    df = group_stats(with_arrivals(df) if banks else df, "recv", DST)
    if "receiver_decay_count_12h" in wanted:
        df = W.with_decayed_count(df, "receiver_decay_count_12h", "ts_s", HALF_LIFE, DST, ORDER)
    df = W.with_prev_distincts(df, chosen_of(("receiver_unique_senders_prev", SRC), ("receiver_unique_sender_banks_prev", "from_bank")), DST, ORDER)
    if banks:
        df = bank_history(df, tx)
    for prefix, name in (("own", "own"), ("pair", "counterparty"), ("recv", "receiver"), ("bank", "receiver_bank")):
        if f"{name}_amount_24h_sum" in wanted:
            df = _flow(df, prefix, name)
    internal = F.col("from_bank") == F.col("to_bank")
    df = df.withColumns({
        "log_amount_paid": F.log1p("amount_paid"),
        "log_amount_received": F.log1p("amount_received"),
        "same_currency": (F.col("payment_currency") == F.col("receiving_currency")).cast("int"),
        "own_account_prev_count": F.col("own_prev"),
        "time_since_last_tx_own": F.col("own_since"),
        "counterparty_prev_count": F.col("pair_prev"),
        "time_since_last_tx_counterparty": F.col("pair_since"),
        "receiver_account_prev_count": F.col("recv_prev"),
        "time_since_last_tx_receiver": F.col("recv_since"),
        "hour": S.hour_of("ts_s"),
        "dayofweek": S.weekday_of("ts_s"),
        "internal_transfer": internal.cast("int"),
        "self_account": (internal & (F.col("from_account") == F.col("to_account"))).cast("int"),
        "tx_24h": F.col("own_count"),
        "amt_vs_prevmean": F.log1p(F.greatest(S.safe_ratio(F.col("amount_paid"), F.try_divide(F.col("_paid_before"), F.col("_sent_before")), 1.0), F.lit(0.0))),
        **{f"amount_round{n}k": S.round_amount("amount_paid", n * 1000) for n in (1, 10, 100)},
    })
    one = F.lit(1)
    df = df.withColumns({"pair_to_sender_ratio": F.col("pair_prev") / F.greatest(F.col("own_prev"), one), "same_amount_to_sender_ratio": F.col("same_amount_cnt") / F.greatest(F.col("own_prev"), one)})
    if "receiver_fanin_ratio" in wanted:
        df = df.withColumn("receiver_fanin_ratio", F.col("receiver_unique_senders_prev") / F.greatest(F.col("recv_prev"), one))
    if "receiver_bank_prev_count" in wanted:
        df = df.withColumns({
            "receiver_bank_prev_count": F.col("bank_prev"),
            "time_since_last_tx_receiver_bank": F.col("bank_since"),
            "receiver_bank_unique_senders_prev": F.col("bank_senders"),
            "receiver_bank_fanin_ratio": F.col("bank_senders") / F.greatest(F.col("bank_prev"), one),
        })
    df = S.one_hot(df, "payment_format", "payment_format", formats)
    for column in ("payment_currency", "receiving_currency") if "payment_currency_" in wanted else ():
        df = S.one_hot(df, column, column, names)
    chosen = [c for x in wanted for c in (sorted(d for d in df.columns if d.startswith(x)) if x.endswith("_") else [x])]
    return df.select("transaction_id", "ts_s", "is_laundering", *chosen)
