"""Relational graph operators: edges, weights, shares, flows over hops and in time, neighbourhood summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S, windows as W
from ..sources.constants import CURRENCIES
from . import graph_metrics as M, neighbourhoods as N
from .hops import candidate_counts, hop_table, temporal_table
from .shelves import once


def as_edges(tx: DataFrame) -> DataFrame:
    """Transactions under graph names: source, target, their banks, currency, both amounts, time and format."""
    return tx.select(
        F.col("from_account").alias("source"), F.col("to_account").alias("target"), F.col("from_bank").alias("source_bank"), F.col("to_bank").alias("target_bank"), F.col("payment_currency").alias("source_currency"),
        F.col("amount_paid").alias("source_amount"), F.col("amount_paid").alias("amount"), F.col("payment_format").alias("format"), "ts_s", "transaction_id",
    )


def edge_totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target").agg(F.sum("amount").alias("amount"))


def node_totals(totals: DataFrame, side: str) -> DataFrame:
    """(node, total) sent (side source) or received (side target)."""
    return totals.groupBy(F.col(side).alias("node")).agg(F.sum("amount").alias("total"))


def edge_weights(totals: DataFrame) -> DataFrame:
    """weight: the edge's share of what its source sends plus its share of what its target receives."""
    sent, received = F.sum("amount").over(Window.partitionBy("source")), F.sum("amount").over(Window.partitionBy("target"))
    return totals.withColumn("weight", F.col("amount") / sent + F.col("amount") / received)


def multi_edges(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Edges by banks and currency with counts, sums, the sorted (offset, amount) events and the weighted amount.

    Offsets count from a minute before the first transaction.  The weight is the pair's, so it repeats; weights has
    them where they are known already.
    """
    first = edges.agg((F.min("ts_s") - 60).alias("_first"))  # one row
    grouped = edges.crossJoin(F.broadcast(first)).groupBy("source", "target", "source_bank", "target_bank", "source_currency").agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.sum("amount").alias("amount"),
        F.sum("source_amount").alias("source_amount"),
        F.sort_array(F.collect_list(F.struct((F.col("ts_s") - F.col("_first")).alias("ts"), "amount"))).alias("events"),
    )
    if weights is None:
        weights = edge_weights(edge_totals(edges)).select("source", "target", "weight")
    top = weights.agg(F.max("weight").alias("_top"))  # one row
    weighed = grouped.join(weights, ["source", "target"], "left").crossJoin(F.broadcast(top))
    return weighed.withColumn("amount_weighted", F.col("amount") * (F.col("weight") / F.col("_top"))).drop("_top")


def edge_shares(edges: DataFrame, formats: Sequence[str], currencies: Sequence[tuple[str, str]] = tuple((n, c) for n, c, _ in CURRENCIES)) -> DataFrame:
    """Per edge: total, seconds between first and last payment, and shares by currency (of source amounts) and format."""
    total = F.sum("amount")
    return edges.groupBy("source", "target").agg(
        total.alias("total_amount"),
        (F.max("ts_s") - F.min("ts_s")).alias("related_for"),
        *((F.coalesce(F.sum(F.when(F.col("source_currency") == n, F.col("source_amount"))), F.lit(0.0)) / total).alias(f"share_{c}") for n, c in currencies),
        *((F.coalesce(F.sum(F.when(F.col("format") == f, F.col("amount"))), F.lit(0.0)) / total).alias(f"share_{S.snake(f)}") for f in formats),
    )


def _top(df: DataFrame, side: str, other: str, n: int) -> DataFrame:
    """The n largest rows of each node on one side; ties by the other node."""
    rank = F.row_number().over(Window.partitionBy(side).orderBy(F.col("amount").desc(), other))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def hop_flows(totals: DataFrame, hops: int, top_n: int, side: str, caps: DataFrame, anchors: DataFrame | None = None) -> list[DataFrame]:
    """Per hop (source, target, amount): the bottleneck flow that leaves (side source) or reaches (side target) each anchor.

    Each hop joins on one shared node, takes the smaller amount, sums parallel ways, keeps an anchor's top_n and
    caps them by its total.  Pruning first bounds the next join: a node has at most top_n edges on one side.
    """
    if not 1 <= hops <= 10 or top_n < 1:
        raise ValueError("hops must be 1 to 10 and top_n at least 1")
    other = "target" if side == "source" else "source"
    limits = (caps if anchors is None else caps.join(anchors, "node", "left_semi")).select(F.col("node").alias("_node"), F.col("total").alias("_total"))

    def pruned(df: DataFrame) -> DataFrame:
        kept = _top(df.join(limits, F.col(side) == F.col("_node")), side, other, top_n)
        return kept.select("source", "target", F.least("amount", "_total").alias("amount"))

    level = first = pruned(totals.where("source <> target"))
    found = [first]
    for _ in range(1, hops):
        left = level.select(F.col("source").alias("_from"), F.col("target").alias("_via"), F.col("amount").alias("_amount"))
        joined = left.join(first, F.col("_via") == F.col("source")).select(F.col("_from").alias("source"), "target", F.least("_amount", "amount").alias("amount"))
        level = pruned(joined.where("source <> target").groupBy("source", "target").agg(F.sum("amount").alias("amount")))
        found.append(level)
    return found


def hop_features(flows: Sequence[DataFrame], side: str, caps: DataFrame) -> DataFrame:
    """Per anchor and hop: total, nodes, population deviation, largest, and the total relative to the anchor's own."""
    out = caps.select(F.col("node").alias("key"), "total")
    for k, flow in enumerate(flows, 1):
        stats = flow.groupBy(F.col(side).alias("key")).agg(
            F.sum("amount").alias(f"flow_hop_{k}_total"), F.count(F.lit(1)).alias(f"flow_hop_{k}_number_of_nodes"), F.stddev_pop("amount").alias(f"flow_hop_{k}_std_amounts"), F.max("amount").alias(f"flow_hop_{k}_max_amounts")
        )
        out = out.join(stats, "key", "left").withColumn(f"flow_hop_{k}_rel_transferred", F.col(f"flow_hop_{k}_total") / F.col("total"))
    return out


#: Variants of the hop flows: side, side of the caps, and whether anchors must be on both sides.
FLOW_VARIANTS = {"dispense": ("source", "source", False), "sink": ("target", "target", False), "passthrough": ("source", "target", True), "passthrough_reverse": ("target", "source", True)}


def numbered(edges: DataFrame) -> bool:
    return all(dict(edges.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in ("source", "target"))


def hop_variant(edges: DataFrame, variant: str, hops: int = 5, top_n: int = 50) -> DataFrame:
    """hop_features of a variant: from shelves where accounts are whole numbers and amounts are known, else by joins."""
    side, cap_side, both = FLOW_VARIANTS[variant]
    if not 1 <= hops <= 10 or top_n < 1:
        raise ValueError("hops must be 1 to 10 and top_n at least 1")
    if numbered(edges):
        edges = once(edges.select("source", "target", "amount"))
        caps = node_totals(edges, cap_side)
        kept = caps.join(edges.select(F.col(side).alias("node")).distinct(), "node", "left_semi") if both else caps
        if (found := hop_table(edges, kept, side, hops, top_n)) is not None:
            return found
    totals = edge_totals(edges)
    caps = node_totals(totals, cap_side)
    anchors = caps.select("node").join(node_totals(totals, side), "node", "left_semi") if both else None
    kept = caps if anchors is None else caps.join(anchors, "node", "left_semi")
    return hop_features(hop_flows(totals, hops, top_n, side, kept, anchors), side, kept)


def temporal_flows(edges: DataFrame, top_n: int = 50) -> DataFrame:
    """(dispense, passthrough, sink, amount) over two payments in time order through one account.

    Only a node's top_n busiest edges on each side take part, so an account pairs at most top_n incoming with
    top_n outgoing relations.  Sums run over the pairs of payments, as the definition has it.
    """
    busy = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("amount"))
    left_edges, right_edges = _top(busy, "target", "source", top_n).select("source", "target"), _top(busy, "source", "target", top_n).select("source", "target")
    payments = edges.select("source", "target", "ts_s", "amount")
    left = payments.join(left_edges, ["source", "target"], "left_semi").select(F.col("source").alias("dispense"), F.col("target").alias("_via"), F.col("ts_s").alias("_ts"), F.col("amount").alias("_amount"))
    right = payments.join(right_edges, ["source", "target"], "left_semi")
    pairs = left.join(right, (F.col("_via") == F.col("source")) & (F.col("_ts") <= F.col("ts_s")))
    summed = pairs.groupBy("dispense", F.col("source").alias("passthrough"), F.col("target").alias("sink")).agg(F.sum("_amount").alias("_in"), F.sum("amount").alias("_out"))
    return summed.select("dispense", "passthrough", "sink", F.least("_in", "_out").alias("amount"))


def temporal_stats(flows: DataFrame, role: str) -> DataFrame:
    """Statistics of a role's flows, and the same over its cycles, from one pass."""
    cycle = F.col("dispense") == F.col("sink")

    def stats(of: Column, suffix: str) -> list[Column]:
        x = F.when(of, F.col("amount"))
        return [
            F.sum(x).alias(f"amount_sum{suffix}"), F.avg(x).alias(f"amount_mean{suffix}"), F.median(x).alias(f"amount_median{suffix}"), F.max(x).alias(f"amount_max{suffix}"), F.stddev_samp(x).alias(f"amount_std{suffix}"),
            *(F.count_distinct(F.when(of, F.col(c))).alias(f"{c}_count{suffix}") for c in ("dispense", "passthrough", "sink")),
        ]

    return flows.groupBy(F.col(role).alias("key")).agg(*stats(F.lit(True), ""), *stats(cycle, "_cycle"))


def temporal_role(edges: DataFrame, role: str, top_n: int = 50) -> DataFrame:
    """temporal_stats of the flows of a role: from shelves as hop_variant, the accounts between from the flows themselves."""
    found = temporal_table(edges, role, top_n) if role != "passthrough" and numbered(edges) else None
    return temporal_stats(temporal_flows(edges, top_n), role) if found is None else found


def segments(members: DataFrame, source: str, target: str, suffix: str = "") -> DataFrame:
    """Per key: how many endpoints are sources, targets, either, both, or one only."""
    ends = members.select("key", F.inline(F.array(F.struct(F.col(source).alias("n"), F.lit(1).alias("s"), F.lit(0).alias("t")), F.struct(F.col(target).alias("n"), F.lit(0).alias("s"), F.lit(1).alias("t")))))
    flagged = ends.groupBy("key", "n").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    count = lambda c: F.sum(c.cast("long"))
    s, t = F.col("s") == 1, F.col("t") == 1
    names = ("num_sources", "num_targets", "num_source_or_target", "num_source_and_target", "num_source_only", "num_target_only") if not suffix else tuple(
        f"num_{x}" for x in ("source_banks", "target_banks", "source_or_target_bank", "source_and_target_bank", "source_only_bank", "target_only_bank"))
    return flagged.groupBy("key").agg(*(count(c).alias(n) for n, c in zip(names, (s, t, s | t, s & t, s & ~t, t & ~s))))


def sided_amounts(members: DataFrame) -> DataFrame:
    """Per key: largest, mean, median and population deviation of what accounts receive (credit) and send (debit)."""
    out = None
    for name, side in (("credit", "target"), ("debit", "source")):
        per = members.groupBy("key", side).agg(F.sum("amount").alias("a"), F.sum("amount_weighted").alias("w"))
        stats = per.groupBy("key").agg(*(f(c).alias(f"{n}_{name}_edges{suffix}") for c, suffix in (("a", ""), ("w", "_weighted")) for n, f in (("max", F.max), ("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))))
        out = stats if out is None else out.join(stats, "key", "full_outer")
    return out


def turnover(members: DataFrame) -> DataFrame:
    """Per key: the sum of what accounts gain, and each currency's share of it in US dollars."""
    legs = members.select("key", "source_currency", F.inline(F.array(F.struct(F.col("target").alias("n"), F.col("amount").alias("d")), F.struct(F.col("source").alias("n"), (-F.col("amount")).alias("d")))))
    gained = legs.groupBy("key", "n").agg(F.sum("d").alias("d")).where("d > 0").groupBy("key").agg(F.sum("d").alias("turnover"))
    by_currency = legs.groupBy("key", "n", "source_currency").agg(F.sum("d").alias("d")).where("d > 0").groupBy("key").agg(
        *(F.sum(F.when(F.col("source_currency") == n, F.lit(rate) * F.col("d"))).alias(f"_{c}") for n, c, rate in CURRENCIES))
    keys = members.select("key").distinct()
    joined = keys.join(gained, "key", "left").join(by_currency, "key", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return joined.select("key", "turnover", *(F.try_divide(F.col(f"_{c}"), F.col("turnover")).alias(f"turnover_{c}") for _, c, _ in CURRENCIES))


def event_times(members: DataFrame) -> DataFrame:
    """Per key: range, deviation, and amount-weighted mean, median and deviation of the event times.

    The weighted median interpolates between the middles of the weights; moments are taken about the first time.
    """
    events = members.select("key", F.inline("events"))
    plain = events.groupBy("key").agg((F.max("ts") - F.min("ts")).alias("ts_range"), F.stddev_samp("ts").alias("ts_std"), (F.sum(F.col("ts") * F.col("amount")) / F.sum("amount")).alias("ts_weighted_mean"))
    deviations = events.join(plain.select("key", "ts_weighted_mean"), "key").groupBy("key").agg(F.sqrt(F.sum(F.col("amount") * F.pow(F.col("ts") - F.col("ts_weighted_mean"), 2)) / F.sum("amount")).alias("ts_weighted_std"))
    return plain.join(deviations, "key").join(weighted_quantile(events, "ts", "amount", 0.5, "ts_weighted_median"), "key")


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, name: str, interpolate: bool = True) -> DataFrame:
    """(key, name): the weighted quantile by the middles of cumulated weights, clamped at both ends; or the step form."""
    order = Window.partitionBy("key").orderBy(value, weight)
    run = F.sum(weight).over(order.rowsBetween(W.PRECEDING, W.CURRENT))
    total = F.sum(weight).over(Window.partitionBy("key"))
    if not interpolate:
        return df.withColumn("_c", run).withColumn("_t", total).where(F.col("_c") >= q * F.col("_t")).groupBy("key").agg(F.min_by(value, "_c").alias(name))
    placed = df.withColumn("_x", (run - F.col(weight) / 2) / total).withColumns({"_nx": F.lead("_x").over(order), "_nv": F.lead(value).over(order), "_first": F.row_number().over(order) == 1})
    slope = F.try_divide(F.col("_nv") - F.col(value), F.col("_nx") - F.col("_x"))
    at = F.when((F.col("_x") <= q) & (F.col("_nx") > q), F.col(value) + (q - F.col("_x")) * slope).when((F.col("_x") <= q) & F.col("_nx").isNull(), F.col(value)).when(F.col("_first") & (F.col("_x") > q), F.col(value))
    return placed.groupBy("key").agg(F.max(at.cast("double")).alias(name))


def neighbourhood_features(members: DataFrame) -> DataFrame:
    """All relational summaries of keyed multi-edges: members has key beside the columns of multi_edges."""
    counts = members.groupBy("key").agg(F.sum("num_transactions").alias("num_transactions"), F.count_distinct("source_currency").alias("num_currencies"))
    parts = [segments(members, "source", "target"), segments(members, "source_bank", "target_bank", "bank"), sided_amounts(members), turnover(members), event_times(members)]
    out = counts
    for part in parts:
        out = out.join(part, "key", "left")
    return out


def one_hop(multi: DataFrame, side: str) -> DataFrame:
    """Features of the edges that leave (source) or reach (target) each account."""
    return neighbourhood_features(multi.withColumn("key", F.col(side)))


def candidate_sets(totals: DataFrame, keep: int = 100) -> DataFrame:
    """(key, member): each account with its neighbours and theirs, over its heaviest undirected edges."""
    weights = edge_weights(totals)
    both = weights.select("source", "target", "weight").union(weights.select("target", "source", "weight")).toDF("source", "target", "amount")
    near = _top(both.groupBy("source", "target").agg(F.round(F.sum("amount"), 9).alias("amount")), "source", "target", keep).select(F.col("source").alias("key"), F.col("target").alias("member"))
    further = near.join(near.select(F.col("key").alias("_via"), F.col("member").alias("_next")), F.col("member") == F.col("_via")).select("key", F.col("_next").alias("member"))
    selves = near.select("key", F.col("key").alias("member"))
    return near.union(further).union(selves).distinct()


def candidate_numbers(edges: DataFrame, keep: int = 100) -> DataFrame:
    """(key, members): the sizes of candidate_sets, from shelves as hop_variant."""
    found = candidate_counts(edges, keep) if numbered(edges) else None
    return candidate_sets(edge_totals(edges), keep).groupBy("key").agg(F.count(F.lit(1)).alias("members")) if found is None else found


def _weighed(totals: DataFrame) -> DataFrame:
    """The account graph with the reference's weights, up to a factor."""
    return edge_weights(totals).withColumn("weight", F.col("amount") * F.col("weight"))


def neighbourhood_shapes(edges: DataFrame, keep: int = 100) -> DataFrame:
    """Diameters and biconnectivity within the candidate set of every account: from shelves as hop_variant."""
    found = N.shapes(edges, keep) if numbered(edges) else None
    return M.induced_shapes(candidate_sets(totals := edge_totals(edges), keep), _weighed(totals)) if found is None else found


def neighbourhood_ranks(edges: DataFrame, keep: int = 100, threshold: float = 0.01) -> DataFrame:
    """(key, member): who ranks high from each account within its candidate set: from shelves as hop_variant."""
    found = N.rank_communities(edges, keep, threshold) if numbered(edges) else None
    return M.induced_rank_communities(candidate_sets(totals := edge_totals(edges), keep), _weighed(totals), threshold) if found is None else found


def account_labels(edges: DataFrame) -> DataFrame:
    """graph_metrics.label_communities of the account graph: from shelves as hop_variant."""
    found = N.label_communities(edges) if numbered(edges) else None
    return M.label_communities(_weighed(edge_totals(edges))) if found is None else found


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in a key's member set, with the key."""
    starts = edges.join(members.select("key", F.col("member").alias("source")), "source")
    return starts.join(members.select("key", F.col("member").alias("target")), ["key", "target"], "left_semi")


def degrees(members: DataFrame, source: str = "source", target: str = "target", suffix: str = "") -> DataFrame:
    """Per key of an edge table: largest total, in- and out-degree, density without loops, and degree assortativity."""
    ends = members.select("key", F.inline(F.array(F.struct(F.col(source).alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    per = ends.groupBy("key", "n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    top = per.groupBy("key").agg(
        F.max(F.col("o") + F.col("i")).alias(f"max_degree{suffix}"), F.max("i").alias(f"max_degree_in{suffix}"), F.max("o").alias(f"max_degree_out{suffix}"),
        F.try_divide(F.sum("o"), F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias(f"density{suffix}"),
    )
    a = per.select("key", F.col("n").alias(source), F.col("o").alias("_o"), (F.col("o") + F.col("i")).alias("_ds"))
    b = per.select("key", F.col("n").alias(target), F.col("i").alias("_i"), (F.col("o") + F.col("i")).alias("_dt"))
    paired = members.groupBy("key", source, target).agg(F.count(F.lit(1)).alias("_m")).join(a, ["key", source]).join(b, ["key", target])
    both = paired.select("key", "_m", F.inline(F.array(F.struct(F.col("_ds").alias("x"), F.col("_dt").alias("y")), F.struct(F.col("_dt").alias("x"), F.col("_ds").alias("y")))))

    def corr(x: str, y: str) -> Column:
        """Pearson correlation from sums of whole numbers, exact to 38 digits; null where a side doesn't vary."""
        exact = lambda *names: F.sum(reduce(mul, (F.col(c).cast("decimal(12,0)") for c in ("_m", *names))).cast("decimal(38,0)"))
        n, sx, sy = exact(), exact(x), exact(y)
        vx, vy = (n * exact(x, x) - sx * sx).cast("double"), (n * exact(y, y) - sy * sy).cast("double")
        return F.try_divide((n * exact(x, y) - sx * sy).cast("double"), F.sqrt(vx) * F.sqrt(vy))

    directed = paired.groupBy("key").agg(corr("_o", "_i").alias(f"assortativity_degree{suffix}"))
    undirected = both.groupBy("key").agg(corr("x", "y").alias(f"assortativity_degree{suffix}_ud"))
    return top.join(directed, "key", "left").join(undirected, "key", "left")


def with_node_features(edges: DataFrame, nodes: DataFrame, keep_bare_target: bool = False) -> DataFrame:
    """Edges with the features of both accounts, as target_* and source_*; or the target's bare and the source's suffixed."""
    names = [c for c in nodes.columns if c != "key"]
    t = nodes.select(F.col("key").alias("target"), *(F.col(c).alias(c if keep_bare_target else f"target_{c}") for c in names))
    s = nodes.select(F.col("key").alias("source"), *(F.col(c).alias(f"{c}_source" if keep_bare_target else f"source_{c}") for c in names))
    return edges.join(t, "target", "left").join(s, "source", "left")


def merged_features(groups: dict[str, DataFrame]) -> DataFrame:
    """Feature groups outer-joined on key, each column suffixed by its group; accounts missing from a group have nulls."""
    out = None
    for name, df in groups.items():
        renamed = df.select("key", *(F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "key"))
        out = renamed if out is None else out.join(renamed, "key", "full_outer")
    return out


def varying_columns(df: DataFrame, keep: Sequence[str] = ("key",)) -> DataFrame:
    """df without its constant columns, columns in alphabetical order; one pass counts all of them."""
    others = [c for c in df.columns if c not in keep]
    spread = df.agg(*((F.min(c) < F.max(c)).alias(c) for c in others)).first()
    return df.select(*keep, *sorted(c for c in others if spread[c]))


def membership_flags(keys: DataFrame, totals: DataFrame) -> DataFrame:
    """has_credits: the key sends in some edge; has_debits: it receives (names as the definition has them)."""
    s, t = totals.select(F.col("source").alias("key")).distinct().withColumn("_s", F.lit(True)), totals.select(F.col("target").alias("key")).distinct().withColumn("_t", F.lit(True))
    return keys.join(s, "key", "left").join(t, "key", "left").select("key", F.coalesce("_s", F.lit(False)).alias("has_credits"), F.coalesce("_t", F.lit(False)).alias("has_debits"))
