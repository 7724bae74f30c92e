"""Registered queries over all of their accounts, against brute force on tables of a few rows."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from quillflow.operators import evaluation as E, graph_metrics as M, ml
from quillflow.plans import models, registry

#: (order's customer, part, quantity); two parts of the graph, a loop, a way through accounts 5 and 7.
PAYMENTS = [(1, 5, 10), (2, 5, 4), (5, 7, 6), (5, 1, 3), (7, 8, 9), (7, 2, 2), (8, 8, 1), (8, 1, 5), (301, 302, 7), (302, 303, 8), (303, 301, 2), (301, 303, 1), (1, 5, 2), (7, 302, 1)]


def written(spark, folder, payments):
    """The payments as lineitem and orders."""
    day = datetime.date(1995, 1, 2)
    lines = [(k, t, 1, 1, float(q), float(q) * 10, 0.05, 0.0, "N", "O", day + datetime.timedelta(k % 5)) for k, (_, t, q) in enumerate(payments)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k, s, "1-URGENT") for k, (s, _, _) in enumerate(payments)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("whole")), PAYMENTS)


def totals():
    out: dict = {}
    for s, t, q in PAYMENTS:
        out[s, t] = out.get((s, t), 0) + q * 100.0
    return out


def neighbourhoods():
    """account -> edges within the account, its neighbours and theirs."""
    near: dict = {}
    for s, t in totals():
        near.setdefault(s, {s}).add(t)
        near.setdefault(t, {t}).add(s)
    sets = {k: set().union(*(near[x] for x in near[k])) for k in near}
    return {k: [(s, t) for s, t in totals() if s in xs and t in xs] for k, xs in sets.items()}


def longest(edges):
    """By Floyd and Warshall."""
    nodes = {x for e in edges for x in e}
    d = {(a, b): 0 if a == b else 1 if (a, b) in edges else np.inf for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return max(x for x in d.values() if x < np.inf)


def pieces(edges, without=None):
    left = {x for e in edges for x in e} - {without}
    found = 0
    while left:
        found, level = found + 1, [left.pop()]
        while level:
            level = [y for x in level for e in edges if x in e for y in e if y in left and not left.discard(y)]
    return found


def test_shapes_of_every_account(spark, small_dir):
    found = {r.key: r for r in registry.queries()["gr12_gr13_shapes"](spark, small_dir).collect()}
    expected = neighbourhoods()
    assert set(found) == set(expected)
    for key, edges in expected.items():
        both = edges + [(t, s) for s, t in edges]
        cut = [x for x in {x for e in edges for x in e} if pieces(edges, x) > pieces(edges)]
        assert (found[key].diameter, found[key].diameter_ud, found[key].num_articulation_points) == (longest(edges), longest(both), len(cut))


def test_rank_communities_of_every_account(spark, small_dir):
    found: dict = {}
    for r in registry.queries()["gr15_gr16_rank_communities"](spark, small_dir).collect():
        found.setdefault(r.key, set()).add(r.member)
    amounts, expected = totals(), neighbourhoods()
    sent = {s: sum(v for (a, _), v in amounts.items() if a == s) for s, _ in amounts}
    received = {t: sum(v for (_, b), v in amounts.items() if b == t) for _, t in amounts}
    assert set(found) == set(expected)
    for seed, edges in expected.items():
        nodes = sorted({x for e in edges for x in e})
        a = np.zeros((len(nodes), len(nodes)))
        for s, t in edges:
            w = amounts[s, t] ** 2 * (1 / sent[s] + 1 / received[t])
            a[nodes.index(s), nodes.index(t)] += w
            a[nodes.index(t), nodes.index(s)] += w
        start = np.array([float(x == seed) for x in nodes])
        rank = np.linalg.solve(np.eye(len(nodes)) - 0.95 * (a / a.sum(1, keepdims=True)).T, 0.05 * start)
        top = max(r for x, r in zip(nodes, rank) if x != seed)
        assert found[seed] == {seed, *(x for x, r in zip(nodes, rank) if r / top >= 0.01)}


@pytest.mark.parametrize("block", [1, 256])
def test_blocks_do_not_matter(spark, block):
    sets = spark.createDataFrame([(k, m) for k in range(6) for m in range(k, k + 4)], "key long, member long")
    edges = spark.createDataFrame([(a, a + d) for a in range(9) for d in (1, 2)], "source long, target long")
    assert sorted(tuple(r) for r in M.induced_shapes(sets, edges, block).collect()) == [(k, 2, 2, 1, 0) for k in range(6)]


def test_two_hops_over_all_edges(spark, small_dir):
    found = {(r.source, r.target): r.amount for r in registry.queries()["jn05_two_hop_all_edges"](spark, small_dir).collect()}
    expected: dict = {}
    for (s, via), a in totals().items():
        for (middle, t), b in totals().items():
            if middle == via and s != t:
                expected[s, t] = expected.get((s, t), 0) + min(a, b)
    assert found == expected and any(s > 100 for s, _ in found)


def test_temporal_pairs_of_all_payments(spark, small_dir):
    found = {r.dispense: r.pairs for r in registry.queries()["jn07_temporal_all_payments"](spark, small_dir).collect()}
    expected: dict = {}
    for j, (s, via, _) in enumerate(PAYMENTS):
        for k, (middle, _, _) in enumerate(PAYMENTS):
            if middle == via and j % 5 <= k % 5:
                expected[s] = expected.get(s, 0) + 1
    assert found == expected and max(found) > 300


def test_anchors_are_all_accounts_of_their_side(spark, small_dir):
    rows = registry.queries()["jn04_all_anchors"](spark, small_dir).collect()
    sources, targets = {s for s, _ in totals()}, {t for _, t in totals()}
    for variant, expected in (("dispense", sources), ("passthrough", sources & targets)):
        assert {r.source for r in rows if r.variant == variant} == expected
    for variant, expected in (("sink", targets), ("passthrough_reverse", sources & targets)):
        assert {r.target for r in rows if r.variant == variant} == expected


def test_splits_hold_every_row(spark, small_dir):
    rows = registry.queries()["jn03_materialised_splits"](spark, small_dir).collect()
    for rule in ("count", "time", "chain"):
        assert sorted(r.transaction_id for r in rows if r.rule == rule) == list(range(len(PAYMENTS)))
        assert sum(r.amount_paid for r in rows if r.rule == rule) == sum(totals().values())
    grown = {r.upto: r.rows for r in registry.queries()["so01_cumulative_splits"](spark, small_dir).collect()}
    assert grown == {0: 8, 1: 10, 2: 14}


def test_node_features_hold_every_group(spark, small_dir):
    df = registry.queries()["cp03_node_features"](spark, small_dir)
    rows = {r.key: r for r in df.collect()}
    assert set(rows) == {x for e in totals() for x in e}
    groups = ("label", "rank", "source", "target", "hop_dispense", "hop_sink", "hop_passthrough", "hop_passthrough_reverse", "dispense", "passthrough", "sink")
    assert not [g for g in groups if not any(c.endswith(f"_{g}") for c in df.columns)]
    assert all(r.anomaly_score is not None for r in rows.values())
    for key in (1, 8, 303):
        assert rows[key].flow_hop_1_total_hop_sink == sum(v for (s, t), v in totals().items() if t == key != s)
    for c in set(df.columns) - {"anomaly_score"}:
        assert len({r[c] for r in rows.values()} - {None}) > 1


def test_final_features_of_three_graphs(spark, small_dir):
    df = registry.queries()["cp06_jn09_final_features"](spark, small_dir)
    order = sorted(range(len(PAYMENTS)), key=lambda k: (k % 5, k))
    bucket = {k: (at >= 8) + (at >= 10) for at, k in enumerate(order)}
    rows = {r.transaction_id: r for r in df.collect()}
    assert {k: r.bucket for k, r in rows.items()} == bucket
    for k, r in rows.items():
        assert r.total_amount == sum(q * 100.0 for j, (s, t, q) in enumerate(PAYMENTS) if (s, t) == PAYMENTS[k][:2] and bucket[j] <= bucket[k])
        assert r.source_anomaly_score is not None and r.anomaly_scores_diff == r.target_anomaly_score - r.source_anomaly_score
    assert len([c for c in df.columns if c.startswith("share_")]) == 20


def test_ordinary_accounts_are_not_cut(spark, tmp_path):
    star = [(1, t, 1 + t % 7) for t in range(2, 42)] + [(t, 100 + t, 1) for t in range(2, 42)]
    folder, q = written(spark, str(tmp_path), star), registry.queries()
    assert {r.flow_hop_1_number_of_nodes for r in q["gr02_hop_flow_five_hops"](spark, folder).where("key = 1").collect()} == {40}
    hop = q["gr02_gr03_hop_flow_dispense_whole"](spark, folder).where("key = 1").first()
    assert (hop.flow_hop_1_number_of_nodes, hop.flow_hop_2_number_of_nodes, hop.flow_hop_5_total) == (40, 40, None)
    assert q["gr14_candidate_sets_whole"](spark, folder).where("key = 1").first().members == 81
    later = sum(k % 5 <= (k + 40) % 5 for k in range(40))
    assert q["gr04_temporal_flows_whole"](spark, folder).where("dispense = 1").count() == later


def test_counts_of_trees_and_replicates(spark, small_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "boosted", lambda rows, names, trees=50, **other: seen.append(trees) or ml.logistic(rows, names))
    monkeypatch.setattr(models, "_features", lambda spark, sf_dir: spark.range(40).selectExpr("id as transaction_id", "int(id % 2) as is_laundering", *(f"double(id * {k + 1} % 7) as {c}" for k, c in enumerate(models.SMALL))))
    for name in ("ml02_ml11_boosted", "ml04_quantised"):
        assert registry.queries()[name](spark, small_dir).count() == 40
    assert seen == [300, 50]
    rates = E.rates
    monkeypatch.setattr(E, "rates", lambda drawn: seen.append(drawn.count()) or rates(drawn))
    for name in ("ag28_bootstrap_f1", "cp16_prediction_analysis"):
        registry.queries()[name](spark, small_dir)
    assert seen[2:].count(2000) == 2
