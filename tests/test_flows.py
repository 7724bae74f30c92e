"""Flows, neighbourhoods and rounding as SQL has them, and that no row of a join of edges is exchanged."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillflow.operators import arcs as A, graph as R, graph_metrics as M, hops, neighbourhoods as N, shelves as H
from quillflow.operators.node_features import community_features, rank_features
from quillflow.plans import graphs


def payments(spark, seed=3, n=600, accounts=40, shift=0):
    random = np.random.default_rng(seed)
    rows = [(int(s) + shift, int(t) + shift, float(a) * 100, int(ts)) for s, t, a, ts in zip(random.integers(0, accounts, n), random.integers(0, accounts, n), random.integers(1, 9, n), random.integers(0, 12, n))]
    return spark.createDataFrame(rows, "source long, target long, amount double, ts_s long")


def by_joins(edges, variant, hops, top_n):
    side, cap_side, both = R.FLOW_VARIANTS[variant]
    totals = R.edge_totals(edges)
    caps = R.node_totals(totals, cap_side)
    kept = caps.join(R.node_totals(totals, side), "node", "left_semi") if both else caps
    return R.hop_features(R.hop_flows(totals, hops, top_n, side, kept, kept.select("node") if both else None), side, kept)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def alike(found, expected):
    assert found.columns == expected.columns
    key = lambda r: (r["key"] is not None, r["key"])
    a, b = sorted(found.collect(), key=key), sorted(expected.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert [v if v is None else pytest.approx(v, rel=1e-12, abs=1e-9) for v in y] == list(x)


@pytest.mark.parametrize("value", [5.77875, 8.38375, 4.30125, 0.03125, -5.77875, 1e300, 2.5])
def test_rounding_is_that_of_sql(spark, duck, value):
    found = graphs._rounded(spark.createDataFrame([(value, 1)], "x double, n long")).first()
    assert (found.x, found.n) == (duck.execute("SELECT round(?::DOUBLE, 4)", [value]).fetchone()[0], 1)


@pytest.mark.parametrize("variant", R.FLOW_VARIANTS)
def test_hops_from_shelves(spark, variant):
    edges = payments(spark, shift=-700)
    found = R.hop_variant(edges, variant, 4, 3)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    alike(found, by_joins(edges, variant, 4, 3))


@pytest.mark.parametrize("variant", ["dispense", "sink"])
def test_hops_of_unknown_accounts_and_amounts(spark, variant):
    odd = payments(spark, n=60).union(spark.createDataFrame([(1, None, 100.0, 1), (2, 3, None, 1)], "source long, target long, amount double, ts_s long"))
    alike(R.hop_variant(odd, variant, 2, 3), by_joins(odd, variant, 2, 3))


def test_sums_without_packing():
    random = np.random.default_rng(1)
    owner, other, value = random.integers(0, 9, 500), random.integers(0, 9, 500), random.random(500)
    small, wide = H.grouped(owner, other, [value]), H.grouped(owner, other << 58, [value])
    assert (small[0] == wide[0]).all() and (small[1] << 58 == wide[1]).all() and np.allclose(small[2], wide[2])


@pytest.mark.parametrize("role", ["dispense", "sink"])
@pytest.mark.parametrize("rows", [1 << 20, 50])
def test_temporal_roles_from_shelves(spark, monkeypatch, role, rows):
    monkeypatch.setattr(H, "ROWS", rows)
    edges = payments(spark, accounts=25).union(payments(spark, seed=4, n=9, accounts=9, shift=5000))
    found = R.temporal_role(edges, role, 6)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    alike(found, R.temporal_stats(R.temporal_flows(edges, 6), role))


def test_medians_of_uneven_accounts():
    owner, amount = np.repeat([0, 2, 3], [90, 1, 4]), np.random.default_rng(2).random(95)
    expected = [np.median(amount[owner == k]) if k != 1 else np.nan for k in range(4)]
    for n in (4, 400):
        shuffled = np.r_[owner, np.arange(4, n)], np.r_[amount, np.zeros(n - 4)]
        assert np.allclose(hops._middle(n, *shuffled)[:4], expected, equal_nan=True)


def test_candidate_numbers_from_shelves(spark):
    edges = payments(spark, n=90, accounts=60)
    found = R.candidate_numbers(edges, 4)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    alike(found, R.candidate_sets(R.edge_totals(edges), 4).groupBy("key").count().withColumnRenamed("count", "members"))


def test_degrees_whose_squares_exceed_a_long(spark):
    # banks with some 1.2 million payments: the sum of their squared degrees is above 2^63
    sizes = {(1, 2): 1_500_000, (2, 3): 1_200_000, (3, 1): 900_000, (1, 3): 600_000}
    parts = [spark.range(n).selectExpr("1L as key", f"{s}L as source", f"{t}L as target") for (s, t), n in sizes.items()]
    row = R.degrees(parts[0].union(parts[1]).union(parts[2]).union(parts[3])).first()
    out, into = ({x: sum(n for e, n in sizes.items() if e[k] == x) for x in (1, 2, 3)} for k in (0, 1))
    n = np.array(list(sizes.values()), float)
    x, y = np.array([out[s] for s, _ in sizes], float), np.array([into[t] for _, t in sizes], float)
    x, y = x - np.average(x, weights=n), y - np.average(y, weights=n)
    assert row.max_degree == max(out[k] + into[k] for k in out)
    assert row.assortativity_degree == pytest.approx((n * x * y).sum() / np.sqrt((n * x * x).sum() * (n * y * y).sum()), rel=1e-9)


def test_degrees_that_do_not_vary(spark):
    ring = spark.createDataFrame([(1, k, (k + 1) % 5) for k in range(5)], "key long, source long, target long")
    row = R.degrees(ring).first()
    assert (row.max_degree, row.assortativity_degree, row.assortativity_degree_ud) == (2, None, None)


def test_ranks_of_neighbourhoods_from_shelves(spark, monkeypatch):
    edges = payments(spark, n=150, accounts=60).union(payments(spark, seed=4, n=9, accounts=9, shift=5000))
    sets = R.candidate_sets(totals := R.edge_totals(edges), 4)
    expected = {tuple(r) for r in M.induced_rank_communities(sets, R._weighed(totals), 0.05).collect()}
    for rows in (1 << 20, 50):
        monkeypatch.setattr(H, "ROWS", rows)
        found = R.neighbourhood_ranks(edges, 4, 0.05)
        assert "Join" not in plan(found) and "Exchange" not in plan(found)
        pairs = [tuple(r) for r in found.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


@pytest.mark.parametrize("damping", [0.95, 0.5])
def test_ranks_by_conjugate_gradients(damping):
    random = np.random.default_rng(7)
    for n, m in ((2, 1), (30, 25), (40, 300)):
        s, t, w = random.integers(0, n, m), random.integers(0, n, m), random.random(m) * (random.random(m) < 0.9)
        a, b, both = np.r_[s, t], np.r_[t, s], np.r_[w, w]
        order = np.lexsort((b, a))
        for seed in range(0, n, 7):
            found, expected = N.rank_of(seed, n, a[order], b[order], both[order], damping), M.personal_rank(s, t, w, seed, damping)
            assert np.allclose([found[k] for k in expected], list(expected.values()), atol=1e-10) and found.sum() == pytest.approx(1)


def test_unknown_amounts_take_the_joins(spark):
    edges = payments(spark, n=60, accounts=20).union(spark.createDataFrame([(1, 77, None, 3)], "source long, target long, amount double, ts_s long"))
    assert N.rank_communities(edges, 4) is None
    totals = R.edge_totals(edges)
    alike(R.candidate_numbers(edges, 4), R.candidate_sets(totals, 4).groupBy("key").count().withColumnRenamed("count", "members"))


def test_shapes_of_neighbourhoods_from_shelves(spark):
    edges = payments(spark, n=110, accounts=60).union(payments(spark, seed=4, n=9, accounts=9, shift=5000))
    found = R.neighbourhood_shapes(edges, 4)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    totals = R.edge_totals(edges)
    expected = M.induced_shapes(R.candidate_sets(totals, 4), totals).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected))
    assert len({r.diameter for r in expected}) > 1 and any(r.num_articulation_points for r in expected)


@pytest.mark.parametrize("rows", [1 << 20, 50])
def test_features_of_rank_communities_from_shelves(spark, monkeypatch, rows):
    monkeypatch.setattr(H, "ROWS", rows)
    edges = payments(spark, n=150, accounts=40).union(payments(spark, seed=4, n=9, accounts=9, shift=5000))
    bank = lambda c: F.pmod(F.col(c), F.lit(4)).cast("int")
    names = F.get(F.array(*(F.lit(n) for n in ("Euro", "US Dollar", "Token"))), F.pmod(F.col("source") + F.col("ts_s"), F.lit(3)).cast("int"))
    edges = edges.withColumns({"source_bank": bank("source"), "target_bank": bank("target"), "source_currency": names, "source_amount": F.col("amount")}).localCheckpoint()
    multi = R.multi_edges(edges).localCheckpoint()
    found = rank_features(edges, multi, 4, 0.05)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    alike(found, community_features(R.neighbourhood_ranks(edges, 4, 0.05), multi).select(*found.columns))
    # without a known bank they take the joins
    bare = edges.withColumn("source_bank", F.when(F.col("source") != 3, F.col("source_bank")))
    assert N.rank_features(bare, R.multi_edges(bare), 4, 0.05) is None


def test_labels_from_shelves(spark):
    edges = payments(spark, n=120, accounts=80).union(payments(spark, seed=4, n=30, accounts=20, shift=5000)).localCheckpoint()
    found = R.account_labels(edges)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    expected = {tuple(r) for r in M.label_communities(R._weighed(R.edge_totals(edges))).collect()}
    assert {tuple(r) for r in found.collect()} == expected and len({c for _, c in expected}) > 3


def arcs_of(kind: int, n: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Any arcs, branches of two levels below 0, or a long path with some more arcs."""
    random = np.random.default_rng(seed)
    a, b = random.integers(0, n, m), random.integers(0, n, m)
    if kind == 1:
        top, inside = 1 + m % 20, (a > 0) & (b > 0) & (random.random(m) < 0.3)
        a, b = np.r_[np.zeros(top, int), random.integers(1, top + 1, n - top - 1), a[inside]], np.r_[np.arange(1, n), b[inside]]
    if kind == 2:
        a, b = np.r_[np.arange(n - 1), a], np.r_[np.arange(1, n), b]
    turned = random.random(len(a)) < 0.3
    return np.divmod(np.unique(np.where(turned, b, a) * n + np.where(turned, a, b)), n)


def slow_shape(n: int, a: np.ndarray, b: np.ndarray) -> tuple[int, ...]:
    ways, both = {k: set() for k in range(n)}, {k: set() for k in range(n)}
    for x, y in zip(a.tolist(), b.tolist()):
        ways[x].add(y)
        both[x].add(y)
        both[y].add(x)
    return M.diameter(ways), M.diameter(both), *M.biconnected(both)


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("few", [64, 192])
def test_shapes_by_bounds(monkeypatch, kind, few):
    monkeypatch.setattr(A, "FEW", few)
    for k, share in enumerate((0.3, 0.8, 1, 1.3, 2, 4, 8) * 3):
        a, b = arcs_of(kind, n := 80 + 11 * k, int(share * n), k)
        assert A.shape_around(0, n, a, b) == slow_shape(n, a, b)


def test_shapes_by_few_searches(monkeypatch):
    searched, farthest = [], A._Search.farthest
    monkeypatch.setattr(A._Search, "farthest", lambda self, nodes: searched.append(len(nodes)) or farthest(self, nodes))
    a, b = arcs_of(0, n := 2000, 20000, 5)
    assert A.diameter(n, a, b) == slow_shape(n, a, b)[0] and sum(searched) < n / 4


def test_ranks_end_early_where_nothing_can_change():
    random = np.random.default_rng(3)
    for seed in range(20):
        s, t, w = random.integers(0, 80, 500), random.integers(0, 80, 500), random.random(500) ** 4
        kept = N._ranked(seed, seed, np.arange(80), s, t, w, 0.2)
        ranks = M.personal_rank(s, t, w, seed)
        top = max(r for x, r in ranks.items() if x != seed)
        assert kept.tolist() == sorted({seed, *(x for x, r in ranks.items() if r >= 0.2 * top)})


def test_unknown_ends_are_one_node():
    pdf = __import__("pandas").DataFrame({"source": [1.0, None, 2.0], "target": [None, 2.0, 3.0]})
    assert M._shape(7, pdf).values.tolist() == [[7, 3, 3, 3, 2]]
