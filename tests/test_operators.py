"""Thresholds, metrics, sampling, publishing, graph measures, models and sources on small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.operators import evaluation as E, features as X, graph as R, graph_metrics as M, ml, publish as P, scale_features as Z, staging as G
from quillflow.sources import tables as T


def labelled(spark, labels, scores):
    return spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(labels, scores))], "transaction_id long, label int, score double")


def test_retention(spark):
    df = labelled(spark, [1, 0, 1, 0, 1], [0.9, 0.8, 0.7, 0.7, 0.2])
    row = E.retention_table(df, df, [2 / 3]).first()
    assert (row.threshold, row.transactions_remained_count, row.illicit_missed_count) == (0.7, 4, 1)


def test_retention_without_positives(spark):
    df = labelled(spark, [0, 0], [0.5, 0.4])
    assert [r.threshold for r in E.retention_thresholds(df, [0.9]).collect()] == [0.0]


def test_ranking_measures_with_ties(spark):
    df = labelled(spark, [1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1])
    assert E.roc_auc(df).first()[0] == 0.875
    assert abs(E.average_precision(df).first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_best_threshold(spark):
    best = E.best_threshold(labelled(spark, [0, 0, 1, 1], [0.1, 0.2, 0.7, 0.9])).first()
    assert best.f1 == 1.0 and 0.25 <= best.threshold <= 0.7
    none = E.best_threshold(labelled(spark, [0, 0], [0.1, 0.2])).first()
    assert tuple(none) == (0.0, 0.5, 0.0, 0.0)


def test_confusion_rates(spark):
    row = E.rates(E.confusion(labelled(spark, [0, 1, 1, 0], [0.1, 0.8, 0.3, 0.2]), 0.5)).first()
    assert (row.precision, row.recall) == (1.0, 0.5)


def test_subsample(spark):
    df = labelled(spark, [0, 1, 0, 0, 1, 0, 0, 0, 1, 0], range(10))
    found = E.train_subsample(df, 3)
    assert sorted(r.label for r in found.collect()) == [0, 0, 0, 1, 1, 1]
    assert E.random_rows(df, 0) is df and E.random_rows(df, 500).count() == 10


def test_shares_are_checked(spark):
    with pytest.raises(ValueError):
        E.check_shares(0.7, 0.4)


def test_bootstrap_brackets_f1(spark):
    random = np.random.default_rng(1)
    labels = random.integers(0, 2, 4000)
    df = labelled(spark, labels, np.clip(labels * 0.4 + random.random(4000) * 0.6, 0, 1))
    f1 = E.rates(E.confusion(df, 0.5)).first().f1
    row = E.bootstrap_f1(df, 0.5, 100).first()
    assert row.f1_low <= f1 <= row.f1_high and row.f1_std < 0.05


def test_feature_sets_follow_their_definition(spark):
    sets = X.feature_sets(("payment_format_wire",))
    assert len(sets) == 18 and len(Z.SETS) == 10
    assert len(sets["old"][0]) == 13
    assert "hour" not in sets["compact_core"][0] and "same_amount_cnt" in sets["compact_core"][0]
    assert X.choose(sets["old"][0], ["currency_format"]) == [c for c in X.BASE if c != "same_currency"]
    with pytest.raises(ValueError):
        X.sender_features(spark.createDataFrame([], "transaction_id long, ts_s long, from_bank int, from_account long, to_bank int, to_account long, amount_paid double, amount_received double, payment_currency string, receiving_currency string, payment_format string"), "unknown", formats=())


def test_snapshot_flags(spark):
    edges = spark.createDataFrame([(f"e{k}", f"h{k}", "bank999" if k == 2 else "bank001") for k in (5, 3, 1, 0, 4, 2)], "edge_id string, tx_ref_hash string, reporting_bank string")
    flags = spark.createDataFrame([(f"h{k}", b) for k, b in enumerate([True, False, True, True, False, True])], "tx_ref_hash string, is_kept boolean")
    found = [tuple(r) for r in P.snapshot_flags(edges, flags, "bank001", "m2_lr_p95_v1").collect()]
    assert found == [(f"e{k}", b, "bank001", "m2_lr_p95_v1") for k, b in ((0, True), (1, False), (3, True), (4, False), (5, True))]
    with pytest.raises(ValueError):
        P.snapshot_flags(edges, flags, "bank000", "p")
    with pytest.raises(ValueError):
        P.snapshot_flags(edges, flags.where("tx_ref_hash > 'h3'"), "bank001", "p")


def test_two_hop_flows(spark):
    e = spark.createDataFrame([("a", "b", 1, 10.0), ("b", "c", 2, 4.0), ("b", "c", 0, 7.0), ("b", "a", 3, 5.0)], "source string, target string, ts_s long, amount double")
    found = {tuple(r) for r in R.temporal_flows(e).collect()}
    assert found == {("a", "b", "c", 4.0), ("a", "b", "a", 5.0)}


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 2.0)], "key long, v double, w double")
    assert abs(R.weighted_quantile(df, "v", "w", 0.5, "q").first().q - 7 / 3) < 1e-12


def test_shapes():
    near = M._neighbours(__import__("pandas").DataFrame({"source": [1, 2, 3, 3, 4], "target": [2, 3, 1, 4, 5]}), False)
    assert M.diameter(near) == 3
    assert M.biconnected(near) == (3, 2)


def test_personal_rank_favours_heavy_neighbours():
    ranks = M.personal_rank(np.array([1, 1]), np.array([2, 3]), np.array([10.0, 1.0]), 1)
    assert ranks[2] > 5 * ranks[3] and abs(sum(ranks.values()) - 1) < 1e-9


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for part in ((1, 2, 3, 4), (11, 12, 13, 14)) for a in part for b in part if a < b] + [(4, 11)]
    edges = spark.createDataFrame([(a, b, 1.0 if (a, b) != (4, 11) else 0.1) for a, b in pairs], "source long, target long, weight double")
    found = {r.node: r.community for r in M.label_communities(edges, 8).collect()}
    assert len({found[k] for k in (1, 2, 3, 4)}) == 1 and len({found[k] for k in (11, 12, 13, 14)}) == 1 and found[1] != found[11]


def _modularity(pairs, of):
    """Q of an undirected weighted graph from its definition, one pair of nodes at a time."""
    weight, degree = {}, {}
    for a, b, w in pairs:
        weight[(a, b)] = weight.get((a, b), 0) + w
        weight[(b, a)] = weight.get((b, a), 0) + w
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    total = sum(degree.values())
    return sum(weight.get((a, b), 0) - degree[a] * degree[b] / total for a in degree for b in degree if of[a] == of[b]) / total


def test_modularity_from_the_definition(spark):
    pairs = [(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0), (3, 4, 0.5), (4, 5, 3.0), (5, 6, 1.0), (4, 6, 1.0)]
    of = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    both = spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs], "a long, b long, w double")
    assert abs(M.modularity(both, spark.createDataFrame(list(of.items()), "node long, community long")) - _modularity(pairs, of)) < 1e-12


def test_feature_clusters_are_wards():
    """Against mergers chosen by the variance that they add, computed from the columns themselves."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(300, 3))
    x = np.column_stack([base[:, k % 3] + 0.4 * rnd.normal(size=300) for k in range(8)])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    groups = [[k] for k in range(8)]
    spread = lambda g: ((x[:, g].T - x[:, g].mean(axis=1)) ** 2).sum()
    while len(groups) > 3:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: spread(groups[p[0]] + groups[p[1]]) - spread(groups[p[0]]) - spread(groups[p[1]]))
        groups[b] += groups.pop(a)
    found = ml.feature_clusters(np.corrcoef(x.T), 3)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(found == c).tolist()) for c in set(found.tolist())}


def test_reduced_features(spark):
    rows = [(k, float(k), 2.0 * k + 1, float(k % 3), 7.0) for k in range(30)]
    df = ml.reduced(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), ["a", "b", "c", "d"], 3)
    assert df.columns == ["id", "cluster_0", "cluster_1", "cluster_2"]
    for r in df.collect():
        assert abs(r.cluster_0 - r.id / 29) < 1e-9 and abs(r.cluster_1 - (r.id % 3) / 2) < 1e-9 and r.cluster_2 == 0


def test_isolation_trees_cut_between_neighbouring_floats():
    """A column whose values differ in the last bit alone leaves no side of a cut empty."""
    a = 0.1 + 0.2
    pool = np.array([[a], [np.nextafter(a, 1)]] * 40 + [[np.nextafter(a, 0)]])
    forest = ml.Forest(pool, 300, 16)
    assert (forest.feature[:, 0] == 0).any() and np.isfinite(forest.decision(pool)).all()
    inner = forest.feature >= 0
    assert set(np.unique(forest.threshold[inner])) <= {np.nextafter(a, 0), a}


def test_isolation_forest(spark):
    """Path lengths against a walk node by node; far rows score lowest; runs agree."""
    rnd = np.random.default_rng(1)
    pool = rnd.normal(size=(400, 3))
    forest = ml.Forest(pool, 60)
    probe = np.vstack([pool[:20], [[9, -9, 9], [0, 0, 0]]])

    def length(t, x):
        k = 0
        while forest.feature[t, k] >= 0:
            k = 2 * k + 1 + int(x[forest.feature[t, k]] > forest.threshold[t, k])
        return forest.path[t, k]

    n = forest.drawn
    expected = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    want = [0.5 - 2 ** (-np.mean([length(t, x) for t in range(60)]) / expected) for x in probe]
    assert np.allclose(forest.decision(probe), want, atol=1e-9) and np.argmin(want) == 20 and want[20] < 0 < want[21]
    df = spark.createDataFrame([(k, *map(float, x), None if k else 1.0) for k, x in enumerate(np.vstack([pool, [[9, -9, 9]]]))], "id long, a double, b double, c double, d double")
    first, again = ({r.id: r.anomaly_score for r in ml.anomaly_scores(df, ["a", "b", "c", "d"], 50).collect()} for _ in range(2))
    assert first == again and min(first, key=first.get) == 400 and len(first) == 401
    assert ml.anomaly_scores(df.limit(0), ["a"]).count() == 0


def test_experiment_reaches_its_targets(spark):
    """Thresholds chosen on the second part keep that share of its positives; contributions come by absolute value."""
    rnd = np.random.default_rng(8)
    rows = [(k, int(x[0] + 0.3 * x[1] > 1.0), float(x[0]), float(x[1])) for k, x in enumerate(rnd.random((900, 2)))]
    df = spark.createDataFrame(rows, "transaction_id long, is_laundering int, a double, b double")
    split = df.select("transaction_id", (F.col("transaction_id") % 3).alias("bucket"))
    for model, settings in (("logistic", {}), ("boosted", {"trees": 20})):
        found = ml.experiment(df, ["a", "b"], split, model, (0.95, 0.9), **settings)
        assert found["roc_auc"].first()[0] > 0.97
        positives = sum(r[1] for r in rows if r[0] % 3 == 2)
        for r in found["retention"].collect():
            assert r.illicit_missed_count <= 0.25 * positives
    prepared = ml.prepared(df, ["a", "b"])
    weights = [(r.name, r.coefficient) for r in ml.contributions(ml.logistic(prepared, ["a", "b"]), ["a", "b"], prepared).collect()]
    assert [n for n, _ in weights] == ["a", "b"] and weights[0][1] > weights[1][1] > 0


def test_boosted_trees_find_a_planted_signal(spark):
    random = np.random.default_rng(3)
    rows = [(k, float(x[0] + x[1] > 1.2), *map(float, x)) for k, x in enumerate(random.random((600, 2)))]
    df = spark.createDataFrame(rows, "transaction_id long, label double, a double, b double")
    assert E.roc_auc(ml.scored(ml.boosted(df, ["a", "b"], trees=10), df)).first()[0] > 0.9
    assert E.roc_auc(ml.scored(ml.logistic(df, ["a", "b"]), df)).first()[0] > 0.9


def test_patterns_and_lines(spark, tmp_path):
    path = tmp_path / "patterns.txt"
    lines = ["BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 3 hops", "2022/09/01 00:05,001,A1,002,B1,5.0,Euro,5.0,Euro,ACH,1", "END LAUNDERING ATTEMPT - CYCLE", "", "BEGIN LAUNDERING ATTEMPT - STACK", "2022/09/01 00:06,003,C1,002,B1,6.0,Euro,6.0,Euro,Wire,1", "END LAUNDERING ATTEMPT - STACK"]
    path.write_text("\n".join(lines))
    found = [(r.chain_id, r.type, r.sub_type, r.from_bank, r.payment_format) for r in T.read_patterns(spark, str(path)).orderBy("line_no").collect()]
    assert found == [(0, "cycle", "max 3 hops", "001", "ACH"), (1, "stack", "stack", "003", "Wire")]
    raw = tmp_path / "raw.csv"
    raw.write_text("\n".join([",".join(T.RAW_COLUMNS), lines[1]]))
    row = T.read_raw(spark, str(raw)).first()
    assert (row.from_bank, row.amount_paid, row.timestamp.minute) == ("001", 5.0, 5)
    with pytest.raises(Exception, match="no transaction line equals"):
        G.matched_lines(T.read_lines(spark, str(raw)), spark.createDataFrame([("x",)], "value string")).collect()


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('dataset = "small"\n[model]\nn_estimators = 10\n')
    config = T.load_config(str(path))
    assert (config.dataset, config.model.n_estimators, config.model.n_bits, config.split.train) == ("small", 10, 3, 0.6)
    path.write_text("[other]\nx = 1\n")
    with pytest.raises(ValueError):
        T.load_config(str(path))


def test_sweep_reports_failures(spark):
    rows = spark.createDataFrame([(k, k % 2, float(k % 2)) for k in range(40)], "transaction_id long, is_laundering int, a double")
    split = rows.select("transaction_id", F.when(F.col("transaction_id") < 20, 0).otherwise(1).alias("bucket"))
    found = ml.sweep(rows, ["a"], split, [{"trees": 1}, {"depth": -5}]).collect()
    assert found[0].f1 == 1.0 and found[1].error


def test_streaming_sessions(spark, tmp_path):
    from quillflow.streaming.events import sessions, windowed_activity

    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 03:00:00", 4.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, df in (("s_sessions", sessions(stream)), ("s_windows", windowed_activity(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "s_windows" else "append").start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("s_windows").where("n = 3").count() > 0


def test_boosted_trees_take_newton_steps_on_exact_sums(spark, monkeypatch):
    """Against trees grown on all rows at once; the ways to run agree, and files of parts don't change a tree."""
    from quillflow.operators import training

    random = np.random.default_rng(11)
    x = np.stack([random.integers(0, 2, 700), random.integers(0, 9, 700) * 0.5, random.random(700), np.ones(700)], axis=1).astype(np.float32).astype(float)
    y = (x[:, 1] + 3 * x[:, 2] * x[:, 0] + random.random(700) > 4.0).astype(float)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(k, *map(float, (l, *r))) for k, (l, r) in enumerate(zip(y, x))], "transaction_id long, label double, a double, b double, c double, d double").repartition(5)
    margin, ratio = np.zeros(700), (700 - y.sum()) / y.sum()
    w = np.where(y == 1, ratio, 1.0)
    cuts = [np.unique(c) for c in x.T]
    cuts[2] = None
    monkeypatch.setattr(training, "BINS", 1000)
    monkeypatch.setattr(training, "POINTS", 1000)
    cuts[2] = np.unique(x[:, 2])

    def grow(rows, level):
        g, h = (w * (p - y))[rows], (w * p * (1 - p))[rows]
        found = None
        for f in range(4):
            for cut in cuts[f][:-1]:
                left = x[rows, f] <= cut
                a, b = h[left].sum(), h[~left].sum()
                if a >= 1 and b >= 1:
                    gain = g[left].sum() ** 2 / (a + 1) + g[~left].sum() ** 2 / (b + 1) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, left)
        if level == 2 or found is None:
            out[rows] = -0.1 * g.sum() / (h.sum() + 1)
        else:
            grow(rows[found[1]], level + 1)
            grow(rows[~found[1]], level + 1)

    for _ in range(4):
        out, p = np.zeros(700), 1 / (1 + np.exp(-margin))
        grow(np.arange(700), 0)
        margin += out
    expected = 1 / (1 + np.exp(-margin))
    for together in (True, False):
        model = training.boosted(training.stored(df, names), 4, 2, 0.1, together)._replace(names=tuple(names))
        found = {r.transaction_id: r.score for r in ml.scored(model, df).collect()}
        assert max(abs(found[k] - expected[k]) for k in range(700)) < 1e-5
    assert not training.boosted(training.stored(df.limit(0), names), 4, 2, 0.1).trees


def test_bins_hold_equal_shares_of_many_values():
    from quillflow.operators import training

    values = np.random.default_rng(5).random(40_000)
    told = [training._summary(v) for v in np.split(values, 8)]
    cuts = training._cuts(*(np.concatenate([t[k] for t in told]) for k in (0, 1)))
    assert len(cuts) <= training.BINS and cuts[-1] == values.max()
    shares = np.bincount(np.searchsorted(cuts, values), minlength=len(cuts))
    assert shares.sum() == 40_000 and shares.max() < 3 * 40_000 / training.BINS


def test_logistic_regression_ends_where_the_loss_is_least(spark):
    """The gradient of the balanced loss vanishes, also with a constant column and one that others add up to."""
    random = np.random.default_rng(12)
    rows = [(k, float(a + random.normal() > 0.3), float(a), float(b), float(a > 0), float(a <= 0), 7.0) for k, (a, b) in enumerate(random.normal(size=(800, 2)))]
    df = spark.createDataFrame(rows, "transaction_id long, label double, a double, b double, c double, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    score = {r.transaction_id: r.score for r in ml.scored(ml.logistic(df, names), df).collect()}
    positives = sum(r[1] for r in rows)
    w = {1.0: 400 / positives, 0.0: 400 / (800 - positives)}
    for k in range(2, 7):
        assert abs(sum(w[r[1]] * (score[r[0]] - r[1]) * r[k] for r in rows)) < 1e-3


def test_features_of_shares_are_those_of_all(spark, sf_dir):
    """Features made share by share, from lines that were written first, are the same rows; nothing stays cached."""
    from quillflow.operators import features as X
    from quillflow.plans import models

    spark.catalog.clearCache()
    found = models._features(spark, sf_dir)
    every = X.sender_features(T.transactions(spark, sf_dir), "old_new").select(*found.columns)
    assert found.count() == every.count() > 0
    assert found.exceptAll(every).count() == 0
    assert not found.is_cached and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    buckets = {r.transaction_id: r.bucket for r in models._with_buckets(found).collect()}
    assert buckets == {r.transaction_id: r.bucket for r in models._split(every).collect()}


def test_features_leave_only_themselves_on_disk(spark, sf_dir):
    from pathlib import Path

    from quillflow.functions.workers import shared_path
    from quillflow.plans import models

    folder = Path(shared_path(spark, "any")).parent
    folder.mkdir(parents=True, exist_ok=True)
    before = set(folder.iterdir())
    features = models._features(spark, sf_dir)
    assert len(set(folder.iterdir()) - before) == models.SHARES
    assert features.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
