"""Hand-made cases: ties, both window bounds, decay, distinct values, balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.functions import windows as W
from quillflow.operators import staging as G

HOUR = 3600


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("id").select(*columns).collect()]


def test_ties_and_bounds(spark):
    times = [0, 0, 12 * HOUR, 24 * HOUR, 24 * HOUR, 24 * HOUR + 60]
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate(times)], "id long, k long, t long")
    open_end = W.trailing_count("t", 24 * HOUR, ("k",), ("t", "id"))
    closed = W.trailing_count("t", 24 * HOUR, ("k",), ("t", "id"), inclusive=True)
    assert rows(df.select("id", open_end.alias("a"), closed.alias("b")), "a", "b") == [(1, 1), (2, 2), (3, 3), (2, 4), (3, 5), (4, 4)]


def test_decay(spark):
    df = spark.createDataFrame([(k, 1, t * HOUR) for k, t in enumerate((0, 12, 12, 36))], "id long, k long, t long")
    found = W.with_decayed_count(df, "d", "t", 12 * HOUR, ("k",), ("t", "id"))
    assert [round(x, 9) for (x,) in rows(found, "d")] == [0, 0.5, 1.5, 0.625]


def test_decay_over_many_half_lives(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 1, 10**9), (2, 1, 10**9 + 12 * HOUR)], "id long, k long, t long")
    assert [round(x, 9) for (x,) in rows(W.with_decayed_count(df, "d", "t", 12 * HOUR, ("k",), ("t", "id")), "d")] == [0, 0, 0.5]


def test_previous_distinct(spark):
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate("abac")], "id long, k long, v string")
    assert rows(W.with_prev_distinct(df, "n", ("k",), "v", ("id",)), "n") == [(0,), (1,), (2,), (2,)]


def test_trailing_distinct_counts_earlier_ties(spark):
    df = spark.createDataFrame([(0, 1, 0, "a"), (1, 1, 5, "b"), (2, 1, 5, "c"), (3, 1, 20, "d")], "id long, k long, t long, v string")
    assert rows(W.with_trailing_distinct(df, "n", "v", "t", 10, ("k",), ("t", "id")), "n") == [(0,), (1,), (2,), (0,)]


def test_trailing_distinct_by_hand(spark):
    """Few values, many ties, values that come back within the window and after it, and nulls."""
    import random

    rnd = random.Random(3)
    data = [(k, rnd.randrange(3), rnd.randrange(60), rnd.choice(["a", "b", "c", "d", None])) for k in range(400)]
    df = spark.createDataFrame(data, "id long, k long, t long, v string")
    found = {r.id: r.n for r in W.with_trailing_distinct(df, "n", "v", "t", 10, ("k",), ("t", "id")).collect()}
    for i, k, t, _ in data:
        assert found[i] == len({v for j, q, u, v in data if q == k and (u, j) < (t, i) and u >= t - 10 and v is not None})


def test_pattern_blocks_across_ranges(spark, tmp_path, monkeypatch):
    from quillflow.sources import tables as T

    lines = []
    for k in range(9):
        lines += [f"BEGIN LAUNDERING ATTEMPT - FAN-OUT: part {k}" if k % 2 else "BEGIN LAUNDERING ATTEMPT - CYCLE", *(f"t{k},{j},a,b,c,1,USD,1,USD,ACH,1" for j in range(k)), "END LAUNDERING ATTEMPT", ""]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    monkeypatch.setattr(T, "LINE_RANGE", 4)
    found = [(r.chain_id, r.type, r.sub_type) for r in T.read_patterns(spark, str(tmp_path / "p.txt")).orderBy("line_no").collect()]
    assert found == [(k, "fan-out" if k % 2 else "cycle", f"part {k}" if k % 2 else "cycle") for k in range(9) for _ in range(k)]


def test_balances(spark):
    tx = spark.createDataFrame([(0, 0, 1, 2, 10.0), (1, 1, 2, 3, 4.0), (2, 2, 3, 1, 20.0)], "transaction_id long, ts_s long, from_account long, to_account long, amount_paid double")
    found = G.balances(tx).orderBy("transaction_id").select("source_positive_balance", "source_negative_balance", "target_positive_balance", "target_negative_balance")
    assert [tuple(abs(x) for x in r) for r in found.collect()] == [(0, 10, 10, 0), (6, 0, 4, 0), (0, 16, 10, 0)]


def test_payment_to_oneself_changes_nothing(spark):
    tx = spark.createDataFrame([(0, 0, 1, 1, 10.0)], "transaction_id long, ts_s long, from_account long, to_account long, amount_paid double")
    assert [abs(x) for x in G.balances(tx).first()[1:5]] == [0, 0, 0, 0]


def test_global_rank(spark):
    df = spark.createDataFrame([(None,), (7,), (3,), (3,), (100,)], "x long")
    found = W.global_rank(df, F.floor(F.col("x") / 5), ("x",), "r", start=0)
    assert sorted((r.r, r.x) for r in found.collect()) == [(0, None), (1, 3), (2, 3), (3, 7), (4, 100)]
