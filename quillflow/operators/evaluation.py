"""Splits, thresholds and metrics as relational operators over (label, score) rows.

Scores are summed to distinct values first; running sums over those give every threshold, so nothing is sorted on
the driver and ties are one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S, windows as W
from ..sources.constants import TARGETS

TRAIN, VALID, TEST = 0, 1, 2


def check_shares(train: float, valid: float) -> None:
    if not 0 < train < 1 or not 0 < valid < 1 or train + valid >= 1:
        raise ValueError("shares must lie in (0, 1) and sum to less than 1")


def split_by_count(tx: DataFrame, train: float = 0.6, valid: float = 0.2, per_lead: int = 3600) -> DataFrame:
    """bucket by position in time: the first floor(n train) rows, the next floor(n valid), the rest; ties by id."""
    check_shares(train, valid)
    ranked = W.global_rank(tx, F.floor(F.col("ts_s") / per_lead), ("ts_s", "transaction_id"), "_position")
    n = tx.agg(F.count(F.lit(1)).alias("_n"))  # one row
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * valid)
    bucket = F.when(F.col("_position") <= first, TRAIN).when(F.col("_position") <= first + second, VALID).otherwise(TEST)
    return ranked.crossJoin(F.broadcast(n)).withColumn("bucket", bucket).drop("_position", "_n")


def _bucket(at: Column, first: Column, second: Column) -> Column:
    return F.when(at < first, TRAIN).when(at < second, VALID).otherwise(TEST)


def quantile_cuts(tx: DataFrame, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """One row (t_train, t_valid): interpolated time quantiles."""
    check_shares(train, valid)
    return tx.agg(F.percentile("ts_s", F.lit(train)).alias("t_train"), F.percentile("ts_s", F.lit(train + valid)).alias("t_valid"))


def order_cuts(tx: DataFrame, train: float = 0.6, valid: float = 0.8) -> DataFrame:
    """One row (t_train, t_valid): the times at positions int(n train) and int(n valid), not interpolated."""
    counts = tx.groupBy("ts_s").agg(F.count(F.lit(1)).alias("n"))
    run = counts.withColumn("c", F.sum("n").over(Window.orderBy("ts_s"))).withColumn("t", F.sum("n").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("c") > F.floor(F.col("t") * q), F.col("ts_s")))
    return run.agg(at(train).alias("t_train"), at(valid).alias("t_valid"))


def split_by_time(tx: DataFrame, cuts: DataFrame) -> DataFrame:
    """bucket by strict comparison with the cuts."""
    return tx.crossJoin(F.broadcast(cuts)).withColumn("bucket", _bucket(F.col("ts_s"), F.col("t_train"), F.col("t_valid"))).drop("t_train", "t_valid")


def split_by_chain(tx: DataFrame, cuts: DataFrame) -> DataFrame:
    """As split_by_time, but all rows of a chain go where its first row goes."""
    firsts = tx.where("chain_id >= 0").groupBy("chain_id").agg(F.min("ts_s").alias("_first"))
    at = F.coalesce("_first", "ts_s")
    # two numbers a chain, and nearly all rows have none: dealt out by chain, they would meet in one task
    joined = tx.join(F.broadcast(firsts), "chain_id", "left").crossJoin(F.broadcast(cuts))
    return joined.withColumn("bucket", _bucket(at, F.col("t_train"), F.col("t_valid"))).drop("t_train", "t_valid", "_first")


def moved(a: DataFrame, b: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row (moved): rows whose bucket differs between two splits."""
    other = b.select(key, F.col("bucket").alias("_b"))
    return a.join(other, key).agg(F.coalesce(F.sum((F.col("bucket") != F.col("_b")).cast("long")), F.lit(0)).alias("moved"))


def split_summary(split: DataFrame, label: str = "is_laundering") -> DataFrame:
    return split.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("illicit"), F.avg(label).alias("rate"))


#: Score ranges that running counts are summed by first.
RANGES = 4096


def by_score(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, n, tp, kept, positives, total): running counts down the distinct scores.

    A model gives about as many scores as rows, so no window holds them all: they run within ranges of scores,
    and only the sums of ranges meet in one.
    """
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("_r", F.floor(F.col("score") * RANGES))
    above, every = Window.orderBy(F.col("_at").desc()), Window.partitionBy()
    ranges = per.groupBy(F.col("_r").alias("_at")).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n")).select(
        "_at", (F.sum("_p").over(above) - F.col("_p")).alias("_tp"), (F.sum("_n").over(above) - F.col("_n")).alias("_kept"), F.sum("_p").over(every).alias("positives"), F.sum("_n").over(every).alias("total")
    )
    down = Window.partitionBy("_r").orderBy(F.col("score").desc()).rowsBetween(W.PRECEDING, W.CURRENT)
    inside = per.withColumns({"_itp": F.sum("pos").over(down), "_ikept": F.sum("n").over(down)})
    joined = inside.join(ranges, F.col("_r").eqNullSafe(F.col("_at")))
    return joined.select("score", "pos", "n", (F.col("_tp") + F.col("_itp")).alias("tp"), (F.col("_kept") + F.col("_ikept")).alias("kept"), "positives", "total")


def retention_thresholds(df: DataFrame, targets: Sequence[float] = TARGETS, label: str = "label", score: str = "score") -> DataFrame:
    """(target, threshold): the largest score that keeps at least the target share of positives; 0 if none does."""
    wanted = F.explode(F.array(*map(F.lit, targets)))
    reached = by_score(df, label, score).select("*", wanted.alias("target")).where((F.col("positives") > 0) & (F.col("tp").cast("double") / F.col("positives") >= F.col("target")))
    found = reached.groupBy("target").agg(F.max("score").alias("threshold"))
    every = df.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    return every.join(found, "target", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))


def quantile_threshold(df: DataFrame, retention: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row (threshold): the interpolated 1 - retention quantile of the positives' scores; 0 without positives."""
    return df.where(F.col(label) == 1).agg(F.coalesce(F.percentile(score, F.lit(1 - retention)), F.lit(0.0)).alias("threshold"))


def retention_table(valid: DataFrame, test: DataFrame, targets: Sequence[float] = TARGETS, recommended: float = 0.95, label: str = "label", score: str = "score") -> DataFrame:
    """Per target: the threshold that valid chooses and what it keeps and drops on test."""
    thresholds = retention_thresholds(valid, targets, label, score)
    per = test.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    kept = F.col("score") >= F.col("threshold")
    agg = per.crossJoin(F.broadcast(thresholds)).groupBy("target", "threshold").agg(
        F.sum("n").alias("_n"), F.sum("pos").alias("_p"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("remained"), F.coalesce(F.sum(F.when(kept, F.col("pos"))), F.lit(0)).alias("_kept")
    )
    text = F.concat(F.format_string("%.1f%%", 100 * F.col("target")), F.when(F.abs(F.col("target") - recommended) < 1e-9, " (recommended)").otherwise(""))
    return agg.select(
        F.col("target").alias("target_retention"), text.alias("label"), "threshold", (F.col("_kept") / F.greatest("_p", F.lit(1))).alias("actual_illicit_retained"),
        (100.0 * (F.col("_n") - F.col("remained")) / F.col("_n")).alias("transactions_dropped_pct"), F.col("remained").alias("transactions_remained_count"), (F.col("_p") - F.col("_kept")).alias("illicit_missed_count"),
    )


def gain_table(test: DataFrame, targets: Sequence[float] = TARGETS, label: str = "label", score: str = "score") -> DataFrame:
    """Per target: the score at which the running count of positives reaches ceil(target positives)."""
    curve = by_score(test, label, score).select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    reached = curve.where((F.col("positives") > 0) & (F.col("tp") >= F.ceil(F.col("target") * F.col("positives"))))
    best = reached.groupBy("target").agg(F.max_by(F.struct("score", "tp", "kept", "positives", "total"), "score").alias("r"))
    return best.select("target", F.col("r.score").alias("threshold"), (F.col("r.tp") / F.col("r.positives")).alias("actual_illicit_retained"), (100.0 * (F.col("r.total") - F.col("r.kept")) / F.col("r.total")).alias("transactions_dropped_pct"), F.col("r.kept").alias("transactions_remained_count"), (F.col("r.positives") - F.col("r.tp")).alias("illicit_missed_count"))


def confusion(df: DataFrame, threshold: float | Column, label: str = "label", score: str = "score") -> DataFrame:
    """One row (tn, fp, fn, tp) at a threshold."""
    kept, positive = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(n(~kept & ~positive).alias("tn"), n(kept & ~positive).alias("fp"), n(~kept & positive).alias("fn"), n(kept & positive).alias("tp"))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp = F.col("tp")
    return df.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def operating_point(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: counts, shares, retention and precision at a threshold, with both ranking measures."""
    c = confusion(df, threshold, label, score)
    n, kept, pos = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("fp") + F.col("tp"), F.col("tp") + F.col("fn")
    one = c.select("*", n.alias("rows"), pos.alias("illicit"), F.lit(float(threshold)).alias("threshold"), (n - kept).alias("dropped"), ((n - kept) / n).alias("drop_rate"), kept.alias("kept"), (F.col("tp") / F.greatest(pos, F.lit(1))).alias("illicit_retention"), (F.col("tp") / F.greatest(kept, F.lit(1))).alias("precision_among_kept"))
    return one.crossJoin(roc_auc(df, label, score)).crossJoin(average_precision(df, label, score))


def threshold_grid(df: DataFrame, points: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tn, fp, fn, tp, precision, recall, f1) at each point of a grid: the grid is broadcast."""
    grid = df.sparkSession.createDataFrame([(float(p),) for p in points], "threshold double")
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    kept = F.col("score") >= F.col("threshold")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rates(per.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(
        s(F.when(~kept, F.col("n") - F.col("pos"))).alias("tn"), s(F.when(kept, F.col("n") - F.col("pos"))).alias("fp"), s(F.when(~kept, F.col("pos"))).alias("fn"), s(F.when(kept, F.col("pos"))).alias("tp")))


SWEEP = tuple(round(0.05 * k, 2) for k in range(1, 20))


def best_threshold(df: DataFrame, points: Sequence[float] = SWEEP, label: str = "label", score: str = "score") -> DataFrame:
    """One row (f1, threshold, precision, recall): the best F1 of a grid, the lowest threshold among ties; 0.5 if none is positive."""
    found = threshold_grid(df, points, label, score).where("f1 > 0").orderBy(F.col("f1").desc(), "threshold").limit(1).select("f1", "threshold", "precision", "recall")
    none = df.sparkSession.createDataFrame([(0.0, 0.5, 0.0, 0.0)], "f1 double, threshold double, precision double, recall double")
    return found.union(none).orderBy(F.col("f1").desc()).limit(1)


def precision_at_recall(df: DataFrame, targets: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """(target, threshold, precision) at the retention thresholds of one set."""
    marks = retention_thresholds(df, targets, label, score)
    curve = by_score(df, label, score).select(F.col("score").alias("threshold"), (F.col("tp") / F.col("kept")).alias("precision"))
    return marks.join(curve, "threshold", "left").select("target", "threshold", "precision")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (roc_auc): the rank sum, ties counted half; null if a class is missing."""
    curve = by_score(df, label, score)
    negatives_below = F.col("total") - F.col("positives") - (F.col("kept") - F.col("tp"))
    wins = F.sum(F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2.0))
    return curve.agg(F.try_divide(wins, (F.max("positives") * (F.max("total") - F.max("positives"))).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (pr_auc): the sum of precision over the steps of recall."""
    return by_score(df, label, score).agg(F.try_divide(F.sum(F.col("pos") * (F.col("tp") / F.col("kept"))), F.max("positives").cast("double")).alias("pr_auc"))


def grid_pr_auc(df: DataFrame, points: int = 201, label: str = "label", score: str = "score") -> DataFrame:
    """One row (auc_pr): the trapezoid over recall of a threshold grid, rates rounded to six digits."""
    grid = threshold_grid(df, [k / (points - 1) for k in range(points)], label, score).select("threshold", F.round("precision", 6).alias("p"), F.round("recall", 6).alias("r"))
    order = Window.orderBy("r", "threshold")
    steps = grid.withColumns({"pr": F.lag("r").over(order), "pp": F.lag("p").over(order)})
    return steps.agg(F.sum((F.col("r") - F.col("pr")) * (F.col("p") + F.col("pp")) / 2).alias("auc_pr"))


def or_combined(obs: DataFrame, label: str = "label", score: str = "score", key: str = "transaction_id") -> DataFrame:
    """Per transaction the larger score and label of its observations."""
    return obs.groupBy(key).agg(F.max(score).alias(score), F.max(label).alias(label))


def match_rate(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Percentage of rows on which two predictions agree, overall or by class."""
    rate = (100.0 * F.avg((F.col(a) == F.col(b)).cast("double"))).alias("match_pct")
    return df.groupBy(by).agg(rate, F.count(F.lit(1)).alias("rows")) if by else df.agg(rate, F.count(F.lit(1)).alias("rows"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """One row (weight): negatives for each positive."""
    return df.agg((F.sum(F.when(F.col(label) == 0, 1).otherwise(0)) / F.greatest(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(1))).alias("weight"))


def bin_summary(df: DataFrame, bin_column: str, label: str = "label", score: str = "score", kept: str = "kept") -> DataFrame:
    """Per bin: rows and share, positives and rate, mean and median score, kept and dropped shares."""
    total = F.sum("rows").over(Window.partitionBy())
    part = df.groupBy(bin_column).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("illicit"), (100.0 * F.avg(label)).alias("illicit_rate_pct"), F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), (100.0 * F.avg(F.col(kept).cast("double"))).alias("kept_pct"))
    return part.withColumns({"row_share_pct": 100.0 * F.col("rows") / total, "dropped_pct": 100.0 - F.col("kept_pct")})


def bootstrap_f1(df: DataFrame, threshold: float, replicates: int = 2000, seed: int = 42, label: str = "label", score: str = "score", key: str = "transaction_id") -> DataFrame:
    """One row (f1_mean, f1_low, f1_high, f1_std): a Poisson bootstrap of F1 with 95 % bounds.

    Only the four cells of the confusion matrix matter, so each replicate draws their counts: rows are summed to
    hashed groups of about a hundred rows, and groups are drawn.
    """
    kept, positive = F.col(score) >= threshold, F.col(label) == 1
    groups = df.groupBy(F.pmod(F.xxhash64(key), F.greatest(F.lit(64), F.lit(df.count() // 100))).alias("g")).agg(F.sum((kept & positive).cast("long")).alias("tp"), F.sum((kept & ~positive).cast("long")).alias("fp"), F.sum((~kept & positive).cast("long")).alias("fn"))
    u = F.pmod(F.xxhash64("g", "rep", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    steps, p, c = [], 0.36787944117144233, 0.0
    for k in range(12):
        c += p
        steps.append(c)
        p /= k + 1
    times = sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))
    drawn = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("times", times)
    f1 = rates(drawn.groupBy("rep").agg(*(F.sum(F.col(x) * F.col("times")).alias(x) for x in ("tp", "fp", "fn"))))
    return f1.agg(F.avg("f1").alias("f1_mean"), F.percentile("f1", F.lit(0.025)).alias("f1_low"), F.percentile("f1", F.lit(0.975)).alias("f1_high"), F.stddev_pop("f1").alias("f1_std"))


def leakage_gap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row (gap_pp): the difference of a share between two results, in percentage points."""
    return a.select(F.col(column).alias("_a")).crossJoin(b.select(F.col(column).alias("_b"))).select((100.0 * (F.col("_a") - F.col("_b"))).alias("gap_pp"))


def savings(table: DataFrame, rows: int, bytes_per_row: int = 839_168, seconds_per_row: float = 4.31) -> DataFrame:
    """A retention table with what its dropped rows save in bytes and compute seconds."""
    dropped = F.lit(rows) - F.col("transactions_remained_count")
    return table.withColumns({"saved_bytes": dropped * bytes_per_row, "saved_seconds": dropped * F.lit(seconds_per_row)})


def train_subsample(df: DataFrame, normal_rows: int, seed: int = 42, label: str = "label", key: str = "transaction_id") -> DataFrame:
    """All positives and at most normal_rows negatives, chosen by a hash of the key: the same rows on every run."""
    chosen = df.where(F.col(label) == 0).orderBy(F.xxhash64(F.lit(seed), key), key).limit(normal_rows)
    return df.where(F.col(label) == 1).unionByName(chosen)


def random_rows(df: DataFrame, n: int, seed: int = 0, key: str = "transaction_id") -> DataFrame:
    """n rows by a hash of the key; all rows if n is not positive."""
    return df if n <= 0 else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
