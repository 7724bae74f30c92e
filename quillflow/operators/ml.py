"""Estimators over feature tables, from pyspark.ml where it has them, and the experiment that ties them to the metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import QuantileDiscretizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scalars as S
from ..functions.workers import cut, importable
from . import evaluation as E, training


def prepared(df: DataFrame, names: Sequence[str], label: str = "is_laundering", *other: str) -> DataFrame:
    """Finite features and a label column named label; other columns as they are."""
    return df.select("transaction_id", *other, F.col(label).cast("double").alias("label"), *(S.clean(n).cast("double").alias(n) for n in names))


def logistic(train: DataFrame, names: Sequence[str]) -> training.Logistic:
    """Standardised features and balanced logistic regression."""
    return training.logistic(training.stored(train, names, binned=False))._replace(names=tuple(names))


def boosted(train: DataFrame, names: Sequence[str], trees: int = 50, depth: int = 2, rate: float = 0.1, seed: int = 42, bits: int | None = None) -> training.Trees | PipelineModel:
    """Gradient boosted trees with positives weighted by the class ratio; with bits, those of a pipeline on 2^bits quantile bins."""
    if bits:
        return boosted_pipeline(train, names, trees, depth, rate, seed, bits)
    return training.boosted(training.stored(train, names), trees, depth, rate)._replace(names=tuple(names))


def boosted_pipeline(train: DataFrame, names: Sequence[str], trees: int = 50, depth: int = 2, rate: float = 0.1, seed: int = 42, bits: int | None = None) -> PipelineModel:
    """Spark's boosted trees, as a pipeline that can be saved; with bits, features are cut to 2^bits quantile bins."""
    (ratio,) = E.class_weight(train).first()
    weighed = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(1.0))
    inputs, stages = list(names), []
    if bits:
        stages.append(QuantileDiscretizer(inputCols=inputs, outputCols=[f"{n}_q" for n in inputs], numBuckets=2**bits, handleInvalid="keep"))
        inputs = [f"{n}_q" for n in inputs]
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), GBTClassifier(weightCol="weight", maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(weighed)


def scored(model: training.Logistic | training.Trees | PipelineModel, df: DataFrame) -> DataFrame:
    """(transaction_id, label, score): the probability of the positive class, partition by partition."""
    if isinstance(model, PipelineModel):
        return model.transform(df).select("transaction_id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
    rows = df.select("transaction_id", F.col("label").cast("int").alias("label"), *(F.col(n).cast("double") for n in model.names))
    schema = T.StructType([*rows.schema[:2], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.scores([c.to_numpy() for c in batch.columns[2:]]))], schema.names)

    return importable(rows).mapInArrow(run, schema)


def contributions(model: training.Logistic, names: Sequence[str], df: DataFrame) -> DataFrame:
    """(name, coefficient) of a logistic model, by absolute value."""
    rows = sorted(zip(names, map(float, model.coefficients)), key=lambda x: -abs(x[1]))
    return df.sparkSession.createDataFrame(rows, "name string, coefficient double")


def feature_clusters(correlation: np.ndarray, k: int) -> np.ndarray:
    """The cluster of each standardised feature: Ward's agglomeration, at each step the two whose merger adds least variance.

    Squared distances of standardised columns are 2 n (1 - correlation), so the matrix of features by features is
    all that is needed, however many rows there are.
    """
    n = len(correlation)
    distance = 2.0 * (1.0 - correlation)
    np.fill_diagonal(distance, np.inf)
    sizes, cluster = np.ones(n), np.arange(n)
    for _ in range(n - max(1, k)):
        a, b = sorted(map(int, np.unravel_index(np.argmin(distance), distance.shape)))
        others = np.array([c for c in range(n) if sizes[c] > 0 and c not in (a, b)], int)
        merged = ((sizes[a] + sizes[others]) * distance[a, others] + (sizes[b] + sizes[others]) * distance[b, others] - sizes[others] * distance[a, b]) / (sizes[a] + sizes[b] + sizes[others])
        distance[a, others] = distance[others, a] = merged
        distance[b, :] = distance[:, b] = np.inf
        sizes[a], sizes[b] = sizes[a] + sizes[b], 0
        cluster[cluster == b] = a
    return np.unique(cluster, return_inverse=True)[1]


def reduced(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """k cluster_i columns in place of the features: means of the standardised features of each cluster, scaled to 0..1."""
    stages = [VectorAssembler(inputCols=list(names), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True)]
    scaled = Pipeline(stages=stages).fit(df).transform(df)
    correlation = np.nan_to_num(Correlation.corr(scaled, "_s").head()[0].toArray())
    np.fill_diagonal(correlation, 1.0)
    cluster, values = feature_clusters(correlation, k), vector_to_array("_s")
    held = scaled.withColumn("_a", values)
    means = [(sum((F.col("_a")[int(j)] for j in np.flatnonzero(cluster == c)), F.lit(0.0)) / int((cluster == c).sum())).alias(f"_c{c}") for c in range(cluster.max() + 1)]
    pooled = held.select(*(c for c in df.columns if c not in names), *means)
    spread = pooled.agg(*(f(c).alias(f"{n}{c}") for c in pooled.columns if c.startswith("_c") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    bounded = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lit(spread[f"lo{c}"]), F.lit(spread[f"hi{c}"] - spread[f"lo{c}"])), F.lit(0.0))
    return pooled.select(*(bounded(c).alias(f"cluster_{c[2:]}") if c.startswith("_c") else c for c in pooled.columns))


#: Rows that the trees of a forest draw from, and rows that each of them draws.
POOL, DRAWN = 8192, 256


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length of an unsuccessful search among n keys in a binary tree."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: node k of a tree has the children 2k + 1 and 2k + 2; a leaf has feature -1 and a path length."""

    def __init__(self, pool: np.ndarray, trees: int, drawn: int = DRAWN, seed: int = 42):
        self.drawn = min(drawn, len(pool))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.drawn)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature, self.threshold, self.path = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        random = np.random.default_rng(seed)
        for t in range(trees):
            todo = [(0, 0, pool[random.choice(len(pool), self.drawn, replace=False)])]
            while todo:
                k, level, rows = todo.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                varying = np.flatnonzero(high > low)
                if level == self.depth or len(rows) <= 1 or not len(varying):
                    self.path[t, k] = level + mean_path(len(rows))
                    continue
                f = int(random.choice(varying))
                # between neighbouring floats a draw can round up to the highest value, which would leave one side empty
                cut_at = min(random.uniform(low[f], high[f]), np.nextafter(high[f], low[f]))
                right = rows[:, f] > cut_at
                self.feature[t, k], self.threshold[t, k] = f, cut_at
                todo += [(2 * k + 1, level + 1, rows[~right]), (2 * k + 2, level + 1, rows[right])]

    def decision(self, rows: np.ndarray) -> np.ndarray:
        """1/2 - 2^(-mean path / expected path): below 0 for odd rows."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, path in zip(self.feature, self.threshold, self.path):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (rows[every, f] > threshold[at]), at)
            total += path[at]
        return 0.5 - 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.drawn)), 1e-9))


def anomaly_scores(df: DataFrame, names: Sequence[str], trees: int = 1000, seed: int = 42) -> DataFrame:
    """df with anomaly_score from an isolation forest: lower is odder, below 0 is odd.

    Trees draw DRAWN rows each, as the method has it, from a pool of POOL rows that a hash picks among all; the
    forest has a fixed size and goes to the workers that score every row.
    """
    values = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names]
    held = df.withColumn("_x", F.array(*values))
    pool = held.select("_x").orderBy(F.xxhash64("_x", F.lit(seed)), "_x").limit(POOL).collect()
    if not pool:
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(Forest(np.array([r[0] for r in pool], float), trees, seed=seed))
    width, schema = len(names), T.StructType([*df.schema, T.StructField("anomaly_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.decision(x))], schema.names)

    return importable(held).mapInArrow(run, schema)


def experiment(features: DataFrame, names: Sequence[str], split: DataFrame | None = None, model: str = "boosted", targets: Sequence[float] = (0.99, 0.95, 0.9), **settings) -> dict[str, DataFrame]:
    """Fits on bucket 0, chooses thresholds on bucket 1 and reports on bucket 2: the prefilter experiment.

    Without split, features have their bucket.  Scores are written, since several measures read them.
    """
    rows = prepared(features, names).join(split.select("transaction_id", "bucket"), "transaction_id") if split is not None else prepared(features, names, "is_laundering", "bucket")
    part = lambda k: rows.where(F.col("bucket") == k).drop("bucket")
    fitted = logistic(part(E.TRAIN), names) if model == "logistic" else boosted(part(E.TRAIN), names, **settings)
    valid, test = cut(scored(fitted, part(E.VALID))), cut(scored(fitted, part(E.TEST)))
    return {"retention": E.retention_table(valid, test, targets), "fixed_recall": E.gain_table(test, targets), "roc_auc": E.roc_auc(test), "pr_auc": E.average_precision(test), "test": test}


def sweep(features: DataFrame, names: Sequence[str], split: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """(config, f1, threshold, error) of each setting: a failing setting is reported and doesn't end the sweep."""
    rows = prepared(features, names).join(split.select("transaction_id", "bucket"), "transaction_id").persist()
    out = []
    for config in grid:
        try:
            fitted = boosted(rows.where("bucket = 0").drop("bucket"), names, **config)
            best = E.best_threshold(scored(fitted, rows.where("bucket = 1"))).first()
            out.append((str(config), float(best.f1), float(best.threshold), None))
        except Exception as problem:  # the report says which setting failed and why
            out.append((str(config), None, None, str(problem)[:200]))
    rows.unpersist()
    return features.sparkSession.createDataFrame(out, "config string, f1 double, threshold double, error string")
