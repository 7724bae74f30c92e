"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

Every pair of features interacts through the product of their low-rank factors; all pairs together cost
linear time by the sum-of-squares identity,

    sum over pairs <v_i, v_j> x_i x_j = 1/2 * sum over factors ((sum v x)^2 - sum (v x)^2).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Memo
from .labelled import remainder, training_rows

#: Word buckets, factors, most labelled rows to learn from, passes over them.
WORD_BUCKETS, FACTORS, TRAINING_ROWS, EPOCHS = 1 << 15, 8, 6000, 12
#: Most bytes of their texts, whatever their number: what the driver holds is a few times as much.
TRAINING_BYTES = 32 << 20
#: Labels of rows with this remainder are held out.
MODULUS, HELD_OUT = 3, 1
#: Bins of each statistic, and how many there are.
BINS, STATISTICS = 12, 9
SIZE = WORD_BUCKETS + BINS * STATISTICS

_buckets = Memo(lambda word: zlib.crc32(word.lower().encode()) % WORD_BUCKETS)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_DIGITS = str.maketrans("", "", "0123456789")
_MARKS = str.maketrans("", "", "!?.,;:")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: damped word counts of unit length, and one bin of each statistic."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if n:
        index, counts = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int32, n), return_counts=True)
        values = np.log1p(counts)
        values /= np.sqrt((values**2).sum())
    else:
        index, values = np.zeros(0, np.int32), np.zeros(0)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ascii_upper = sum(map(str.isupper, words))
    statistics = (
        np.log2(n + 1),  # words
        np.log2(chars),  # length
        2 * len("".join(words)) / max(1, n) - 3,  # word length
        BINS * len(index) / max(1, n),  # distinct words
        40 * (len(text) - len(text.translate(_SYMBOLS))) / chars,  # symbols
        BINS * ascii_upper / max(1, n),  # upper-case words
        40 * (len(text) - len(text.translate(_DIGITS))) / chars,  # digits
        40 * (len(text) - len(text.translate(_MARKS))) / chars,  # punctuation
        BINS * (1 - len(set(lines)) / max(1, len(lines))),  # repeated lines
    )
    bins = [WORD_BUCKETS + BINS * k + int(min(BINS - 1, max(0, x))) for k, x in enumerate(statistics)]
    return np.r_[index, bins].astype(np.int32), np.r_[values, np.ones(STATISTICS)].astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, index: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[index] * values[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[index] @ values + 0.5 * ((s * s).sum() - (v * v).sum()))

    def probability(self, text: str) -> float:
        return 1 / (1 + np.exp(-np.clip(self.logit(*features(text)), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, rate: float = 0.1, decay: float = 1e-4, batch: int = 128) -> Machine:
    """Logistic loss, AdaGrad over mini-batches.  One class alone, or no row, gives a machine that says so for all texts."""
    random, bias = np.random.default_rng(seed), 0.0
    linear, factors = np.zeros(SIZE, np.float32), random.normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32)
    if len(rows):
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
    if len(rows) == 0 or labels.min() == labels.max():
        return Machine(bias, linear, np.zeros_like(factors))
    seen_linear, seen_factors, seen_bias = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(EPOCHS):
        shuffled = random.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = shuffled[at : at + batch]
            index, values = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some])
            sizes = np.array([len(rows[k][0]) for k in some])
            first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
            v = factors[index] * values[:, None]
            s = np.add.reduceat(v, first)
            z = bias + np.add.reduceat(linear[index] * values, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), first))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]).astype(np.float32) / len(some)
            used, back = np.unique(index, return_inverse=True)
            step = error[owner] * values
            g_linear = np.bincount(back, step, len(used)).astype(np.float32) + decay * linear[used]
            g_each = step[:, None] * (s[owner] - v)
            g_factors = np.stack([np.bincount(back, g_each[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * factors[used]
            seen_linear[used] += g_linear**2
            seen_factors[used] += g_factors**2
            seen_bias += float(error.sum()) ** 2
            linear[used] -= rate * g_linear / np.sqrt(seen_linear[used])
            factors[used] -= 0.5 * rate * g_factors / np.sqrt(seen_factors[used])
            bias -= rate * float(error.sum()) / np.sqrt(seen_bias)
    return Machine(bias, linear, factors)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Machine:
    """Learns from at most bound labelled documents outside the held-out fold; their features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), batch.column(1)], ["i", "v", "label"])

    rows = training_rows(docs, labels, "quality", MODULUS, HELD_OUT, bound, TRAINING_BYTES).mapInArrow(run, "i binary, v binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r.i), bytes(r.v), r.label))  # the same model however the rows arrive
    return fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in rows], np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts are scored by their statistics; very long ones are read whole.  A null key is not held
    out.  Repeated rows give repeated rows, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size, whatever the corpus
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = shared.value.probability
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([probability(x) for x in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
