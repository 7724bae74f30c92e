"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability of its own; the document's is their noisy-or,
1 - prod(1 - p).  Training sees labels of documents only, and the model then points at the offending sentences.
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

#: Buckets of words and of their beginnings, most labelled rows to learn from, gradient steps over them.
BUCKETS, TRAINING_ROWS, STEPS = 1 << 17, 6000, 2400
#: Most bytes of their texts, whatever their number: what the driver holds is a few times as much.
TRAINING_BYTES = 32 << 20
#: Labels of rows with this remainder are held out.
MODULUS, HELD_OUT = 5, 0
#: Beginnings of words that count as features; a feature needs so many toxic training documents, and so many standard deviations more than chance.
PREFIXES, LEAST_DOCUMENTS, DEVIATIONS = (4, 5), 3, 5.0
#: The logit of a sentence without such features: low, since a long document has thousands of sentences.
BIAS = -10.0
_COLUMNS = 2 + len(PREFIXES)


def _bucket(kind: str, part: str) -> int:
    return zlib.crc32(f"{kind}{part}".encode()) % BUCKETS


def _word(word: str) -> bytes:
    """The word's buckets and whether it ends a sentence."""
    bare = word.lower().strip(".,;:!?\"'()*#$%&")
    ids = [_bucket("w", bare), *(_bucket(str(n), bare[:n]) for n in PREFIXES)]
    return np.array([*ids, word[-1] in ".!?"], "<i4").tobytes()


_words = Memo(_word)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words, and where each sentence starts; sentences end at . ! ? and at line ends."""
    lines = [line.split() for line in text.split("\n")]
    rows = np.frombuffer(b"".join(_words[w] for line in lines for w in line), "<i4").reshape(-1, _COLUMNS)
    if not len(rows):
        return rows[:, :-1], np.zeros(0, np.int64)
    ends = rows[:, -1] > 0
    ends[np.cumsum([len(x) for x in lines if x]) - 1] = True
    return rows[:, :-1], np.r_[0, np.flatnonzero(ends[:-1]) + 1]


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - p) in logarithms."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each sentence and where it starts, in words."""
        rows, starts = bag(text)
        if not len(starts):
            return np.zeros(0), starts
        return self.bias + np.add.reduceat(self.weights[rows].sum(axis=1), starts), starts


def telling(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """The features that toxic documents have significantly more often than the share of toxic documents explains."""
    counts, share = np.zeros((2, BUCKETS)), labels.mean()
    for (rows, _), label in zip(bags, labels):
        counts[int(label)][np.unique(rows)] += 1
    seen = counts.sum(axis=0)
    excess = (counts[1] - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return (counts[1] >= LEAST_DOCUMENTS) & (excess >= DEVIATIONS)


def document_slopes(logits: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The derivative of the negative log-likelihood of documents' labels by each sentence's logit.

    Sentences follow each other by document, counts[k] >= 1 of them in document k.  A clean document wants every
    sentence clean; a toxic one, 1 - prod(1 - p) likely, which pulls least on sentences that others explain.
    """
    clean = np.exp(-np.add.reduceat(np.logaddexp(0, logits), np.cumsum(counts) - counts))  # 1 - P of each document
    pull = np.where(labels > 0, -clean / np.maximum(1 - clean, 1e-3), 1.0)
    return np.repeat(pull, counts) / (1 + np.exp(-logits))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11, rate: float = 0.5, decay: float = 2e-4, batch: int = 64) -> Model:
    """Likelihood of the documents' labels under the noisy-or, by plain gradient steps.

    Steps aren't scaled per feature: frequent features are learnt first, and once they explain a document its
    rare words get no more weight.  Labels of one class alone teach nothing: every sentence keeps the bias.
    """
    random, weights = np.random.default_rng(seed), np.zeros(BUCKETS)
    filled = np.array([k for k, (_, starts) in enumerate(bags) if len(starts)], np.int64)
    if not len(filled) or labels.min() == labels.max():
        return Model(BIAS, weights)
    known = telling(bags, labels)
    batches, step = max(1, len(filled) // batch), 0
    while step < STEPS:
        for some in np.array_split(random.permutation(filled), batches):
            step += 1
            rows = np.concatenate([bags[k][0] for k in some])
            shift = np.cumsum([0, *(len(bags[k][0]) for k in some)])
            starts = np.concatenate([bags[k][1] + s for k, s in zip(some, shift)])
            counts = np.array([len(bags[k][1]) for k in some])
            z = np.clip(BIAS + np.add.reduceat(weights[rows].sum(axis=1), starts), -30, 30)
            per_word = np.repeat(document_slopes(z, counts, labels[some]), np.diff(np.r_[starts, len(rows)]))
            inside = known[rows]
            used, back = np.unique(rows[inside], return_inverse=True)
            if len(used):
                grad = np.bincount(back, np.broadcast_to(per_word[:, None], rows.shape)[inside], len(used)) / np.sqrt(len(some))
                weights[used] -= rate * grad + decay * weights[used]
    return Model(BIAS, weights)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """Learns from at most bound labelled documents outside the held-out fold; their features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes() for r, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()), batch.column(1)], ["r", "s", "label"])

    rows = training_rows(docs, labels, "toxic", MODULUS, HELD_OUT, bound, TRAINING_BYTES).mapInArrow(run, "r binary, s binary, label int").collect()
    rows.sort(key=lambda x: (bytes(x.r), bytes(x.s), x.label))  # the same model however the rows arrive
    bags = [(np.frombuffer(x.r, "<i4").reshape(-1, _COLUMNS - 1), np.frombuffer(x.s, np.int64)) for x in rows]
    return fit(bags, np.array([x.label for x in rows], np.float64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every document.

    offending lists the sentences of probability 0.5 and more as (start, stop, probability), in words.  Null and
    empty texts have no sentence and score 0; very long ones are read whole, every sentence counts.  A null key
    is not held out.  Repeated rows give repeated rows, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the corpus
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                z, starts = model.sentences(text)
                scores.append(noisy_or(z))
                stops = np.r_[starts[1:], len(text.split())] if (z >= 0).any() else starts
                found.append([{"start": int(starts[k]), "stop": int(stops[k]), "probability": float(1 / (1 + np.exp(-z[k])))} for k in np.flatnonzero(z >= 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, found_type)], ["doc_id", "score", "offending"])

    scored = source.mapInArrow(run, "doc_id long, score double, offending array<struct<start: int, stop: int, probability: double>>")
    held = F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
