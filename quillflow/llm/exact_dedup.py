"""Exact dedup against a minimal perfect hash over the distinct digests of the history.

The history (documents that came before) is indexed once: its distinct digests are dealt by prefix to shards
of bounded size, and each shard holds a minimal perfect hash whose slots carry the whole digest, the winner's
doc_id and the number of copies.  Incoming documents are pre-aggregated by digest; a digest is looked up in
its shard's slot and compared byte by byte.  Members repeat a historical text; nonmembers form groups among
themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .scratch import stored

#: Distinct digests of a shard, about; bounds what one task holds.
SHARD_KEYS = 50_000
DIGEST = 32
MAX_LEVELS = 48


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, digest): SHA-256 of the UTF-8 text after lower-casing A-Z only; null counts as empty.  Carried columns get the prefix _c_."""
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    schema = T.StructType([source.schema[0], T.StructField("digest", T.BinaryType()), *source.schema[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = pc.ascii_lower(batch.column(1)).cast(pa.binary())
            found = [hashlib.sha256(x.as_buffer() or b"").digest() for x in lowered]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], schema.names)

    return source.mapInArrow(run, schema)


def classes(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(digest, keep_id, copies): one row per distinct digest, summed before the shuffle."""
    return found.groupBy("digest").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of each digest's first words for each level."""
    with np.errstate(over="ignore"):
        h = words[:, 0] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30)) ^ words[:, 1]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by cascading bit arrays.

    At each level every key left hashes to a bit; bits hit by one key alone are set and that key is placed,
    the others go on to the next level.  A key's slot is the number of set bits before its own.  Keys that no
    level places (practically none) follow at the end and are found by their whole digest.
    """

    def __init__(self, levels: list[np.ndarray], rest: list[bytes]):
        self.levels, self.rest = levels, {d: k for k, d in enumerate(rest)}
        self.before = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.cumsum(bits) - bits for bits in levels]

    @staticmethod
    def build(words: np.ndarray, raw: list[bytes], spread: float = 1.7) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the slot of each key."""
        left, levels = np.arange(len(words)), []
        while len(left) and len(levels) < MAX_LEVELS:
            size = max(64, int(len(left) * spread))
            at = (_mix(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        built = PerfectHash(levels, [raw[k] for k in left])
        return built, built.slots(words, raw)

    def slots(self, words: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """The slot of each key that was built in; for others any slot or -1."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(words[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        for k in left:
            if (r := self.rest.get(raw[k])) is not None:
                out[k] = self.before[-1] + r
        return out

    def dump(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return [len(b) for b in self.levels], [np.packbits(b).tobytes() for b in self.levels], list(self.rest)

    @staticmethod
    def load(sizes, bits, rest) -> PerfectHash:
        return PerfectHash([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)], list(rest))


def _words(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u8").reshape(-1, DIGEST // 8).astype(np.uint64)


def with_shard(found: DataFrame, shards: int) -> DataFrame:
    prefix = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return found.withColumn("shard", (prefix % F.lit(shards)).cast("int"))


INDEX = "shard int, sizes array<int>, bits array<binary>, rest array<binary>, digests binary, winners array<long>, copies array<long>"


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of history (digest, keep_id, copies): its perfect hash and its slots."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest", ignore_index=True)
        raw = [bytes(d) for d in pdf["digest"]]
        built, slots = PerfectHash.build(_words(raw), raw)
        order = np.argsort(slots)
        sizes, bits, rest = built.dump()
        winners = [None if pd.isna(w) else int(w) for w in pdf["keep_id"].iloc[order]]
        slot_digests = b"".join(raw[k] for k in order)
        return pd.DataFrame([[int(pdf["shard"].iloc[0]), sizes, bits, rest, slot_digests, winners, [int(c) for c in pdf["copies"].iloc[order]]]], columns=["shard", "sizes", "bits", "rest", "digests", "winners", "copies"])

    return with_shard(history, shards).groupBy("shard").applyInPandas(build, INDEX)


LOOKED_UP = "digest binary, keep_id long, copies long, member boolean"


def look_up(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Incoming (digest, keep_id, copies), each with what the index holds of its digest.

    A member takes the later winner and the sum of the copies; a nonmember keeps its own.  Historical digests
    without an incoming copy are returned too, so the result is the classes of both.
    """

    def probe(new: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        raw = [bytes(d) for d in new["digest"]]
        keep = [None if pd.isna(w) else int(w) for w in new["keep_id"]]
        copies, member, used, rest = [int(c) for c in new["copies"]], [False] * len(raw), set(), []
        for row in slots.itertuples(index=False):
            table = PerfectHash.load(row.sizes, row.bits, [bytes(r) for r in row.rest])
            held, winners = bytes(row.digests), list(row.winners)
            at = table.slots(_words(raw), raw) if raw else []
            for k, s in enumerate(at):
                if 0 <= s < len(winners) and held[s * DIGEST : (s + 1) * DIGEST] == raw[k]:
                    w = None if pd.isna(winners[s]) else int(winners[s])
                    keep[k] = w if keep[k] is None else keep[k] if w is None else max(keep[k], w)
                    copies[k] += int(row.copies[s])
                    member[k] = True
                    used.add(int(s))
            rest += [(held[s * DIGEST : (s + 1) * DIGEST], None if pd.isna(w) else int(w), int(row.copies[s]), True) for s, w in enumerate(winners) if s not in used]
        out = [*zip(raw, keep, copies, member), *rest]
        return pd.DataFrame({"digest": [x[0] for x in out], "keep_id": pd.array([x[1] for x in out], "Int64"), "copies": [x[2] for x in out], "member": [x[3] for x in out]})

    return with_shard(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, LOOKED_UP)


def merged_classes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(digest, keep_id, copies, member) of all distinct digests of history and incoming, given the (key, digest) rows of both."""
    old_classes = stored(classes(old, key), "classes-old")
    shards = max(1, ceil(max(old.count(), new.count()) / SHARD_KEYS))
    return stored(look_up(classes(new, key), stored(build_index(old_classes, shards), "perfect-hash"), shards), "classes")


def dedup(history: DataFrame, incoming: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document of both: (key, digest, keep_id, group_size, kept, member); the largest key of equal texts stays.

    Documents without key never win; a group that has none but such has a null keep_id and keeps none of
    them.  Rows that repeat key and text stay together: all of the winning key have kept = true.
    """
    old, new = stored(digests(history, key, text), "digests-old"), stored(digests(incoming, key, text), "digests-new")
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    # a plain join on the digest: the classes are distinct, and AQE splits the partition of a hot text
    return both.join(merged_classes(old, new, key), "digest").select(
        key, "digest", "keep_id", F.col("copies").alias("group_size"), F.coalesce(F.col(key) == F.col("keep_id"), F.lit(False)).alias("kept"), (F.col("member") & F.col("_new")).alias("member")
    )


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of equal texts, that with the largest key, with the columns it came with.

    The older half of the keys is the history.  Of rows that repeat the winning key one stays, and one of a
    class that has no key at all: the first by a hash of the other columns.  Null and empty texts are one class,
    very long ones are hashed whole, and an empty table gives an empty one.
    """
    history, incoming = older_half(docs, key)
    found = merged_classes(stored(digests(history, key, text), "digests-old"), stored(digests(incoming, key, text), "digests-new"), key)
    others = tuple(c for c in docs.columns if c != key)
    winners = found.select("digest", F.col("keep_id").alias(key))
    # copies of a hot text differ in their keys; rows that repeat both, or have no key, are thinned before they meet
    keyed = first_rows(digests(docs.where(F.col(key).isNotNull()), key, text, others), "digest", key).join(winners, ["digest", key])
    keyless = first_rows(digests(docs.where(F.col(key).isNull()), key, text, others), "digest").join(winners.where(F.col(key).isNull()).select("digest"), "digest")
    kept = keyed.unionByName(keyless)
    return kept.select(*(F.col(c) if c == key else F.col(f"_c_{c}").alias(c) for c in docs.columns))


def first_rows(rows: DataFrame, *group: str) -> DataFrame:
    """The first row of each group by a hash of its carried columns; each task keeps one row a group before the exchange."""
    carried = [c for c in rows.columns if c.startswith("_c_")]
    order = Window.partitionBy(*group).orderBy(F.xxhash64(*carried) if carried else F.lit(0))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def older_half(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as history (keys up to the middle of their range, or none) and what came after."""
    low, high = docs.agg(F.min(key), F.max(key)).first()
    middle = ((low or 0) + (high or 0)) // 2
    is_new = F.coalesce(F.col(key) > F.lit(middle), F.lit(False))
    return docs.where(~is_new), docs.where(is_new)


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
