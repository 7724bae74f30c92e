"""SimHash near-dedup with BK-trees over shards of fingerprints.

Fingerprints at most RADIUS bits apart agree on at least three of six bit blocks, so each of the 20 choices of three
blocks deals the distinct fingerprints to shards (equal bits on the chosen blocks), and every link lies in
some shard.  A shard's fingerprints go into a BK-tree, whose children are keyed by their Hamming distance
to the parent; a search follows only the edges within the radius of its own distance.  Links found in a shard
are merged there and leave it as a star for each group, never as all pairs.

Trees aren't broadcast: their sum grows with the corpus.  Each shard is read as one run of sorted rows.  A shard
of more than SHARD_LIMIT fingerprints is dealt anew by a quarter of the bits that are still free (again some
quarter must agree), so that none has to fit a task whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .components import connected_components
from .exact_dedup import first_rows
from .scratch import stored

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCKS, AGREEING = 6, 3
SHARD_LIMIT, LEVELS = 4096, 4
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text in UTF-8: words after lower-casing A-Z, XXH64 of each shingle, bitwise majority."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    view = memoryview(line)
    starts = [0, *(e + 1 for e in ends)]
    hashes = [digest(view[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(majority, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp): the fingerprint as a signed long.  Null and empty texts have fingerprint zero.  Carried columns get the prefix _c_."""
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    schema = T.StructType([source.schema[0], T.StructField("fp", T.LongType()), *source.schema[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]], schema.names)

    return source.mapInArrow(run, schema)


def _split(bits: list[int], parts: int) -> list[int]:
    """Masks of about equally many of the given bit positions."""
    return [sum(1 << b for b in chunk) for chunk in np.array_split(bits, parts) for chunk in [[int(b) for b in chunk]]]


def shard_masks(level: int) -> list[int]:
    """The bits that the fingerprints of a shard share, for each table of a level; table k of a level has the tables 4k to 4k+3 of the next."""
    if level == 0:
        return [sum(c) for c in combinations(_split([*range(64)], BLOCKS), AGREEING)]
    return [m | part for m in shard_masks(level - 1) for part in _split([b for b in range(64) if not m >> b & 1], RADIUS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Fingerprints by integer Hamming distance; also keeps which of them are linked."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.values, self.children, self.group = radius, [], [], []

    def root(self, k: int) -> int:
        group = self.group
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    def add(self, value: int) -> None:
        """Links value to all held within the radius, then inserts it."""
        radius, values, children = self.radius, self.values, self.children
        me = len(values)
        self.group.append(me)
        stack = [0] if me else []
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                a, b = self.root(node), self.root(me)
                self.group[max(a, b)] = min(a, b)
            below = children[node]
            if below:
                stack += [below[e] for e in range(max(1, d - radius), d + radius + 1) if e in below]
        values.append(value)
        children.append({})
        if me:
            node = 0
            while (step := children[node].setdefault((values[node] ^ value).bit_count(), me)) != me:
                node = step

    def stars(self) -> Iterator[tuple[int, int]]:
        """(centre, member) for every value linked to another."""
        for k, value in enumerate(self.values):
            if (r := self.root(k)) != k:
                yield self.values[r], value


def _search(level: int, limit: int):
    """Over sorted (table, shared, fp): stars of each shard, or the rows of its finer shards where it is too large."""
    finer = shard_masks(level + 1) if level + 1 < LEVELS else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        current: tuple[int, int] | None = None
        out: tuple[list, ...] = ([], [], [], [])

        def deal(table: int, fps: list[int]) -> None:
            for fp in fps:
                for t in range((RADIUS + 1) * table, (RADIUS + 1) * (table + 1)):
                    for column, x in zip(out, (t, _signed(fp & finer[t]), _signed(fp), None)):
                        column.append(x)

        def close() -> None:
            if len(held) > 1 and (not finer or len(held) <= limit):
                tree = BKTree()
                for fp in held:
                    tree.add(fp)
                for a, b in tree.stars():
                    for column, x in zip(out, (None, None, _signed(a), _signed(b))):
                        column.append(x)
            elif finer and len(held) > limit:
                deal(current[0], held)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["table", "shared", "fp", "other"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            table, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (shared[1:] != shared[:-1])])
            sizes = np.diff(np.r_[starts, len(fps)])
            last = len(starts) - 1
            for k, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
                if k and n == 1 and k != last and not held:
                    continue
                run_key = (int(table[a]), int(shared[a]))
                if run_key != current:
                    close()
                    held, current = [], run_key
                    if n == 1 and k != last:
                        continue
                held += fps[a : a + n].tolist()
                if finer and len(held) > 4 * limit:  # sure to be dealt anew: needs no more than this in memory
                    deal(current[0], held[: -limit - 1])
                    held = held[-limit - 1 :]
            if len(out[0]) > 10_000:
                yield flush()
        close()
        if out[0]:
            yield flush()

    return run


def links(classes: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): stars that connect all fingerprints of classes (distinct fp) within RADIUS of each other."""
    masks = shard_masks(0)
    rows = classes.select(F.inline(F.array(*(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared"), F.col("fp").alias("fp")) for k, m in enumerate(masks)))))
    found = None
    for level in range(LEVELS):
        shards = rows.repartition("table", "shared").sortWithinPartitions("table", "shared")
        searched = stored(shards.mapInArrow(_search(level, limit), "table int, shared long, fp long, other long"), "shards")
        stars = searched.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        found = stars if found is None else found.union(stars)
        rows = searched.where("other is null").select("table", "shared", "fp")
        if rows.isEmpty():
            break
    return found.distinct()


def fingerprint_components(found: DataFrame, key: str = "doc_id", limit: int = SHARD_LIMIT) -> DataFrame:
    """(fp, component_id, label, chosen) of every distinct fingerprint of (key, fp); chosen is one fingerprint of the component, which the smallest key has."""
    classes = stored(found.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    labels = connected_components(links(classes, limit)).withColumnRenamed("node", "fp")
    labelled = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp")))
    firsts = labelled.groupBy("label").agg(smallest.alias("_s"), F.min("fp").alias("_f")).select("label", F.col("_s.first").alias("component_id"), F.coalesce("_s.fp", "_f").alias("chosen"))
    return stored(labelled.join(firsts, "label").select("fp", "component_id", "label", "chosen"), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_LIMIT) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links between fingerprints, one row per document.

    Documents with one fingerprint are linked, those without words too.  A null key is never the smallest; a
    component of such documents alone has a null id.
    """
    found = stored(fingerprints(docs, key, text), "fingerprints")
    # a plain join on the fingerprint: the classes are distinct, and AQE splits the partition of a hot one
    return found.join(fingerprint_components(found, key, limit), "fp").select(key, "fp", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_LIMIT) -> DataFrame:
    """One document of each component, that with the smallest key, with the columns it came with.

    Of rows that repeat that key one stays, and one of a component that has no key at all: the first by a hash of
    the other columns.  Null, empty and wordless texts are one component, very long ones are read whole, and
    an empty table gives an empty one.
    """
    components = fingerprint_components(stored(fingerprints(docs, key, text), "fingerprints"), key, limit)
    winners = components.where("fp = chosen").select("fp", F.col("component_id").alias(key))
    others = tuple(c for c in docs.columns if c != key)
    # documents of a hot fingerprint differ in their keys; rows that repeat both, or have no key, are thinned before they meet
    keyed = first_rows(fingerprints(docs.where(F.col(key).isNotNull()), key, text, others), "fp", key).join(winners, ["fp", key])
    keyless = first_rows(fingerprints(docs.where(F.col(key).isNull()), key, text, others), "fp").join(winners.where(F.col(key).isNull()).select("fp"), "fp")
    kept = keyed.unionByName(keyless)
    return kept.select(*(F.col(c) if c == key else F.col(f"_c_{c}").alias(c) for c in docs.columns))
