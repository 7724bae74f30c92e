"""Rows by account in files that workers map: steps along pruned edges look them up, so no row of a join is exchanged.

A shelf has a file for each class of keys; neighbouring keys lie together.  A file counts only through the row that
its task returned, so retried and lost tasks leave no wrong data.  Mapped pages are not held in memory: a shelf may be
larger than an executor.  From a folder that can't be mapped, a worker copies files to its own temporary folder first.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.workers import cut, importable, shared_path

#: Keys that lie together, as a power of two, and rows that are joined at a time.
SHIFT, ROWS = 8, 1 << 20
FILE_ROWS = "kind int, class int, path string, keys long, rows long, types string, odd boolean"


class Shelf(NamedTuple):
    """What the driver knows of a shelf; odd: some key or value is null or not a number."""

    classes: int
    files: dict[int, tuple]
    types: str
    odd: bool = False

    def arrays(self, k: int) -> tuple | None:
        return _mapped(*self.files[k]) if k in self.files else None

    def take(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For all rows of keys: the place of the key in keys, and the columns."""
        of = (keys >> SHIFT) % self.classes
        order = np.argsort(of, kind="stable")
        found, places = [], []
        for k, at in zip(*_runs(of[order], order)):
            if (held := self.arrays(int(k))) is None:
                continue
            names, starts, columns = held
            row = np.minimum(np.searchsorted(names, keys[at]), len(names) - 1)
            hit = names[row] == keys[at]
            at, first, n = at[hit], starts[row[hit]], starts[row[hit] + 1] - starts[row[hit]]
            rows = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places.append(np.repeat(at, n))
            found.append([c[rows].astype(float) if c.dtype.kind == "f" else c[rows] for c in columns])
        if not found:
            return np.zeros(0, np.int64), [np.zeros(0, t) for t in self.types.split()]
        return np.concatenate(places), [np.concatenate(c) for c in zip(*found)]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The number of rows of each key."""
        out, of = np.zeros(len(keys), np.int64), (keys >> SHIFT) % self.classes
        order = np.argsort(of, kind="stable")
        for k, at in zip(*_runs(of[order], order)):
            if (held := self.arrays(int(k))) is not None:
                row = np.minimum(np.searchsorted(held[0], keys[at]), len(held[0]) - 1)
                out[at] = np.where(held[0][row] == keys[at], held[1][row + 1] - held[1][row], 0)
        return out

    def one(self, keys: np.ndarray) -> np.ndarray:
        """The only value of each key; not a number where it has none."""
        out = np.full(len(keys), np.nan)
        at, columns = self.take(keys)
        out[at] = columns[0]
        return out


def _runs(of: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The values of a sorted array, and what stands at each in order."""
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    return of[np.r_[0, cuts]] if len(of) else of, np.split(order, cuts) if len(of) else []


def raw_bytes(path: str) -> np.ndarray:
    """The mapped bytes of a file; of one that can't be mapped, those of a temporary copy."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if not isinstance(system, fs.LocalFileSystem):
        name = tempfile.TemporaryFile()
        with system.open_input_stream(path.split("://", 1)[-1]) as source:
            while piece := source.read(1 << 20):
                name.write(piece)
        name.flush()
    return np.asarray(np.memmap(name, np.uint8, "r"))


@lru_cache(maxsize=4096)
def _mapped(path: str, keys: int, rows: int, types: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    raw, at, out = raw_bytes(path), 0, []
    for kind, n in [("<i8", keys), ("<i8", keys + 1), *((t, rows) for t in types.split())]:
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += -(-size // 8) * 8
    return out[0], out[1], out[2:]


def _narrow(column: np.ndarray) -> np.ndarray:
    """Four bytes a value where they hold the same values."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = column.astype("<i4" if column.dtype.kind == "i" else "<f4")
    return small if np.array_equal(small.astype(column.dtype), column, equal_nan=column.dtype.kind == "f") else column


def _saved(folder: str, kind: int, k: int, keys: np.ndarray, columns: Sequence[np.ndarray], odd: bool = False) -> list:
    """The row of a file of class k: keys in order, once for each of their rows."""
    from pyarrow import fs

    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    columns = [_narrow(c) for c in columns]
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{base}/{name}") as file:
        for a in (keys[cuts].astype("<i8"), np.r_[cuts, len(keys)].astype("<i8"), *columns):
            file.write(raw := np.ascontiguousarray(a).tobytes())
            file.write(b"\0" * (-len(raw) % 8))
    return [kind, k, f"{folder}/{name}", len(cuts), len(keys), " ".join(f"<{c.dtype.kind}{c.dtype.itemsize}" for c in columns), odd]


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _listed(rows: Sequence[Sequence], schema: str = FILE_ROWS) -> pa.RecordBatch:
    names = names_of(schema)
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _shelf(rows: Sequence, classes: int, types: str, kind: int = 0) -> Shelf:
    mine = [r for r in rows if r["kind"] == kind]
    return Shelf(classes, {r["class"]: (r["path"], r["keys"], r["rows"], r["types"]) for r in mine}, types, any(r["odd"] for r in mine))


def classes_of(spark: SparkSession) -> int:
    return min(1024, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def place(key: str, classes: int) -> Column:
    """The class of a key: what is dealt out by it needs no further exchange for a shelf."""
    return F.coalesce(F.pmod(F.shiftright(F.col(key).cast("long"), SHIFT), F.lit(classes)), F.lit(0)).cast("int")


def released(spark: SparkSession) -> None:
    """Lets go of exchanges that nothing needs: else they stay on disk until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def once(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written and read back, without the exchanges that led to it."""
    found = cut(df, path)
    released(df.sparkSession)
    return found


def shelve(df: DataFrame, classes: int, order: Sequence = ()) -> Shelf:
    """A shelf of (_class, key, columns of longs and doubles), whose partitions hold whole classes."""
    folder = shared_path(df.sparkSession, "shelf")
    key = df.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            odd = any(c.null_count > 0 or pa.types.is_floating(c.type) and bool(np.isnan(c.to_numpy()).any()) for c in table.columns[1:])
            columns = [c.fill_null(0).to_numpy() for c in table.columns[1:]]
            return _listed([_saved(folder, 0, held[0].column(0)[0].as_py(), columns[0], columns[1:], odd)])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[0].column(0)[0].as_py() != of[a]:
                    yield closed()
                    held.clear()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield closed()

    ordered = df.sortWithinPartitions("_class", key, *order)
    files = importable(ordered).mapInArrow(run, FILE_ROWS).collect()
    del ordered
    released(df.sparkSession)
    types = " ".join("<f8" if kind == "double" else "<i8" for _, kind in df.dtypes[2:])
    return _shelf(files, classes, types)


def remove(path: str) -> None:
    """Deletes a file that nothing reads any more."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.delete_file(name)


def forget(shelf: Shelf) -> None:
    """Deletes the files of a shelf that nothing reads any more."""
    for path, *_ in shelf.files.values():
        remove(path)


def each_class(spark: SparkSession, shelf: Shelf, run: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run returns for each class of a shelf, in a task of its own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from run(k)

    numbers = spark.sparkContext.parallelize([(k,) for k in sorted(shelf.files)], max(1, len(shelf.files)))
    return importable(spark.createDataFrame(numbers, "class int")).mapInArrow(task, schema)


def grouped(owner: np.ndarray, other: np.ndarray, values: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums of values by (owner, other), in their order."""
    n = len(owner)
    if not n:
        return owner, other, list(values)
    low = int(other.min())
    at_bits, other_bits = n.bit_length(), (int(other.max()) - low).bit_length()
    if at_bits + other_bits + int(owner.max()).bit_length() < 63:
        # one sort of packed numbers is several times as fast as a sort of places
        packed = ((owner.astype(np.int64) << other_bits | (other.astype(np.int64) - low)) << at_bits) | np.arange(n)
        packed.sort()
        order = packed & ((1 << at_bits) - 1)
        pair = packed >> at_bits
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    else:
        order = np.lexsort((other, owner))
        a, b = owner[order], other[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = order[first]
    return owner[at], other[at].astype(np.int64), [np.add.reduceat(v[order], first) for v in values]


def largest(owner: np.ndarray, other: np.ndarray, amount: np.ndarray, n: int) -> np.ndarray:
    """Places of each owner's n largest amounts, of equals the smallest others; rows are in order of owner and other."""
    if not len(owner):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[first, len(owner)])
    kept = np.arange(len(owner))
    if counts.max() > n:
        row = np.repeat(np.arange(len(first)), counts)
        square = np.full((len(first), int(counts.max())), -np.inf)
        square[row, kept - np.repeat(first, counts)] = amount
        least = np.partition(square, square.shape[1] - n, axis=1)[:, square.shape[1] - n]
        kept = np.flatnonzero(amount >= least[row])
    order = kept[np.lexsort((other[kept], -amount[kept], owner[kept]))]
    start = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < n]
