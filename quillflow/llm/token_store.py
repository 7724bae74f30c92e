"""A token store: binary shards of separately compressed documents, a shared dictionary and an offset index.

Layout of a store::

    dictionary/  Parquet, one row: the zstandard dictionary, its SHA-256 and the width of an id in bytes
    shards/      binary files; a shard is the concatenation of one zstandard frame per document
    index/       Parquet, one row per document in ascending key order: shard, offset, length, start, n_tokens, dict_hash

A document is read by one seek: the index gives its frame, the hash names the dictionary that unpacks it.
Shards carry a name of their own for each attempt and count only once the index row that names them is
committed, so retried, lost and speculative tasks leave no wrong data.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from . import bpe

#: Bounds of what the dictionary is trained on, documents and characters of each, and its size.
TRAINING_DOCUMENTS, TRAINING_CHARS, DICTIONARY_BYTES = 2000, 8192, 64 << 10
LEVEL = 3
SHARD_ROWS = "key long, file string, part int, offset long, length int, local_start long, n_tokens int"


class LibraryCodec(bpe.Codec):
    """The tokenizers library's own model, asked for the pre-tokens of each distinct word."""

    def __init__(self, path: str):
        super().__init__(path)
        self.by_id, self.ask = [np.int32(k).astype("<i4").tobytes() for k in range(self.size)], self.library.model.tokenize
        self.words = bpe.Memo(self.encode_word, 4 * bpe.MEMO_ENTRIES)

    def encode_word(self, word: str) -> bytes:
        by_id = self.by_id
        return b"".join([by_id[t.id] for piece in self.pieces(word) for t in self.ask(piece)])


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def serialized(codec: LibraryCodec, text: str | None, end_id: int, width: int) -> tuple[bytes, int]:
    """The ids of a text and end_id, little-endian in width bytes each, and their count."""
    ids = np.frombuffer(codec.encode(text) + end_id.to_bytes(4, "little"), "<i4")
    return ids.astype(f"<u{width}").tobytes(), len(ids)


def id_width(tokenizer_path: str) -> int:
    return 2 if library_codec(tokenizer_path).size <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small to train on.

    The sample is a piece of one document of each of some distinct keys, all chosen by a hash over all rows: it is
    the same in every run, no row comes too late for it, a key that many rows share counts once, and a long
    document's piece may lie anywhere in it.  A chosen key without any text gives no piece.
    """
    import zstandard

    width = id_width(tokenizer_path)
    h, length = F.xxhash64(key), F.length(text)
    # the keys' hashes alone decide, so this pass reads no text; pieces of text then leave only the tasks that have chosen keys
    lowest = [r.h for r in docs.select(h.alias("h")).distinct().orderBy("h").limit(TRAINING_DOCUMENTS).collect()]
    at = F.pmod(F.xxhash64(key, text), F.greatest(F.lit(1), length - TRAINING_CHARS + 1)).cast("int") + 1
    chosen = docs.where((h <= F.lit(lowest[-1] if lowest else None).cast("long")) & (F.col(text) != ""))
    pieces = chosen.select(h.alias("h"), F.substring(F.col(text), at, F.lit(TRAINING_CHARS)).alias("t")).groupBy("h").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialized(codec, x, end_id, width)[0] for x in batch.column(0).to_pylist()], pa.binary())], ["s"])

    samples = sorted(bytes(r.s) for r in pieces.select("t").mapInArrow(run, "s binary").collect())
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def file_system(uri: str):
    """The file system of a folder's URI (or absolute path) and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes whole texts, appends end_id to each, writes a store at path and returns its index.

    Order is ascending by key, null keys first; rows with equal keys follow each other by a hash of their texts,
    so a key that many rows share, or the lack of one, fills no single range.  A null text is empty and has end_id
    alone.  A very long text is one frame.  An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    shared = train_dictionary(docs, tokenizer_path, end_id, key, text)
    digest, width = hashlib.sha256(shared).hexdigest(), id_width(tokenizer_path)
    spark.createDataFrame([(digest, bytearray(shared), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    store, folder = file_system(f"{path}/shards")
    store.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        target, base = file_system(f"{path}/shards")
        codec, part = library_codec(tokenizer_path), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        name, out, offset, start = f"{part:06d}-{uuid.uuid4().hex}.frames", None, 0, 0
        try:
            for batch in batches:
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw, n = serialized(codec, t, end_id, width)
                    frame = packer.compress(raw)
                    out = out or target.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(frame)
                    rows.append((k, name, part, offset, len(frame), start, n))
                    offset, start = offset + len(frame), start + n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["key", "file", "part", "offset", "length", "local_start", "n_tokens"])
        finally:
            if out:
                out.close()

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = ordered.withColumn("h", F.xxhash64("t")).repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "t")
    ordered.mapInArrow(run, SHARD_ROWS).write.parquet(f"{path}/frames")
    frames = spark.read.parquet(f"{path}/frames")
    # one row per shard: where its first document starts
    sums = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    frames.join(sums, "part").select(
        "key", "file", "offset", "length", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(digest).alias("dict_hash")
    ).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_store(spark: SparkSession, path: str, index: DataFrame | None = None, derive: tuple[str, pa.DataType, Callable[[np.ndarray], object]] | None = None) -> DataFrame:
    """(key, start, n_tokens, ids) read from the shards for all rows of the index, or of the part of it given.

    With derive, a name, a type and a function of a document's ids, that column stands for the ids, which then
    needn't leave the worker that read them.
    """
    entries = spark.read.parquet(f"{path}/index") if index is None else index
    (head,) = spark.read.parquet(f"{path}/dictionary").collect()
    shared, digest, width = bytes(head.dictionary), head.dict_hash, head.width
    name, kind, value = derive or ("ids", pa.list_(pa.int32()), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        source, base = file_system(f"{path}/shards")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for batch in batches:
            table = batch.to_pydict()
            if any(h != digest for h in table["dict_hash"]):
                raise ValueError("a document was packed with another dictionary")
            found: list = [None] * batch.num_rows
            by_file: dict[str, list[int]] = {}
            for k, f in enumerate(table["file"]):
                by_file.setdefault(f, []).append(k)
            for file_name, rows in by_file.items():
                with source.open_input_file(f"{base}/{file_name}") as file:
                    for k in sorted(rows, key=table["offset"].__getitem__):
                        file.seek(table["offset"][k])
                        ids = np.frombuffer(unpacker.decompress(file.read(table["length"][k])), f"<u{width}")
                        found[k] = value(ids) if value else ids.astype("<i4").tobytes()
            column = pa.array(found, kind) if value else bpe.id_lists(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), column], ["key", "start", "n_tokens", name])

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "start", "n_tokens")), T.StructField(name, from_arrow_type(kind))])
    return entries.select("key", "start", "n_tokens", "file", "offset", "length", "dict_hash").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Some documents by key: only their frames are read."""
    return read_store(spark, path, spark.read.parquet(f"{path}/index").where(F.col("key").isin(keys)))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    read = read_store(spark, path, derive=("ids_crc32", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes())))
    return read.withColumnRenamed("key", "doc_id")
