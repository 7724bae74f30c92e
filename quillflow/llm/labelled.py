"""Labelled rows for training: which may be learnt from, and a bounded choice of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus: deals rows to folds."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def chosen(labels: DataFrame, label: str, modulus: int, held: int, keep_held_out: bool, bound: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of at most bound rows that are not held out, in the order of a hash of the key."""
    inside = remainder(key, modulus) == held
    fold = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (inside if keep_held_out else ~inside))
    return fold.select(key, F.col(label).cast("int").alias("label")).orderBy(F.xxhash64(key), key).limit(bound)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int, most_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most bound labelled rows and most_bytes of text, in the order of a hash of the key.

    A document that doesn't fit in what is left is passed over.  Sizes are looked up first, at most bound of
    them, so neither long documents nor a key that many rows share make the sample larger.
    """
    rows = chosen(labels, label, modulus, held, False, bound, key)
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("long")
    sized = docs.select(key, text).join(F.broadcast(rows), key).groupBy(key, "label").agg(size.alias("size"), F.count(F.lit(1)).alias("n"))
    left, left_rows, kept = most_bytes, bound, []
    for r in sized.orderBy(F.xxhash64(key), key, "label").collect():
        if r["size"] <= left and r["n"] <= left_rows:
            left, left_rows = left - r["size"], left_rows - r["n"]
            kept.append((r[key], r["label"]))
    wanted = docs.sparkSession.createDataFrame(kept, rows.schema)
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(wanted), key).select("text", "label")
