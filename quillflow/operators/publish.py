"""Flag tables, snapshot flags, parity checks and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S, windows as W

REFERENCE_FIELDS = ("ts_s", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format")


def flag_table(scored: DataFrame, threshold: float, id_offset: int = 0, raw_keys: Sequence[str] = ()) -> DataFrame:
    """(transaction_id, is_kept, risk_score[, raw keys]) of scored transactions."""
    extra = [(F.col("transaction_id") + 1).alias("staging_transaction_id"), *raw_keys] if raw_keys else []
    return scored.select((F.col("transaction_id") + id_offset).alias("transaction_id"), (F.col("score") >= threshold).alias("is_kept"), F.col("score").cast("float").alias("risk_score"), *extra)


def payment_references(tx: DataFrame, fields: Sequence[str] = REFERENCE_FIELDS, scheme: str = "pay-v1") -> DataFrame:
    """tx with occurrence, the number of equal payments before, and tx_ref_hash, the digest that names the payment."""
    occurrence = F.row_number().over(W.over(fields, ("transaction_id",))) - 1
    counted = tx.withColumn("occurrence", occurrence.cast("long"))
    return counted.withColumn("tx_ref_hash", S.payment_reference(F.lit(scheme), *(F.col(f).cast("string") for f in fields), F.col("occurrence").cast("string")))


def snapshot_flags(edges: DataFrame, flags: DataFrame, bank: str, policy: str, min_match: float = 0.99) -> DataFrame:
    """(edge_id, inference_flag, flag_source_bank, selection_policy_id) of a bank's edges, in order of edge_id.

    flags has tx_ref_hash and is_kept.  Refused if the bank reports no edge, if too few edges find a flag, or if
    an edge_id would repeat.
    """
    mine = edges.where(F.col("reporting_bank") == bank)
    joined = mine.join(flags.select("tx_ref_hash", "is_kept"), "tx_ref_hash", "left")
    n, matched, distinct = joined.agg(F.count(F.lit(1)), F.count("is_kept"), F.count_distinct("edge_id")).first()
    if not n:
        raise ValueError(f"no edge of this snapshot is reported by {bank}")
    if matched / n < min_match:
        raise ValueError(f"only {matched / n:.2%} of the edges of {bank} find a flag; {min_match:.2%} are needed")
    if distinct != n:
        raise ValueError("edge_id must be unique")
    return joined.select("edge_id", F.coalesce("is_kept", F.lit(False)).alias("inference_flag"), F.lit(bank).alias("flag_source_bank"), F.lit(policy).alias("selection_policy_id")).orderBy("edge_id")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint): a digest of the rows that doesn't depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).alias("fingerprint"))


def parity(a: DataFrame, b: DataFrame, label: str | None = None) -> DataFrame:
    """(measure, left, right, equal) of two feature tables: rows, columns, label and null counts, and the rows' digest.

    Null counts are reported and don't make the tables differ.
    """

    def measures(df: DataFrame) -> list[tuple[str, str]]:
        nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
        got = fingerprint(df).crossJoin(df.agg(nulls.alias("nulls"), (F.sum(label) if label else F.lit(0)).alias("labels"))).first()
        return [("rows", str(got.rows)), ("columns", ",".join(sorted(df.columns))), ("labels", str(got.labels)), ("nulls", str(got.nulls)), ("fingerprint", str(got.fingerprint))]

    rows = [(m, x, y, x == y) for (m, x), (_, y) in zip(measures(a), measures(b))]
    return a.sparkSession.createDataFrame(rows, "measure string, left string, right string, equal boolean")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df itself; an error if a key repeats."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {', '.join(keys)}")
    return df


def write_parquet(df: DataFrame, path: str, partitions: int | None = None) -> None:
    (df if partitions is None else df.repartition(partitions)).write.mode("overwrite").parquet(path)


def write_strict(df: DataFrame, path: str, schema: dict[str, str], key: str) -> None:
    """Parquet with exactly the given columns and types, sorted by a unique key: a global order over range partitions."""
    assert_unique(df, key).select(*(F.col(c).cast(t) for c, t in schema.items())).orderBy(key).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_row(payload: dict, df: DataFrame, path: str) -> None:
    """Metadata beside a table: one JSON row."""
    df.sparkSession.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, names: Sequence[str], parts: int = 1) -> None:
    """A feature matrix of finite single-precision columns with its label, in several files."""
    df.select("transaction_id", "is_laundering", *(S.clean(n).alias(n) for n in names)).repartition(parts).write.mode("overwrite").parquet(path)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """(name, nulls) of every column from one pass."""
    one = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in df.columns))))


def ranked_by_size(df: DataFrame, value: str) -> DataFrame:
    """Rows by absolute value, largest first, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(value).desc())))
