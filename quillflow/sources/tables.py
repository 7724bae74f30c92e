"""Sources: the canonical transaction view, raw transaction files, pattern files, accounts and configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.windows import global_rank
from .constants import CURRENCIES, DAY, NAMES, RAW_COLUMNS, RAW_TIMESTAMP

LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


#: Lines that are numbered in one window.
LINE_RANGE = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or some columns of it: the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def transactions(spark: SparkSession, sf_dir: str, between: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The canonical transaction view: lineitem with its orders; times are epoch seconds (ts_s).

    between is applied to the numbered lines before they meet their orders: written there, they leave one exchange behind.
    """
    lines = global_rank(table(spark, sf_dir, "lineitem"), F.floor(F.col("l_orderkey") / 4096), LINE_ORDER, "transaction_id", start=0)
    if between:
        lines = between(lines.select("transaction_id", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    names = F.array(*map(F.lit, NAMES))
    label = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "transaction_id",
        (F.lit(1661990400) + 900 * F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))).cast("long").alias("ts_s"),
        F.col("o_custkey").alias("from_account"),
        F.col("l_partkey").alias("to_account"),
        (F.col("o_custkey") % 25).cast("int").alias("from_bank"),
        (F.col("l_partkey") % 25).cast("int").alias("to_bank"),
        F.get(names, ((F.col("o_custkey") % 25) % 15).cast("int")).alias("payment_currency"),
        F.get(names, ((F.col("l_partkey") % 25) % 15).cast("int")).alias("receiving_currency"),
        (F.col("l_quantity") * 100).alias("amount_paid"),
        F.round(F.col("l_quantity") * 100 * (1 - F.col("l_discount")), 2).alias("amount_received"),
        F.col("o_orderpriority").alias("payment_format"),
        label.cast("int").alias("is_laundering"),
        F.when(label & (F.col("l_linenumber") % 2 == 1), F.col("o_custkey") % 37).otherwise(-1).cast("long").alias("chain_id"),
        F.round((F.col("l_discount") * 10 + F.col("l_quantity") / 50.0) / 2, 4).alias("score"),
    )
    return joined


def currencies(spark: SparkSession) -> DataFrame:
    """The currency dimension (name, code, usd_rate): fifteen rows, broadcast where it is joined."""
    return spark.createDataFrame(list(CURRENCIES), "name string, code string, usd_rate double")


def raw_schema() -> T.StructType:
    """The schema of a raw transaction file: identifiers are strings, so leading zeros survive."""
    kinds = {"timestamp": T.TimestampType(), "amount_received": T.DoubleType(), "amount_paid": T.DoubleType(), "is_laundering": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in RAW_COLUMNS])


def read_raw(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A raw transaction file under an explicit schema; columns are named by position, since the header repeats names."""
    return spark.read.schema(raw_schema()).option("timestampFormat", RAW_TIMESTAMP).option("header", header).option("enforceSchema", True).csv(path)


def with_position(df: DataFrame, order: tuple[str, ...], lead: F.Column, name: str = "transaction_id", start: int = 0, limit: int | None = None) -> DataFrame:
    """Numbers rows from start in an order that begins with lead; with a limit, only the first rows."""
    numbered = global_rank(df, lead, order, name, start=start)
    return numbered if limit is None else numbered.where(F.col(name) < start + limit)


def read_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(line_no, value, line_hash) of a text file: line_no is the order of lines, 0 the header's."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    numbered = global_rank(lines, F.shiftright("at", 33), ("at",), "line_no", start=0)
    kept = numbered.where("line_no > 0") if header else numbered
    return kept.select("line_no", "value", F.xxhash64("value").alias("line_hash"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, type, sub_type, line_no and the raw fields) of a pattern file's blocks.

    A BEGIN line opens a block and names its type after the dash; the running count of BEGIN lines is the
    chain's number, from 0.  Lines are counted within ranges, and only ranges meet in one window: each hands the
    number of its blocks and the head of the last one on to the next.
    """
    lines = read_lines(spark, path, header=False).select(F.trim("value").alias("value"), "line_no", F.floor(F.col("line_no") / LINE_RANGE).alias("_range"))
    begins = F.col("value").startswith("BEGIN")
    ranges = lines.groupBy("_range").agg(F.sum(begins.cast("long")).alias("_n"), F.max(F.when(begins, F.struct("line_no", "value")))["value"].alias("_last"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.last("_last", ignorenulls=True).over(earlier).alias("_head"))
    inside = Window.partitionBy("_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.withColumns({"_nth": F.sum(begins.cast("long")).over(inside), "_own": F.last(F.when(begins, F.col("value")), ignorenulls=True).over(inside)})
    marked = told.join(offsets, "_range").withColumns({"chain_id": F.col("_before") + F.col("_nth") - 1, "head": F.coalesce("_own", "_head")})
    title = F.element_at(F.split("head", " - "), -1)
    part = lambda k: F.lower(F.trim(F.get(F.split(title, ":"), F.lit(k))))
    rows = marked.where(~begins & ~F.col("value").startswith("END") & (F.col("value") != ""))
    cells = F.split("value", ",")
    return rows.select("chain_id", part(0).alias("type"), F.coalesce(part(1), part(0)).alias("sub_type"), "line_no", *(F.trim(F.get(cells, F.lit(k))).alias(c) for k, c in enumerate(RAW_COLUMNS)))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account, entity) of an account file, for a lookup join."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("Account Number").alias("account"), F.col("Entity ID").alias("entity"))


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, type) of a Parquet data set."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(spark.read.parquet(path).schema)]
    return spark.createDataFrame(rows, "ordinal int, name string, type string")


def missing_files(folder: str, required: tuple[str, ...]) -> list[str]:
    """The required files that a data folder lacks."""
    return [f for f in required if not (Path(folder) / f).is_file()]


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.6
    valid: float = 0.2
    test: float = 0.2


@dataclass(frozen=True)
class ModelConfig:
    n_estimators: int = 50
    max_depth: int = 5
    learning_rate: float = 0.1
    n_bits: int = 3
    seed: int = 42


@dataclass(frozen=True)
class FeatureConfig:
    feature_set: str = "old_new"
    history_mode: str = "bank_local"
    window_seconds: int = DAY
    n_hops: int = 5
    top_n: int = 50


@dataclass(frozen=True)
class Config:
    """A pipeline's settings; sections that a file leaves out keep their defaults."""

    dataset: str = "transactions"
    split: SplitConfig = field(default_factory=SplitConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)


def load_config(path: str) -> Config:
    """Settings from a TOML file: ``dataset`` and the tables ``split``, ``model`` and ``features``."""
    data = tomllib.loads(Path(path).read_text())
    unknown = set(data) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    parts = {name: kind(**data.get(name, {})) for name, kind in (("split", SplitConfig), ("model", ModelConfig), ("features", FeatureConfig))}
    config = Config(data.get("dataset", Config.dataset), **parts)
    if abs(config.split.train + config.split.valid + config.split.test - 1) > 1e-9:
        raise ValueError("the split's shares must sum to 1")
    return config
