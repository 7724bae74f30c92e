"""Scalar expressions of the feature families; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.constants import CURRENCIES


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def usd_rate(currency: Column | str) -> Column:
    """The US dollar rate of a currency name, null if unknown: a literal map, so no join."""
    return F.create_map(*(F.lit(x) for name, _, rate in CURRENCIES for x in (name, rate)))[_col(currency)]


def currency_code(currency: Column | str) -> Column:
    return F.create_map(*(F.lit(x) for name, code, _ in CURRENCIES for x in (name, code)))[_col(currency)]


def in_usd(amount: Column | str, currency: Column | str) -> Column:
    return _col(amount) * usd_rate(currency)


def safe_ratio(a: Column | str, b: Column | str, otherwise: float = 0.0) -> Column:
    """a / b; where that has no value (division by zero, null, not a number), otherwise."""
    ratio = F.try_divide(_col(a).cast("double"), _col(b).cast("double"))
    return F.when(ratio.isNull() | F.isnan(ratio), F.lit(otherwise)).otherwise(ratio)


def log1p_positive(x: Column | str) -> Column:
    return F.log1p(F.greatest(_col(x), F.lit(0.0)))


def hour_of(ts: Column | str) -> Column:
    """Hour of the day of epoch seconds, UTC."""
    return F.pmod(F.floor(_col(ts) / 3600), F.lit(24)).cast("int")


def weekday_of(ts: Column | str) -> Column:
    """Day of the week of epoch seconds, Monday 0; 1970-01-01 was a Thursday."""
    return F.pmod(F.floor(_col(ts) / 86400) + 3, F.lit(7)).cast("int")


def round_amount(amount: Column | str, unit: int) -> Column:
    return (F.pmod(_col(amount), F.lit(float(unit))) == 0).cast("int")


def snake(value: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in value.lower()).strip("_")


def one_hot(df: DataFrame, column: str, prefix: str, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per value; the values are those present unless given."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()) if values is None else values
    return df.withColumns({f"{prefix}_{snake(v)}": (F.coalesce(F.col(column) == v, F.lit(False))).cast("int") for v in found})


def inverse_one_hot(columns: Sequence[str]) -> Column:
    """The name of the first column that holds the row's largest value."""
    best = F.greatest(*columns)
    return F.coalesce(*(F.when(F.col(c) == best, F.lit(c)) for c in columns))


def amount_bin(count: Column | str) -> Column:
    """Repeat counts in five bins: 0, 1, 2-4, 5-9, 10+."""
    c = _col(count)
    return F.when(c < 0.5, "0").when(c < 1.5, "1").when(c < 4.5, "2-4").when(c < 9.5, "5-9").otherwise("10+")


def payment_reference(*parts: Column | str) -> Column:
    """The digest that names a payment: SHA-256 with a domain prefix, after joining the parts by a bar."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("tx-ref-v1"), F.concat_ws("|", *parts)).cast("binary"), 256))


def policy_id(retention: float, family: str = "m2_lr", version: int = 1) -> str:
    """The name of a selection policy, from its target retention in per cent."""
    return f"{family}_p{round(100 * retention):d}_v{version}"


def clean(x: Column | str) -> Column:
    """A finite single-precision number: null, not-a-number and infinities become 0."""
    c = _col(x).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c).cast("float")


def label_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code) of the sorted distinct values of a training column, from 0: rows are distinct values."""
    values = train.select(F.col(column).alias("value")).where("value is not null").distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def encoded(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """The code of each value; values that training did not see share code 0."""
    known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(known, F.col(column) == F.col("_value"), "left").withColumn(name, F.coalesce("_code", F.lit(0))).drop("_value", "_code")
