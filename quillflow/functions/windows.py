"""Causal windows over keyed, time-ordered rows.

"Previous" means earlier in row order, (ts, id, ...), so ties in time count up to the current row.  Trailing
windows have two lower bounds: exclusive, (t - w, t], and inclusive, [t - w, t].  A trailing value is a running
value less what is too old, so that every feature of a key shares one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

PRECEDING, CURRENT = Window.unboundedPreceding, Window.currentRow


def over(keys: Sequence, order: Sequence) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def prev_count(keys: Sequence, order: Sequence) -> Column:
    """Rows of the key before this one."""
    return F.row_number().over(over(keys, order)).cast("long") - 1


def since_prev(ts: str, keys: Sequence, order: Sequence) -> Column:
    """Seconds since the key's previous row, -1 at its first."""
    return F.coalesce(F.col(ts) - F.lag(ts).over(over(keys, order)), F.lit(-1))


def prev_sum(x: Column, keys: Sequence, order: Sequence) -> Column:
    """Sum of x over the key's previous rows, 0 at its first."""
    return F.coalesce(F.sum(x).over(over(keys, order).rowsBetween(PRECEDING, -1)), F.lit(0))


def too_old(keys: Sequence, ts: str, seconds: int, inclusive: bool) -> WindowSpec:
    """The rows of the key that have left the trailing window."""
    return Window.partitionBy(*keys).orderBy(ts).rangeBetween(PRECEDING, -(seconds + int(inclusive)))


def trailing_count(ts: str, seconds: int, keys: Sequence, order: Sequence, inclusive: bool = False) -> Column:
    """Rows of the key in the trailing window, this one included."""
    return F.row_number().over(over(keys, order)).cast("long") - F.count(F.lit(1)).over(too_old(keys, ts, seconds, inclusive))


def trailing_sum(x: Column, ts: str, seconds: int, keys: Sequence, order: Sequence, inclusive: bool = False) -> Column:
    """Sum of x over the key's rows in the trailing window, this one included."""
    return F.sum(x).over(over(keys, order).rowsBetween(PRECEDING, CURRENT)) - F.coalesce(F.sum(x).over(too_old(keys, ts, seconds, inclusive)), F.lit(0))


def with_prev_distinct(df: DataFrame, name: str, keys: Sequence[str], value: str | Sequence[str], order: Sequence) -> DataFrame:
    """Distinct values among the key's previous rows: first occurrences, summed."""
    return with_prev_distincts(df, {name: value}, keys, order)


def with_prev_distincts(df: DataFrame, wanted: dict[str, str | Sequence[str]], keys: Sequence[str], order: Sequence) -> DataFrame:
    """with_prev_distinct of several values of one key, name by name.

    A value that begins another shares its sort: the longest has its first rows told by their number, the others by
    the smallest order among their rows, which needs no order of its own.
    """
    if not wanted:
        return df
    values = {n: [v] if isinstance(v, str) else list(v) for n, v in wanted.items()}
    told = df
    for k, (n, v) in enumerate(sorted(values.items(), key=lambda x: -len(x[1]))):
        place = F.struct(*order)
        first = F.row_number().over(over([*keys, *v], order)) == 1 if k == 0 else F.min(place).over(Window.partitionBy(*keys, *v)) == place
        told = told.withColumn(f"_first_{n}", first.cast("long"))
    return told.withColumns({n: prev_sum(F.col(f"_first_{n}"), keys, order) for n in values}).drop(*(f"_first_{n}" for n in values))


def with_trailing_distinct(df: DataFrame, name: str, value: str, ts: str, seconds: int, keys: Sequence, order: Sequence) -> DataFrame:
    """Distinct values in [t - seconds, t] among the key's rows before this one, from running sums alone.

    Every row stands for its value until the value's next row takes over, if that comes within the window, or
    until it is too old.  So the values that count are the rows before, less those that have been taken over,
    less those that nobody took over and that are too old by now.  order begins with ts and has no ties.
    """
    same = over([*keys, value], order)
    known = F.col(value).isNotNull()
    takes_over = known & F.coalesce(F.col(ts) - F.lag(ts).over(same) <= seconds, F.lit(False))
    expires = known & F.coalesce(F.lead(ts).over(same) - F.col(ts) > seconds, F.lit(True))
    marked = df.withColumns({"_stands": known.cast("long") - takes_over.cast("long"), "_expires": expires.cast("long")})
    standing = marked.withColumn("_stood", prev_sum(F.col("_stands"), keys, order))
    gone = F.coalesce(F.sum("_expires").over(too_old(keys, ts, seconds, True)), F.lit(0))
    return standing.withColumn(name, (F.col("_stood") - gone).cast("long")).drop("_stands", "_expires", "_stood")


def with_decayed_count(df: DataFrame, name: str, ts: str, half_life: int, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Sum over the key's previous rows of 2^(-age / half_life).

    Weights 2^(t / half_life) are taken from the start of a span of 128 half-lives, so they neither overflow nor
    need a recursion; a row sees its own span and the one before, and older rows weigh less than 2^-128.
    """
    span = 128 * half_life
    spanned = df.withColumn("_span", F.floor(F.col(ts) / span)).withColumn("_w", F.pow(F.lit(2.0), (F.col(ts) - F.col("_span") * span) / half_life))
    inside = over([*keys, "_span"], order)
    summed = spanned.withColumns({"_here": prev_sum(F.col("_w"), [*keys, "_span"], order), "_run": F.sum("_w").over(inside.rowsBetween(PRECEDING, CURRENT))})
    # the largest running sum is the span's total; it comes from the windows before, so their sort serves both
    before = F.coalesce(F.max("_run").over(Window.partitionBy(*keys).orderBy("_span").rangeBetween(-1, -1)), F.lit(0.0))
    return summed.withColumn(name, (F.col("_here") + before * 2.0**-128) / F.col("_w")).drop("_span", "_w", "_here", "_run")


def global_rank(df: DataFrame, lead: Column, order: Sequence, name: str, start: int = 1) -> DataFrame:
    """Row numbers in a global order without sorting all rows in one task.

    lead must not fall along the order.  Rows are numbered within their value of lead, and values of lead are
    offset by the rows before them: only their counts meet in one window.
    """
    led = df.withColumn("_lead", lead)
    counts = led.groupBy("_lead").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_lead").alias("_at"), (F.sum("_n").over(Window.orderBy("_lead")) - F.col("_n")).alias("_before"))
    inside = led.withColumn("_rank", F.row_number().over(over(["_lead"], order)))
    ranked = inside.join(offsets, F.col("_lead").eqNullSafe(F.col("_at")))
    return ranked.withColumn(name, (F.col("_before") + F.col("_rank") - 1 + start).cast("long")).drop("_lead", "_at", "_before", "_rank")
