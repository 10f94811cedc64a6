"""Scans along a series whose rows are spread over many tasks.

A series is cut by time into segments; rows are shuffled once, by (symbol, segment). Inside a segment a scan runs as
usual; what a segment does to a scan is one small associative value: for a recursive mean y = a x + (1 - a) y the
known rows' number n and the mean e they make from zero (y after = e + (1 - a)^n y before), for a last known value that
value. These are combined along each symbol, a few rows a segment, and carried back into the segments. So one symbol of
any length uses all cores, and no task sorts a whole series.

A segment is a column that rises with the date (segment_of makes one). Rows with a NULL symbol carry nothing from one
segment to the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the longest series in one segment, about.
SEGMENT_ROWS = 100_000
#: Rows of a stretch inside which powers of 1 - a are taken; fewer where they would overflow.
STRETCH = 500
#: Values that weigh less than e to the minus this are left out of a mean.
NEGLIGIBLE = 45.0
SEG = "_seg"


def wall_seconds(date: Column) -> Column:
    """Seconds since 1970 by the calendar, with no time zone's gaps."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(date) * 3600 + F.minute(date) * 60 + F.second(date)


def segment_of(df: DataFrame, rows: int = SEGMENT_ROWS, symbol: str = "symbol", date: str = "date") -> Column | None:
    """The segment of a row, such that the longest series has about `rows` in each; None where all series are shorter.
    One count by symbol is run."""
    at = wall_seconds(F.col(date).cast("timestamp_ntz"))
    seen = df.groupBy(symbol).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if seen["n"] is None or seen["n"] <= rows or seen["low"] is None:
        return None
    width = max(1, math.ceil((seen["high"] - seen["low"] + 1) * rows / seen["n"]))
    return F.floor((at - seen["low"]) / width).cast("long")


def _inside(symbol: str, date: str):
    return Window.partitionBy(symbol, SEG).orderBy(date)


def _along(symbol: str):
    return Window.partitionBy(symbol).orderBy(SEG)


def with_previous(df: DataFrame, columns: dict[str, str], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """df, which has a segment column, with each new column the value of another one in the row before."""
    ends = df.groupBy(symbol, SEG).agg(F.max_by(F.struct(*set(columns.values())), F.col(date)).alias("_end"))
    before = ends.select(symbol, SEG, F.lag("_end").over(_along(symbol)).alias("_before"))
    w = _inside(symbol, date)
    rows = df.withColumns({"_place": F.row_number().over(w)} | {new: F.lag(old).over(w) for new, old in columns.items()})
    joined = rows.join(before, [symbol, SEG], "left")
    first = F.col("_place") == 1
    return joined.withColumns({new: F.when(first, F.col("_before")[old]).otherwise(F.col(new)) for new, old in columns.items()}).drop("_place", "_before")


@dataclass(frozen=True)
class Ewm:
    """out: the recursive mean of value, seeded with its first known value, NULL before `least` known values."""

    value: str
    alpha: float
    out: str
    least: int = 0


def with_ewm(df: DataFrame, means: list[Ewm], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """df, which has a segment column, with all the means: one more shuffle, of one row for each stretch."""
    stretch = min([STRETCH, *(max(1, int(600 / -math.log1p(-m.alpha))) for m in means if m.alpha < 1)])
    rows = df.withColumn("_stretch", F.floor((F.row_number().over(_inside(symbol, date)) - 1) / stretch).cast("int"))
    so_far = Window.partitionBy(symbol, SEG, "_stretch").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)

    def decay(m: Ewm, n: Column) -> Column:
        return F.pow(F.lit(1.0 - m.alpha), n) if m.alpha < 1 else F.when(n == 0, 1.0).otherwise(0.0)

    def weighed(ends: Column, before: Column, m: Ewm) -> Column:
        return F.aggregate(ends, F.lit(0.0), lambda acc, c: acc + F.when(c["e"].isNotNull() & (c["to"] <= before), c["e"] * decay(m, before - c["to"])).otherwise(0.0))

    rows = rows.withColumns({f"_n{k}": F.count(m.value).over(so_far) for k, m in enumerate(means)})
    # From zero: the sum of a x (1 - a)^-i, scaled back.
    rows = rows.withColumns(
        {f"_e{k}": F.coalesce(F.sum(F.lit(m.alpha) * F.col(m.value) * decay(m, 1 - F.col(f"_n{k}"))).over(so_far) * decay(m, F.col(f"_n{k}") - 1), F.lit(0.0)) if m.alpha < 1 else F.coalesce(F.last(m.value, ignorenulls=True).over(so_far), F.lit(0.0)) for k, m in enumerate(means)}
    )
    parts = []
    for k, m in enumerate(means):
        parts += [F.max(f"_n{k}").alias(f"n{k}"), F.max_by(f"_e{k}", date).alias(f"e{k}"), F.min_by(m.value, F.when(F.col(m.value).isNotNull(), F.col(date))).alias(f"x{k}")]
    stretches = rows.groupBy(symbol, SEG, "_stretch").agg(*parts)
    order = Window.partitionBy(symbol).orderBy(SEG, "_stretch")
    stretches = stretches.withColumns({f"to{k}": F.sum(f"n{k}").over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in range(len(means))} | {f"x{k}": F.first(f"x{k}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in range(len(means))})
    carried = {}
    for k, m in enumerate(means):
        reach = math.ceil(NEGLIGIBLE / -math.log1p(-m.alpha)) + stretch if m.alpha < 1 else stretch
        near = F.collect_list(F.struct(F.col(f"to{k}").alias("to"), F.when(F.col(f"n{k}") > 0, F.col(f"e{k}")).alias("e"))).over(Window.partitionBy(symbol).orderBy(f"to{k}").rangeBetween(-reach, 0))
        before = F.col(f"to{k}") - F.col(f"n{k}")
        carried[f"c{k}"] = F.struct(before.alias("known"), (weighed(near, before, m) + F.coalesce(F.col(f"x{k}"), F.lit(0.0)) * decay(m, before)).alias("mean"))
    # Windows first, then one row a segment, still partitioned by symbol.
    carry = stretches.select(symbol, SEG, "_stretch", *[c.alias(name) for name, c in carried.items()]).groupBy(symbol, SEG).agg(F.array_sort(F.collect_list(F.struct("_stretch", *carried))).alias("_carry"))
    joined = rows.join(carry, [symbol, SEG], "left").withColumn("_carry", F.get("_carry", F.col("_stretch")))
    result = {}
    for k, m in enumerate(means):
        c = F.col("_carry")[f"c{k}"]
        known = c["known"] + F.col(f"_n{k}")
        result[m.out] = F.when(known >= max(m.least, 1), F.col(f"_e{k}") + decay(m, F.col(f"_n{k}")) * c["mean"])
    return joined.withColumns(result).drop("_stretch", "_carry", *[f"_{x}{k}" for x in "ne" for k in range(len(means))])


def with_last_known(df: DataFrame, value: str, order: list[str], symbol: str = "symbol") -> DataFrame:
    """df, which has a segment column, with a column's NULLs replaced by its last known value before."""
    w = Window.partitionBy(symbol, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(symbol, SEG).agg(F.max_by(value, known).alias("_end"))
    before = ends.select(symbol, SEG, F.last("_end", ignorenulls=True).over(_along(symbol).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = df.withColumn(value, F.last(value, ignorenulls=True).over(w))
    return rows.join(before, [symbol, SEG], "left").withColumn(value, F.coalesce(value, "_before")).drop("_before")
