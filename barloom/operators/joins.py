"""As-of, lookback and fold joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.segments import SEG, with_last_known


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], key: str = "symbol", date: str = "date", segment: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its date; NULL
    without one. Both sides are stacked and scanned once in date order: one shuffle by key, no join.
    With a segment (of the date, see segments) rows are shuffled by key and segment instead."""
    names = [c for c in left.columns if c not in (key, date)]
    top = left.select(key, date, F.lit(1).alias("_side"), F.struct(*names).alias("_row") if names else F.lit(0).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    low = right.select(key, date, F.lit(0).alias("_side"), F.lit(None).cast(top.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    stacked = top.unionByName(low)
    if segment is None:
        scan = Window.partitionBy(key).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
        seen = stacked.withColumn("_value", F.last("_value", ignorenulls=True).over(scan)).where("_side = 1")
    else:
        seen = with_last_known(stacked.withColumn(SEG, segment), "_value", [date, "_side"], key).where("_side = 1")
    return seen.select(key, date, *([F.col(f"_row.{c}") for c in names]), *[F.col(f"_value.{v}") for v in values])


def rebalance_dates(panel: DataFrame, every: int) -> DataFrame:
    """Every k-th distinct date. The ranking window runs over distinct dates, not over rows."""
    dates = panel.select("date").distinct()
    return dates.withColumn("_n", F.row_number().over(Window.orderBy("date"))).where((F.col("_n") - 1) % every == 0).select(F.col("date").alias("rebalance_date"))


def lookback_spans(panel: DataFrame, days: int, every: int) -> DataFrame:
    """(date, first, last): the numbers, from 0, of the first and last rebalance date in whose lookback of `days` days a
    date lies; dates in none are left out. Windows run over distinct dates, not over rows."""
    dates = panel.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")))
    reach = F.expr(f"max(_n) over (order by date range between current row and interval {days} days following)")
    spans = dates.select("date", F.ceil((F.col("_n") - 1) / every).cast("int").alias("first"), F.floor((reach - 1) / every).cast("int").alias("last"))
    return spans.where("first <= last")


def lookback(panel: DataFrame, days: int, every: int) -> DataFrame:
    """Panel rows within `days` calendar days before each rebalance date, both ends included. Both sides
    are cut into buckets of `days` days, so the range join is an equi-join on one or two buckets."""
    dates = rebalance_dates(panel, every)
    width = days * 86400
    bucket = F.floor(F.unix_timestamp(F.col("date").cast("timestamp")) / width)
    at = F.floor(F.unix_timestamp(F.col("rebalance_date").cast("timestamp")) / width)
    spread = dates.withColumn("_b", F.explode(F.array(at - 1, at)))
    near = panel.withColumn("_b", bucket).join(spread, "_b").drop("_b")
    return near.where((F.col("date") <= F.col("rebalance_date")) & (F.col("date") >= F.col("rebalance_date") - F.expr(f"INTERVAL {days} DAYS")))


def fold_rows(rows: DataFrame, train_min: int, step: int) -> DataFrame:
    """Rows of every fold with is_test: an expanding training part, then `step` dates. A row's folds follow from
    its date's rank alone (all from the first whose test part ends behind it), so they are generated, not joined."""
    dates = rows.select("date").distinct().withColumn("rank", F.row_number().over(Window.orderBy("date")) - 1)
    last = dates.agg((F.floor((F.max("rank") + 1 - train_min) / step) - 1).cast("int")).scalar()
    first = F.greatest(F.lit(0), F.floor((F.col("rank") - train_min) / step).cast("int"))
    ranked = rows.join(dates, "date").withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    out = ranked.withColumn("fold", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    first_rank = F.col("fold") * step + train_min
    return out.withColumns({"first_rank": first_rank, "is_test": F.col("rank") >= first_rank})
