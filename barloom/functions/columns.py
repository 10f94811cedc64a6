"""Row-wise and windowed column builders.

NULL means "missing" everywhere; NaN is turned into NULL where data is read. Spark's greatest and least
skip NULLs, so every clip is guarded to keep a NULL a NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

LOG_FLOOR = 1e-12
EPSILON_Z = 1e-9


def by_symbol(symbol: str = "symbol", date: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(date)


def cross_section(date: str = "date") -> WindowSpec:
    return Window.partitionBy(date)


def safe_log(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(LOG_FLOOR))))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def first_truthy(*values: Column) -> Column:
    """The first value that is neither missing nor zero."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values])


def trailing(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def min_periods(n: int) -> int:
    return max(5, n // 4)


def rolling_std(x: Column, window: WindowSpec, n: int, least: int | None = None) -> Column:
    w = trailing(window, n)
    return F.when(F.count(x).over(w) >= (min_periods(n) if least is None else least), F.stddev_samp(x).over(w))


def rolling_zscore(x: Column, window: WindowSpec, n: int) -> Column:
    w = trailing(window, n)
    z = (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + EPSILON_Z)
    return F.coalesce(F.when(F.count(x).over(w) >= min_periods(n), z), F.lit(0.0))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    return F.greatest(F.abs(high - low), F.abs(high - previous_close), F.abs(low - previous_close))


def linear_fill(df: DataFrame, columns: list[str], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Fill gaps by position between the nearest known values; edges take the nearest one. All columns
    share one shuffle and one sort."""
    w = by_symbol(symbol, date)
    numbered = df.withColumn("_i", F.row_number().over(w))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("v"))) for c in columns}
    sides = numbered.withColumns({f"_p_{c}": F.last(k, ignorenulls=True).over(back) for c, k in known.items()} | {f"_n_{c}": F.first(k, ignorenulls=True).over(ahead) for c, k in known.items()})

    def filled(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        between = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / (n["i"] - p["i"])
        return F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(between)

    return sides.withColumns({c: filled(c) for c in columns}).drop("_i", *[f"_{s}_{c}" for s in "pn" for c in columns])


#: Rows of a block of the exponential mean: (1 - a) ** -EWM_BLOCK stays far from overflow for spans up to 60.
EWM_BLOCK = 500


def ewm_mean(df: DataFrame, value: str, alpha: float, out: str, symbol: str = "symbol", date: str = "date", least: int = 0) -> DataFrame:
    """Recursive exponential mean y = alpha x + (1 - alpha) y, seeded with the first known value.

    Inside a block of rows it is a running sum of x (1 - alpha) ** -i, scaled back; what comes from before
    a block is the last block's end. Earlier blocks weigh less than a double can show. All windows use the
    partitioning by symbol, so there is one shuffle, and a series of any length works. NULLs carry the last
    mean on; fewer than `least` known values give NULL."""
    r = 1.0 - alpha
    w = by_symbol(symbol, date)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    known = F.count(x).over(so_far)
    place = F.when(x.isNotNull(), known - 1)
    step = df.withColumn("_k", known).withColumn("_i", place)
    block, at = F.floor(F.col("_i") / EWM_BLOCK), F.col("_i") % EWM_BLOCK
    step = step.withColumn("_block", block).withColumn("_at", at)
    term = F.when(F.col("_i") == 0, x).otherwise(alpha * x) * F.pow(F.lit(r), -F.col("_at"))
    inside = Window.partitionBy(symbol, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("_local", F.sum(term).over(inside) * F.pow(F.lit(r), F.col("_at")))
    end = F.last(F.when(F.col("_at") == EWM_BLOCK - 1, F.col("_local")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = step.withColumn("_mean", F.col("_local") + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(r), F.col("_at") + 1))
    carried = F.last("_mean", ignorenulls=True).over(so_far)
    result = F.when(F.col("_k") >= least, carried) if least else carried
    return step.withColumn(out, result).drop("_k", "_i", "_block", "_at", "_local", "_mean")


#: Rank error of the brackets below is at most 1 / BRACKET_ACCURACY of the values.
BRACKET_ACCURACY = 100_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], out: str = "q") -> DataFrame:
    """One row: for each column an array `{out}_{column}` of its exact quantiles, interpolated between neighbours,
    over its known values; NULLs where it has none.

    A first pass brackets each quantile by approximate ones a little below and above it; a second counts what
    lies below and above the bracket, with the value next to it, and groups what lies inside. Only the distinct
    values of a bracket, a few hundred thousandths of all, are put in order, so no task ever holds a column."""
    slack = 2.0 / BRACKET_ACCURACY
    edges = [edge for q in shares for edge in (max(0.0, q - slack), min(1.0, q + slack))]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.*").where("v is not null and not isnan(v)")
    brackets = long.groupBy("c").agg(F.count("*").alias("n"), F.percentile_approx("v", edges, BRACKET_ACCURACY).alias("edges"))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("share"), F.col("edges")[2 * k].alias("low"), F.col("edges")[2 * k + 1].alias("high")) for k, q in enumerate(shares)]))
    # One row a column and share.
    wanted = F.broadcast(brackets.select("c", "n", parts.alias("p")).select("c", "n", "p.*"))
    zone = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    marked = long.join(wanted, "c").withColumn("zone", zone).withColumn("slot", F.when(F.col("zone") == 0, F.col("v")))
    zones = marked.groupBy("c", "k", "n", "share", "zone", "slot").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
    seen = F.sum("m").over(Window.partitionBy("c", "k").orderBy("zone", "slot"))
    ranked = zones.withColumns({"place": (F.col("n") - 1) * F.col("share"), "seen": seen, "value": F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least"))})
    first = F.min(F.when(F.col("seen") > F.floor("place"), F.col("value")))
    second = F.min(F.when(F.col("seen") > F.ceil("place"), F.col("value")))
    weight = F.max(F.col("place") - F.floor("place"))
    found = ranked.groupBy("c", "k").agg(first.alias("a"), second.alias("b"), weight.alias("w")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    return found.agg(*[F.array(*[F.max(F.when((F.col("c") == j) & (F.col("k") == k), F.col("q"))) for k in range(len(shares))]).alias(f"{out}_{c}") for j, c in enumerate(columns)])
