"""Regime discovery by clustering of lookback statistics, and its stability between rebalances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.density import hierarchical_labels, neighbour_layout
from barloom.operators.joins import asof_backward, lookback_spans, rebalance_dates

STATS = ["mean_ret", "std_ret", "mean_vol", "mean_dv"]
UNKNOWN = -1
MANIFOLD_LEAST = 20


def lookback_moments(panel: DataFrame, values: tuple[str, ...], days: int, every: int) -> DataFrame:
    """(rebalance_date, symbol, for each value a struct of n, mean and m2) over the `days` days up to each rebalance
    date. Rows of one symbol that lie in the same lookbacks become one set of moments (number, mean, sum of squared
    deviations) before anything is repeated; only those are, inside the tasks that hold the symbol, and merged."""
    spans = lookback_spans(panel, days, every)
    near = panel.select("date", "symbol", *values).join(spans, "date")
    # First the map side, so that a symbol that holds most rows travels as moments.
    parts = [F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")).alias(v) for v in values]
    classes = near.groupBy("symbol", "first", "last").agg(*parts).repartition("symbol")
    spread = classes.withColumn("k", F.explode(F.sequence("first", "last")))
    merged = spread.groupBy("symbol", "k").agg(*[F.collect_list(v).alias(v) for v in values])
    out = merged.select("symbol", "k", *[merge_moments(F.col(v)).alias(v) for v in values])
    dates = rebalance_dates(panel, every).withColumn("k", F.row_number().over(Window.orderBy("rebalance_date")) - 1)
    return out.join(dates, "k").select("rebalance_date", "symbol", *values)


def merge_moments(parts: Column) -> Column:
    """One set of moments of an array of them; none of them known: n 0, mean NULL."""
    known = F.filter(parts, lambda p: p["n"] > 0)

    def total(x: Column, f) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, p: acc + f(p))

    n = F.aggregate(known, F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    mean = total(known, lambda p: p["n"] * p["mean"]) / F.nullif(n, F.lit(0))
    return F.transform(F.array(mean), lambda m: F.struct(n.alias("n"), m.alias("mean"), total(known, lambda p: p["m2"] + p["n"] * (p["mean"] - m) * (p["mean"] - m)).alias("m2")))[0]


def lookback_stats(panel: DataFrame, days: int, every: int, least_symbols: int) -> DataFrame:
    """Per rebalance date and symbol: mean and deviation of returns, mean volatility, mean dollar volume;
    dates with fewer than least_symbols complete symbols are left out."""
    values = ("log_return", "realized_vol", "dollar_volume")
    stats = lookback_moments(panel, values, days, every).select(
        "rebalance_date",
        "symbol",
        F.col("log_return.mean").alias("mean_ret"),
        F.when(F.col("log_return.n") > 1, F.sqrt(F.col("log_return.m2") / (F.col("log_return.n") - 1))).alias("std_ret"),
        F.col("realized_vol.mean").alias("mean_vol"),
        F.col("dollar_volume.mean").alias("mean_dv"),
    )
    full = stats.na.drop()
    return full.withColumn("_n", F.count("*").over(Window.partitionBy("rebalance_date"))).where(F.col("_n") >= least_symbols).drop("_n")


def principal_axes(x: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first k principal components, signs fixed by each axis's largest loading."""
    x = x - x.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:k]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return x @ axes.T


def independent_axes(x: np.ndarray, k: int, seed: int = 42, rounds: int = 600, tolerance: float = 0.01) -> np.ndarray:
    """Unit-variance independent components by symmetric fixed-point iteration with the log-cosh contrast."""
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = min(k, int((s > 1e-12 * max(s[0], 1e-300)).sum()) if len(s) else 0)
    if not k:
        return np.zeros((len(x), 0))
    white = (u[:, :k] * np.sqrt(len(x))).T

    def orthogonal(w: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(w @ w.T)
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T @ w

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(rounds):
        g = np.tanh(w @ white)
        new = orthogonal(g @ white.T / white.shape[1] - (1 - g * g).mean(1)[:, None] * w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    return (w @ white).T


def density_labels(x: np.ndarray, radius: float, least: int, chunk: int = 256) -> np.ndarray:
    """Density clusters: points with at least `least` points (themselves included) within the radius are
    cores; cores within the radius of each other share a label, others take a near core's, the rest -1.

    Points are put in order of the first axis and compared, a chunk at a time, with those within the radius on
    that axis only, so memory is a chunk times its neighbourhood. Labels count up by each cluster's first core."""
    n = len(x)
    by = np.argsort(x[:, 0], kind="stable")
    z = x[by]
    low, high = np.searchsorted(z[:, 0], z[:, 0] - radius, "left"), np.searchsorted(z[:, 0], z[:, 0] + radius, "right")

    def chunks():
        for a in range(0, n, chunk):
            b = min(n, a + chunk)
            c, d = int(low[a]), int(high[b - 1])
            yield a, c, ((z[a:b, None, :] - z[None, c:d, :]) ** 2).sum(-1) <= radius * radius

    core = np.concatenate([near.sum(1) >= least for _, _, near in chunks()]) if n else np.zeros(0, bool)
    parent, reach = np.arange(n), np.full(n, -1)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, c, near in chunks():
        for i, j in zip(*np.nonzero(near & core[None, c : c + near.shape[1]])):
            i, j = a + i, c + j
            if core[i]:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
            elif reach[i] < 0 or by[j] < by[reach[i]]:
                reach[i] = j
    roots = np.array([root(k) if core[k] else (root(reach[k]) if reach[k] >= 0 else -1) for k in range(n)], int)
    first = {}
    for k in np.argsort(by, kind="stable"):  # in the order of the points as they came
        if core[k]:
            first.setdefault(roots[k], len(first))
    labels = np.full(n, UNKNOWN)
    labels[by] = [first[r] if r >= 0 else UNKNOWN for r in roots]
    return labels


def discover_regimes(
    panel: DataFrame, rebalance_days: int = 7, lookback_days: int = 126, pca: int = 4, ica: int = 4, min_cluster_size: int = 6, manifold: int = 2, radius: float | None = None
) -> DataFrame:
    """(date, symbol, regime). Each rebalance date's cross-section of symbols is one group; its size is
    the number of symbols, not of rows.

    Principal and independent axes of the lookback statistics; from MANIFOLD_LEAST symbols on, their neighbour-keeping
    layout on `manifold` axes (0: never); then hierarchical density clusters, or clusters of one fixed radius."""
    stats = lookback_stats(panel, lookback_days, rebalance_days, max(3, min_cluster_size))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("symbol")
        x = frame[STATS].to_numpy(float)
        cap = min(x.shape)
        points = np.hstack([principal_axes(x, min(pca, cap)), independent_axes(x, min(ica, cap))])
        if manifold and len(points) >= MANIFOLD_LEAST:
            points = neighbour_layout(points, manifold, min(15, len(points) - 1))
        labels = hierarchical_labels(points, min_cluster_size) if radius is None else density_labels(points, radius, max(2, min_cluster_size // 2))
        return pd.DataFrame({"date": frame["rebalance_date"], "symbol": frame["symbol"], "regime": labels.astype("int32")})

    return stats.groupBy("rebalance_date").applyInPandas(cluster, "date timestamp_ntz, symbol string, regime int")


def variation_of_information(assignments: DataFrame) -> DataFrame:
    """(date, prev_date, n_overlap, vi) of each kept rebalance date and the one before: entropies of both
    maps less twice their mutual information, over the symbols in both."""
    dates = assignments.select("date").distinct().withColumn("prev_date", F.lag("date").over(Window.orderBy("date"))).where("prev_date is not null")
    now = assignments.join(dates, "date").select("date", "prev_date", "symbol", F.col("regime").alias("x"))
    before = assignments.select(F.col("date").alias("prev_date"), "symbol", F.col("regime").alias("y"))
    cells = now.join(before, ["prev_date", "symbol"]).groupBy("date", "prev_date", "x", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy("date")
    cells = cells.withColumns({"total": F.sum("n").over(w), "n_x": F.sum("n").over(Window.partitionBy("date", "x")), "n_y": F.sum("n").over(Window.partitionBy("date", "y"))})
    p, px, py = F.col("n") / F.col("total"), F.col("n_x") / F.col("total"), F.col("n_y") / F.col("total")
    # Each cell carries its share of a marginal's entropy; the small constant is in the entropies only.
    entropy = -p * F.log(px + 1e-12) - p * F.log(py + 1e-12)
    mutual = p * (F.log(p) - F.log(px) - F.log(py))
    return cells.groupBy("date", "prev_date").agg(F.max("total").cast("int").alias("n_overlap"), (F.sum(entropy) - 2 * F.sum(mutual)).alias("vi"))


def attach_regime(panel: DataFrame, assignments: DataFrame, segment: Column | None = None) -> DataFrame:
    """The panel with the latest regime at or before each row, -1 without one."""
    out = asof_backward(panel, assignments.select("date", "symbol", "regime"), ["regime"], segment=segment)
    return out.withColumn("regime", F.coalesce("regime", F.lit(UNKNOWN)))
