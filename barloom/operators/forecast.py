"""Walk-forward forecasts: an expanding training window and a boosted-tree or network fit per fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.boosting import forecast_folds
from barloom.operators.joins import fold_rows

SEED = 42


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 32, cuts: list[np.ndarray] | None = None) -> np.ndarray:
    """Least-squares boosting of one fold on quantile bins (or given cuts); every level of a tree is split for all its
    nodes at once. The plain form of what boosting.py does for all folds."""
    if cuts is None:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    new_binned = np.stack([np.searchsorted(c, new[:, f], "left") for f, c in enumerate(cuts)], 1)
    fit, out = np.full(len(y), y.mean()), np.full(len(new), y.mean())
    for _ in range(trees):
        left = y - fit
        node, new_node, nodes = np.zeros(len(y), int), np.zeros(len(new), int), 1
        for _ in range(depth):
            best = np.full(nodes, 1e-12)
            feature, cut = np.zeros(nodes, int), np.full(nodes, bins)
            n_all, s_all = np.bincount(node, minlength=nodes), np.bincount(node, left, nodes)
            for f in range(x.shape[1]):
                key = node * bins + binned[:, f]
                n = np.bincount(key, minlength=nodes * bins).reshape(nodes, bins).cumsum(1)
                s = np.bincount(key, left, nodes * bins).reshape(nodes, bins).cumsum(1)
                m, t = n_all[:, None] - n, s_all[:, None] - s
                gain = np.where((n > 0) & (m > 0), s**2 / np.maximum(n, 1) + t**2 / np.maximum(m, 1) - (s_all**2 / np.maximum(n_all, 1))[:, None], -1)
                at = gain.argmax(1)
                better = gain[np.arange(nodes), at] > best
                best[better], feature[better], cut[better] = gain[np.arange(nodes), at][better], f, at[better]
            node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            new_node = 2 * new_node + (new_binned[np.arange(len(new)), feature[new_node]] > cut[new_node])
            nodes *= 2
        value = rate * np.bincount(node, left, nodes) / np.maximum(np.bincount(node, minlength=nodes), 1)
        fit += value[node]
        out += value[new_node]
    return out


def network(x: np.ndarray, y: np.ndarray, new: np.ndarray, sizes: tuple[int, int] = (64, 32), epochs: int = 300) -> np.ndarray:
    """A two-hidden-layer perceptron with rectified units, trained by Adam on mini-batches."""
    rng = np.random.default_rng(SEED)
    layers = [x.shape[1], *sizes, 1]
    p = [z for a, b in zip(layers, layers[1:]) for z in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    m, v, step = [np.zeros_like(z) for z in p], [np.zeros_like(z) for z in p], 0

    def forward(z: np.ndarray) -> list[np.ndarray]:
        out = [z]
        for k in range(0, len(p), 2):
            z = z @ p[k] + p[k + 1]
            z = np.maximum(z, 0) if k < len(p) - 2 else z
            out.append(z)
        return out

    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 200):
            rows = order[k : k + 200]
            a = forward(x[rows])
            back, grads = (a[-1] - y[rows, None]) / len(rows), []
            for j in range(len(p) - 2, -1, -2):
                grads[:0] = [a[j // 2].T @ back + 1e-4 * p[j] / len(rows), back.sum(0)]
                if j:
                    back = (back @ p[j].T) * (a[j // 2] > 0)
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= 1e-3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return forward(new)[-1][:, 0]


def walk_forward(rows: DataFrame, features: list[str], train_min: int = 252, step: int = 5, model: str = "gbt", **options) -> DataFrame:
    """(date, symbol, target, prediction). Boosted trees of all folds are grown together (see boosting); `mlp` is the
    network, fitted by fold in parallel, so there a fold's history must fit a task. Too few dates give an empty result."""
    if model != "mlp":
        return forecast_folds(rows, features, train_min, step, **options)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["date", "symbol"])
        train, test = frame[~frame["is_test"]], frame[frame["is_test"]]
        prediction = network(train[features].to_numpy(float), train["next_return"].to_numpy(float), test[features].to_numpy(float), **options)
        return pd.DataFrame({"date": test["date"], "symbol": test["symbol"], "target": test["next_return"], "prediction": prediction})

    folds = fold_rows(rows, train_min, step).select("fold", "is_test", "date", "symbol", *features, "next_return")
    return folds.groupBy("fold").applyInPandas(one, "date timestamp_ntz, symbol string, target double, prediction double")
