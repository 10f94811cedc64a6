"""Boosted trees of all folds of a walk-forward, grown together.

A fold trains on the rows before its first test date, so fold k's rows are those of rank below first[k]: membership is a
comparison inside a task, and no row is copied for a fold. Features become bin numbers once. Rows lie in blocks of at
most BLOCK rows, each kept beside the present fit of its rows under at most FOLDS folds, which is what boosting must
remember of a (row, fold). One job grows one level of one tree for all folds: every task adds up counts and residual
sums by (fold, node, feature, bin) over its blocks, a shuffle by fold adds the tasks' sums one fold at a time, and only
the splits come to the driver. No task holds a history, and the number of jobs (trees x depth) does not depend on the
number of folds.

A panel of at most SMALL_CELLS values (rows x features, counted) goes to the tasks whole instead, and each task grows the
trees of some folds without shuffles: the same levels, sums and splits, in one job.

Cuts are quantiles of the rows before the first fold, and again of every history twice as long; a fold uses only those
that were known before its own first test date. They come from at most CUT_ROWS rows of each history, chosen by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.streaming.live import delete, scratch

BLOCK = 4096
FOLDS = 64
CUT_ROWS = 20_000
SMALL_CELLS = 2_000_000
#: Trees after which the rows' fits are written; until then tasks add the newer trees' values themselves.
STATE_EVERY = 16
LEAST_GAIN = 1e-12
RECORD = "chunk int, first_fold int, rank binary, y binary, bins binary, fit binary"


@dataclass
class Plan:
    """First test rank of each fold; for each feature its cuts in order and the rank from which each is known."""

    first: np.ndarray
    cuts: list[np.ndarray]
    since: list[np.ndarray]

    @property
    def starts(self) -> np.ndarray:
        """Where each feature's bins begin among all bins; the last entry is their number."""
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])]).astype(np.int64)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1).astype(np.uint16)


@dataclass
class Trees:
    """For each fold: its mean, and for each tree the split (feature, cut) of every inner node and every leaf's value.
    A node without a split sends all rows left."""

    mean: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def blank(mean: np.ndarray, trees: int, depth: int) -> Trees:
        k = len(mean)
        return Trees(mean, np.zeros((k, trees, 2**depth - 1), np.int16), np.full((k, trees, 2**depth - 1), 65535, np.uint16), np.zeros((k, trees, 2**depth)))

    def slice(self, trees: slice) -> Trees:
        return Trees(self.mean, self.feature[:, trees], self.cut[:, trees], self.value[:, trees])

    def nodes(self, folds: slice, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """(fold, row): the node that each row reaches after `depth` splits of a tree."""
        feature, cut = self.feature[folds, tree], self.cut[folds, tree]
        of, rows = np.arange(len(feature))[:, None], np.arange(len(bins))[None, :]
        node = np.zeros((len(feature), len(bins)), np.int64)
        for level in range(depth):
            at = node + (2**level - 1)
            node = 2 * node + (bins[rows, feature[of, at]] > cut[of, at])
        return node

    def added(self, folds: slice, bins: np.ndarray, depth: int) -> np.ndarray:
        """(fold, row): the sum of all trees' values."""
        out = np.zeros((len(self.mean[folds]), len(bins)))
        of = np.arange(len(out))[:, None]
        for tree in range(self.value.shape[1]):
            out += self.value[folds, tree][of, self.nodes(folds, tree, bins, depth)]
        return out


def level_sums(plan: Plan, folds: slice, rank: np.ndarray, left: np.ndarray, bins: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """(fold, node, count or residual sum, bin) over a block's rows that the folds train on."""
    first = plan.first[folds]
    starts = plan.starts
    inside = rank[None, :] < first[:, None]
    cell = (np.arange(len(first))[:, None] * nodes + node)[inside]
    left, row = left[inside], np.broadcast_to(np.arange(len(rank))[None, :], inside.shape)[inside]
    out = np.zeros((len(first) * nodes, 2, starts[-1]))
    for f in range(len(plan.cuts)):
        width = starts[f + 1] - starts[f]
        key = cell * width + bins[row, f]
        out[:, 0, starts[f] : starts[f + 1]] = np.bincount(key, minlength=len(out) * width).reshape(len(out), width)
        out[:, 1, starts[f] : starts[f + 1]] = np.bincount(key, left, len(out) * width).reshape(len(out), width)
    return out.reshape(len(first), nodes, 2, starts[-1])


def best_splits(plan: Plan, folds: slice, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (fold, node): feature, cut, and the mean residual left and right of it. sums: (fold, node, 2, bin)."""
    starts = plan.starts
    n_all, s_all = sums[:, :, 0, : starts[1]].sum(2), sums[:, :, 1, : starts[1]].sum(2)
    best, feature, cut = np.full(n_all.shape, LEAST_GAIN), np.zeros(n_all.shape, np.int16), np.full(n_all.shape, 65535, np.uint16)
    n_left, s_left = n_all.copy(), s_all.copy()
    for f in range(len(plan.cuts)):
        if not len(plan.cuts[f]):
            continue
        n, s = (sums[:, :, k, starts[f] : starts[f + 1] - 1].cumsum(2) for k in (0, 1))
        m, t = n_all[:, :, None] - n, s_all[:, :, None] - s
        known = plan.since[f][None, :] <= plan.first[folds][:, None]
        gain = np.where((n > 0) & (m > 0) & known[:, None, :], s**2 / np.maximum(n, 1) + t**2 / np.maximum(m, 1) - (s_all**2 / np.maximum(n_all, 1))[:, :, None], -1)
        at = gain.argmax(2)
        here = [np.take_along_axis(x, at[:, :, None], 2)[:, :, 0] for x in (gain, n, s)]
        better = here[0] > best
        best[better], feature[better], cut[better] = here[0][better], f, at[better]
        n_left[better], s_left[better] = here[1][better], here[2][better]
    means = np.stack([s_left / np.maximum(n_left, 1), (s_all - s_left) / np.maximum(n_all - n_left, 1)], 2)
    return feature, cut, means


def _set_level(trees: Trees, folds: slice, tree: int, level: int, depth: int, rate: float, split: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    feature, cut, means = split
    at = slice(2**level - 1, 2 ** (level + 1) - 1)
    trees.feature[folds, tree, at], trees.cut[folds, tree, at] = feature, cut
    if level == depth - 1:
        trees.value[folds, tree] = rate * means.reshape(len(means), -1)


def grow_here(plan: Plan, folds: slice, rank: np.ndarray, y: np.ndarray, bins: np.ndarray, mean: np.ndarray, trees: int, depth: int, rate: float) -> Trees:
    """The trees of some folds over rows at hand. mean: of all folds."""
    out = Trees.blank(mean, trees, depth)
    low, high = folds.start, folds.stop
    blocks = [slice(k, k + BLOCK) for k in range(0, len(rank), BLOCK) if rank[k : k + BLOCK].min() < plan.first[high - 1]]
    fit = {b.start: np.repeat(mean[folds, None], len(rank[b]), 1) for b in blocks}
    for tree in range(trees):
        for level in range(depth):
            total = np.zeros((high - low, 2**level, 2, plan.starts[-1]))
            for b in blocks:
                total += level_sums(plan, folds, rank[b], y[b] - fit[b.start], bins[b], out.nodes(folds, tree, bins[b], level), 2**level)
            _set_level(out, folds, tree, level, depth, rate, best_splits(plan, folds, total))
        for b in blocks:
            fit[b.start] += out.value[folds, tree][np.arange(high - low)[:, None], out.nodes(folds, tree, bins[b], depth)]
    return out


def _rows_of(batch: pa.RecordBatch | pa.Table, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        batch.column("rank").to_numpy().astype(np.int32),
        batch.column("next_return").to_numpy(zero_copy_only=False).astype(float),
        np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1).reshape(batch.num_rows, len(features)),
    )


def _blocks(plan: Plan, features: list[str], mean: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of RECORD: blocks of a partition's rows, once for each chunk of folds that trains on any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rank, y, x = _rows_of(batch.slice(at, BLOCK), features)
                bins = plan.binned(x)
                for chunk in range(-(-len(plan.first) // FOLDS)):
                    low, high = chunk * FOLDS, min(len(plan.first), (chunk + 1) * FOLDS)
                    low = max(low, int(np.searchsorted(plan.first, rank.min(), "right")))
                    if low < high:
                        fit = np.repeat(mean[low:high, None], len(rank), 1)
                        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "first_fold": low, "rank": rank.tobytes(), "y": y.tobytes(), "bins": bins.tobytes(), "fit": fit.tobytes()}], pa.schema([("chunk", pa.int32()), ("first_fold", pa.int32()), *[(c, pa.binary()) for c in ("rank", "y", "bins", "fit")]]))

    return run


def _opened(record: dict) -> tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rank, y = np.frombuffer(record["rank"], np.int32), np.frombuffer(record["y"])
    fit = np.frombuffer(record["fit"]).reshape(-1, len(rank))
    return slice(record["first_fold"], record["first_fold"] + len(fit)), rank, y, np.frombuffer(record["bins"], np.uint16).reshape(len(rank), -1), fit


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _summed(plan: Plan, newer: Trees, level: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(fold, sums) over a task's records, one chunk of folds at a time; newer: trees since the fits were written,
    the one in growth last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            seen = [k for k in range(len(total)) if total[k, :, 0].any()]
            return pa.RecordBatch.from_arrays([pa.array([now * FOLDS + k for k in seen], pa.int32()), pa.array([total[k].tobytes() for k in seen], pa.binary())], names=["fold", "sums"])

        for record in _records(batches):
            if record["chunk"] != now:
                if now is not None:
                    yield out()
                now = record["chunk"]
                total = np.zeros((min(FOLDS, len(plan.first) - now * FOLDS), 2**level, 2, plan.starts[-1]))
            folds, rank, y, bins, fit = _opened(record)
            grown, last = newer.slice(slice(0, -1)), newer.value.shape[1] - 1
            left = y - fit - grown.added(folds, bins, depth)
            total[folds.start - now * FOLDS : folds.stop - now * FOLDS] += level_sums(plan, folds, rank, left, bins, newer.nodes(folds, last, bins, level), 2**level)
        if now is not None:
            yield out()

    return run


def _split(plan: Plan, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the sums of each fold, which follow one another, and yields its splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            feature, cut, means = best_splits(plan, slice(now, now + 1), total[None])
            return pa.RecordBatch.from_pylist([{"fold": now, "feature": feature.tobytes(), "cut": cut.tobytes(), "means": means.tobytes()}], pa.schema([("fold", pa.int32()), *[(c, pa.binary()) for c in ("feature", "cut", "means")]]))

        for batch in batches:
            for fold, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                if fold != now:
                    if now is not None:
                        yield out()
                    now, total = fold, np.zeros((2**level, 2, plan.starts[-1]))
                total += np.frombuffer(sums.as_buffer()).reshape(total.shape)
        if now is not None:
            yield out()

    return run


def _refitted(newer: Trees, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records with the newer trees' values in their fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                folds, _, _, bins, fit = _opened(one.to_pylist()[0])
                yield one.set_column(5, "fit", pa.array([(fit + newer.added(folds, bins, depth)).tobytes()], pa.binary()))

    return run


def grow_on_cluster(ranked: DataFrame, plan: Plan, features: list[str], mean: np.ndarray, trees: int, depth: int, rate: float) -> Trees:
    """One job for each level of each tree; fits are written every STATE_EVERY trees. As many tasks as there are blocks,
    the session's shuffle partitions at most."""
    spark = ranked.sparkSession
    base, written = scratch(spark, "trees"), 0
    fields = ["rank", "next_return", *features]
    # By date, so that a block's rows lie close in time and most blocks concern few chunks of folds.
    rows = ranked.where(F.col("rank") < int(plan.first[-1])).select(*fields)
    most, blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK)
    table = rows.repartitionByRange(max(1, min(most, blocks)), "rank").sortWithinPartitions("rank")
    table = table.mapInArrow(_blocks(plan, features, mean), RECORD)
    deal = max(1, min(most, blocks * -(-len(plan.first) // FOLDS)))

    def store(records: DataFrame) -> DataFrame:
        nonlocal written
        path, written = f"{base}/{written}", written + 1
        records.write.parquet(path)
        kept = spark.read.schema(RECORD).parquet(path)
        return kept.persist()

    state = store(table.repartition(deal).sortWithinPartitions("chunk"))
    out, done = Trees.blank(mean, trees, depth), 0
    for tree in range(trees):
        if tree - done == STATE_EVERY:
            old, state = state, store(state.mapInArrow(_refitted(out.slice(slice(done, tree)), depth), RECORD))
            old.unpersist()
            done = tree
        for level in range(depth):
            sums = state.mapInArrow(_summed(plan, out.slice(slice(done, tree + 1)), level, depth), "fold int, sums binary")
            found = sums.repartition("fold").sortWithinPartitions("fold").mapInArrow(_split(plan, level), "fold int, feature binary, cut binary, means binary")
            for r in found.collect():
                _set_level(out, slice(r["fold"], r["fold"] + 1), tree, level, depth, rate, (np.frombuffer(r["feature"], np.int16)[None], np.frombuffer(r["cut"], np.uint16)[None], np.frombuffer(r["means"]).reshape(1, -1, 2)))
    state.unpersist()
    delete(spark, base)
    return out


def grow_in_tasks(ranked: DataFrame, plan: Plan, features: list[str], mean: np.ndarray, trees: int, depth: int, rate: float) -> Trees:
    """For a panel of at most SMALL_CELLS values: it goes to every task, and each grows the trees of a few folds."""
    spark = ranked.sparkSession
    at_hand = ranked.where(F.col("rank") < int(plan.first[-1])).select("rank", "symbol", "next_return", *features).orderBy("rank", "symbol").toArrow()
    rank, y, x = _rows_of(at_hand.combine_chunks(), features)
    sent = spark.sparkContext.broadcast((rank, y, plan.binned(x)))
    together = min(FOLDS, -(-len(plan.first) // (2 * spark.sparkContext.defaultParallelism)))
    deal = -(-len(plan.first) // together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                folds = slice(part * together, min(len(plan.first), (part + 1) * together))
                rank, y, bins = sent.value
                mine = rank < plan.first[folds.stop - 1]
                made = grow_here(plan, folds, rank[mine], y[mine], bins[mine], mean, trees, depth, rate)
                for k in range(folds.start, folds.stop):
                    yield pa.RecordBatch.from_pylist([{"fold": k, "feature": made.feature[k].tobytes(), "cut": made.cut[k].tobytes(), "value": made.value[k].tobytes()}], pa.schema([("fold", pa.int32()), *[(c, pa.binary()) for c in ("feature", "cut", "value")]]))

    out = Trees.blank(mean, trees, depth)
    for r in spark.range(0, deal, 1, deal).mapInArrow(run, "fold int, feature binary, cut binary, value binary").collect():
        for name, kind in (("feature", np.int16), ("cut", np.uint16), ("value", np.float64)):
            getattr(out, name)[r["fold"]] = np.frombuffer(r[name], kind).reshape(getattr(out, name)[r["fold"]].shape)
    sent.destroy()
    return out


def history_cuts(ranked: DataFrame, features: list[str], first: np.ndarray, bins: int) -> Plan:
    """Quantile cuts of the history before the first fold and of every one twice as long, with when each is known."""
    known: list[dict[float, int]] = [{} for _ in features]
    bound = int(first[0])
    while bound <= int(first[-1]):
        sample = ranked.where(F.col("rank") < bound).orderBy(F.xxhash64("date", "symbol"), "date", "symbol").limit(CUT_ROWS).select(*features).toArrow()
        for f, name in enumerate(features):
            for c in np.unique(np.quantile(sample[name].to_numpy().astype(float), np.linspace(0, 1, bins + 1)[1:-1])) if len(sample) else []:
                known[f].setdefault(float(c), bound)
        bound *= 2
    return Plan(first, [np.array(sorted(k)) for k in known], [np.array([k[c] for c in sorted(k)], np.int64) for k in known])


def forecast_folds(rows: DataFrame, features: list[str], train_min: int, step: int, trees: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 32, small_cells: int | None = None) -> DataFrame:
    """(date, symbol, target, prediction) of every fold's test rows. small_cells=0 grows by levels at any size."""
    empty = rows.sparkSession.createDataFrame([], "date timestamp_ntz, symbol string, target double, prediction double")
    rows = rows.select(F.col("date").cast("timestamp_ntz").alias("date"), F.col("symbol").cast("string").alias("symbol"), F.col("next_return").cast("double").alias("next_return"), *[F.col(f).cast("double").alias(f) for f in features])
    dates = rows.select("date").distinct().withColumn("rank", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    ranked = rows.join(dates, "date").persist()
    try:
        # One row a date: counts and sums, from which a fold's mean is a prefix.
        fold = F.greatest(F.lit(0), F.floor((F.col("rank") - train_min) / step).cast("int") + 1)
        sums = {r["fold"]: r for r in ranked.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("next_return").alias("s"), F.max("rank").alias("last")).collect()}
        last = max((r["last"] for r in sums.values()), default=-1)
        folds = (last + 1 - train_min) // step
        if train_min < 1 or folds < 1:
            return empty
        first = train_min + step * np.arange(folds)
        n = np.cumsum([sums[k]["n"] if k in sums else 0 for k in range(folds)])
        mean = np.cumsum([sums[k]["s"] if k in sums else 0.0 for k in range(folds)]) / np.maximum(n, 1)
        plan = history_cuts(ranked, features, first, bins)
        grow = grow_in_tasks if n[-1] * len(features) <= (SMALL_CELLS if small_cells is None else small_cells) else grow_on_cluster
        made = grow(ranked, plan, features, mean, trees, depth, rate)
    finally:
        ranked.unpersist()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rank, y, x = _rows_of(batch, features)
                bins, of = plan.binned(x), (rank - train_min) // step
                out = np.empty(len(rank))
                for k in np.unique(of):
                    mine = of == k
                    out[mine] = mean[k] + made.added(slice(k, k + 1), bins[mine], depth)[0]
                yield pa.RecordBatch.from_arrays([batch.column("date"), batch.column("symbol"), pa.array(y), pa.array(out)], names=["date", "symbol", "target", "prediction"])

    tested = rows.join(dates, "date").where((F.col("rank") >= train_min) & (F.col("rank") < int(first[-1]) + step))
    return tested.select("date", "symbol", "rank", "next_return", *features).mapInArrow(predict, empty.schema)
