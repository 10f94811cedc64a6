"""Folds grown together against one fold at a time, and regimes against plain quadratic versions."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import boosting, density, forecast, regimes

FEATURES = ["a", "b", "c"]


def panel(spark, dates=60, symbols=5, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(dates * symbols, 3)) * [1, 5, 0.1]
    x[:, 1] = np.round(x[:, 1])  # ties
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.2 * x[:, 1] + 0.3 * rng.normal(size=len(x))
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=k // symbols), f"s{k % symbols}", *map(float, x[k]), float(y[k])) for k in range(len(x))]
    return spark.createDataFrame(data, "date timestamp_ntz, symbol string, a double, b double, c double, next_return double"), x, y


@pytest.mark.parametrize("chunk, block", [(64, 4096), (2, 7)])
def test_folds_equal_one_at_a_time(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(boosting, "FOLDS", chunk)
    monkeypatch.setattr(boosting, "BLOCK", block)
    monkeypatch.setattr(boosting, "STATE_EVERY", 2)
    data, x, y = panel(spark)
    seen = []
    plain = boosting.history_cuts
    monkeypatch.setattr(boosting, "history_cuts", lambda *a: seen.append(plain(*a)) or seen[-1])
    made = [forecast.walk_forward(data, FEATURES, 20, 8, trees=5, small_cells=cells).toPandas().sort_values(["date", "symbol"]).reset_index(drop=True) for cells in (None, 0)]
    plan = seen[0]
    assert plan.first.tolist() == [20, 28, 36, 44, 52] and {int(s) for f in plan.since for s in f} == {20, 40}
    rank = np.arange(len(x)) // 5
    for k, first in enumerate(plan.first):
        train, test = rank < first, (rank >= first) & (rank < first + 8)
        cuts = [c[s <= first] for c, s in zip(plan.cuts, plan.since)]
        want = forecast.boosted(x[train], y[train], x[test], trees=5, cuts=cuts)
        for got in made:
            at = slice(k * 40, k * 40 + 40)
            assert got.prediction[at].to_numpy() == pytest.approx(want, abs=1e-9)
            assert got.target[at].to_numpy() == pytest.approx(y[test])
    assert len(made[0]) == 200 and np.corrcoef(made[0].prediction, made[0].target)[0, 1] > 0.8


def test_a_cut_is_never_used_before_it_is_known(spark):
    """Later rows change no earlier fold's forecasts."""
    data, _, _ = panel(spark)
    early = data.where("date < '2024-02-01'")  # 31 dates: one fold of 8 after 20
    moved = early.unionByName(data.where("date >= '2024-02-01'").selectExpr("date", "symbol", "a * 7 + 3 as a", "b", "c", "-next_return as next_return"))
    one, both = (forecast.walk_forward(d, FEATURES, 20, 8, trees=3).where("date < '2024-01-29'").toPandas().sort_values(["date", "symbol"]) for d in (early, moved))
    assert len(one) == 40 and one.prediction.to_numpy() == pytest.approx(both.prediction.to_numpy(), abs=1e-12)


def test_no_task_holds_a_history(spark, monkeypatch):
    """A record has at most BLOCK rows and FOLDS folds, however many of both there are, and no row twice for a fold."""
    monkeypatch.setattr(boosting, "FOLDS", 4)
    monkeypatch.setattr(boosting, "BLOCK", 16)
    data, _, _ = panel(spark, dates=80)
    from pyspark.sql import functions as F

    ranked = data.withColumn("rank", F.datediff("date", F.lit("2024-01-01")).cast("int"))
    first = 10 + 5 * np.arange(14)
    plan = boosting.history_cuts(ranked, FEATURES, first, 8)
    mean = np.zeros(len(first))
    table = ranked.where(F.col("rank") < 75).select("rank", "next_return", *FEATURES).repartitionByRange(6, "rank").sortWithinPartitions("rank").mapInArrow(boosting._blocks(plan, FEATURES, mean), boosting.RECORD)
    trained = np.zeros(len(first), int)
    for r in table.collect():
        folds, rank, _, bins, fit = boosting._opened(r.asDict())
        assert len(rank) <= 16 and len(fit) <= 4 and bins.shape == (len(rank), 3)
        for k in range(folds.start, folds.stop):
            trained[k] += (rank < first[k]).sum()
    assert trained.tolist() == [5 * f for f in first]


def test_jobs_do_not_grow_with_folds(spark):
    """trees x depth levels, each one job, whatever the number of folds."""
    data, _, _ = panel(spark, dates=40)

    def jobs(step):
        tracker, group = spark.sparkContext.statusTracker(), f"folds-{step}"
        spark.sparkContext.setJobGroup(group, group)
        forecast.walk_forward(data, FEATURES, 10, step, trees=2, small_cells=0)
        return len(tracker.getJobIdsForGroup(group))

    few, many = jobs(15), jobs(2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 4


def test_too_few_dates_and_empty_panels(spark):
    data, _, _ = panel(spark, dates=12)
    for d, least in ((data, 12), (data, 50), (data.limit(0), 5)):
        assert forecast.walk_forward(d, FEATURES, least, 4).collect() == []


# --- Density clusters


def plain_hierarchy(x, least, k):
    """From the whole matrix of mutual reachability, a threshold at a time."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(k, n - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(points, below):
        left, out = set(points), []
        while left:
            front = [left.pop()]
            group = list(front)
            while front:
                p = front.pop()
                near = [q for q in left if m[p, q] < below]
                left -= set(near)
                front += near
                group += near
            out.append(group)
        return out

    clusters = []  # (birth, points at birth, [(density, point)], children)

    def walk(points, birth):
        me = {"birth": birth, "left": [], "children": [], "sum": 0.0}
        clusters.append(me)
        now = points
        while True:
            values = sorted({m[p, q] for p in now for q in now if p != q}, reverse=True)
            cut = next((v for v in values if len(parts(now, v)) > 1), None)
            if cut is None:  # a lone point cannot come here: parts have at least `least` points
                break
            at, groups = 1 / max(cut, 1e-12), parts(now, cut)
            large = [g for g in groups if len(g) >= least]
            for g in groups:
                if len(g) < least:
                    me["left"] += g
                    me["sum"] += len(g) * (at - birth)
            if len(large) == 1:
                now = large[0]
                continue
            for g in large:
                me["sum"] += len(g) * (at - birth)
                me["children"].append(walk(g, at))
            break
        return me

    labels = np.full(n, -1)
    if n < 2 * least:
        return labels
    top = walk(list(range(n)), 0.0)

    def best(c):
        below = [best(x) for x in c["children"]]
        total = sum(v for v, _ in below)
        if c is not top and not (below and total > c["sum"]):
            return c["sum"], [c]
        return total, [x for _, xs in below for x in xs]

    def members(c):
        return c["left"] + [p for x in c["children"] for p in members(x)]

    for label, group in enumerate(sorted((members(c) for c in best(top)[1]), key=min)):
        labels[group] = label
    return labels


def test_hierarchy_equals_plain_one():
    rng = np.random.default_rng(8)
    several = 0
    for t in range(60):
        n, dims = int(rng.integers(1, 36)), int(rng.integers(1, 4))
        x = rng.normal(size=(n, dims)) + rng.choice([0, 4, 9], (n, 1)) * rng.choice([0.3, 1])
        if t % 3 == 0:
            x = np.round(x * 2) / 2  # ties and repeated points
        least = int(rng.integers(2, 6))
        got = density.hierarchical_labels(x, least)
        assert got.tolist() == plain_hierarchy(x, least, least).tolist(), (t, n, least)
        several += got.max() > 0
        back = rng.permutation(n)
        again = density.hierarchical_labels(x[back], least)
        assert len({(a, b) for a, b in zip(got[back], again)}) == len(set(got))
    assert several > 10


def test_clusters_of_unequal_density():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.05, rng.normal(size=(60, 2)) * 0.05 + [0.6, 0], rng.normal(size=(60, 2)) * 1.5 + [10, 0]])
    got = density.hierarchical_labels(x, 10)
    assert [set(got[k : k + 60]) for k in (0, 60)] == [{0}, {1}] and (got[120:] == 2).mean() > 0.9
    # One radius that keeps the thin cluster whole joins the dense ones.
    fixed = regimes.density_labels(x, 0.8, 5)
    assert set(fixed[:120]) == {0}
    assert (density.hierarchical_labels(np.zeros((0, 2)), 3) == []).all() and density.hierarchical_labels(np.zeros((50, 2)), 3).tolist() == [-1] * 50


def rolled_sheet(n=300):
    rng = np.random.default_rng(1)
    t, h = rng.uniform(1.5 * np.pi, 4.5 * np.pi, n), rng.uniform(0, 20, n)
    return np.stack([t * np.cos(t), h, t * np.sin(t)], 1), np.stack([t * t / 2, h], 1)


def kept(x, y, k=10):
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(density.nearest_points(x, k)[0], density.nearest_points(y, k)[0])])


def test_layout_keeps_neighbours_of_a_rolled_sheet():
    x, flat = rolled_sheet()
    y = density.neighbour_layout(x)
    axes = regimes.principal_axes(x, 2)
    assert kept(x, y) > 0.65 > 0.55 > kept(x, axes) and kept(flat, y) > 1.4 * kept(flat, axes)
    assert (density.neighbour_layout(x) == y).all()


def test_memberships_sum_to_their_target():
    x, _ = rolled_sheet(80)
    w = density.memberships(density.nearest_points(x, 15)[1])
    assert w.sum(1) == pytest.approx(np.full(80, np.log2(15)), rel=1e-6) and (w[:, 0] == 1).all()
    a, b, weight = density.fuzzy_graph(x, 15)
    assert (a < b).all() and len(set(zip(a, b))) == len(a) and (weight > 0).all() and (weight <= 1).all()


def test_regimes_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(12)
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(days=k), f"s{s:02d}", float(rng.normal(s % 3, 0.1 + s % 3)), float(s % 3 + rng.normal() * 0.1), float(rng.normal())) for k in range(30) for s in range(30)]
    df = spark.createDataFrame(data, "date timestamp_ntz, symbol string, log_return double, realized_vol double, dollar_volume double")
    one, other = (sorted(map(tuple, regimes.discover_regimes(d, 10, 20, min_cluster_size=4).collect())) for d in (df.coalesce(1), df.repartition(7, "symbol")))
    assert one == other and len({r for _, _, r in one}) >= 2
