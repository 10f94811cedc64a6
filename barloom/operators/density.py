"""Density clusters of unequal density, and a neighbour-keeping layout, of one group's points.

hierarchical_labels: mutual reachability (the largest of two points' core distances and their distance), its minimum
spanning tree, the hierarchy of components as edges are taken away, longest first, condensed to components of at least
min_cluster_size points, and the set of clusters with the greatest stability among those that exclude one another.
Edges of one length go together, so neither the order of the points nor the choice of the tree matters.

neighbour_layout: a fuzzy neighbour graph whose bandwidths give every point the same effective number of neighbours,
symmetrised, laid out by attraction along its edges and repulsion from seeded random points.

Both hold vectors of n, never a matrix of n by n: distances are made a chunk of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 256
NOISE = -1


def _distances(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances of a chunk of rows to all points)."""
    for a in range(0, len(x), CHUNK):
        d = np.zeros((len(x[a : a + CHUNK]), len(x)))
        for j in range(x.shape[1]):
            d += (x[a : a + CHUNK, j, None] - x[None, :, j]) ** 2
        yield a, d


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th nearest other point (the last one where there are fewer)."""
    k = min(k, len(x) - 1)
    return np.concatenate([np.sqrt(np.partition(d, k, 1)[:, k]) for _, d in _distances(x)]) if len(x) else np.zeros(0)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, end, length) of the edges of a minimum spanning tree under mutual reachability."""
    n = len(x)
    near, link, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    ends, lengths, now = [], [], 0
    for _ in range(n - 1):
        open_[now] = False
        d = np.maximum(np.maximum(np.sqrt(((x - x[now]) ** 2).sum(1)), core[now]), core)
        closer = open_ & (d < near)
        near[closer], link[closer] = d[closer], now
        now = int(np.where(open_, near, np.inf).argmin())
        ends.append((link[now], now))
        lengths.append(near[now])
    a = np.array(ends, int).reshape(-1, 2)
    return a[:, 0], a[:, 1], np.array(lengths)


class _Hierarchy:
    """Nodes 0 to n-1 are points; each later node is a component that edges of one length made of its children."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
        self.n, self.size, self.length, self.children = n, [1] * n, [0.0] * n, [[] for _ in range(n)]
        parent = list(range(n))
        top = list(range(n))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and length[order[end]] == length[order[at]]:
                end += 1
            joined: dict[int, list[int]] = {}
            for e in order[at:end]:
                p, q = root(int(a[e])), root(int(b[e]))
                parts = joined.pop(p, [top[p]]) + joined.pop(q, [top[q]])
                parent[q] = p
                joined[p] = parts
            for p, parts in joined.items():
                self.children.append(parts)
                self.size.append(sum(self.size[c] for c in parts))
                self.length.append(float(length[order[at]]))
                top[p] = len(self.children) - 1
            at = end

    def points(self, node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < self.n:
                out.append(k)
            else:
                stack.extend(self.children[k])
        return out


def hierarchical_labels(x: np.ndarray, min_cluster_size: int, min_samples: int | None = None) -> np.ndarray:
    """A label for each point, -1 for noise; labels count up by each cluster's first point. All points as one cluster
    is no clustering: with fewer than two clusters everything is noise."""
    n, least = len(x), max(2, min_cluster_size)
    labels = np.full(n, NOISE)
    if n < 2 * least:
        return labels
    core = core_distances(x, max(1, min_cluster_size if min_samples is None else min_samples))
    tree = _Hierarchy(n, *spanning_tree(x, core))
    density = [1 / max(d, 1e-12) for d in tree.length]
    # A cluster of the condensed tree: birth density, parent, members that left it by themselves, stability.
    birth, parent, left, stability = [0.0], [-1], [[]], [0.0]
    stack = [(len(tree.children) - 1, 0)]
    while stack:
        node, of = stack.pop()
        at = density[node]
        large = [c for c in tree.children[node] if tree.size[c] >= least]
        for c in tree.children[node]:
            if tree.size[c] < least:
                left[of].extend(tree.points(c))
                stability[of] += tree.size[c] * (at - birth[of])
        if len(large) == 1:
            stack.append((large[0], of))
        for c in large if len(large) > 1 else []:
            stability[of] += tree.size[c] * (at - birth[of])
            birth.append(at)
            parent.append(of)
            left.append([])
            stability.append(0.0)
            stack.append((c, len(birth) - 1))
    children: list[list[int]] = [[] for _ in birth]
    for k, p in enumerate(parent[1:], 1):
        children[p].append(k)
    # Later clusters lie below earlier ones, so one walk backwards settles every choice.
    worth, chosen = list(stability), [k > 0 for k in range(len(birth))]
    for k in range(len(birth) - 1, 0, -1):
        below = sum(worth[c] for c in children[k])
        if children[k] and below > stability[k]:
            worth[k], chosen[k] = below, False
    groups, stack = [], [(c, -1) for c in children[0]]
    while stack:
        k, group = stack.pop()
        if group < 0 and chosen[k]:
            groups.append([])
            group = len(groups) - 1
        if group >= 0:
            groups[group].extend(left[k])
        stack.extend((c, group) for c in children[k])
    for label, members in enumerate(sorted(groups, key=min)):
        labels[members] = label
    return labels


# --- Layout


# The curve 1 / (1 + a d^(2 b)) closest to exp(-(d - 0.1)) beyond a distance of 0.1 and to 1 within.
CURVE = (1.577, 0.895)


def nearest_points(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest other points, ties by place."""
    places, far = [], []
    for a, d in _distances(x):
        d[np.arange(len(d)), a + np.arange(len(d))] = -1
        at = np.argsort(d, 1, kind="stable")[:, 1 : k + 1]
        places.append(at)
        far.append(np.sqrt(np.take_along_axis(d, at, 1)))
    return np.concatenate(places), np.concatenate(far)


def memberships(far: np.ndarray) -> np.ndarray:
    """exp(-(d - nearest) / bandwidth) for each neighbour; the bandwidth, by bisection, makes a row sum to log2 of the
    number of neighbours."""
    nearest, target = far[:, :1], np.log2(far.shape[1])
    gap = np.maximum(far - nearest, 0)
    low, high, width = np.zeros(len(far)), np.full(len(far), np.inf), np.ones(len(far))
    for _ in range(64):
        total = np.exp(-gap / width[:, None]).sum(1)
        high = np.where(total > target, width, high)
        low = np.where(total > target, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
        width = np.clip(width, 1e-12, 1e12)
    return np.exp(-gap / np.maximum(width, 1e-3 * far.mean() + 1e-12)[:, None])


def fuzzy_graph(x: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, end, weight), each pair once, ends ascending: w + v - w v of the two directions' memberships."""
    places, far = nearest_points(x, neighbours)
    of = np.repeat(np.arange(len(x)), places.shape[1])
    to, w = places.ravel(), memberships(far).ravel()
    key, back = np.unique(np.minimum(of, to) * len(x) + np.maximum(of, to), return_inverse=True)
    miss = np.ones(len(key))
    np.multiply.at(miss, back, 1 - w)
    return key // len(x), key % len(x), 1 - miss


def neighbour_layout(x: np.ndarray, axes: int = 2, neighbours: int = 15, epochs: int = 300, seed: int = 42, repel: int = 5) -> np.ndarray:
    """Coordinates that keep neighbours, from the smoothest functions on the graph by seeded steps."""
    n = len(x)
    a, b, weight = fuzzy_graph(x, min(neighbours, n - 1))
    rng = np.random.default_rng(seed)
    y = _smooth_start(n, a, b, weight, axes, rng)
    p, q = CURVE
    due = np.maximum(weight / weight.max(), 1e-9)
    done = np.zeros(len(weight))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        # Every edge is used in proportion to its weight: at each whole step of its sum.
        use = np.floor(done + due) > np.floor(done)
        done += due
        i, j = a[use], b[use]
        gap = y[i] - y[j]
        d2 = (gap**2).sum(1)
        pull = np.clip((-2 * p * q * np.where(d2 > 0, d2, 1) ** (q - 1) / (1 + p * d2**q))[:, None] * gap, -4, 4) * rate
        ends = np.concatenate([i, j])
        other = rng.integers(0, n, (repel, len(ends)))
        away = y[ends] - y[other]
        r2 = (away**2).sum(2)
        # A point drawn against itself is no distance away, and no push comes of it.
        push = np.clip((2 * q / ((0.001 + r2) * (1 + p * r2**q)))[:, :, None] * away, -4, 4).sum(0) * rate
        moved = np.concatenate([pull, -pull]) + push
        step = np.stack([np.bincount(ends, moved[:, k], n) for k in range(axes)], 1)
        count = np.bincount(ends, minlength=n)
        # All edges move at once, so a point with many takes their mean, at the pace of a few.
        y = y + step / np.maximum(1, count / 3)[:, None]
    return y


def _smooth_start(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, axes: int, rng: np.random.Generator) -> np.ndarray:
    """The leading non-constant eigenvectors of the normalised graph, by orthogonal iteration, scaled to 10."""
    degree = np.zeros(n)
    np.add.at(degree, a, weight)
    np.add.at(degree, b, weight)
    root = np.sqrt(np.maximum(degree, 1e-12))
    w = weight / (root[a] * root[b])

    def times(v: np.ndarray) -> np.ndarray:
        out = v.copy()  # of the graph plus one, so that the greatest eigenvalues lead
        np.add.at(out, a, w[:, None] * v[b])
        np.add.at(out, b, w[:, None] * v[a])
        return out

    flat = (root / np.linalg.norm(root))[:, None]
    v = rng.normal(size=(n, axes + 2))
    for _ in range(300):
        v = times(v)
        v, _ = np.linalg.qr(v - flat @ (flat.T @ v))
    values, turn = np.linalg.eigh(v.T @ times(v))
    y = (v @ turn[:, np.argsort(-values)])[:, :axes] / root[:, None]
    y = y * np.sign(y[np.abs(y).argmax(0), np.arange(y.shape[1])])
    return 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(scale=1e-4, size=y.shape)
