"""Vector dedup against brute force."""

import numpy as np
import pytest

from barloom.llm import embedding_dedup


def brute(rows):
    good = [(i, l, np.array(v, float)) for i, v, l in rows if v is not None and l is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.linalg.norm(np.array(v, float)) > 0]
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, l, x) in enumerate(good):
        for j, m, y in good[k + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return links, {i: root(i) for i in links}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for group in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            out.append([len(out), (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist(), int(group % 3)])
    out += [[len(out), None, 0], [len(out) + 1, [0.0] * 16, 0], [len(out) + 2, [1.0, None] + [0.0] * 14, 0], [len(out) + 3, [float("nan")] + [1.0] * 15, 0], [len(out) + 4, out[0][1], None], [len(out) + 5, [1.0, 2.0], 0], [len(out) + 6, [1.0, 2.0], 0], [len(out) + 7, [2.0, 4.0], 0], [len(out) + 8, [], 0]]
    return out


@pytest.mark.parametrize("block", [2048, 5])
def test_links_and_components(spark, rows, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vector string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    links, component = brute(rows)
    assert len(got) == len(rows) and sum(n for n, *_ in got.values()) >= 0.9 * sum(links.values())
    assert all(got[i][0] <= links[i] and got[i][2] == (got[i][1] == i) for i in got)
    assert sum(got[i][1] != component[i] for i in got) <= 0.1 * len(got)


def test_groups_of_many_labels(spark, monkeypatch):
    """Groups stay near GROUP_ROWS when many labels of like size share them."""
    compare = embedding_dedup._compare

    def watched(*options):
        run = compare(*options)

        def small(group):
            assert group.num_rows <= 200, group.num_rows
            return run(group)

        return small

    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 50)
    monkeypatch.setattr(embedding_dedup, "_compare", watched)
    rng = np.random.default_rng(3)
    made = []
    for label in range(400):
        base = rng.normal(size=16)
        made += [(label * 6 + k, (base + rng.normal(size=16) * 1e-6).tolist(), label) for k in range(6)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label long")).collect()
    assert all(r.component_id == r.vec_id // 6 * 6 and r.n_links == 5 for r in got) and len(got) == len(made)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_scaled_copies_and_signs_of_zero(spark, kind):
    base = [1.0, 0.0, -2.5, 0.0, 3.25, 1e-3]
    made = [(1, base), (2, [2 * x for x in base]), (3, [-0.0 if x == 0 else x for x in base]), (4, [1e30 * x for x in base]), (5, [-x for x in base]), (6, [1e-30 * x for x in base]), (7, base)]
    df = spark.createDataFrame([(i, v, 3) for i, v in made], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {i: (0, 5) if i == 5 else (5, 1) for i in range(1, 8)}


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1)], schema)).count() == 2


def test_repeated_ids(spark):
    """Two vectors under one vec_id have links of their own; a row that is repeated links with its copy."""
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(4, [1.0, 0.0, 0.0], 1), (4, [0.0, 1.0, 0.0], 1), (2, [0.0, 1.0, 0.01], 1), (9, [1.0, 0.0, 0.0], 1), (7, [0.0, 0.0, 1.0], 1), (7, [0.0, 0.0, 1.0], 1), (None, [0.0, 0.0, 1.0], 1)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (2, 1, 2, True), (4, 1, 2, False), (4, 1, 4, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 4, False)]


def test_hash_probabilities():
    rng = np.random.default_rng(2)
    for d in (0.374, 1.414):
        a = rng.normal(size=200_000) * d
        b = rng.uniform(0, embedding_dedup.WIDTH, 200_000)
        same = (np.floor(b / embedding_dedup.WIDTH) == np.floor((a + b) / embedding_dedup.WIDTH)).mean()
        assert same == pytest.approx(embedding_dedup.collision(d), abs=0.01)
    near = embedding_dedup.collision(np.sqrt(2 - 2 * 0.93))
    for n in (10, 10**4, 10**8):
        hashes, tables = embedding_dedup.table_sizes(n)
        assert (1 - near**hashes) ** tables <= embedding_dedup.MISS
