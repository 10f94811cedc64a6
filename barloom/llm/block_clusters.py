"""Centroid clustering of integer vectors, exact, with block-norm screening.

A vector's components x become floor(64 x). Vectors are kept as compressed bytes (one, two or four a component, the
fewest that hold it) beside the Euclidean norms of their segments of eight components. By Cauchy-Schwarz the squared
distance to a centroid is at least the sum over segments of the squared difference of norms; a vector's centroids are
tried in the order of that bound, and exact integer distances are computed only while the bound does not exceed the
least distance found. The bound is taken a little lower than its rounding errors, so no nearest centroid, tie
included, is ever pruned.

Each round is one pass: every task adds up its vectors by centroid, and Spark adds the tasks' sums, at most CENTROIDS
rows, which alone reach the driver. Sums and distances are 64-bit integers, so results do not depend on the
partitioning.

Defined results: vectors that are null, have not exactly DIMS components, or hold a null, NaN or infinite one are left
out; so are vectors with a component beyond 2^27 after scaling, whose distances a long could not hold. A null vec_id is
assigned like any other and comes last among first centroids; rows that share a vec_id are rows of their own, the one
with the smaller vector first. With fewer kept vectors than centroids there are as many centroids as
vectors. An empty table gives no rows; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEGMENT = 8
LARGEST = 1 << 27


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id, v): rows that take part, with integer components."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * SCALE))
    raw = F.col(vector_col).cast("array<double>")
    good = (F.size(raw) == dims) & F.forall(raw, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < LARGEST), F.lit(False)))
    return vectors.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), x).alias("v")).where("v is not null")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        norms = np.sqrt(np.add.reduceat((v * v).astype(np.float64), np.arange(0, v.shape[1], SEGMENT), 1))
        least, most = v.min(1), v.max(1)
        width = np.where((least >= -128) & (most < 128), 1, np.where((least >= -32768) & (most < 32768), 2, 4))
        codes = [row.astype(f"<i{w}").tobytes() for row, w in zip(v, width)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array([n.tobytes() for n in norms.astype("<f8")], pa.binary())], names=["vec_id", "code", "norms"])


def compressed(kept: DataFrame) -> DataFrame:
    """(vec_id, code, norms): vectors as the fewest bytes, and their segments' norms."""
    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(_compress, f"vec_id {kind}, code binary, norms binary")


def _opened(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, segment norms) of a batch."""
    codes = batch.column(1).to_pylist()
    v = np.empty((len(codes), dims), np.int64)
    size = np.array([len(c) for c in codes]) // dims
    for w in (1, 2, 4):
        at = np.nonzero(size == w)[0]
        if len(at):
            v[at] = np.frombuffer(b"".join([codes[k] for k in at]), f"<i{w}").reshape(len(at), dims)
    return v, np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(len(codes), -1)


def lower_bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """Bounds (vectors x centroids) below the squared distances, from segment norms alone."""
    out = np.zeros((len(norms), len(centroid_norms)))
    for s in range(norms.shape[1]):
        a, b = norms[:, s, None], centroid_norms[None, :, s]
        out += np.maximum(np.abs(a - b) - (a + b) * 1e-12, 0.0) ** 2
    return out * (1 - 1e-12)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, the smaller number of equals, and how many exact distances
    were computed."""
    low = lower_bounds(norms, np.sqrt(np.add.reduceat((centroids * centroids).astype(np.float64), np.arange(0, centroids.shape[1], SEGMENT), 1)))
    order = np.argsort(low, 1, kind="stable")
    best, found, exact = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64), 0
    rows = np.arange(len(v))
    for k in range(len(centroids)):
        which = order[rows, k]
        # Bounds rise along a row's order: what is pruned now stays pruned.
        open_ = low[rows, which] <= best[rows]
        rows, which = rows[open_], which[open_]
        if not len(rows):
            break
        gap = v[rows] - centroids[which]
        d = np.einsum("ij,ij->i", gap, gap)
        exact += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (which < found[rows]))
        best[rows[better]], found[rows[better]] = d[better], which[better]
    return found, best, exact


def _partial_sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                v, norms = _opened(batch, dims)
                at, d, _ = nearest(v, norms, centroids)
                n += np.bincount(at, minlength=k)
                np.add.at(inertia, at, d)
                np.add.at(total, at, v)
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(inertia[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "inertia", "total"])

    return run


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid: how many vectors, their distances' sum, and their components' sums; one row a centroid comes back."""
    made = table.mapInArrow(_partial_sums(centroids), "cluster int, n long, inertia long, total array<long>")
    parts = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(centroids.shape[1])]
    rows = made.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *parts).collect()
    return {r["cluster"]: (r["n"], r["inertia"], [r[f"t{j}"] for j in range(centroids.shape[1])]) for r in rows}


def first_centroids(kept: DataFrame, centroids: int = CENTROIDS) -> np.ndarray:
    """The kept vectors with the smallest hashes of "1:<vec_id>", in ascending hash order."""
    named = kept.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    return np.array([r["v"] for r in named.orderBy(F.col("h").asc_nulls_last(), "v").limit(centroids).collect()], np.int64)


@dataclass
class Clustering:
    """assigned: (vec_id, cluster, distance); the rest has one entry a centroid."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> Clustering:
    kept = kept_vectors(vectors, id_col, vector_col, dims)
    start = first_centroids(kept, centroids)
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not len(start):
        return Clustering(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), start, [])
    table, c = cut_lineage(compressed(kept)), start
    for _ in range(rounds):
        c = c.copy()
        for k, (n, _, total) in _sums(table, c).items():
            c[k] = [t // n for t in total]
    last = _sums(table, c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d, _ = nearest(*_opened(batch, dims), c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return Clustering(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), c, [last[k][1] if k in last else 0 for k in range(len(c))])


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, the inertia of its cluster and of all, and the SHA-256
    of its centroid's components."""
    found = cluster(vectors, **options)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()] or [""]
    inertia = found.inertia or [0]
    return found.assigned.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        _by_cluster(names, "string").alias("centroid_sha256"),
    )
