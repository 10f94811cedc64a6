"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are scaled to length one; each table buckets them by HASHES quantised Gaussian projections
floor((a.x + b) / WIDTH). The number of projections grows with the log of the largest label's rows so
that chance bucket mates stay few, and the number of tables with it so that a pair at the threshold is
missed with probability MISS at most. Inside a bucket all cosines are computed, in double precision.

Equal vectors of a label form one class, counted once with its number. Numbers and buckets alone are dealt out; a
vector, in the width it came in, is fetched only for buckets that hold another one. A bucket of more than BLOCK
classes is dealt out to tasks as pairs of blocks, so that no task holds more than two blocks of it and no
pair is left out. A pair that shares several buckets counts in the first table where it does, decided on whole 64-bit
buckets. Tasks return sums of links and a spanning set of edges, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null
label, link with nothing and are their own components; vectors of different lengths never link; repeated
rows, and different vectors under one vec_id, are vectors of their own; a vector whose vec_id is null counts
for nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.shared import cut_lineage, forget, partitions_for

THRESHOLD = 0.93
WIDTH = 2.0
MISS = 0.02
LEAST_HASHES = 8
#: Expected chance mates in a bucket, and rows of a bucket that are compared in one piece.
MATES = 4
BLOCK = 2048
GROUP_ROWS = 20_000
SEED = 20240504


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two points at that distance is equal."""
    c = width / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_sizes(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections in a table, tables) for that many rows of one label."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(LEAST_HASHES, math.ceil(math.log(max(rows, 1) / MATES) / -math.log(far)) if rows > MATES else 0)
    return hashes, math.ceil(math.log(MISS) / math.log(1 - near**hashes))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector as bytes of its floats or doubles, or null)."""
    for batch in batches:
        vectors = []
        for label, values in zip(batch.column(1).to_pylist(), batch.column(2)):
            vector = None
            if label is not None and values.is_valid and len(values) and not values.values.null_count:
                x = values.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and np.abs(x).max() > 0:
                    vector = x.tobytes()
            vectors.append(vector)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one size as doubles, scaled to length one."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _buckets(hashes: int, tables: int, kind: str):
    """(id, number, vector, signature): the signature holds the bucket of every table."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = part.column(3).to_pylist()
                by_size: dict[int, list[int]] = {}
                for row, x in enumerate(raw):
                    by_size.setdefault(len(x) // width, []).append(row)
                for size, rows in by_size.items():
                    if size not in planes:
                        rng = np.random.Generator(np.random.PCG64([SEED, size]))
                        planes[size] = (rng.normal(size=(size, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes), rng.integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1)
                    a, b, turn = planes[size]
                    x = _unit([raw[r] for r in rows], kind)
                    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(rows), tables, hashes)
                    value = (cell * turn).sum(2)
                    labels = np.array(part.column(1).take(pa.array(rows)).to_pylist(), np.int64)
                    value = (value ^ (value >> 29)) * 0x1B873593CC9E2D51 + (labels * 1_000_003 + size)[:, None] * 0x2545F4914F6CDD1D
                    value ^= value >> 32
                    at = pa.array(rows)
                    signature = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(value.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), part.column(3).take(at), signature], names=["id", "number", "vector", "signature"])

    return run


def _compare(threshold: float, kind: str):
    """One group of buckets (or block pairs of them) to (id, links, other): sums of links, and edges."""

    def run(group: pa.Table) -> pa.Table:
        column = {c: group.column(c) for c in group.column_names}
        number, ids = column["number"].to_numpy(), column["id"].to_numpy()
        keys = np.stack([column[c].to_numpy() for c in ("table", "bucket", "low", "high")], axis=1)
        own = column["own"].to_numpy()
        by = np.lexsort(keys.T[::-1])
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[by[1:]] != keys[by[:-1]]).any(axis=1)])), len(by))
        out_id, out_links, edge_a, edge_b = [], [], [], []
        vector = column["vector"].to_pylist()
        signature = column["signature"].combine_chunks()
        signature = signature.flatten().to_numpy().reshape(len(ids), -1)
        for c0, c1 in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = by[c0:c1]
            table, _, low, high = keys[rows[0]].tolist()
            sides = [rows[own[rows] == low], rows[own[rows] == high]] if low != high else [rows, rows]
            if not all(map(len, sides)) or len(rows) < 2:
                continue
            x, y = (_unit([vector[r] for r in side], kind) for side in sides)
            sx, sy = (signature[side][:, :table] for side in sides)
            links = [np.zeros(len(side), np.int64) for side in sides]
            first = np.full(len(y), -1)  # of each right row, the first left row that it links to
            for k in range(0, len(x), 256):
                a, b = np.nonzero(x[k : k + 256] @ y.T >= threshold)
                a += k
                if low == high:
                    a, b = a[a < b], b[a < b]
                if table and len(a):
                    new = np.ones(len(a), bool)
                    for s in range(0, len(a), 1 << 18):
                        part = slice(s, s + (1 << 18))
                        new[part] = ~(sx[a[part]] == sy[b[part]]).any(axis=1)
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                links[0] += np.bincount(a, number[sides[1][b]], len(x)).astype(np.int64)
                links[1] += np.bincount(b, number[sides[0][a]], len(y)).astype(np.int64)
                # Edges that join the same rows as all of these do: each right row to its first left row,
                # and the left rows that meet in a right row to its first one.
                order = np.lexsort((a, b))
                a, b = a[order], b[order]
                head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                fresh = head[first[b[head]] < 0]
                first[b[fresh]] = a[fresh]
                tie = np.stack([a, first[b]], axis=1)
                tie = np.unique(tie[tie[:, 0] != tie[:, 1]], axis=0)
                if len(tie):
                    tie = _spanning(tie)
                    edge_a.append(ids[sides[0][tie[:, 0]]])
                    edge_b.append(ids[sides[0][tie[:, 1]]])
                edge_a.append(ids[sides[1][b[fresh]]])
                edge_b.append(ids[sides[0][a[fresh]]])
            for side, n in zip(sides, links):
                some = np.flatnonzero(n)
                out_id.append(ids[side[some]])
                out_links.append(n[some])
        a, n, ea, eb = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_id, out_links, edge_a, edge_b))
        return pa.table({"id": np.concatenate([a, ea]), "links": pa.array(np.concatenate([n, np.zeros(len(ea), np.int64)])), "other": pa.array([None] * len(a) + eb.tolist(), pa.int64())})

    return run


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """A forest with the same components as the pairs (rows of two numbers)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """embeddings: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept for each row."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"))
    rows = cut_lineage(rows.mapInArrow(_clean, "vec_id long, label long, vector binary"))
    valid = rows.where("vector is not null")
    # Written down, so that a class keeps its number.
    classes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("vec_id").alias("number")).where("first is not null")
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashes, tables = table_sizes(most, threshold)
    signed = cut_lineage(classes.select("id", "label", "number", "vector").mapInArrow(_buckets(hashes, tables, kind), "id long, number long, vector binary, signature array<long>"))
    dealt = signed.select("id", F.posexplode("signature").alias("table", "bucket"))
    sizes = dealt.groupBy("table", "bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    pieces = F.ceil(F.col("mates") / BLOCK)
    shared = dealt.join(sizes, ["table", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), pieces)).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    shared = shared.join(signed, "id")
    blocks = shared.select("id", "number", "vector", "signature", F.col("table").cast("long").alias("table"), "bucket", "own", F.least("own", "mate").alias("low"), F.greatest("own", "mate").alias("high"))
    # Every row of a bucket goes to each of the bucket's pieces.
    rows_out = sizes.agg(F.sum(F.col("mates") * pieces)).first()[0] or 0
    groups = max(partitions_for(embeddings), rows_out // GROUP_ROWS)
    compared = blocks.groupBy(F.pmod(F.xxhash64("table", "bucket", "low", "high"), F.lit(groups)).alias("deal")).applyInArrow(_compare(threshold, kind), "id long, links long, other long")
    compared = cut_lineage(compared)
    links = compared.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(compared.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = components.join(classes.select("id", "first"), "id")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("smallest")), "component").select("id", "smallest")
    known = classes.join(links, "id", "left").join(named, "id", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("number") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component"))
    component = F.coalesce("component", "vec_id")
    known = rows.where("vec_id is not null").join(known, ["label", "vector"], "left").unionByName(rows.where("vec_id is null").withColumns({"n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")}))
    out = known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out = cut_lineage(out)
    forget(rows, classes, signed, compared, components)
    return out
