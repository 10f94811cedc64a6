"""Text quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters, digits or other signs between spaces, hashed to VOCABULARY buckets; marks
for an upper-case word and for a word that repeats the one before it are tokens as well. A token's
vector is its sparse ternary index vector plus those of its neighbours over the training sample
(random indexing), scaled to length one. A document is the mean vector of its tokens, the mean vector
of its distinct tokens, the log of its length and its share of distinct tokens. The network has one
hidden tanh layer; its logit is divided by a temperature fitted on a fifth of the sample.

Training reads a bounded sample of labelled rows: at most SAMPLE_ROWS rows and SAMPLE_CHARS
characters of whole texts, chosen in hash order of the id by numbers alone; a text that does not fit is passed
over. Scoring covers every whole text, in numpy on Arrow bytes.

Defined results: null and empty texts score as a document without tokens; rows of labels without a
label or document are ignored; with one class or no labels, every score is the share of label 1
(1.0 without labels). Repeated rows score alike; a row without a doc_id is
scored and counts as not held out; other columns are never read.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import text_hash
from barloom.llm.shared import texts_of

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 30_000_000
#: Longer texts are learned from only where shorter ones leave room.
SAMPLE_TEXT = 300_000
VOCABULARY = 1 << 14
DIMS = 48
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.7
SEED = 20240502

_UPPER, _REPEAT, _DIGITS = VOCABULARY, VOCABULARY + 1, VOCABULARY + 2
_BUCKETS = VOCABULARY + 3
_CLASS = np.full(256, 3, np.uint8)
_CLASS[text_hash.SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_IS_UPPER = np.zeros(256, np.int32)
_IS_UPPER[65:91] = 1


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token and mark, in text order."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= edge[:n]
    bounds = np.append(np.flatnonzero(new), n)
    used = kind[bounds[:-1]] > 0 if n else np.zeros(0, bool)
    starts, ends = bounds[:-1][used], bounds[1:][used]
    rows = np.searchsorted(offsets, starts, "right") - 1
    value = text_hash.span_hashes(data, starts, ends)
    bucket = (value % np.uint64(VOCABULARY)).astype(np.int32)
    of = kind[starts] if len(starts) else np.zeros(0, np.uint8)
    bucket[of == 2] = _DIGITS
    ups = np.concatenate([[0], np.cumsum(_IS_UPPER[data])])
    upper = (of == 1) & (ends - starts > 1) & (2 * (ups[ends] - ups[starts]) > ends - starts)
    repeat = np.zeros(len(starts), bool)
    repeat[1:] = (value[1:] == value[:-1]) & (rows[1:] == rows[:-1])
    at = np.concatenate([np.arange(len(starts)), np.flatnonzero(upper), np.flatnonzero(repeat)])
    by = np.argsort(at, kind="stable")
    all_buckets = np.concatenate([bucket, np.full(int(upper.sum()), _UPPER, np.int32), np.full(int(repeat.sum()), _REPEAT, np.int32)])
    return all_buckets[by], rows[at[by]]


def pooled(bucket: np.ndarray, rows: np.ndarray, n_rows: int, vectors: np.ndarray) -> np.ndarray:
    """The documents' inputs to the network, one row each."""
    key = rows.astype(np.int64) * _BUCKETS + bucket
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key))).astype(np.float32)
    row, bucket = np.divmod(key[first], _BUCKETS)
    tokens, kinds = np.bincount(row, times, n_rows), np.bincount(row, minlength=n_rows)
    out = np.zeros((n_rows, 2 * DIMS + 2), np.float32)
    some = np.flatnonzero(kinds)
    if len(some):
        cuts = np.concatenate([[0], np.cumsum(kinds[some])])[:-1]
        each = vectors[bucket]
        out[some, DIMS : 2 * DIMS] = np.add.reduceat(each, cuts, axis=0) / kinds[some, None]
        each *= times[:, None]
        out[some, :DIMS] = np.add.reduceat(each, cuts, axis=0) / tokens[some, None]
    out[:, -2] = np.log1p(tokens)
    out[:, -1] = kinds / np.maximum(tokens, 1)
    return out


def random_index(streams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Vectors of all buckets from the sample's token streams (bucket, row)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    place = rng.integers(0, DIMS, (_BUCKETS, NONZERO))
    sign = rng.choice([-1.0, 1.0], (_BUCKETS, NONZERO))
    index = np.zeros((_BUCKETS, DIMS))
    for k in range(NONZERO):
        index[np.arange(_BUCKETS), place[:, k]] += sign[:, k]
    vectors = np.zeros(_BUCKETS * DIMS)
    seen = np.zeros(_BUCKETS)
    for bucket, rows in streams:
        seen += np.bincount(bucket, minlength=_BUCKETS)
        for step in range(1, REACH + 1):
            same = np.flatnonzero(rows[step:] == rows[:-step])
            for a, b in ((bucket[same], bucket[same + step]), (bucket[same + step], bucket[same])):
                for k in range(NONZERO):
                    vectors += np.bincount(a.astype(np.int64) * DIMS + place[b, k], sign[b, k], _BUCKETS * DIMS)
    vectors = vectors.reshape(_BUCKETS, DIMS)
    context = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-12)
    return ((context + own) / 2).astype(np.float32)


@dataclass
class QualityModel:
    """Everything that scoring needs; about VOCABULARY * DIMS * 4 bytes, whatever the corpus holds."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _stream(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in text_hash.byte_slices(text):
        yield i, j, *tokens_of(data, offsets)


def train(texts: pa.Array, labels: np.ndarray) -> QualityModel:
    streams, sizes = [], []
    for i, j, bucket, rows in _stream(texts):
        streams.append((bucket, rows))
        sizes.append(j - i)
    vectors = random_index(streams)
    dims = 2 * DIMS + 2
    blank = QualityModel(vectors, np.zeros(dims), np.ones(dims), np.zeros((dims, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if len(labels) < 10 or labels.min() == labels.max():
        blank.constant = float(labels.mean()) if len(labels) else 1.0
        warnings.warn(f"{len(labels)} usable labels, fewer than 10 or all alike: every text scores {blank.constant}", stacklevel=2)
        return blank
    x = np.concatenate([pooled(b, r, n, vectors) for (b, r), n in zip(streams, sizes)]).astype(np.float64)
    y = labels.astype(np.float64)
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    mixed = rng.permutation(len(x))
    held, used = mixed[: len(x) // 5], mixed[len(x) // 5 :]
    centre, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - centre) / scale
    p = [rng.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(used)
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            step += 1
            for q, (w, g) in enumerate(zip(p, (z[rows].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)))):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                w -= 3e-3 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = model.logits(x[held])

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t))

    model.temperature = min(np.geomspace(0.5, 8, 101).tolist(), key=loss)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chosen_rows(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(doc_id, quality, text hash) of the sample's rows, from (doc_id, quality, text hash, characters) in hash
    order: texts of up to SAMPLE_TEXT characters first, then longer ones, shortest first; a text that no longer
    fits in SAMPLE_CHARS is passed over, so that no long text keeps the ones behind it out."""
    usual = [r for r in rows if r[3] <= SAMPLE_TEXT]
    longer = sorted((r for r in rows if r[3] > SAMPLE_TEXT), key=lambda r: r[3])
    left, out = SAMPLE_CHARS, []
    for doc_id, quality, text, chars in usual + longer:
        if chars <= left:
            left -= chars
            out.append((doc_id, quality, text))
    return out


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of the bounded sample; no held-out row. Labels of documents that are not at hand
    are left out before rows are chosen. Rows are chosen by numbers alone, and only the texts of chosen rows travel."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    # SAMPLE_ROWS rows of two numbers, and then of four: the broadcasts and the list have fixed bounds.
    at_hand = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = chosen.distinct().join(at_hand, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS)
    texts = texts_of(docs).withColumn("h", F.xxhash64("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "h", F.char_length("text").alias("chars")).distinct()
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(SAMPLE_ROWS)
    rows = docs.sparkSession.createDataFrame(chosen_rows([tuple(r) for r in sizes.collect()]), "doc_id long, quality int, h long")
    return texts.join(F.broadcast(rows), ["doc_id", "h"]).groupBy("doc_id", "h", "quality").agg(F.first("text").alias("text")).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    sample = training_sample(docs, labels).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).toArrow()
    return train(sample["text"].combine_chunks(), sample["quality"].to_numpy().astype(np.int64))


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, bucket, rows in _stream(batch.column(1)):
                score = model.value.scores(pooled(bucket, rows, j - i, model.value.vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    scored = texts_of(docs).mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.value.scores(pooled(bucket, rows, j - i, model.value.vectors)) >= threshold for i, j, bucket, rows in _stream(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
