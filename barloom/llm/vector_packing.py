"""Packing of token sequences by vector best-fit, planned on length classes.

Every bin (sequence) has three capacities: tokens, documents and attention cost (the sum of squared
lengths). Items are placed longest first; each goes to the bin that leaves the smallest weighted
residual norm (or has the largest weighted dot product with the item), among the bins that hold it
under every capacity; of equally good ones, to one with the least in it. Items of one length are alike, so
the plan is made for lengths and their counts: its input has at most max_tokens rows and it moves runs of
equal bins at once. It gives what placing the items one by one would give, whatever their number.

Spark jobs: texts are tokenised once, cut into pieces and numbered within (partition, length); a
window over the partitions' counts turns those numbers into ranks within each length; each piece looks
its sequence and offset up in the plan. No task gathers the pieces of a length.

Defined results: a null text is empty and becomes one piece with the end token alone; only documents
longer than a bin's tokens (or than the root of its attention capacity, where that is less) are cut, the
first piece being the shorter one; repeated rows are packed as
often as they occur; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage, texts_of
from barloom.llm.token_ids import default_files, encoder

END_ID = 2
PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin, the weights of the three dimensions, and how bins are chosen."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def longest(self) -> int:
        """Tokens of the longest piece that a bin holds under every capacity."""
        return min(self.tokens, math.isqrt(self.attention))


#: Capacities of which each binds on ordinary documents.
BINDING = Limits(1024, 4, 500_000, (1.0, 1.0, 1.0), "dot")


@dataclass
class Plan:
    """Runs of placements, ascending by length and rank (the key): pieces of a length with ranks from first_rank go, each_bin to a bin, to
    the bins from first_bin, the first of each at offset."""

    key: list[int] = field(default_factory=list)
    first_bin: list[int] = field(default_factory=list)
    each_bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0


_RANKS = 1 << 44


def plan_bins(counts: dict[int, int], limits: Limits = Limits()) -> Plan:
    """counts: items of each length, 1 to limits.longest().

    By the norm, the bin that took an item is the best one for the next of that length, as its residual is
    smaller still, so a bin is filled before the next is touched. By the dot product it is a worse one than
    before, so every bin of a run takes one item first. A new bin is opened where no other holds the item;
    it takes all that it can."""
    capacity = np.array([limits.tokens, limits.documents, limits.attention], float)
    weight = np.array(limits.weights)
    plan = Plan()
    states: dict[tuple[int, int, int], list[list[int]]] = defaultdict(list)  # used capacities -> runs [first bin, bins]
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > capacity).any():
            raise ValueError(f"an item of {length} tokens exceeds a bin's capacities")
        left, rank = counts[length], 0
        while left:
            used = np.array(list(states), float).reshape(-1, 3)
            rest = capacity - used
            fits = np.flatnonzero((rest >= item).all(axis=1))
            if len(fits):
                if limits.rule == "norm":
                    score = -(weight * ((rest[fits] - item) / capacity) ** 2).sum(axis=1)
                else:
                    score = (weight * (rest[fits] / capacity) * (item / capacity)).sum(axis=1)
                state = min(tuple(int(x) for x in used[fits[k]]) for k in np.flatnonzero(score == score.max()))
                runs = states[state]
            else:
                state, runs = (0, 0, 0), []
            each = 1 if runs and limits.rule == "dot" else int(((capacity - state) // item).min())
            if runs:
                first, bins = runs.pop()
            else:
                first, bins = plan.bins, -(-left // each)
                plan.bins += bins
            if not states.get(state):
                states.pop(state, None)
            full = min(bins, left // each)
            rest_of_one = left - full * each if full < bins else 0
            plan.key.append(length * _RANKS + rank)
            plan.first_bin.append(first)
            plan.each_bin.append(each)
            plan.offset.append(state[0])

            def keep(at: int, many: int, items: int) -> None:
                now = (state[0] + items * length, state[1] + items, state[2] + items * length * length)
                if many and now[0] < limits.tokens and now[1] < limits.documents and now[2] < limits.attention:
                    states[now].append([at, many])

            keep(first, full, each)
            if rest_of_one:
                keep(first + full, 1, rest_of_one)
            spare = bins - full - bool(rest_of_one)
            if spare:
                states[state].append([first + full + bool(rest_of_one), spare])
            placed = full * each + rest_of_one
            left, rank = left - placed, rank + placed
    by = np.argsort(np.array(plan.key, np.int64)).tolist()
    for name in ("key", "first_bin", "each_bin", "offset"):
        setattr(plan, name, [getattr(plan, name)[k] for k in by])
    return plan


def _tokenised(files: tuple[str, str], end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, so_far = encoder(files).encode, TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % most or most
                for piece, start in enumerate([0, *range(first, len(ids), most)]):
                    length = first if piece == 0 else most
                    rows.append((part, so_far[length], doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    so_far[length] += 1
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, limits: Limits = Limits(), end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    # Written down first: ranks must not change if a task runs again.
    pieces = cut_lineage(texts_of(docs).mapInArrow(_tokenised(files or default_files(), end_id, limits.longest()), PIECES))
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("length", "part", before.alias("base"))
    # At most limits.longest() rows.
    counts = {row["length"]: row["n"] for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, limits)
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (plan.key, plan.first_bin, plan.each_bin, plan.offset)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_bin, each_bin, offset = table.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * _RANKS + rank, "right") - 1
            bins, slot = np.divmod(rank - key[at] % _RANKS, each_bin[at])
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(first_bin[at] + bins), pa.array(offset[at] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
