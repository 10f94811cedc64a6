"""Packed token-id matrices by best-fit-decreasing with a segment tree over capacities.

Each task tokenises its documents, cuts longer ones losslessly into pieces of at most max_tokens ids,
and packs blocks of about BLOCK_IDS ids: pieces are placed longest first, each into the open row with
the least free space that holds it, which a segment tree over free spaces finds in log(max_tokens)
steps. A packed row holds its ids (little-endian, two bytes each where the vocabulary fits in them,
else four), the cumulative lengths of its segments from 0 on, and positions that start again at 0 with
each segment. Ids never leave the task that made them, so nothing is shuffled.

Defined results: a null text is empty and becomes a segment with the end token alone; repeated rows are
packed as often as they occur; an empty table packs to nothing; other columns are ignored. Row ids are
(partition, number) and the same whenever a task runs again on the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import texts_of
from barloom.llm.token_ids import default_files, encoder

MAX_TOKENS = 2048
END_ID = 50256
#: Ids that a task packs at once.
BLOCK_IDS = 1 << 23
ROWS = "row_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_FIELDS = pa.schema(
    [("row_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)


class CapacityTree:
    """Open rows by their free space. Leaf c is set while a row with c free ids exists; an inner node is
    set while a leaf below it is."""

    def __init__(self, most: int) -> None:
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.set = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = self.size + free
        while node and not self.set[node]:
            self.set[node] = 1
            node //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest free space of `least` or more, and that space."""
        node = self.size + least
        if not self.set[node]:
            while node > 1 and (node % 2 or not self.set[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.set[2 * node] else 2 * node + 1
        free = node - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.set[node] = 0
            node //= 2
            while node:
                self.set[node] = self.set[2 * node] | self.set[2 * node + 1]
                node //= 2
        return row, free


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """The items of each row, by index. Items are placed longest first, equal ones in their order."""
    tree, rows = CapacityTree(most), []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[item])
        if found is None:
            found = (len(rows), most)
            rows.append([])
        row, free = found
        rows[row].append(item)
        if free > lengths[item]:
            tree.add(free - lengths[item], row)
    return rows


def pack_rows(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, files: tuple[str, str] | None = None, wide: bool = False) -> DataFrame:
    """One row for each packed row: ROWS. wide: ids in four bytes instead of two."""
    files, kind = files or default_files(), "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(files).encode, TaskContext.get().partitionId() << 33
        held: list[tuple[int, int, np.ndarray]] = []
        n_held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, n_held
            rows = best_fit([len(x[2]) for x in held], max_tokens)
            for k in range(0, len(rows), 256):
                out = []
                for items in rows[k : k + 256]:
                    segments = [held[item] for item in items]
                    ends = np.cumsum([len(x[2]) for x in segments])
                    ids = np.concatenate([x[2] for x in segments])
                    places = np.concatenate([np.arange(len(x[2]), dtype=kind) for x in segments])
                    out.append((number, len(ids), [x[0] for x in segments], [x[1] for x in segments], [0, *ends.tolist()], ids.tobytes(), places.tobytes()))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)
            held.clear()
            n_held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                if not wide and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes: pass wide=True")
                ids = ids.astype(kind)
                for start in range(0, len(ids), max_tokens):
                    held.append((doc_id, start, ids[start : start + max_tokens]))
                n_held += len(ids)
                if n_held >= BLOCK_IDS:
                    yield from packed()
        yield from packed()

    return texts_of(docs).mapInArrow(run, ROWS)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as a Parquet table: id matrix, cumulative segment lengths and position resets."""
    pack_rows(docs, **options).write.mode("overwrite").option("compression", "zstd").parquet(path)


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """One row for each segment: where it lies and the CRC-32 of its row's arrays."""
    rows = pack_rows(docs, **options)
    summed = rows.select("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
    segments = summed.select("row_id", "n_tokens", "ids_crc32", "positions_crc32", F.posexplode(F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("begin"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("end"))).alias("segment", "at"))
    return segments.select("row_id", "segment", F.col("at.doc_ids").alias("doc_id"), F.col("at.starts").alias("start"), F.col("at.begin").alias("row_offset"), (F.col("at.end") - F.col("at.begin")).alias("length"), "n_tokens", "ids_crc32", "positions_crc32")
