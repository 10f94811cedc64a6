"""A Spark data source for recorded broker responses, batch and stream: format "broker_tables".

A table lies in JSON lines under a name that ends in `<adapter>.<kind>.jsonl`, a file or a folder of files, in one folder
of a local disk or any store that Arrow opens. Options: `path`, `kind`, `adapter` (names, comma-separated: only their
files are read) and `piece_bytes` (the most that one task reads). Columns: adapter, then the kind's own.

Batch: files are cut into pieces at line ends, one partition each. Files are chosen by an option and not by pushed
filters, since Spark 4.1 keeps what one query pushes in the relation, and a second query on the same DataFrame would then
lack rows. Stream: the offset is how far each file has been read, in bytes, always a line's end; a file that
grows is read on from there. A line that is no JSON object, or holds a value of another type, is a row of NULLs but for
its adapter, as Spark's own reader takes it.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

KINDS = {
    "positions": "symbol string, quantity double, mark_price double, unrealized_pnl double",
    "holdings": "symbol string, quantity double, mark_price double, unrealized_pnl double",
    "balances": "currency string, amount double",
    "accounts": "currency string, amount double",
    "orders": "order_id string, symbol string, side string, quantity double, state string",
    "fills": "order_id string, symbol string, side string, quantity double, price double",
    "symbols": "symbol string, kind string",
}
PIECE_BYTES = 64 << 20
BATCH_ROWS = 4096


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in [start, end)."""

    adapter: str
    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def recorded_files(path: str, kind: str, adapters: frozenset[str] | None = None) -> list[tuple[str, str, int]]:
    """(adapter, file, bytes) of a kind's files, by name. Hidden files and markers, whose names begin with a dot or an
    underscore, are left out."""
    store, root = opened(path)
    end, out = f".{kind}.jsonl", []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        named = [p for p in parts if p.endswith(end) and p != end]
        if info.type == fs.FileType.File and named and parts[-1][0] not in "._" and info.size:
            out.append((named[0].removesuffix(end), info.path, info.size))
    return sorted(f for f in out if adapters is None or f[0] in adapters)


def _lines(path: str, piece: Piece) -> Iterator[bytes]:
    with opened(path)[0].open_input_file(piece.path) as source:
        at = piece.start
        if at:
            # A line that begins before the piece belongs to the one before.
            source.seek(at - 1)
        else:
            source.seek(0)
        rest, skip, size = b"", bool(at), source.size()
        at = max(at - 1, 0)
        while True:
            block = source.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                if skip:
                    skip = False
                elif at >= piece.end:
                    return
                else:
                    yield line
                at += len(line) + 1
            if not block:
                return
            if not rest and at >= min(piece.end, size):
                return


def _batches(path: str, piece: Piece, schema: StructType) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "double": pa.float64()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]
    rows: list[dict] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(rows, pa.schema(fields))
        rows.clear()
        return made

    for line in _lines(path, piece):
        if line.strip():
            rows.append({"adapter": piece.adapter} | _values(line, fields[1:]))
            if len(rows) == BATCH_ROWS:
                yield out()
    if rows:
        yield out()


def _values(line: bytes, fields: list[tuple[str, pa.DataType]]) -> dict:
    try:
        read = json.loads(line)
    except ValueError:
        return {}
    out = {}
    for name, kind in fields if isinstance(read, dict) else []:
        value = read.get(name)
        if kind == pa.string():
            out[name] = value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))
        elif value is not None:
            if isinstance(value, bool) or not isinstance(value, int | float):
                return {}
            out[name] = float(value)
    return out


class BrokerReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, kind: str, piece_bytes: int, adapters: frozenset[str] | None) -> None:
        self.schema, self.path, self.kind, self.piece_bytes, self.adapters = schema, path, kind, piece_bytes, adapters

    def partitions(self) -> Sequence[InputPartition]:
        files = recorded_files(self.path, self.kind, self.adapters)
        pieces = [Piece(adapter, path, at, min(at + self.piece_bytes, size)) for adapter, path, size in files for at in range(0, size, self.piece_bytes)]
        # Spark asks for one partition at least.
        return pieces or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(self.path, partition, self.schema)


class BrokerStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, kind: str, piece_bytes: int, adapters: frozenset[str] | None) -> None:
        self.schema, self.path, self.kind, self.piece_bytes, self.adapters = schema, path, kind, piece_bytes, adapters

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {path: end for _, path, size in recorded_files(self.path, self.kind, self.adapters) if (end := self._last_line_end(path, size))}}

    def _last_line_end(self, path: str, size: int) -> int:
        """A line still being written is left for later."""
        with opened(self.path)[0].open_input_file(path) as source:
            end = size
            while end > 0:
                start = max(0, end - (1 << 16))
                source.seek(start)
                found = source.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        adapters = {path: adapter for adapter, path, _ in recorded_files(self.path, self.kind)}
        out = []
        for path, until in sorted(end["files"].items()):
            begin = start["files"].get(path, 0)
            out += [Piece(adapters.get(path, _adapter_of(path, self.kind)), path, at, min(at + self.piece_bytes, until)) for at in range(begin, until, self.piece_bytes)]
        return out or [Piece("", "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(self.path, partition, self.schema)


def _adapter_of(path: str, kind: str) -> str:
    return next(p.removesuffix(f".{kind}.jsonl") for p in path.split(posixpath.sep) if p.endswith(f".{kind}.jsonl"))


class BrokerTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker_tables"

    def _option(self) -> tuple[str, str, int, frozenset[str] | None]:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"option kind must be one of {', '.join(KINDS)}")
        if not self.options.get("path"):
            raise ValueError("option path must name the folder of the recorded tables")
        names = self.options.get("adapter")
        return self.options["path"], kind, int(self.options.get("piece_bytes", PIECE_BYTES)), None if names is None else frozenset(names.split(","))

    def schema(self) -> str:
        return f"adapter string, {KINDS[self._option()[1]]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BrokerReader(schema, *self._option())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return BrokerStreamReader(schema, *self._option())
