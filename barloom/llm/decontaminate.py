"""Benchmark decontamination by pigeonhole edit matching.

Text is compared in a normal form: lower case, every run of signs other than letters and digits one
space. A test item of m characters may occur with up to k = ERROR_RATE * m edits, rounded down. It is cut
into k + 1 pieces; an occurrence with at most k edits leaves one of them unchanged, so
exact piece hits (an Aho-Corasick automaton over all pieces) miss nothing. Around each hit, Myers'
bit-parallel algorithm gives the least edit distance of the item to any stretch of the document; where many
windows are to be searched, as with items made from one template, they are searched together, a column of
all of them in a step.

Up to FEW_BLOCKS blocks of items, of about BLOCK_CHARS characters each, are sent to the tasks, and documents are
read in place, once for each block, and never shuffled. A larger benchmark is dealt out by piece: a bit array of
fixed size, which marks the pieces' first GRAM characters, is all that is sent; documents' stretches that it marks
are joined with the pieces, and the pairs found so are verified, each text once whatever the number of its copies.
Both ways give the same rows.

Defined results: null and empty texts match nothing; an item without a budget (fewer than 20 normal
characters) matches without edits and between word bounds only (any place beside a sign of a script
without spaces is one), so an item of one common word matches all documents with that word; an item
without letters or digits matches none; an item without an item_id matches like all others and is reported
with a null item_id; equal items each match; repeated document rows match alike; of an item's occurrences in a document
the one with the least distance, then the earliest, is reported, as offsets in the normal form.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import text_hash
from barloom.llm.shared import cut_lineage, texts_of

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
FEW_BLOCKS = 8
#: Every piece of an item with a budget has GRAM characters at least: of 20 characters, ten.
GRAM = 10
#: Characters of windows from which on they are searched together.
TOGETHER = 6_000
#: Characters of windows that are searched together at once.
LOT_CHARS = 4_000_000
#: Bits of the array that marks them (16 MB).
MARK_BITS = 1 << 27
LEAST_WITH_BUDGET = math.ceil(1 / ERROR_RATE)

_SIGNS = re.compile(r"[\W_]+")
#: Signs of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
HITS = "doc_id long, item_id long, distance int, span_start int, span_end int"


def normal(text: str | None) -> str:
    return _SIGNS.sub(" ", (text or "").lower()).strip()


def budget(m: int) -> int:
    """Errors allowed in an item of m characters; with none (fewer than 20 characters) it must stand there as words."""
    return int(ERROR_RATE * m)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces whose lengths differ by at most one."""
    n, m = budget(len(item)) + 1, len(item)
    cuts = [m * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for at, sign in enumerate(item):
        masks[sign] = masks.get(sign, 0) | 1 << at
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of text, and the first end of one with it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for at, sign in enumerate(text, 1):
        eq = masks.get(sign, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if distance < best:
            best, end = distance, at
    return best, end


def myers_together(items: list[str], which: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As myers() for many windows of one text at once: window w is text[starts[w]:ends[w]], searched for
    items[which[w]]. All windows move on by one character in a step; a row of 64-bit words holds a window's column."""
    best, end = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    alphabet = np.array(sorted({ord(c) for item in items for c in item}), np.uint32)
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.searchsorted(alphabet, signs)
    codes = np.where(alphabet[np.minimum(place, len(alphabet) - 1)] == signs, place, len(alphabet)).astype(np.int32)
    sizes = np.array([len(item) for item in items])
    words = -(-sizes // 64)
    for n in np.unique(words[which]):
        of = np.unique(which[words[which] == n])
        peq = np.zeros((len(of), len(alphabet) + 1, n), np.uint64)
        for row, k in enumerate(of):
            item = np.searchsorted(alphabet, np.frombuffer(items[k].encode("utf-32-le", "surrogatepass"), np.uint32))
            at = np.arange(len(item))
            np.bitwise_or.at(peq[row], (item, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        mine = np.nonzero(words[which] == n)[0]
        # Windows of about one length go together.
        mine = mine[np.argsort(ends[mine] - starts[mine], kind="stable")]
        lot = max(1, LOT_CHARS // int((ends[mine] - starts[mine]).max(initial=1)))
        for first in range(0, len(mine), lot):
            rows = mine[first : first + lot]
            best[rows], end[rows] = _columns(peq, np.searchsorted(of, which[rows]), sizes[which[rows]], codes, starts[rows], ends[rows])
    return best, end


def _columns(peq: np.ndarray, item: np.ndarray, m: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, n = np.uint64(1), peq.shape[2]
    up, down = np.full((n, len(item)), ~np.uint64(0)), np.zeros((n, len(item)), np.uint64)
    last = ((m - 1) % 64).astype(np.uint64)
    distance, best, end, length = m.copy(), m.copy(), np.zeros(len(m), np.int64), ends - starts
    for t in range(int(length.max(initial=0))):
        sign = codes[np.minimum(starts + t, len(codes) - 1)]
        rise, fall = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
        for w in range(n):
            eq = peq[item, sign, w]
            vertical = eq | down[w]
            eq |= fall
            across = (((eq & up[w]) + up[w]) ^ up[w]) | eq
            plus, minus = down[w] | ~(across | up[w]), up[w] & across
            if w == n - 1:
                distance += ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
            next_rise, next_fall = plus >> np.uint64(63), minus >> np.uint64(63)
            plus, minus = (plus << one) | rise, (minus << one) | fall
            up[w], down[w] = minus | ~(vertical | plus), plus & vertical
            rise, fall = next_rise, next_fall
        better = (distance < best) & (t < length)
        best[better], end[better] = distance[better], t + 1
    return best, end


def is_bound(text: str, at: int) -> bool:
    """Whether a word can begin or end at that place of the normal text."""
    if at in (0, len(text)) or " " in text[at - 1 : at + 1]:
        return True
    return _UNSPACED.search(text, at - 1, at + 1) is not None


class Matcher:
    """The items of one block, ready for matching."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            if item:
                for offset, piece in pieces(item):
                    found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item that a piece hit, the stretches that can hold it: one for the pieces of one occurrence, so none
        is longer than the item and four times its budget."""
        out: dict[int, list[list[int]]] = {}
        begins: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                m = len(self.items[n][1])
                k = budget(m)
                begin = end + 1 - size - offset
                if not k:
                    # The piece is the whole item; its first place is the result.
                    if n not in out and is_bound(text, begin) and is_bound(text, end + 1):
                        out[n] = [[begin, end + 1]]
                    continue
                begins.setdefault(n, []).append(begin)
        for n, places in begins.items():
            m = len(self.items[n][1])
            k = budget(m)
            spans = out[n] = []
            places.sort()
            first = None
            for begin in places:
                if first is None or begin > first + 2 * k:
                    first = begin
                    spans.append([max(0, begin - k), 0])
                spans[-1][1] = min(len(text), begin + m + k)
        return out

    def hits(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of each item that occurs in the normal text."""
        out: list[tuple[int | None, int, int, int]] = []
        if self.empty:
            return out
        near = {}
        for n, spans in self.windows(text).items():
            if budget(len(self.items[n][1])):
                near[n] = spans
            else:
                out.append((self.items[n][0], 0, *spans[0]))
        for n, (distance, end) in sorted(self.nearest(text, near).items()):
            item_id, item = self.items[n]
            if distance <= budget(len(item)):
                # The same search backwards from the end finds where the stretch starts.
                stretch = text[max(0, end - len(item) - distance) : end]
                out.append((item_id, distance, end - myers_prefix(item[::-1], stretch[::-1], distance), end))
        return out

    def nearest(self, text: str, near: dict[int, list[list[int]]]) -> dict[int, tuple[int, int]]:
        """(distance, end) of each item: the least distance in its windows, and the first end with it."""
        out: dict[int, tuple[int, int]] = {}
        if sum(b - a for spans in near.values() for a, b in spans) >= TOGETHER:
            order = list(near)
            which = np.repeat(np.arange(len(order)), [len(near[n]) for n in order])
            starts, ends = np.array([span for n in order for span in near[n]], np.int64).T
            best, end = myers_together([self.items[n][1] for n in order], which, text, starts, ends)
            for k, d, e in zip(which.tolist(), best.tolist(), (starts + end).tolist()):
                out[order[k]] = min(out.get(order[k], (d, e)), (d, e))
            return out
        for n, spans in near.items():
            item = self.items[n][1]
            masks = self.masks.get(n)
            if masks is None:
                masks = self.masks[n] = masks_of(item)
            for a, b in spans:
                distance, end = myers(masks, len(item), text[a:b])
                out[n] = min(out.get(n, (distance, a + end)), (distance, a + end))
        return out


def myers_prefix(item: str, text: str, distance: int) -> int:
    """Length of the shortest prefix of text at that edit distance from item (both reversed by the caller)."""
    row = list(range(len(item) + 1))
    if row[-1] == distance:
        return 0
    for at, sign in enumerate(text, 1):
        last, row[0] = row[0], at
        low, high = max(1, at - distance), min(len(item), at + distance)
        if low > 1:
            last, row[low - 1] = row[low - 1], distance + at
        for j in range(low, high + 1):
            last, row[j] = row[j], min(last + (item[j - 1] != sign), row[j] + 1, row[j - 1] + 1)
        if high == len(item) and row[-1] <= distance:
            return at
    return len(text)


_ready: dict[str, Matcher] = {}


def _matcher(name: str, items) -> Matcher:
    """Built once in each Python worker; only the latest block is kept."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Matcher(items.value)
    return _ready[name]


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def block_count(items: DataFrame) -> int:
    return (items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS + 1


def benchmark_blocks(rows: DataFrame, n: int) -> Iterator[tuple[str, object]]:
    """(name, broadcast items) of each of n blocks."""
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        items = [(i, normal(t)) for i, t in zip(block["item_id"].to_pylist(), block["text"].to_pylist())]
        items.sort(key=lambda item: (item[0] is None, item[0] or 0, item[1]))
        held = rows.sparkSession.sparkContext.broadcast(items)
        yield uuid.uuid4().hex, held


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all stretches of GRAM characters, some hundred thousand at a time."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for first in range(0, len(signs) - GRAM + 1, 1 << 18):
        part = signs[first : first + (1 << 18) + GRAM - 1].astype(np.uint64)
        value = np.zeros(len(part) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            value = value * np.uint64(0x9E3779B97F4A7C15) + part[k : k + len(value)]
        yield text_hash.mix(value)


def _normal_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())], names=["item_id", "text"])


def _piece_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_key, gram) of the first GRAM characters of each piece."""
    for batch in batches:
        rows = [(key, int(next(gram_hashes(piece[:GRAM]))[0])) for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, piece in pieces(item)]
        keys, grams = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(grams, np.uint64).view(np.int64))], names=["item_key", "gram"])


def _marked_grams(marks):
    """(body, gram) of each text's stretches that the array marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            for body, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = []
                for value in gram_hashes(normal(text.as_py())):
                    at = value % np.uint64(MARK_BITS)
                    found.append(np.unique(value[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]))
                grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([body] * len(grams), pa.string()), pa.array(grams.view(np.int64))], names=["body", "gram"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, item_id, item, text) to (body, and what hits() gives)."""
    for batch in batches:
        rows = [
            (body, *hit) for body, i, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)) for hit in Matcher([(i, item)]).hits(normal(text.as_py()))
        ]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["body", "item_id", "distance", "span_start", "span_end"])


def _body(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def hits_by_piece(texts: DataFrame, items: DataFrame) -> DataFrame:
    """texts: text, with repeats. (body, item_id, distance, span_start, span_end) of each text, by its hash, and item
    that occurs in it."""
    spark = items.sparkSession
    known = cut_lineage(items.mapInArrow(_normal_items, "item_id long, text string").where("text <> ''").withColumn("item_key", F.monotonically_increasing_id()))
    longer = known.where(F.char_length("text") >= LEAST_WITH_BUDGET)
    short = known.where(F.char_length("text") < LEAST_WITH_BUDGET).select("item_id", "text")
    grams = cut_lineage(longer.select("item_key", "text").mapInArrow(_piece_grams, "item_key long, gram long"))
    # hash % MARK_BITS, of the hash as it is without a sign: its low bits. At most MARK_BITS / 64 rows.
    bit = F.col("gram").bitwiseAND(F.lit(MARK_BITS - 1))
    words = grams.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(MARK_BITS >> 6, np.uint64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    bodies = cut_lineage(texts.select(_body(F.col("text")).alias("body"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    marked = bodies.mapInArrow(_marked_grams(spark.sparkContext.broadcast(marks)), "body string, gram long")
    pairs = marked.join(grams, "gram").select("body", "item_key").distinct()
    whole = pairs.join(longer.select("item_key", "item_id", F.col("text").alias("item")), "item_key").join(bodies, "body").select("body", "item_id", "item", "text")
    out = whole.mapInArrow(_verified, "body string, item_id long, distance int, span_start int, span_end int")
    if not short.isEmpty():
        for name, held in benchmark_blocks(short, block_count(short)):
            out = out.unionByName(bodies.mapInArrow(_hits_in_place(name, held, pa.string()), "body string, " + HITS.split(", ", 1)[1]))
    return cut_lineage(out)


def _hits_in_place(name: str, items, key: pa.DataType):
    """(key, text) to (key, and what hits() gives) for the items of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, items)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in matcher.hits(normal(t.as_py()))]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [key, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[batch.schema.names[0], "item_id", "distance", "span_start", "span_end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and item that occurs in it: doc_id, item_id, distance, span_start, span_end."""
    texts, items = texts_of(docs), items_of(benchmark)
    n = block_count(items)
    if n > FEW_BLOCKS:
        found = hits_by_piece(texts, items)
        rows = texts.select("doc_id", _body(F.col("text")).alias("body"))
        return rows.join(found, "body").select("doc_id", "item_id", "distance", "span_start", "span_end")
    out = None
    for name, held in benchmark_blocks(items, n):
        found = texts.mapInArrow(_hits_in_place(name, held, pa.int64()), HITS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows in which a test item occurs."""
    items = items_of(benchmark)
    n = block_count(items)
    if n > FEW_BLOCKS:
        leaky = hits_by_piece(docs.select(F.col(text_col).alias("text")), items).select("body").distinct()
        # The rows travel as one struct, so that no column's name can clash.
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _body(F.col(text_col)).alias("body"))
        return rows.join(leaky, "body", "left_anti").select("row.*")
    for name, items in benchmark_blocks(items, n):
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], name=name, items=items, at=at) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, items)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
