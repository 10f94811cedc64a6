"""Spelling variants: words one edit apart, grouped without ever making a pair.

Every word enters one group for each of its positions, keyed by the position's prefix and suffix: words that meet
there differ by one replaced code point, and a group needs no more than its size and its two words of largest count to
serve all of its members. Every distinct deletion of a word enters the group of the string that is left, where it
meets the vocabulary's word of that spelling, if there is one: these are the insertions and deletions. Both kinds are
rows of equal width (128-bit key, word number, count), so a word of any length costs memory in proportion to its
length, and a group has at most one row for each letter of the alphabet and position, whatever the input.

Prefixes and suffixes enter keys as polynomial hashes modulo the primes 2^61 - 1 and 2^61 - 31, joined to the hash of the
whole string, with a symbol of its own for the wildcard; of n different keys two agree by chance about n * n / 2^122
times. Words are numbered in code-point order, so ties are settled on numbers.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least twice its
own. Counts at least double along forms, so following them ends after at most 63 steps, which pointer jumping takes in
six rounds.

Words are the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, only A-Z lower-cased; where 97 divides
the checksum of "<doc_id>:<run>", the run loses one code point (typing errors for the registered query's sake).

Defined results: a null text has no words; a null doc_id counts as the empty string; repeated rows count again; a run
that is left with fewer than LEAST_LENGTH code points is no word; an empty table gives no rows; columns beside the named
ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage, forget

LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGE = 97
#: Characters of a text whose runs are held at once, and distinct words whose counts a task holds.
PIECE = 1 << 20
HELD = 1 << 18
PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (1_234_567_890_123_457, 987_654_321_987_653)
WILD, GONE, WORD = 0, 1, 2
ANY = 0x110001


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that cut no run; a longer run stands whole."""
    at, stop = 0, re.compile("[^a-zÀ-ÿ]")
    while at < len(text):
        cut = stop.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() + 1 if cut else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: object, text: str | None, counts: Counter, damage: int = DAMAGE, least: int = LEAST_LENGTH) -> None:
    """Adds a text's words to counts. Runs shorter than `least` cannot become words and are passed over."""
    if not text:
        return
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    first = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        for run, n in Counter(runs.findall(piece)).items():
            h = zlib.crc32(run.encode(), first)
            if damage and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < least:
                    continue
            counts[run] += n


def _counter(damage: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words_of(doc_id.as_py(), text.as_py(), counts, damage, least)
                if len(counts) > HELD:
                    yield out()
        if counts:
            yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least least_length code points and least_count occurrences; damage 0 leaves runs whole."""
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    made = texts.mapInArrow(_counter(damage, least_length), "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _hashes(points: list[int], prime: int, base: int) -> tuple[list[int], list[int], list[int]]:
    """(hashes of prefixes, hashes of suffixes, powers), each of length + 1."""
    before, after, powers = [0], [0], [1]
    for p in points:
        before.append((before[-1] * base + p + 1) % prime)
        powers.append(powers[-1] * base % prime)
    for k, p in enumerate(reversed(points)):
        after.append(((p + 1) * powers[k] + after[-1]) % prime)
    return before, after[::-1], powers


def keys_of(word: str) -> Iterator[tuple[int, int, int]]:
    """(kind, key, key): a wildcard for each position, each distinct deletion, and the word itself."""
    points = [ord(c) for c in word]
    n = len(points)
    sides = [_hashes(points, p, b) for p, b in zip(PRIMES, BASES)]
    for k in range(n):
        yield WILD, *[((before[k] * powers[1] + ANY) * powers[n - k - 1] + after[k + 1]) % prime for (before, after, powers), prime in zip(sides, PRIMES)]
        if k == 0 or points[k] != points[k - 1]:
            yield GONE, *[(before[k] * powers[n - k - 1] + after[k + 1]) % prime for (before, after, powers), prime in zip(sides, PRIMES)]
    yield WORD, *[before[n] for before, _, _ in sides]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, k1, k2, id, n), a bounded lot at a time."""
    for batch in batches:
        kinds, k1, k2, ids, ns = [], [], [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.array(x, t)) for x, t in ((kinds, np.int8), (k1, np.int64), (k2, np.int64), (ids, np.int64), (ns, np.int64))], names=["kind", "k1", "k2", "id", "n"])
            for x in (kinds, k1, k2, ids, ns):
                x.clear()
            return made

        for i, word, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            for kind, a, b in keys_of(word.as_py()):
                kinds.append(kind)
                k1.append(a)
                k2.append(b)
                ids.append(i)
                ns.append(n)
                if len(ids) >= 1 << 16:
                    yield out()
        if ids:
            yield out()


def numbered(words: DataFrame) -> DataFrame:
    """(id, word, n), written: ids rise in code-point order. A range sort deals the words out."""
    return cut_lineage(words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, form_n, form_id) of the words of a numbered vocabulary that have a near word."""
    keys = words.select("id", "word", "n").mapInArrow(_key_rows, "kind byte, k1 long, k2 long, id long, n long")
    best = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("id"))
    ordered = Window.partitionBy("k1", "k2").orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = keys.withColumns(
        {
            "first": F.first(best).over(ordered),
            "second": F.nth_value(best, 2).over(ordered),
            "size": F.count("*").over(ordered),
            "word_best": F.max(F.when(F.col("kind") == WORD, best)).over(ordered),
            "gone": F.count(F.when(F.col("kind") == GONE, 1)).over(ordered),
            "gone_best": F.max(F.when(F.col("kind") == GONE, best)).over(ordered),
        }
    ).where("size > 1")
    wild, word = F.col("kind") == WILD, F.col("kind") == WORD
    met = seen.select(
        "id",
        F.when(wild, F.col("size") - 1).when(word, F.col("gone")).otherwise(F.col("word_best").isNotNull().cast("long")).alias("met"),
        F.when(wild, F.when(F.col("first")["id"] == -F.col("id"), F.col("second")).otherwise(F.col("first"))).when(word, F.col("gone_best")).otherwise(F.col("word_best")).alias("best"),
    ).where("met > 0")
    found = met.groupBy("id").agg(F.sum("met").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.col("best")["n"].alias("form_n"), (-F.col("best")["id"]).alias("form_id"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of a vocabulary (word, n) of distinct words."""
    table = numbered(words)
    linked = table.join(near_words(table), "id", "left")
    take = F.col("form_n") >= 2 * F.col("n")
    judged = cut_lineage(
        linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(take, F.col("form_n")).alias("form_n"), F.when(take, F.col("form_id")).alias("form_id"))
    )
    # (id, root) of the words with a form; each round follows twice as many forms.
    roots = cut_lineage(judged.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    while True:
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(roots.hint("merge").join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(roots)
        roots = moved
        if roots.where("moved").isEmpty():
            break
    named = table.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = roots.hint("merge").join(table.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = judged.hint("merge").join(named, "form_id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    return variants(vocabulary(docs, **options))
