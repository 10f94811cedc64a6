"""Jaccard self-join of documents on word shingles, with adaptive multi-match prefixes.

Two sets with Jaccard similarity t or more share l tokens among the first n - ceil(t n) + l tokens
of each, in any common order of tokens, for every l up to the least overlap. A longer prefix (larger
l) reads more postings but asks for more shared tokens before a pair is verified; each document takes
the l with the least estimated cost, a pair the smaller l of its two documents.

Steps, each a Spark job over all rows:
1. Profile: every text's shingle set (numpy on Arrow bytes), its 128-bit set key, and partial counts
   of repeated tokens. Equal sets form one class. The most frequent tokens, at most FREQUENT of them,
   are sent to all tasks: they sort last, by count, and give the cost estimates. Any token order gives
   right results, so the bound on that list is no bound on the data.
2. Postings of the chosen prefixes, packed in arrays by token bucket. Frequent tokens are salted.
3. Bucket by bucket: short posting lists give all their pairs; long ones pair every document with the
   list's most central one (the largest share of frequent tokens) and keep their postings for step 5.
4. Pairs with enough shared tokens are verified on whole texts; links give components.
5. Long lists whose documents are still in several components: the shared lists of all pairs across
   components are counted, block by block, and those with enough are verified. Pairs inside a component
   need no check, since only components are asked for. What step 3 counts for a long list is a part of
   its pairs at most, so a pair that it misses is met here.

Defined results: null and empty texts have no shingles and link with nothing; equal texts share a
class whatever their number; rows that repeat a doc_id keep one output row each, and their texts count as
that document's; a row without a doc_id takes the component of documents with the same shingles, or none;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import text_hash
from barloom.llm.components import connected_components
from barloom.llm.shared import cut_lineage, forget, partitions_for, texts_of

WIDTH = 5
PERCENT = 75
#: Tokens in the list of frequent ones, sent to every task (16 bytes each), and the least count in it.
FREQUENT = 1 << 17
FREQUENT_LEAST = 8
#: Expected other documents at a token that is not frequent, for the cost estimate.
LIGHT_OTHERS = 0.05
#: The largest l; posting lists up to SHORT_LIST long give all pairs; postings in a bucket; in a salt of a frequent token.
MOST_MATCHES = 8
SHORT_LIST = 5
BUCKET_POSTINGS = 400_000
SALT_POSTINGS = 2048
#: Bounds on the postings in a block of documents that share long lists; no document has more than its prefix.
LEAST_BLOCK_POSTINGS, MOST_BLOCK_POSTINGS = 512, 32_768
#: Postings for each task that counts shared lists.
DEAL_ROWS = 20_000
#: Tokens held before they are counted, and rows of counts kept of each such lot, in one task.
LOT = 1 << 21
LOT_KEEPS = 1 << 15
#: Text of pairs that are verified together.
VERIFY_BYTES = 1 << 21
FLUSH = 1 << 19

_PROFILE = "doc_id long, k1 long, k2 long, n int, token long, df long"
_POSTINGS = "bucket int, token binary, doc binary, mark binary"
_PAIRS = "kind int, a long, b long, need int, hits int"
#: What is known of a document in an open list.
POSTING = ("rep", "component", "n", "lone", "level", "l", "size")


def _set_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's distinct tokens."""
    sums = []
    for turn in (0x1234567F, 0x7654321D):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text_hash.mix(h * np.uint64(turn)))])
        sums.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("token", pa.int64()), ("df", pa.int64())])
    seen: set[tuple[int, int]] = set()
    lot: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(lot) if lot else np.zeros(0, np.uint64), return_counts=True)
        lot.clear()
        often = np.flatnonzero(df >= 2)
        if len(often) > LOT_KEEPS:
            often = often[np.argsort(-df[often], kind="stable")[:LOT_KEEPS]]
        none = pa.nulls(len(often), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(often), pa.int32()), pa.array(token[often].view(np.int64)), pa.array(df[often].astype(np.int64))], schema=schema)

    for batch in batches:
        for i, j, h, off in text_hash.shingle_sets(batch.column(1), WIDTH):
            k1, k2 = _set_keys(h, off)
            n = np.diff(off)
            for row, key in enumerate(zip(k1.tolist(), k2.tolist())):
                if n[row] and key not in seen:
                    seen.add(key)
                    lot.append(h[off[row] : off[row + 1]])
            none = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int32)), none, none], schema=schema)
            if sum(map(len, lot)) > LOT:
                yield counted()
    yield counted()


def _size_step(n: np.ndarray) -> np.ndarray:
    """Set sizes on a logarithmic scale of 4 % steps, one byte each."""
    return np.minimum(255, np.floor(np.log(np.maximum(n, 1)) / np.log(1.04) * 0.5)).astype(np.uint8)


#: Sizes of linked sets differ by less than log(4/3) / log(1.04) / 2 = 3.67 steps: 4 when rounded down.
SIZE_STEPS = 4


def choose_matches(n: np.ndarray, light: np.ndarray, heavy_sums: np.ndarray, heavy_off: np.ndarray) -> np.ndarray:
    """l of each document: the least of (postings read + candidates times their verification), where
    the frequent tokens among the first p + l - 1 have their estimated counts and all others
    LIGHT_OTHERS; l postings are read for each candidate, so candidates are the postings over l."""
    need = (n * PERCENT + 99) // 100
    p = n - need + 1
    best, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for l in range(1, MOST_MATCHES + 1):
        length = p + l - 1
        heavy = np.clip(length - light, 0, heavy_off[1:] - heavy_off[:-1])
        read = heavy_sums[heavy_off[:-1] + heavy] - heavy_sums[heavy_off[:-1]]
        others = np.minimum(length, light) * LIGHT_OTHERS + read
        cost = np.where(l <= need, length + read + others / l * n, np.inf)
        better = cost < least
        best[better], least[better] = l, cost[better]
    return best


def _postings(frequent: np.ndarray, counts: np.ndarray, buckets: int):
    """frequent: token hashes in ascending order, counts: theirs."""
    order = np.lexsort((frequent, counts))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    salts = np.maximum(1, -(-counts // SALT_POSTINGS)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            bucket, token, doc, mark = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(bucket):
                return
            by = np.argsort(bucket, kind="stable")
            bucket, token, doc, mark = bucket[by], token[by], doc[by], mark[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cuts[1:], len(bucket))
            for k in range(0, len(cuts), 512):
                pieces = list(zip(cuts[k : k + 512].tolist(), ends[k : k + 512].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[k : k + 512]].astype(np.int32)), *[pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (token, doc, mark)]],
                    names=["bucket", "token", "doc", "mark"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, h, off in text_hash.shingle_sets(batch.column(1), WIDTH):
                n = np.diff(off)
                first = np.zeros(j - i, bool)
                for row, key in enumerate(zip(*(k.tolist() for k in _set_keys(h, off)))):
                    if n[row] and key not in seen:
                        seen.add(key)
                        first[row] = True
                row_of = np.repeat(np.arange(j - i), n)
                at = np.searchsorted(frequent, h)
                heavy = np.zeros(len(h), bool)
                inside = at < len(frequent)
                heavy[inside] = frequent[at[inside]] == h[inside]
                light_so_far = np.concatenate([[0], np.cumsum(~heavy)])
                light = light_so_far[off[1:]] - light_so_far[off[:-1]]
                rank = light_so_far[:-1] - light_so_far[off[:-1]][row_of]
                h_at = np.flatnonzero(heavy)
                by = np.lexsort((place[at[h_at]], row_of[h_at]))
                h_at = h_at[by]
                h_off = np.concatenate([[0], np.cumsum(n - light)])
                rank[h_at] = np.arange(len(h_at)) - h_off[row_of[h_at]] + light[row_of[h_at]]
                sums = np.concatenate([[0.0], np.cumsum(counts[at[h_at]].astype(float))])
                l = choose_matches(n, light, sums, h_off)
                p = n - (n * PERCENT + 99) // 100 + 1
                level = np.maximum(1, rank - p[row_of] + 2)
                keep = np.flatnonzero((level <= l[row_of]) & first[row_of])
                rows, hv = row_of[keep], heavy[keep]
                code = text_hash.mix(h[keep])
                doc = ids[i:j][rows].astype(np.int64)
                token = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                token[hv] = at[keep][hv].astype(np.uint32)
                salt = np.zeros(len(keep), np.uint64)
                salt[hv] = text_hash.mix(doc[hv].view(np.uint64)) % salts[at[keep][hv]]
                bucket = (text_hash.mix((code >> np.uint64(32)) + salt * np.uint64(0x632BE59BD9B4E019)) % np.uint64(buckets)).astype(np.int32)
                share = (light * 127 // np.maximum(n, 1)).astype(np.uint8)
                mark = np.stack([_size_step(n)[rows], (level[keep] * 16 + l[rows]).astype(np.uint8), share[rows] | (hv.astype(np.uint8) << 7)], axis=1)
                held.append((bucket, token, doc, mark))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _bucket_pairs(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Rows of one bucket: kind 0, pairs of short lists (a, b, l needed, tokens shared); kind 1, the same
    for a long list's documents with its central one; kind 2, a long list's postings (list, document, marks);
    kind 3, each document's number of postings that are not its own alone."""
    bucket = key[0].as_py()

    def read(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    token, doc, mark = read("token", np.uint32), read("doc", np.int64), read("mark", np.uint8).reshape(-1, 3)
    heavy = (mark[:, 2] >> 7).astype(np.uint64)
    lists = heavy << np.uint64(32) | token
    by = np.lexsort((doc, lists))
    lists, doc, mark, heavy = lists[by], doc[by], mark[by], heavy[by]
    fresh = np.ones(len(lists), bool)
    fresh[1:] = (lists[1:] != lists[:-1]) | (doc[1:] != doc[:-1])
    lists, doc, mark, heavy = lists[fresh], doc[fresh], mark[fresh], heavy[fresh]
    size, level, need, share = mark[:, 0].astype(np.int64), mark[:, 1] >> 4, mark[:, 1] & 15, mark[:, 2] & 127
    begin = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(lists)))
    whole = heavy[begin] == 1
    holders, held = np.unique(doc[np.repeat((count > 1) | whole, count)], return_counts=True)
    zero = np.zeros(len(holders), np.int64)
    out: list[tuple[np.ndarray, ...]] = [(np.full(len(holders), 3, np.int32), holders, zero, zero, held)]
    pairs: list[np.ndarray] = []
    for s in range(2, SHORT_LIST + 1):
        starts = begin[(count == s) & ~whole]
        for x in range(s):
            for y in range(x + 1, s):
                u, v = starts + x, starts + y
                l = np.minimum(need[u], need[v])
                ok = (np.maximum(level[u], level[v]) <= l) & (np.abs(size[u] - size[v]) <= SIZE_STEPS)
                pairs.append(np.stack([doc[u[ok]], doc[v[ok]], l[ok].astype(np.int64)], axis=1))
    if pairs and (joined := np.concatenate(pairs)).size:
        joined = joined[np.lexsort(joined.T[::-1])]
        new = np.flatnonzero(np.concatenate([[True], (joined[1:] != joined[:-1]).any(axis=1)]))
        out.append((np.zeros(len(new), np.int32), joined[new, 0], joined[new, 1], joined[new, 2], np.diff(np.append(new, len(joined)))))
    is_long = (count > SHORT_LIST) | whole
    if is_long.any():
        of = np.repeat(np.arange(len(begin)), count)
        at = np.flatnonzero(is_long[of])
        by = at[np.lexsort((doc[at], share[at], of[at]))]
        heads = np.concatenate([[True], of[by][1:] != of[by][:-1]])
        pivot = by[heads][np.cumsum(heads) - 1]
        ok = (doc[by] != doc[pivot]) & (np.abs(size[by] - size[pivot]) <= SIZE_STEPS)
        u, v = by[ok], pivot[ok]
        star, lists_shared = np.unique(np.stack([np.minimum(doc[u], doc[v]), np.maximum(doc[u], doc[v]), np.minimum(need[u], need[v])], axis=1), axis=0, return_counts=True)
        out.append((np.ones(len(star), np.int32), star[:, 0], star[:, 1], star[:, 2], lists_shared))
        name = np.where(heavy[at] == 1, -1 - (lists[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), (np.int64(bucket) << 32) + (lists[at] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out.append((np.full(len(at), 2, np.int32), name, doc[at], mark[at, 1].astype(np.int64), size[at] * 128 + share[at]))
    cols = [np.concatenate(x) for x in zip(*out)]
    return pa.table({"kind": cols[0].astype(np.int32), "a": cols[1].astype(np.int64), "b": cols[2].astype(np.int64), "need": cols[3].astype(np.int32), "hits": cols[4].astype(np.int32)})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b) where 100 * intersection >= PERCENT * union."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
        so_far, k, rows = np.concatenate([[0], np.cumsum(size)]), 0, batch.num_rows
        while k < rows:
            # Pairs of about VERIFY_BYTES of text at once; a longer pair stands alone.
            at, k = k, min(k + 256, max(k + 1, int(np.searchsorted(so_far, so_far[k] + VERIFY_BYTES, "right")) - 1))
            part = batch.slice(at, k - at)
            sides = [[], []]
            for side, column in zip(sides, (part.column(2), part.column(3))):
                for _, _, h, off in text_hash.shingle_sets(column, WIDTH):
                    side += [h[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            links = []
            for row, (x, y) in enumerate(zip(*sides)):
                if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)) or not len(x):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= PERCENT * (len(both) - shared):
                    links.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(links)), part.column(1).take(pa.array(links))], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough. Of each pair one text travels."""
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_verify, "a long, b long").distinct()


def least_hits(l: Column | str, n_x: str, n_y: str) -> Column:
    """Tokens that two linked sets must share in their l-prefixes: l, or more where the least overlap
    of sets of these sizes exceeds what the longer rest of either set can hold."""
    l, n_x, n_y = (F.col(c) if isinstance(c, str) else c for c in (l, n_x, n_y))
    overlap = F.ceil(PERCENT * (n_x + n_y) / (100 + PERCENT))
    rest = F.greatest(F.ceil(n_x * PERCENT / 100), F.ceil(n_y * PERCENT / 100)) - l
    return F.greatest(l.cast("long"), overlap - rest)


def can_link(x: str, y: str) -> Column:
    """Whether two sets can be similar enough, given the larger one's lone tokens: those of its shortest prefix
    that no other document posts.

    The smaller set's lone tokens say nothing, since the larger one can hold them behind its own prefix. For the
    larger set y of a linked pair with overlap o, n_y - lone_y >= o holds: either the smaller set x holds none of
    y's lone tokens; or it holds one behind its own prefix, so that x's whole prefix comes before that token, and
    all of it but n_x - o tokens at most is in y's shortest prefix and posted by both: lone_y is then at most
    p_y - (p_x - (n_x - o)) = (n_y - ceil(t n_y)) + ceil(t n_x) - o, no more than n_y - o."""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    overlap = F.least(n_x, n_y, F.when(n_x >= n_y, n_x - F.col(f"lone_{x}")), F.when(n_y >= n_x, n_y - F.col(f"lone_{y}")))
    return 100 * overlap >= PERCENT * (n_x + n_y - overlap)


def reachable(lists: DataFrame) -> DataFrame:
    """The postings of documents that can still reach the tokens that a link takes: at least the smaller l of
    the two, among documents of about their size in one of their lists. Lists of one document go as well."""
    # Sums are written down before they are joined: Spark splits a hot list's or document's side of a join only
    # where both sides come straight from a shuffle.
    band = F.floor(F.col("size") / SIZE_STEPS)
    least = cut_lineage(lists.select("list", F.explode(F.array(band - 1, band, band + 1)).alias("band"), "l").groupBy("list", "band").agg(F.min("l").alias("least")))
    able = lists.withColumn("band", band).join(least, ["list", "band"]).groupBy("rep").agg(F.count("*").alias("reach"), F.min("l").alias("l"), F.min("least").alias("least"))
    able = cut_lineage(able.where(F.col("reach") >= F.least("l", "least")).select("rep"))
    kept = cut_lineage(lists.join(able, "rep", "left_semi"))
    several = cut_lineage(kept.groupBy("list").count().where("count > 1").select("list"))
    out = cut_lineage(kept.join(several, "list", "left_semi"))
    forget(least, able, kept, several)
    return out


def across_components(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents in different components that share enough of the open lists.

    Two blocks of documents that meet in a list are compared in one task, which counts the shared lists of all
    their pairs in a matrix. Where every document is like every other but few are linked, each block meets each:
    the counting is quadratic then, and its memory bounded by a block's size."""
    lists = reachable(lists)
    packed = packed_blocks(lists)
    rows_out = packed.groupBy("list").agg((F.sum("postings") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0] or 0
    # Several groups a task, so that pairs of blocks spread evenly over the tasks.
    groups = max(8 * partitions_for(lists), rows_out // DEAL_ROWS)
    deal = F.pmod(F.xxhash64("low", "high"), F.lit(groups)).alias("deal")
    found = cut_lineage(meeting_blocks(packed).groupBy(deal).applyInArrow(_count_dealt, "a long, b long"))
    forget(lists, packed)
    return found


def packed_blocks(lists: DataFrame) -> DataFrame:
    """A row for each list and block of documents in it, with the block's postings of that list in an array.

    Documents are dealt into blocks of about equal numbers of postings: those of a component that fills a
    block into blocks of that component alone, all others by their smallest list, so that those with the
    same lists come together; smallest lists of few postings share blocks."""
    block = block_postings(lists.count(), partitions_for(lists))
    docs = cut_lineage(lists.groupBy("rep", "component").agg(F.min("list").alias("anchor"), F.count("*").alias("weight")))
    large = cut_lineage(docs.groupBy("component").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= block).select("component", F.col("component").alias("solo")))
    key = F.when(F.col("solo").isNull(), F.xxhash64(F.lit("list"), "anchor")).otherwise(F.xxhash64(F.lit("component"), "solo"))
    keyed = cut_lineage(docs.join(large, "component", "left").select("rep", "weight", key.alias("key")))
    pieces = cut_lineage(keyed.groupBy("key").agg(F.sum("weight").alias("weight")).select("key", F.ceil(F.col("weight") / block).alias("pieces"), (F.col("weight") < block / 8).alias("small")))
    light = keyed.join(pieces.where("small"), "key", "left_semi").agg(F.sum("weight")).first()[0] or 0
    # Half full on average, so that few exceed a block.
    bins = 2 * light // block + 1
    own = F.when(F.col("small"), F.xxhash64(F.lit("bin"), F.pmod("key", F.lit(bins)))).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("pieces"))))
    dealt = cut_lineage(lists.join(keyed.join(pieces, "key").select("rep", own.alias("own")), "rep"))
    spans = [f(c).alias(f"{k}_{c}") for c in ("component", "size", "level", "l") for k, f in (("low", F.min), ("high", F.max))]
    packed = cut_lineage(dealt.groupBy("list", "own").agg(F.count("*").alias("postings"), *spans, F.collect_list(F.struct(*POSTING)).alias("docs")))
    forget(docs, large, keyed, pieces, dealt)
    return packed


def meeting_blocks(packed: DataFrame) -> DataFrame:
    """The rows of packed_blocks(), once for each block that they meet in their list and can have a pair with: of
    another component, about the same size and prefixes long enough. A list gives as many rows as it has pairs of
    blocks, however many documents these hold."""
    spans = ("low_component", "high_component", "low_size", "high_size", "low_level", "high_l")
    meets = packed.select("list", F.col("own").alias("other"), *[F.col(c).alias(f"other_{c}") for c in spans])
    one = (F.col("low_component") == F.col("high_component")) & (F.col("other_low_component") == F.col("other_high_component")) & (F.col("low_component") == F.col("other_low_component"))
    near = (F.col("low_size") - F.col("other_high_size") <= SIZE_STEPS) & (F.col("other_low_size") - F.col("high_size") <= SIZE_STEPS)
    deep = (F.col("low_level") <= F.col("other_high_l")) & (F.col("other_low_level") <= F.col("high_l"))
    met = packed.join(meets, "list").where(~one & near & deep)
    return met.select("list", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "docs")


def block_postings(postings: int, tasks: int) -> int:
    """Postings in a block: few enough that hot lists make several pairs of blocks for each task, within bounds
    that keep a pair's matrix and its postings small."""
    return int(min(MOST_BLOCK_POSTINGS, max(LEAST_BLOCK_POSTINGS, postings / (32 * tasks) ** 0.5)))


def _count_dealt(group: pa.Table) -> pa.Table:
    docs = group.column("docs")
    many = pc.list_value_length(docs).to_numpy()
    column = {c: np.repeat(group.column(c).to_numpy(), many) for c in ("list", "own", "low", "high")}
    postings = pa.Table.from_struct_array(pc.list_flatten(docs))
    column |= {c: postings.column(c).to_numpy() for c in POSTING}
    by = np.lexsort((column["list"], column["high"], column["low"]))
    column = {c: v[by] for c, v in column.items()}
    cuts = np.flatnonzero((column["low"][1:] != column["low"][:-1]) | (column["high"][1:] != column["high"][:-1])) + 1
    found = [_count_shared({c: v[x:y] for c, v in column.items()}) for x, y in zip(np.append(0, cuts), np.append(cuts, len(by)))]
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def _count_shared(column: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One pair of blocks, its postings in the order of their lists."""
    low, high = column["low"][0], column["high"][0]
    reps, first, at = np.unique(column["rep"], return_index=True, return_inverse=True)
    of = {c: column[c][first].astype(np.int64) for c in ("component", "n", "lone", "l", "size", "own")}
    sides = [np.flatnonzero(of["own"] == low), np.flatnonzero(of["own"] == high)]
    place = np.zeros(len(reps), np.int64)
    for side in sides:
        place[side] = np.arange(len(side))
    width, level, l = len(sides[1]), column["level"], of["l"]
    counts = np.zeros(len(sides[0]) * width, np.int32)
    left, right = (np.flatnonzero(column["own"] == side) for side in (low, high))
    # Of each left posting, the right ones of its list; taken together in lots.
    begin, end = (np.searchsorted(column["list"][right], column["list"][left], side) for side in ("left", "right"))
    mates = np.concatenate([[0], np.cumsum(end - begin)])
    k = 0
    while k < len(left):
        j = max(k + 1, int(np.searchsorted(mates, mates[k] + LOT, "right")) - 1)
        many = end[k:j] - begin[k:j]
        u = np.repeat(left[k:j], many)
        v = right[np.arange(mates[j] - mates[k]) + np.repeat(begin[k:j] - mates[k:j] + mates[k], many)]
        shared = np.maximum(level[u], level[v]) <= np.minimum(l[at[u]], l[at[v]])
        cell = place[at[u[shared]]] * width + place[at[v[shared]]]
        if len(cell) * 8 > len(counts):
            counts += np.bincount(cell, minlength=len(counts)).astype(np.int32)
        else:
            np.add.at(counts, cell, 1)
        k = j
    i, j = np.divmod(np.flatnonzero(counts), max(width, 1))
    x, y, hits = sides[0][i], sides[1][j], counts[i * width + j]
    n, lone, l = of["n"], of["lone"], np.minimum(of["l"][x], of["l"][y])
    # As in can_link().
    overlap = np.minimum(n[x] - np.where(n[x] >= n[y], lone[x], 0), n[y] - np.where(n[y] >= n[x], lone[y], 0))
    least = -(-PERCENT * (n[x] + n[y]) // (100 + PERCENT))
    need = np.maximum(l, least - np.maximum(-(-PERCENT * n[x] // 100), -(-PERCENT * n[y] // 100)) + l)
    ok = (of["component"][x] != of["component"][y]) & (np.abs(of["size"][x] - of["size"][y]) <= SIZE_STEPS) & (hits >= need) & (overlap >= least)
    if low == high:
        ok &= i < j
    a, b = reps[x[ok]].astype(np.int64), reps[y[ok]].astype(np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns (doc_id, n_shingles, component_id) for each row."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    profile = cut_lineage(texts.mapInArrow(_profile, _PROFILE))
    texts = texts.where("doc_id is not null")
    sets = profile.where("token is null").select("doc_id", "k1", "k2", "n")
    reps = cut_lineage(sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")))
    # Bounded by FREQUENT rows.
    top = profile.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= FREQUENT_LEAST).orderBy(F.desc("df"), "token").limit(FREQUENT).toArrow()
    frequent = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(frequent)
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions_for(docs), int(total * 0.27 / BUCKET_POSTINGS) + 1)
    run = _postings(frequent[by], top["df"].to_numpy().astype(np.int64)[by], buckets)
    found = cut_lineage(texts.mapInArrow(run, _POSTINGS).groupBy("bucket").applyInArrow(_bucket_pairs, _PAIRS))

    shared = found.where("kind = 3").groupBy(F.col("a").alias("doc_id")).agg(F.sum("hits").alias("shared"))
    own = sets.where("n > 0 and doc_id is not null").join(reps, ["k1", "k2", "n"]).join(shared, "doc_id").groupBy("doc_id").agg(F.min(F.struct("rep", "n", "shared")).alias("own"))
    # Tokens of the shortest prefix that no other document posts; a larger one may hold them all the same.
    lone = F.greatest(F.lit(0), F.col("own.n") - F.ceil(F.col("own.n") * PERCENT / 100) + 1 - F.col("own.shared"))
    own = cut_lineage(own.select("doc_id", "own.rep", "own.n", lone.alias("lone")))
    raw = found.where("kind < 2").groupBy("a", "b").agg(F.max("need").alias("l"), F.sum("hits").alias("hits"))
    for side in "ab":
        raw = raw.join(own.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "lone")]), side)
    raw = raw.where(F.col("rep_a") != F.col("rep_b")).where(can_link("a", "b"))
    pairs = raw.groupBy(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    pairs = cut_lineage(pairs.agg(F.max("hits").alias("hits"), F.min(least_hits("l", "n_a", "n_b")).alias("need")))
    tried = pairs.where("hits >= need").select("a", "b")
    links = cut_lineage(verified(tried, texts))
    labels = connected_components(links)

    lists = found.where("kind = 2").select(
        F.col("a").alias("list"), F.col("b").alias("doc"), (F.col("need") / 16).cast("int").alias("level"), (F.col("need") % 16).alias("l"), (F.col("hits") / 128).cast("int").alias("size"), (F.col("hits") % 128).alias("share")
    )
    lists = lists.join(own.withColumnRenamed("doc_id", "doc"), "doc").groupBy("list", "rep", "n").agg(F.min("lone").alias("lone"), *[F.min(c).alias(c) for c in ("level", "l", "size", "share")])
    known = cut_lineage(lists.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    several = cut_lineage(known.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("list"))
    lists = cut_lineage(known.join(several, "list", "left_semi"))
    forget(known, several)
    # Tokens of short lists, or of a long list's central document, count as well.
    some = pairs.where("hits < need")
    for side in "ab":
        some = some.join(lists.groupBy(F.col("rep").alias(side)).agg(F.min("component").alias(f"component_{side}")), side)
    across = across_components(lists)
    more = across.unionByName(some.where("component_a <> component_b").select("a", "b")).distinct()
    more = cut_lineage(more.join(tried, ["a", "b"], "left_anti"))
    forget(across, lists, pairs, own, found)
    if not more.isEmpty():
        forget(labels)
        labels = connected_components(links.unionByName(verified(more, texts)))
    forget(more, links)

    classes = reps.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = cut_lineage(sets.join(classes, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    forget(profile, reps, labels)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate class: the one with the smallest doc_id.
    Rows without a doc_id belong to no class and stay."""
    first = near_duplicate_classes(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
