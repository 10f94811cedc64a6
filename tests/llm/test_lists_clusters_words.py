"""URL filter, centroid clustering and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import block_clusters, spelling_variants, url_filter
from barloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages".split()


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_block_clusters", "op13_spelling_variants"])
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    made = QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))


# --- URL filter


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1", "http://example.org/en/12?x=1", "http://example.org/en/2", "http://a.b.example.org/en/1", "http://notexample.org/es/", "http://org/", "http://org",
    "https://x.com/fr/a", "https://x.com/de/a#b", "https://x.com/es/", "ftp://x.net/a/b//", "http://www.x.net:80/a/b?utm_source=q", "http://x.net./a/b?ref=1#f", "http://x.net/a/b?b=2&a=1&&", "https://X.net/a/b?a=1&b=2",
    "http://x.net/A/b", "http://x.net/a/b/c", "://h/p", "a://b://c", "http://h?q/x", "http://h#f?x", "http://y.net/\nnew", "http://y.net/" + "z" * 100_000, "http://İ.net/é", "http://user@x.net:8080/a",
]
LISTED = [None, "", "plain", "http://x.net/a/b", "http://x.net/a/b", "https://x.net/a/b?b=2&a=1", "http://y.net/" + "z" * 100_000, "http://h#z", "http://x.com/de/a"]


def plain_key(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = rest[len(host) + len(path) :].split("#")[0].removeprefix("?")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    host = re.sub(r"\.\Z", "", re.sub(r":(80|443)\Z", "", host)).removeprefix("www.")
    kept = sorted((p for p in query.split("&") if p and p.split("=")[0] not in ("gclid", "fbclid", "ref") and not p.split("=")[0].startswith("utm_")), key=str.encode)
    return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        rule = max(fits, key=lambda r: len(r.name))
        return host, path, rule.name, rule.verdict
    key = plain_key(url)
    return host, path, None, "block" if key is not None and key in listed else "allow"


@pytest.mark.parametrize("most_blocks", [1 << 20, 1])
def test_verdicts_equal_plain_ones(spark, monkeypatch, most_blocks):
    """With a single block nearly all probes are possible hits, and the join alone decides."""
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most_blocks)
    more = [f"http://s{k}.net/p" for k in range(300)]
    pages = spark.createDataFrame([(k, u, "w0", "key", "salt") for k, u in enumerate(URLS + URLS + more)], "page_id long, url string, w0 string, key string, salt string")
    listed = spark.createDataFrame([(u,) for u in LISTED + more[::7]], "url string")
    keys = {plain_key(u) for u in LISTED + more[::7]} - {None}
    got = url_filter.judge_urls(pages, listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(k, *plain_verdict(u, keys)) for k, u in enumerate(URLS + URLS + more)]


def test_filter_holds_every_listed_url_and_few_others(spark):
    known = spark.range(20_000).selectExpr("concat('x.net/', id) as key")
    blocks = 20_000 * url_filter.BITS // 256
    filled = {r.block: r for r in url_filter.bloom_blocks(known, "key", blocks).collect()}
    assert len(filled) <= blocks
    from pyspark.sql import functions as F

    probes = spark.range(40_000).selectExpr("concat('x.net/', id) as key").select("key", url_filter._block(F.col("key"), blocks).alias("b"), *[m.alias(f"m{w}") for w, m in enumerate(url_filter._masks(F.col("key")))]).collect()
    hits = [int(p.key[6:]) for p in probes if p.b in filled and all(filled[p.b][f"w{w}"] & p[f"m{w}"] == p[f"m{w}"] for w in range(4))]
    assert sum(k < 20_000 for k in hits) == 20_000 and sum(k >= 20_000 for k in hits) < 600


def test_empty_urls_and_lists(spark):
    pages = spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(pages, none).collect()) == [(1, "allow"), (2, "allow")]
    assert url_filter.judge_urls(pages.limit(0), pages).collect() == []


def test_hot_url_is_spread_and_no_python_runs(spark, capsys):
    pages = spark.range(4000).selectExpr("id as page_id", "'http://x.net/hot' as url")
    made = url_filter.judge_urls(pages, pages.limit(1))
    assert made.where("verdict = 'block'").count() == 4000
    made.explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    from pyspark.sql import functions as F

    assert pages.select(F.pmod(F.xxhash64("page_id", F.lit("x.net/hot")), F.lit(url_filter.SALTS)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0] < 400


# --- Centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and max(abs(x) for x in v) * 64 < 2**27]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return [(i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, at)]


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 64))
    rows = [(k, (centres[k % 9] + rng.normal(size=64) * 0.3).astype(np.float32).tolist()) for k in range(260)]
    rows += [(300 + k, rows[0][1]) for k in range(40)] + [(7, rows[5][1]), (7, rows[6][1]), (None, rows[8][1]), (None, rows[9][1])]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [float("nan")] + [1.0] * 63), (406, [float("inf")] + [0.0] * 63), (407, [0.0] * 64), (408, [3e38] + [0.0] * 63)]
    return rows + [(409, [1000.0] * 64), (410, [-1000.0] * 64), (411, [2_000_000.0] * 64)]


@pytest.mark.parametrize("rows", [vectors(), vectors()[:5], vectors()[300:], [(1, [0.0] * 64)] * 30], ids=["all", "few", "odd", "equal"])
def test_clusters_equal_plain_ones(spark, rows):
    made = spark.createDataFrame([(i, v, "v", 1, "norms") for i, v in rows], "vec_id long, embedding array<float>, v string, n long, norms string")
    got = block_clusters.cluster_report(made.repartition(5))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_clusters(rows)))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_clusters.cluster_report(none).collect() == []
    assert block_clusters.cluster_report(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_screening_spares_exact_distances():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-40, 40, (16, 64)) * np.repeat(rng.integers(0, 5, (16, 8)), 8, 1)
    v = centroids[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))
    norms = np.sqrt(np.add.reduceat((v * v).astype(float), np.arange(0, 64, 8), 1))
    at, d, exact = block_clusters.nearest(v, norms, centroids)
    every = ((v[:, None, :] - centroids[None]) ** 2).sum(-1)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    assert (block_clusters.lower_bounds(norms, np.sqrt(np.add.reduceat((centroids**2).astype(float), np.arange(0, 64, 8), 1))) <= every).all()
    assert exact < 0.3 * every.size


# --- Spelling variants


def plain_variants(rows, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    near = defaultdict(set)
    by_length = defaultdict(list)
    for w in v:
        by_length[len(w)].append(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k:] == b[k + 1 :]

    for n, words in list(by_length.items()):
        for a in words:
            for b in words + by_length.get(n + 1, []):
                if a != b and one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x.encode()), default=None)
        form[w] = best if best is not None and v[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(map(repr, ((w, form[w], root(w), n, len(near[w]), v[form[w]] if form[w] else None) for w, n in v.items())))


def word_rows():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.choice((5, 20, 60))])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abcdeéü"), w[k] * 2]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    long_run = "ab" * 15_000
    rows += [(500 + k, long_run) for k in range(4)] + [(510 + k, long_run + "b") for k in range(3)] + [(520 + k, long_run[:-1] + "c") for k in range(9)]
    rows += [(600, None), (601, ""), (602, "1234 \n"), (None, "nulls nulls nulls nullz nullz nullz"), (None, None), (603, "aaaaa " * 3 + "aaaaaa " * 7 + "aaaaaaa " * 20), (603, "aaaaa " * 3)]
    return rows + [(604, "Àààààà àààààà ÀÀÀÀÀÀ " * 4), (605, "×÷×÷× " * 4), (606, "zzzzy zzzzy zzzzy zzzzx zzzzx zzzzx " * 2 + "zzzzw " * 3)]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_variants_equal_plain_ones(spark, monkeypatch, piece):
    monkeypatch.setattr(spelling_variants, "PIECE", piece)
    rows = word_rows()
    docs = spark.createDataFrame([(i, t, "word", 5, "k1") for i, t in rows], "doc_id long, text string, word string, n long, k1 string").repartition(6)
    got = spelling_variants.spelling_variants(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_variants(rows)


def test_no_words(spark):
    none = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert spelling_variants.spelling_variants(none).collect() == []
    assert spelling_variants.spelling_variants(none.limit(0)).collect() == []


def test_keys_meet_exactly_at_one_edit():
    words = ["abcde", "abcdd", "abde", "abcdde", "xbcde", "aaaaa", "aaaa"]
    keys = {w: list(spelling_variants.keys_of(w)) for w in words}
    wild = {w: {k[1:] for k in keys[w] if k[0] == spelling_variants.WILD} for w in words}
    gone = {w: {k[1:] for k in keys[w] if k[0] == spelling_variants.GONE} for w in words}
    whole = {w: next(k[1:] for k in keys[w] if k[0] == spelling_variants.WORD) for w in words}
    assert len(wild["abcde"] & wild["abcdd"]) == 1 and len(wild["abcde"] & wild["xbcde"]) == 1 and not wild["abcdd"] & wild["xbcde"]
    assert whole["abde"] in gone["abcde"] and whole["abcde"] in gone["abcdde"] and whole["abcdd"] in gone["abcdde"]
    assert len(gone["aaaaa"]) == 1 and whole["aaaa"] in gone["aaaaa"]


def test_long_texts_hold_little(spark):
    """Counting goes on by pieces; a run longer than a piece stays whole."""
    counts = Counter()
    spelling_variants.words_of(1, "Hello " * 400_000 + "q" * 3_000_000 + " World" * 3, counts, damage=0)
    assert counts["hello"] == 400_000 and counts["q" * 3_000_000] == 1 and counts["world"] == 3
