"""The registered queries of this package and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    block_clusters,
    decontaminate,
    embedding_dedup,
    license_rules,
    ngram_join,
    pii_crf,
    quality_net,
    secret_ledger,
    spelling_variants,
    token_counts,
    token_packing,
    url_filter,
    vector_packing,
)
from barloom.llm.shared import shared_folder, table


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.find_licenses(table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a ledger on disk: a first run scans and records every blob; the second, whose findings these are, reads
    the ledger back and scans what it lacks."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    secret_ledger.append_ledger(secret_ledger.scan_history(docs, ["doc_id"], ledger=secret_ledger.read_ledger(spark, path)), path)
    return secret_ledger.secret_digest(docs, ledger=secret_ledger.read_ledger(spark, path))


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


def op2_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.packed_digest(table(spark, sf_dir, "documents"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"))


def vector_packing_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7, with capacities for documents and attention that bind, chosen by dot product."""
    return vector_packing.pack(table(spark, sf_dir, "documents"), vector_packing.BINDING)


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of pages whose title holds junk marks."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.junk_pages(pages))


def op12_block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_clusters.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": op1_pii_crf,
    "op2_pigeonhole_edit": op2_pigeonhole_edit,
    "op3_ngram_join": op3_ngram_join,
    "op4_license_rules": op4_license_rules,
    "op5_secret_ledger": op5_secret_ledger,
    "op6_token_packing": op6_token_packing,
    "op7_vector_packing": op7_vector_packing,
    "op8_quality_net": op8_quality_net,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_url_filter": op11_url_filter,
    "op12_block_clusters": op12_block_clusters,
    "op13_spelling_variants": op13_spelling_variants,
    "vector_packing_limits": vector_packing_limits,
}


# Written out, not taken from the implementation: kind, pattern, group whose length counts, least length.
SECRET_PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a match is a whole run, so short ones need not be listed
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 1),
    ("hub", r"gh[opsur]_[0-9A-Za-z]{36,}", 0, 1),
)


def _secret_sql() -> str:
    """Spans by splitting at the matches; offsets are sums of what lies before."""
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(SECRET_PATTERNS):
        p = pattern.replace("'", "''")
        gaps, found = f"string_split_regex(t, '{p}')", f"regexp_extract_all(t, '{p}', 0)"
        spans.append(
            f"""SELECT doc_id, n, {rank} AS rank, '{kind}' AS kind, i, {"s + length(m) - length(z)" if kind == "jwt" else "s"} AS b, s + length(m) AS e FROM (SELECT doc_id, n, i, m[i] AS m, z[i] AS z,
 list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
 FROM (SELECT doc_id, n, {gaps} AS g, {found} AS m, regexp_extract_all(t, '{p}', {group}) AS z, unnest(range(1, len({found}) + 1)) AS i FROM d)) WHERE length(z) >= {least}"""
        )
    joined = "coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents), s AS ({" UNION ALL ".join(spans)})
SELECT d.doc_id, {counts}, sha256({joined} FILTER (rank < 3), '')) AS base_sha256, {joined}, '') AS spans, sha256(any_value(t)) AS blob FROM d LEFT JOIN s ON d.n = s.n GROUP BY d.n, d.doc_id"""


URL_SQL = r"""WITH p AS (SELECT page_id, html, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&') AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|\z)'))) AS ps FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, ':(80|443)\z', ''), '^www\.|\.\z', '', 'g') || regexp_replace(path, '/+\z', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS key FROM k),
bad AS (SELECT DISTINCT key FROM c WHERE regexp_matches(html, '<title>[^<]*([#]{3}|[%]{3}|[*]{3}|[$]{3})') AND key IS NOT NULL),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, c.host, c.path, rule, coalesce(v, CASE WHEN key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path"""


def _cluster_sql() -> str:
    """Every distance to every centroid, round by round."""
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 2097152)) = 64)""",
        "c0 AS (SELECT k - 1 AS k, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS k, v FROM v) WHERE k <= 16)",
    ]
    for t in range(4):
        steps.append(
            f"""d{t} AS (SELECT r, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT r, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{t}) GROUP BY r)"""
        )
        if t < 3:
            steps.append(
                f"""s{t} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM d{t} JOIN v USING (r)) GROUP BY k, j)"""
            )
            # Integer division truncates; one less where a remainder is negative.
            steps.append(f"m{t} AS (SELECT k, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS c FROM s{t} GROUP BY k)")
            steps.append(f"c{t + 1} AS (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON c{t}.k = m{t}.k)")
    return f"""WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT vec_id, CAST(d3.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY d3.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c3.c, ',')) AS centroid_sha256 FROM d3 JOIN v USING (r) JOIN c3 ON d3.k = c3.k"""


SPELLING_SQL = r"""WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) x(i)),
run AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)),
occ AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM occ, t),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS w, n FROM h) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
i AS MATERIALIZED (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
e AS (SELECT w, n, i, left(w, i - 1) || '?' || substring(w, i + 1) AS k FROM i),
g AS (SELECT DISTINCT w, n, left(w, i - 1) || substring(w, i + 1) AS k FROM i),
near AS MATERIALIZED (SELECT a.w AS w, b.w AS x, b.n AS n FROM e a JOIN e b ON a.k = b.k AND a.w <> b.w UNION ALL SELECT g.w, v.w, v.n FROM g JOIN v ON g.k = v.w UNION ALL SELECT v.w, g.w, g.n FROM g JOIN v ON g.k = v.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS m FROM near GROUP BY w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN m END AS form_n, CASE WHEN m >= 2 * v.n THEN (SELECT min(x) FROM near WHERE near.w = v.w AND near.n = m) END AS form FROM v LEFT JOIN best ON v.w = best.w),
r AS (SELECT w, w AS root, 0 AS k FROM f UNION ALL SELECT r.w, f.form, k + 1 FROM r JOIN f ON r.root = f.w WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, root, f.n, n_near, form_n FROM f JOIN (SELECT w, arg_max(root, k) AS root FROM r GROUP BY w) z ON f.w = z.w"""


ORACLE_SQL: dict[str, str] = {
    "op11_url_filter": URL_SQL,
    "op12_block_clusters": _cluster_sql(),
    "op13_spelling_variants": SPELLING_SQL,
    "op5_secret_ledger": _secret_sql(),
    "op3_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT g.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON g.doc_id = c.a""",
}
