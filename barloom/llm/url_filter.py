"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest fitting rule (host and
path together) decides. What no rule fits is judged by the list: the canonical form of a URL is probed in a blocked
Bloom filter of the listed ones, and only possible hits are joined with the list itself, by their whole canonical form,
so a false positive never blocks. All of it is DataFrame expressions; no row leaves the JVM.

The filter is a table of blocks of 256 bits, at about BITS bits a listed URL and never more than MOST_BLOCKS blocks
(32 MB), so its broadcast has a fixed bound; a list beyond that makes more possible hits, not other results. The join
of possible hits is salted SALTS times, so a URL that holds a third of all rows is spread over tasks.

Canonical form: host in lower case (A-Z) without a default port, a leading "www." and a final dot; path without
trailing slashes; query parameters sorted, tracking ones and empty ones left out; no scheme, no fragment.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule and is never listed (allow);
repeated rows stay repeated; repeated, null and malformed listed URLs count once or not at all; an empty list allows all
that no rule blocks; an empty table gives no rows; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage

BITS = 12
MOST_BLOCKS = 1 << 20
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Query parameters that only track.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|\z)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """From after the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form under which URLs of one resource are equal; NULL for what is no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"^www\.|\.\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """An attribute of the longest rule that fits; NULL without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four words of a block, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit(1))

    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_blocks(known: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 to w3): the filter's blocks in which a bit is set."""
    masked = known.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{w}") for w, m in enumerate(_masks(F.col(key)))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """One row for each row of pages: the id, host, path, the name of the deciding rule (or NULL), and the verdict."""
    known = cut_lineage(listed.select(canonical(F.col(listed_col)).alias("key")).where("key is not null").distinct())
    blocks = min(MOST_BLOCKS, max(1, -(-known.count() * BITS // 256)))
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    ruled = read.withColumns({"rule": fitting_rule(F.col("host"), F.col("path"), rules, "name"), "verdict": fitting_rule(F.col("host"), F.col("path"), rules, "verdict")})
    words = F.broadcast(bloom_blocks(known, "key", blocks))
    probed = ruled.withColumn("block", _block(F.col("key"), blocks)).join(words, "block", "left")
    hit = F.col("rule").isNull() & F.col("key").isNotNull() & F.col("block").isNotNull()
    for w, mask in enumerate(_masks(F.col("key"))):
        hit = hit & F.coalesce(F.col(f"w{w}").bitwiseAND(mask) == mask, F.lit(False))
    probed = probed.withColumn("hit", hit)
    out = ["page_id", "host", "path", "rule"]
    decided = probed.where(~F.col("hit")).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    salted = known.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit("block").alias("found"))
    possible = probed.where("hit").withColumn("salt", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int"))
    checked = possible.hint("merge").join(salted, ["key", "salt"], "left")
    return decided.unionByName(checked.select(*out, F.coalesce("found", F.lit("allow")).alias("verdict")))


#: Titles with junk marks put a page's URL on the list of the registered query.
JUNK = r"(?s)<title>[^<]*([#]{3}|[%]{3}|[*]{3}|[$]{3})"


def junk_pages(pages: DataFrame) -> DataFrame:
    """(url) of pages whose title holds a run of three junk marks."""
    return pages.where(F.col("html").rlike(JUNK)).select("url")
