"""Secret scan over every historical version of a set of paths, by an incremental blob ledger.

Each version's text is content-addressed by its SHA-256. The ledger holds one row for each
(blob, rule version) pair that was ever scanned, with the spans found in it; the rule version is a digest of
the rules themselves, so changed rules never meet old findings. A run scans only the pairs the ledger lacks,
each distinct blob once, and joins the spans back to every path that holds the blob; of the ledger, only rows
of blobs at hand go on. All of it is DataFrame expressions; no row leaves the JVM.

Defined results: a null text counts as the empty blob; equal texts share one blob, repeated rows
stay repeated in the findings; repeated ledger rows, as a run that was written twice leaves, count once; an
empty table gives empty findings; columns beside the named ones are ignored, whatever their names. Spans are
code-point offsets, end exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage

#: Matches whose places are summed in one go.
CHUNK = 256
#: Unseen blobs whose identifiers (64 characters each) are sent to all tasks; more are joined by a shuffle.
FEW_BLOBS = 100_000
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and what a match must have: at least `least` characters in group `group`.
    `hint`: a text without it has no match (None: try the pattern)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    hint: str | None = None


# The base patterns, in their given order, then the added ones.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0, False, "PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", 0, 0, False, ".eyJ"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, "gh"),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of the rules in their order."""
    return hashlib.sha256(repr([astuple(rule) for rule in rules]).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches that pass: what lies between the matches
    (split) and the matches themselves (regexp_extract_all) give the offsets by a running sum."""
    empty = F.array().cast(SPANS)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("match"),
        F.transform(sized, F.char_length).alias("size"),
    )
    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + F.coalesce(part["match"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = part["match"].isNotNull() & (part["size"] >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["found"], span)).otherwise(acc["found"]).cast(SPANS).alias("found"))

    def width(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda total, part: total + part["gap"] + F.coalesce(part["match"], F.lit(0)))

    # An appended array is a copied one, so sums run inside chunks and over the chunks' widths. What a lambda
    # names from outside is computed again at each call; parts and chunks are bound as arguments instead.
    def in_chunks(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda k: F.slice(parts, k * CHUNK + 1, CHUNK))

    def placed(chunks: Column) -> Column:
        starts = F.aggregate(F.transform(chunks, width), F.array(F.lit(0)), lambda at, w: F.array_append(at, F.element_at(at, -1) + w))
        spans = F.zip_with(chunks, F.slice(starts, 1, F.size(chunks)), lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("found")), step, lambda acc: acc["found"]))
        return F.flatten(spans)

    chunks = F.transform(F.array(parts), in_chunks)
    found = F.transform(chunks, placed)[0]
    has = text.rlike(rule.pattern)
    if rule.hint:
        has = text.contains(rule.hint) & has
    return F.when(has, found).otherwise(empty)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules, by start, then by the rules' order."""
    return F.sort_array(F.concat(*[_spans(text, rule, rank) for rank, rule in enumerate(rules)]))


@dataclass
class LedgerScan:
    findings: DataFrame
    ledger: DataFrame


def scan_history(
    versions: DataFrame,
    path_cols: list[str],
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> LedgerScan:
    """versions: one row for each path and historical version. ledger: (blob, rule_version, spans)
    of earlier runs. Returns findings (path columns, blob, spans) for every row of versions, and
    the ledger's new rows, to be appended (append_ledger) once the findings are written."""
    version = version_of(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # (blob, body) is the key of a hash aggregate, so that no text is sorted; equal blobs have equal bodies.
    blobs = versions.select(blob_id(text).alias("blob"), text.alias("body"))
    seen = None
    if ledger is not None and not ledger.isEmpty():
        at_hand = versions.select(blob_id(text).alias("blob")).distinct()
        seen = ledger.where(F.col("rule_version") == version).select("blob", F.col("spans").cast(SPANS).alias("spans"))
        seen = seen.join(at_hand, "blob", "left_semi").groupBy("blob").agg(F.first("spans").alias("spans"))
        # Decided on identifiers alone, so that seen texts are neither shuffled nor scanned.
        unseen = cut_lineage(at_hand.join(seen.select("blob"), "blob", "left_anti"))
        n = unseen.count()
        if n == 0:
            blobs = blobs.limit(0)
        else:
            blobs = blobs.join(F.broadcast(unseen) if n <= FEW_BLOBS else unseen.hint("merge"), "blob", "left_semi")
    fresh = blobs.distinct().select("blob", find_spans(F.col("body"), rules).alias("spans"))
    known = fresh.unionByName(seen) if seen is not None else fresh
    paths = versions.select(*path_cols, blob_id(text).alias("blob"))
    return LedgerScan(
        paths.join(known, "blob", "left").select(*path_cols, "blob", "spans"),
        fresh.select("blob", F.lit(version).alias("rule_version"), "spans"),
    )


LEDGER = f"blob string, rule_version string, spans {SPANS}"


def append_ledger(scan: LedgerScan, path: str) -> None:
    """Add a scan's new rows to the ledger at path, a Parquet table with a folder for each rule version."""
    scan.ledger.write.mode("append").partitionBy("rule_version").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; empty before the first run."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, the digest of the base spans, and all spans."""
    base = [rule.kind for rule in RULES if rule.base]
    found = scan_history(docs, ["doc_id"], ledger=ledger).findings
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(F.encode(joined_spans(F.filter(spans, lambda s: s["rank"] < len(base))), "UTF-8"), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        F.col("blob"),
    )


def without_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs, all columns, without the rows whose text holds a secret. The rows travel as one struct, so
    that no column's name can clash with the ledger's."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = scan_history(rows, ["row"], ledger=ledger).findings
    return found.where(F.size("spans") == 0).select("row.*")
