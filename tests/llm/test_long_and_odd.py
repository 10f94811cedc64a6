"""Long texts in linear time, labels of documents that are not at hand, and licence rules against a plain matcher."""

import random
import time
import warnings

import pytest

from barloom.llm import license_rules, pii_crf, quality_net, secret_ledger
from barloom.llm.queries import QUERIES

CONTACT = "Call (555) 555-1234 or write to ann.lee@mail.example.com é\n"


def test_many_added_spans_take_linear_time(spark):
    docs = spark.createDataFrame([(1, CONTACT), (2, CONTACT * 50), (3, CONTACT * 20_000)], "doc_id long, text string").coalesce(1)
    pii_crf.find_personal_data(docs.where("doc_id < 3")).collect()  # trains and starts the worker
    began = time.time()
    got = {r.doc_id: r for r in pii_crf.find_personal_data(docs).collect()}
    assert time.time() - began < 30
    assert got[3].n_email == 20_000 and got[2].n_email == 50
    # Spans are code points: each repetition of a text of equal lines lies one line's characters further on.
    one, fifty = got[1].spans.split(","), got[2].spans.split(",")
    assert len(fifty) >= 50 and one[-1].startswith("email:")
    moved = [f"{k}:{int(a) + len(CONTACT) * 49}:{int(b) + len(CONTACT) * 49}" for k, a, b in (s.split(":") for s in one)]
    assert fifty[-1] == moved[-1]


def test_added_spans_never_meet_base_ones(spark):
    docs = spark.createDataFrame([(1, CONTACT * 30 + "call (415) 555-0199 now, server (10.1.2.3) up")], "doc_id long, text string")
    spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in pii_crf.find_personal_data(docs).first().spans.split(","))]
    text = docs.first().text
    base = [(a, b) for a, _, b in pii_crf.base_spans(text)]
    assert not [(x, y) for x in set(spans) - set(base) for y in base if x[0] < y[1] and y[0] < x[1]]


@pytest.mark.parametrize("text", ["." * 1_000_000 + "x", ".:;!? " * 150_000, " " * 500_000 + "\n" * 500_000, "a.b" * 300_000, "\n \n" * 300_000])
def test_runs_of_stops_take_linear_time(text):
    match = license_rules.Recogniser().matches
    began = time.time()
    assert match(text) == []
    assert time.time() - began < 10


def plain_licenses(text):
    """Sentences found sign by sign, lines joined in every way, rules tried one by one."""
    text, parts, now, k = text.lower(), [], "", 0
    while k < len(text):
        end = k
        while end < len(text) and text[end] in ".!?;:":
            end += 1
        if end > k and (end == len(text) or text[end].isspace()):
            parts.append(now)
            now, k = "", end
            continue
        if end > k:
            now, k = now + text[k:end], end
            continue
        if text[k] == "\n":
            end = k + 1
            while end < len(text) and text[end].isspace() and text[end] != "\n":
                end += 1
            if end < len(text) and text[end] == "\n":
                parts.append(now)
                now, k = "", end + 1
                continue
        now, k = now + text[k], k + 1
    parts.append(now)

    def normal(x):
        return " ".join("".join(c if c.isalnum() else " " for c in x).split())

    rec = license_rules.Recogniser()
    seen, number = [], 0
    for part in parts:
        lines = [x for x in map(normal, part.split("\n")) if x]
        k = 0
        while k < len(lines):
            known = [e for e in range(k + 1, len(lines) + 1) if " ".join(lines[k:e]) in rec.ids]
            if known:
                seen.append((number, rec.ids[" ".join(lines[k : known[-1]])]))
            number, k = number + 1, known[-1] if known else k + 1
    out, k = [], 0
    flat = sorted((-len(row), order, rule, license_, row) for same in rec.rules.values() for _, order, rule, license_, row in same)
    while k < len(seen):
        for _, _, rule, license_, row in flat:
            part = seen[k : k + len(row)]
            if [x for _, x in part] == list(row) and all(b - a <= rec.gap + 1 for (a, _), (b, _) in zip(part, part[1:])):
                out.append((license_, rule, part[0][0], part[-1][0], len(row)))
                k += len(row)
                break
        else:
            k += 1
    return out


def test_licenses_equal_a_plain_matcher(spark, sf_dir, texts):
    want = sorted((i, *m) for i, t in texts.items() for m in plain_licenses(t))
    assert sorted(map(tuple, QUERIES["op4_license_rules"](spark, sf_dir).collect())) == want
    rng = random.Random(11)
    sentences = list(license_rules.SENTENCES.values()) + ["SPDX-License-Identifier: MIT", "Nothing to see", "v. 2.0", "Apache License", "...", "::"]
    match, found = license_rules.Recogniser().matches, 0
    for _ in range(400):
        text = ""
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(sentences).split(" ")
            text += "".join(w + (rng.choice(["\n", "\n\n", " \n \n"]) if rng.random() < 0.05 else " ") for w in words).strip() + rng.choice([". ", ".\n", "\n\n", "; ", ".", " ", "...\n"])
        got = match(text)
        found += len(got)
        assert got == plain_licenses(text), text
    assert found > 200


def test_foreign_labels_change_no_score(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    foreign = spark.range(10_000_000, 10_060_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    one = {r.doc_id: r.score for r in quality_net.quality_scores(docs, labels).collect()}
    both = {r.doc_id: r.score for r in quality_net.quality_scores(docs, labels.select("doc_id", "quality").unionByName(foreign)).collect()}
    assert one == both and len(set(one.values())) > 100
    kept = quality_net.keep_good(docs, labels.select("doc_id", "quality").unionByName(foreign))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in one.items() if s >= quality_net.THRESHOLD}


def test_too_few_labels_are_said(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert {r.score for r in quality_net.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {1.0}
    assert any("usable labels" in str(w.message) for w in said)


def test_web_tokens_with_long_headers(spark):
    head = "eyJ" + "a-_9" * 2000
    rows = [(1, f"auth {head}.eyJ{'b' * 4000}.{'c' * 40} end"), (2, f"x{head}.eyJ{'b' * 30}.cc"), (3, f"={head[:30]}.eyJ{'b' * 30}.cc,{head[:30]}.eyJ{'b' * 30}.dd"), (4, "eyJ" * 300_000 + ".eyJ"), (5, "eyJshort.eyJ1234567890.x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("jwt")] for r in secret_ledger.secret_digest(docs).collect()}
    assert time.time() - began < 30
    assert got == {1: [f"jwt:5:{5 + len(head) + 1 + 4003 + 1 + 40}"], 2: [], 3: [f"jwt:1:{1 + 30 + 1 + 33 + 3}", f"jwt:69:{69 + 67}"], 4: [], 5: []}


def test_registered_ledger_scans_nothing_twice(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "ledger")
    first = secret_ledger.scan_history(docs, ["doc_id"], ledger=secret_ledger.read_ledger(spark, path))
    secret_ledger.append_ledger(first, path)
    again = secret_ledger.scan_history(docs, ["doc_id"], ledger=secret_ledger.read_ledger(spark, path))
    assert again.ledger.count() == 0
    more = docs.unionByName(docs.limit(1).selectExpr("doc_id + 1000000 as doc_id", "'password = hunter22x' as text", "lang", "source", "n_chars"))
    third = secret_ledger.scan_history(more, ["doc_id"], ledger=secret_ledger.read_ledger(spark, path))
    assert third.ledger.count() == 1
    plain = sorted(map(tuple, secret_ledger.secret_digest(more).collect()))
    assert sorted(map(tuple, secret_ledger.secret_digest(more, ledger=secret_ledger.read_ledger(spark, path)).collect())) == plain
