"""Every operator on odd rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, license_rules, ngram_join, pii_crf, quality_net, secret_ledger, token_counts, token_packing, vector_packing

BENCH = "item_id long, text string"


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "two words"), (None, "x")], BENCH)


def labels(spark):
    return spark.createDataFrame([(5, 1), (6, None), (4, 0), (99, 1)], "doc_id long, quality int")


OPERATORS = {
    "pii": lambda s, d: pii_crf.find_personal_data(d),
    "leaks": lambda s, d: decontaminate.find_leaks(d, bench(s)),
    "ngram": lambda s, d: ngram_join.near_duplicate_classes(d),
    "license": lambda s, d: license_rules.find_licenses(d),
    "secrets": lambda s, d: secret_ledger.secret_digest(d),
    "rows": lambda s, d: token_packing.packed_digest(d),
    "pack": lambda s, d: vector_packing.pack(d),
    "quality": lambda s, d: quality_net.quality_scores(d, labels(s)),
    "counts": lambda s, d: token_counts.count_tokens(d),
}
ONE_EACH = {"pii", "ngram", "secrets", "quality", "counts"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    if name in ONE_EACH:
        assert len(got) == odd.count()
    if name == "pack":
        assert len([r for r in got if r.piece == 0]) == odd.count()
    if name == "rows":
        assert len({(r.row_id, r.segment) for r in got if r.start == 0}) == odd.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).collect() == []


def test_classes_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_duplicate_classes(odd).where("doc_id is not null").collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3
    assert got[(5, 6)] == got[(6, 6)] == got[(7, 6)] == 5
    assert got[(8, 1)] == got[(9, 1)] == 8


def test_row_keeping_forms(spark, odd):
    assert set(ngram_join.one_of_each(odd).columns) == set(odd.columns)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(odd).where("doc_id is not null").select("doc_id").collect()) == [1, 2, 3, 4, 5, 8, 10, 11, 12]
    assert ngram_join.one_of_each(odd).where("doc_id is null").count() == 2
    kept = decontaminate.without_leaks(odd, bench(spark))
    assert kept.schema == odd.schema and {5, 6, 7, 8, 9} & {r.doc_id for r in kept.collect()} == set()
    safe = secret_ledger.without_secrets(odd)
    # A run of 70,000 hex digits is a secret by the base pattern.
    assert safe.columns == odd.columns and safe.count() == odd.count() - 1
    assert quality_net.keep_good(odd, labels(spark)).columns == odd.columns
    assert odd.where(F.col("doc_id") == 5).count() == 2
