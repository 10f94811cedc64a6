"""The corpus pipeline, stage by stage."""

import pytest

import corpus_pipeline
from barloom.llm import decontaminate, shared
from barloom.llm.shared import cut_lineage, table


def test_stages(spark, sf_dir):
    from tests.llm.test_text import classes_of, plain_secrets

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()} if "text" in docs.columns else {}
        docs = cut_lineage(stage(spark, docs, sf_dir))
        seen[name] = docs
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != names[-1]:
            assert docs.columns == columns and docs.count() == len(after)
        if name == "near_duplicates":
            assert after == {i for i, (_, c) in classes_of(before).items() if i == c}
        if name == "benchmark_leaks":
            items = [decontaminate.normal(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            assert after <= {i for i, t in before.items() if not any(x in decontaminate.normal(t) for x in items)}
        if name == "secrets":
            extra = {i for i in before if i not in after and not plain_secrets(before[i])}
            assert after <= {i for i, t in before.items() if not plain_secrets(t)} and not extra
        if name == "packing":
            assert after == set(before)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = {r.doc_id for r in seen["quality"].collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in clean) >= 0.95 * len(clean)
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["packing"].count()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_and_empty_tables(spark, odd, sf_dir, tmp_path, rows):
    """Every stage, one after the other, on odd rows and on none; clashing columns stay to the last."""
    docs = odd if rows == "odd" else odd.limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (source if rows == "odd" else source.limit(0)).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, str(tmp_path)))
        assert docs.columns == odd.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) == docs.select("doc_id").distinct().count()
    assert sum(r.piece == 0 for r in packed) == docs.count() and bool(packed) == (rows == "odd")


def test_shared_folder(spark, monkeypatch):
    class Far:
        class sparkContext:
            master, applicationId = "spark://far:7077", "app"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        shared.shared_folder(Far)
    made = cut_lineage(spark.range(3))
    assert made.table_path.startswith(shared.shared_folder(spark)) and made.count() == 3
    shared.forget(made)
    with pytest.raises(Exception):
        made.count()
