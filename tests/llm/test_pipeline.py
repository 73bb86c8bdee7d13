"""The stages on the odd corpus: each holds against what its operator says."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import decontam, mixing, pii, pipeline, simhash

from test_text_operators import bare, corpus, folder, spans  # noqa: F401


def test_stages(spark, folder):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 0
    after = spark.read.parquet(f"{folder}/stage1")
    left = simhash.near_duplicates(after).where("doc_id is not null").collect()
    assert all(r.doc_id == r.component_id for r in left)
    assert len({r.doc_id for r in left}) == len(left)
    clean = spark.read.parquet(f"{folder}/stage2")
    assert decontam.flag(clean.select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").isEmpty()
    for r in spark.read.parquet(f"{folder}/stage3").collect():
        assert not r.text or not spans(r.text)
    kept = {r.doc_id for r in spark.read.parquet(f"{folder}/stage0").collect()}
    good = {r[0] for r in corpus()[:140] if "$$$" not in r[1]}
    assert len(good - kept) <= 3


def test_run_on_empty_tables(spark, bare):  # noqa: F811
    assert corpus_pipeline.run(spark, bare).collect() == []


def test_run_returns_documents(spark, bare, folder, monkeypatch):  # noqa: F811
    """Each document comes as often as the mix takes it, with all its columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, bare).columns == docs.columns
    monkeypatch.setattr(pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.run(spark, folder).collect())
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    by_id = Counter()
    for k, n in got.items():
        by_id[k[0]] += n
    assert by_id == +copies and 0 in copies.values() and max(copies.values()) > 1
    assert set(got) <= {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()}


def test_model_without_candidates(spark, bare):  # noqa: F811
    assert pii.fit(spark.read.parquet(f"{bare}/documents.parquet")).weights == {}


if __name__ == "__main__":
    pytest.main([__file__])
