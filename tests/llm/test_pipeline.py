"""Each stage keeps what its operator says, with the columns of documents."""

import re

import corpus_pipeline
from docloom.llm import decontaminate, mixing, ngram_join, store


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, seen = {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        seen.append((name, before, docs))
        ids = now
    texts = lambda df: [re.sub(r"\s+", "", r.text or "") for r in df.select("text").collect()]
    assert set(texts(seen[1][1])) == set(texts(seen[1][2])) and len(set(texts(seen[1][2]))) == seen[1][2].count()
    groups = ngram_join.jaccard_groups(seen[2][1]).collect()
    assert {r.doc_id for r in groups if r.doc_id == r.component_id} == {r.doc_id for r in seen[2][2].collect()}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.overlaps(seen[3][2], bench, ["doc_id"]).filter("size(overlaps) > 0").isEmpty()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in mixed.collect()} == ids
    assert mixed.columns == mixing.mix(docs).columns


def test_awkward_rows(spark, sf_dir, tmp_path):
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a  b c d e f", "x"), (None, None, None), (2, "", "x"), (3, None, "y"), (4, "idiot " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "1L as n_chars", "1 as cls", "2 as __n2")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() >= 2


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long, __row int, cls string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.isEmpty() and (name == "mixing" or out.columns == docs.columns)


def test_result_of_a_run(spark, sf_dir):
    """run() gives what the stages give one after the other, and leaves no tables but those its result reads."""
    before = store.written()
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir))
    assert sorted({r.doc_id for r in rows}) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    store.sweep(before)
