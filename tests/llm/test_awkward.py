"""Empty tables, very long words, clashing names, repeated rows, and paths that depend on sizes."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, exact_dedup, mixing, ngram_join, pii, queries, store, substring_dedup, token_count, toxicity, url_filter, warc

from .test_brute_force import corpus, frame

NAMES = ["a", "b", "h", "n", "cls", "pos", "score", "spans", "row", "run", "best", "key", "bucket", "group", "block", "u", "m", "p", "digest", "size", "first", "again", "body", "overlaps", "__found", "value", "data", "label", "n_tokens", "kept", "starts", "__new"]


def clashing(df):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    for most in (1 << 20, 0):
        assert decontaminate.overlaps(docs, bench, ["doc_id"], max_bytes=most).isEmpty()
        assert decontaminate.overlaps(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), bench.limit(0), ["doc_id"], max_bytes=most).filter("size(overlaps) > 0").isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).isEmpty()


def test_clashing_names(spark, tmp_path):
    docs = clashing(spark.createDataFrame([(i, f"some words of text {i % 3} " * 5, "s") for i in range(9)], "doc_id long, text string, source string"))
    plain = docs.select("doc_id", "text", "source")
    bench = spark.createDataFrame([(1, "some words of text 1 some words")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for f in (
        lambda d: mixing.mix(d), lambda d: toxicity.score(d, model), lambda d: decontaminate.overlaps(d, bench, ["doc_id"]), lambda d: decontaminate.overlaps(d, bench, ["doc_id"], max_bytes=0),
        lambda d: ngram_join.jaccard_groups(d).drop("class_id"), lambda d: substring_dedup.remove_repeats(d, 13), lambda d: exact_dedup.exact_groups(d), lambda d: pii.pseudonymise(d), lambda d: token_count.count_tokens(d, ["a"]),
    ):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    assert set(toxicity.drop(docs, model).columns) == set(docs.columns)
    assert decontaminate.overlaps(docs, bench, name="__overlaps").columns == [*docs.columns, "__overlaps"]
    pages = clashing(spark.createDataFrame([(1, "http://a.com/en/", "x"), (2, None, "x")], "page_id long, url string, html string"))
    assert url_filter.judge(pages, queries.RULES).count() == 2
    warc.write_archives(pages, str(tmp_path / "w"))
    assert sorted((r.page_id, r.record_type) for r in warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).collect()) == [(1, "response"), (2, "revisit")]


def test_very_long_words(spark):
    long = "ab" * 400_000
    texts = [long, long + "c", f"{long} x", " ".join([long[:200_000]] * 14), " ".join(["w"] + [long[:200_000]] * 14), "é" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 13).collect()) == [(0, 1, 0), (1, 1, 0), (2, 2, 0), (3, 14, 0), (4, 15, 14), (5, 1, 0)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (2, 4), 5: (1, 5)}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, ["▁", "ab", "c", "x", "w"]).collect()} == {0: 400_001, 1: 400_002, 2: 400_003, 3: 14 * 100_001, 4: 14 * 100_001 + 2, 5: 600_001}
    model = toxicity.train(["bad word", "good"] * 4, [1, 0] * 4)
    assert toxicity.score(docs, model).count() == mixing.mix(docs).count() == exact_dedup.exact_groups(docs).count() == 6
    bench = spark.createDataFrame([(7, " ".join([long[:200_000]] * 13))], "item_id long, text string")
    for most in (1 << 30, 0):
        assert {r.doc_id for r in decontaminate.overlaps(docs, bench, ["doc_id"], max_bytes=most).filter("size(overlaps) > 0").collect()} == {3, 4}


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_candidates_sent_or_shuffled(spark, monkeypatch, sent):
    docs = frame(spark, corpus(3, 40))
    monkeypatch.setattr(ngram_join, "SENT", 1 << 20)
    want = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(docs).collect())
    monkeypatch.setattr(ngram_join, "SENT", sent)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()) == want


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = sorted(map(tuple, warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).collect()), key=str)
    assert got == sorted([(1, 4, sha("same"), "response", None)] * 2 + [(2, 4, sha("same"), "revisit", 1), (None, 4, sha("same"), "revisit", 1), (None, 5, sha("other"), "response", None)], key=str)


def test_tables_go(spark):
    before = store.written()
    a, b = store.materialize(spark.range(3), "a"), store.materialize(spark.range(4), "b")
    store.discard(a)
    assert len(store.written() - before) == 1 and b.count() == 4
    c = store.materialize(b.filter("id > 1"), "c")
    store.sweep(before, c)
    assert c.count() == 2 and store.written() - before == {c._folder}
    store.sweep(before)
    assert store.written() == before and spark.conf.get(store.CLEAN, "false") != "true"
