"""Ids at the ends of their range, doubly labelled documents, sketches added up in a tree, wide counts, cells in blocks, hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bloom, exact_dedup, joins, ngram_join, pii, toxicity

from .test_brute_force import corpus, frame


def test_smallest_id(spark):
    docs = spark.createDataFrame([(-(2**63), "a b"), (3, "ab"), (2**63 - 1, "a  b"), (None, "a   b"), (None, "z"), (0, "q"), (-(2**63), "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    low, high = -(2**63), 2**63 - 1
    assert got == sorted([(low, None, 4, False), (3, None, 4, False), (high, None, 4, False), (None, None, 4, True), (None, None, 1, True), (0, low, 2, False), (low, low, 2, True)], key=str)


def test_double_labels(spark):
    docs = spark.createDataFrame([(i, f"bad word {i}" if i % 2 else f"fine text {i}") for i in range(20)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(20)]
    once = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    again = toxicity.fit(docs, spark.createDataFrame([*labels, *[(i, 0) for i in range(1, 20, 2)], (4, None), (None, 1)], "doc_id long, toxic int"))
    assert once.keys() == again.keys() and all(np.array_equal(once[k], again[k]) for k in once)


def test_email_names_are_long(spark):
    rows = spark.createDataFrame([(1, "write to someone.else@mail.example.com now")], "doc_id long, text string")
    text = pii.pseudonymise(rows).first().text
    assert len(text.split()[2].split("@")[0]) == 1 + pii.EMAIL_DIGITS


@pytest.mark.parametrize("fan", [64, 1])
def test_sketches_go_up_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(bloom, "FAN", fan)
    df = spark.range(0, 40, 1, 13).select((F.col("id") % 3).cast("int").alias("chunk"), F.unhex(F.lit("00000070" * 4)).alias("data"))
    got = bloom.add_up(df, "int32", np.add, "int64")
    one = int.from_bytes(bytes.fromhex("00000070"), "little")
    assert {k: np.frombuffer(v, np.int64).tolist() for k, v in got.items()} == {k: [one * n] * 4 for k, n in ((0, 14), (1, 13), (2, 13))} and one * 13 > 2**31


def test_counts_beyond_32_bits():
    size = (1 << ngram_join.COUNT_BITS) // ngram_join.COUNT_CHUNKS
    table = np.zeros(size, np.int64)
    table[:5] = 1, 100, 2**31 - 1, 2**31 + 5, 2**50
    scale = ngram_join._scale({0: table.tobytes()})
    assert len(scale) == 1 << ngram_join.COUNT_BITS and (np.diff(scale[:5].astype(int)) >= 0).all() and scale[3] > scale[1] > scale[0] > scale[7] == 0


@pytest.mark.parametrize("block", [2, 7])
def test_cells_in_blocks(spark, monkeypatch, block):
    docs = frame(spark, corpus(5, 60))
    want = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect())
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()) == want


def test_blocks_miss_no_pair(spark):
    rng = random.Random(6)
    rows = [(h, c, 20, rng.randrange(3), rng.choice([1, 1, 1, 1, c])) for h in (1, 2) for c in range(150)] + [(3, 5, 20, 0, 5), (3, 6, 20, 0, 6), (4, 9, 20, 0, 9)] + [(5, c, 20, 0, 1) for c in range(200, 260)]
    named = spark.createDataFrame(rows, "h long, cls long, n int, pos int, comp long")
    cells = {h: [r for r in rows if r[0] == h] for h in range(1, 6)}
    want = {(min(a[1], b[1]), max(a[1], b[1])) for rs in cells.values() for a in rs for b in rs if a[4] != b[4]}
    for most in (8, 40, 1000):
        dealt = ngram_join._dealt_cells(named, most)
        sizes = [r.n for r in dealt.groupBy("h", "i", "j").agg(F.count(F.lit(1)).alias("n")).collect()]
        got = dealt.repartition(4, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(ngram_join._open_pairs(75), "a long, b long").collect()
        assert {tuple(r) for r in got} == want
        assert max(sizes) <= 6 * most
        if most < 60:  # a cell that is all connected is dropped
            assert not dealt.filter("h = 5").count()


def test_many_open_classes(spark):
    """A cell of 10^5 open classes is dealt to many tasks, no class to more than its row of blocks."""
    named = spark.range(100_000).select(F.lit(1).cast("long").alias("h"), F.col("id").alias("cls"), F.lit(20).alias("n"), F.lit(4).alias("pos"), F.col("id").alias("comp"))
    dealt = ngram_join._dealt_cells(named, ngram_join.CELL_BLOCK)
    sizes = [r.n for r in dealt.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = -(-99_999 // ngram_join.CELL_BLOCK) + 1
    assert len(sizes) >= blocks * (blocks - 1) // 2 and max(sizes) < 3 * ngram_join.CELL_BLOCK and sum(sizes) <= 100_000 * blocks


def test_spread_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (-5, "d")], "k long, v string")
    got = joins.spread(left, right, ["k"], ["row"])
    assert got.columns == ["k", "row", "v"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_hot_joins_give_the_same(spark, monkeypatch):
    docs = frame(spark, corpus(9, 40))
    want = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(docs).collect())
    monkeypatch.setattr(joins, "HOT", 0)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()) == want
