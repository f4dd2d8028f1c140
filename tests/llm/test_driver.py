"""What isn't done in the driver's memory."""

import os

import numpy as np

from docloom.llm import bloom, components, ngram_join, store, toxicity


def test_training_is_a_tasks(spark, monkeypatch):
    """The model is that of the sample in order of its ids, and no text of it is trained on in the driver."""
    texts = [("vile trash you fool" if i % 3 == 0 else "a calm note on rivers") + f" {'abcdefghij'[i % 10]}" for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    want = toxicity.train(texts, labels)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")

    real, driver = toxicity.train_bytes, os.getpid()

    def elsewhere(*x):
        assert os.getpid() != driver, "trained in the driver"
        return real(*x)

    monkeypatch.setattr(toxicity, "train_bytes", elsewhere)
    got = toxicity.fit(docs, marks)
    assert set(got) == set(want) and all(np.array_equal(got[k], want[k]) for k in want)


def test_counts_reach_the_driver_as_logarithms(spark, monkeypatch):
    """Two bytes a count, not the eight that they are added up in."""
    real, sent = bloom.add_up, []

    def seen(*x):
        got = real(*x)
        sent.extend(len(d) for d in got.values())
        return got

    monkeypatch.setattr(bloom, "add_up", seen)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == {i: i - i % 2 for i in range(8)}
    assert sent and max(sent) <= 2 * (1 << ngram_join.COUNT_BITS) // ngram_join.COUNT_CHUNKS


def test_components_broadcast_nothing(spark, monkeypatch):
    """Small tables of links too are joined by sorted merges, and one query tells that a round was the last."""
    asked, plans, real, empty = [], [], store.materialize, type(spark.range(0)).isEmpty

    def write(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(components, "materialize", write)
    monkeypatch.setattr(type(spark.range(0)), "isEmpty", lambda df: asked.append(df._jdf.queryExecution().executedPlan().toString()) or empty(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(7, 7), (50, 45), (45, 50)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {45: 45, 50: 45}
    rounds = len(plans) - 2
    assert len(asked) == rounds and not any("Broadcast" in p for p in asked + plans)


def test_written_tables_release_memory(spark):
    """What a query leaves in the driver's heap is collected once its table is written."""
    runs = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = runs()
    out = store.materialize(spark.range(5))
    assert runs() > before and out.count() == 5
    store.discard(out)
