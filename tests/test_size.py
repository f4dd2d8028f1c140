"""Plans that hold at any size: what grows with the library isn't sent whole to the driver, and pairs aren't on disk all at once."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph
from docloom.plans import registry
from docloom.sources import sinks, versions


@pytest.mark.parametrize("name", ["j10_j11_references", "j13_both_ends_of_references"])
def test_no_index_is_broadcast(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_inference_by_slices(spark, tmp_path):
    """A slice holds few of the pairs, no two slices share one, and together they are those of the whole."""
    rows = {(a, b) for a in range(40) for b in range(40) if (a * 7 + b * 3) % 11 < 2} | {(a, 99) for a in range(40)} | {(99, b) for b in range(40, 80)}
    edges = spark.createDataFrame(sorted(rows), "from_node long, to_node long")
    want = {(a, d) for a, b in rows for c, d in rows if b == c and a != d} - rows
    table, sizes = versions.Table(spark, str(tmp_path / "t")), []

    def slices():
        for x in graph.two_hops_by_slices(edges, str(tmp_path / "work"), cell=16, most=500):
            sizes.append(x.count())
            yield x

    assert table.refresh_by(slices()) == 1
    assert len(sizes) > 4 and max(sizes) < len(want) / 2
    assert sorted(map(tuple, table.read().collect())) == sorted(want)


def test_inference_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """Edges written for the slices go with the stage, also if it fails; a failure leaves the former version."""
    work = tmp_path / "work"
    monkeypatch.setattr(versions, "scratch", lambda s, name: versions._scratch.setdefault(str(work), s) and str(work))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "from_node long, to_node long")
    log, target = str(tmp_path / "log"), str(tmp_path / "t")
    sinks.run_log(spark, "1", "2026-01-01T00:00:00Z", graph.PREDECESSOR, "OK", "", log)
    got = graph.infer_edges(spark, edges, log, target, "2", "2026-01-01T00:01:00Z")
    assert [tuple(r) for r in got.collect()] == [(1, 3, "infer_v1")] and not work.exists()
    bad = edges.withColumn("to_node", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        graph.infer_edges(spark, bad, log, target, "3", "2026-01-01T00:02:00Z")
    assert not work.exists() and versions.Table(spark, target).versions() == [1]


def test_inferred_pairs_are_not_shuffled(spark, tmp_path):
    """Pairs of a from_node are merged where its lists meet: none is a row before."""
    edges = spark.createDataFrame([(a, 50 + b) for a in range(20) for b in range(5)] + [(50 + b, 90 + c) for b in range(5) for c in range(5)], "from_node long, to_node long")
    plans = [x._jdf.queryExecution().sparkPlan().toString() for x in graph.two_hops_by_slices(edges, str(tmp_path / "work"))]
    assert plans and all("explode(array_except" in p for p in plans)
    assert not any("HashAggregate(keys=[from_node" in line and "to_node" in line.split("functions")[0] for p in plans for line in p.splitlines())


@pytest.mark.parametrize("heavy, sent, kind", [(1, 0, "long"), (70, 0, "string"), (70, 10**6, "long")])
def test_inference_with_heavy_nodes(spark, tmp_path, monkeypatch, heavy, sent, kind):
    """Nodes with many pairs go another way than those with few; both ways, and together, give all pairs once, also beside nulls and loops."""
    monkeypatch.setattr(graph, "SENT", sent)
    rows = {(a, b) for a in range(30) for b in range(30) if (a * 7 + b * 3) % 11 < (1 + a % 3)} | {(a, 99) for a in range(40)} | {(99, b) for b in range(40, 80)} | {(5, 5), (7, 200), (300, 7)}
    edges = spark.createDataFrame([*rows, *list(rows)[:50], (None, 1), (1, None), (None, None)], "from_node long, to_node long")
    edges = edges.select(*(edges[c].cast(kind) for c in edges.columns))
    want = {(a, d) for a, b in rows for c, d in rows if b == c and a != d} - rows
    table = versions.Table(spark, str(tmp_path / "t"))
    table.refresh_by(graph.two_hops_by_slices(edges, str(tmp_path / "work"), cell=16, most=2000, heavy=heavy), constant=("source", "x1"))
    got = table.read()
    assert got.dtypes == [("from_node", {"long": "bigint"}.get(kind, kind)), ("to_node", {"long": "bigint"}.get(kind, kind)), ("source", "string")]
    assert sorted((int(a), int(b), c) for a, b, c in got.collect()) == sorted((a, b, "x1") for a, b in want)


def test_inference_that_finds_nothing(spark, tmp_path):
    table = versions.Table(spark, str(tmp_path / "t"))
    table.refresh_by(graph.two_hops_by_slices(spark.createDataFrame([(1, 2), (1, 1)], "from_node long, to_node long"), str(tmp_path / "work")), constant=("source", "12"))
    assert table.read().columns == ["from_node", "to_node", "source"] and table.read().collect() == []
    with pytest.raises(ValueError, match="constant"):
        table.refresh_by([], constant=("source", "a/b"))
