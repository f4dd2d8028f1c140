"""Small cases that pin the operators' semantics."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import analytics, fixes, graph, history, links, matching, quality
from docloom.plans import registry
from docloom.sources import files, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,want", [("Faza 3: Plan", "phase-03"), ("Zakres  i   granice", "zakres-i-granice"), ("zależności", "zalenoci"), ("a -- b", "a-b"), ("", ""), (None, "")])
def test_anchor(spark, value, want):
    assert one(spark, value, T.to_anchor) == want


@pytest.mark.parametrize("value,want", [("1. 2. X", "x"), ("1.2. X", "1.2. x"), ("  A\t b ", "a b"), ("\U0001f600 A", "a"), (None, "")])
def test_heading_norm(spark, value, want):
    assert one(spark, value, T.heading_norm) == want


def test_slug_and_titles(spark):
    assert one(spark, "Zażółć gęślą", T.to_slug) == "zazolc_gesla"
    assert one(spark, "---\ntitle: \"A b\"\n---\n# C", T.title_of_text) == "A b"
    assert one(spark, "# C\ntext", T.title_of_text) == "C"
    assert one(spark, "text", T.title_of_text) is None
    assert one(spark, "core/x/a-b_c.md", T.title_of_path) == "a b c"


def test_ambiguous_context_does_not_fall_through(spark):
    sections = spark.createDataFrame([(1, "d1", "a", "a"), (2, "d1", "a", "a2"), (3, "d2", "b", "b"), (4, "d3", "a", "x")], "section_uid long, doc_uid string, heading_norm string, anchor string")
    ask = spark.createDataFrame([(1, "a", "d1"), (2, "a", "d3"), (3, "b", "d1"), (4, "zz", None), (5, "a", None)], "id long, to_ref string, context_doc_uid string")
    got = {r.id: (r.method, r.to_uid) for r in links.resolve(ask, sections).collect()}
    assert got == {1: ("ambiguous", None), 2: ("context_doc", 4), 3: ("global_unique", 3), 4: ("missing", None), 5: ("ambiguous", None)}


def test_chain_depth(spark):
    edges = spark.range(999).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"))
    assert sorted(tuple(r) for r in graph.downstream(edges, spark.createDataFrame([(0,)], "node long"), 2).collect()) == [(1, 1), (2, 2)]


def test_parents(spark):
    rows = spark.createDataFrame([("d", i, lv) for i, lv in enumerate((2, 3, 3, 2, 4), 1)], "doc_uid string, ordinal int, level int")
    got = [(r.parent, r.kind) for r in quality.parents(rows).orderBy("ordinal").collect()]
    assert got == [(None, "sec"), (1, "subsec"), (1, "subsec"), (None, "sec"), (4, "subsec")]


def test_fixes_are_idempotent(spark):
    docs = spark.createDataFrame([("a.md", "---\ntitle: T\n---\n## Cel dokumentu\nx\n"), ("b.md", "no front ☀\n")], "path string, text string")
    done = fixes.apply_safe(docs, fixes.findings(docs)).select("path", F.col("new_text").alias("text"))
    left = fixes.findings(done).filter("safe").collect()
    assert not left
    again = fixes.apply_safe(done, fixes.findings(done))
    assert again.filter("hash_before <> hash_after").isEmpty()


def test_containment(spark):
    s = spark.createDataFrame([("risk_management",), ("risk_management_plan",), ("nothing_like_it",), ("abc",)], "slug string")
    f = spark.createDataFrame([("risk_management",), ("the_risk_management_plan_v2",), ("abc",)], "file string")
    got = {r.slug: (r.file, r.tier) for r in links.contained(s, f).collect()}
    assert got == {"risk_management": ("risk_management", 1), "risk_management_plan": ("the_risk_management_plan_v2", 2), "nothing_like_it": (None, None), "abc": ("abc", 1)}


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, sinks.insert_if_absent(old, new, ["id"], ["v"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, sinks.delete_by_key(old, new, ["id"]).collect())) == [(1, "a")]
    twice = sinks.insert_if_absent(sinks.insert_if_absent(old, new, ["id"], ["v"]), new, ["id"], ["v"])
    assert twice.count() == 3
    assert "-a\n" in sinks.unified_diff(spark.createDataFrame([("a\n", "b\n", "f")], "x string, y string, n string"), "x", "y", "n").first()["diff"]


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.md").write_text("# A\n")
    (tmp_path / "s" / "b.md").write_text("# B\n")
    assert files.markdown(spark, str(tmp_path)).count() == 2
    assert files.markdown(spark, str(tmp_path), recursive=False).count() == 1
    (tmp_path / "m.csv").write_text("path,hash_sha256_v2\na.md, \n ,x\n")
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path / "m.csv")).collect()] == [("a.md", None)]
    log = spark.createDataFrame([("h|2024-01-01|s|me\nM\ta.md\nR100\tb.md\tc.md",)], "record string")
    assert [(r.status, r.path, r.old_path) for r in files.git_changes(log).orderBy("path").collect()] == [("M", "a.md", None), ("R", "c.md", "b.md")]


def test_matching_and_history(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "a long, tokens array<string>")
    right = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, [])], "b long, tokens array<string>")
    for repeats in (True, False):
        assert [(r.a, r.b, round(r.score, 3)) for r in matching.top_similar(left, right, 0.1, 5, repeats).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 2, 0.333)]
    old, new = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("d", "2"), ("e", "4")]))
    assert sorted(r.kind for r in history.transitions(old, new).collect()) == ["added", "kept", "moved", "removed"]
    assert analytics.totals(spark.createDataFrame([], "path string"), spark.createDataFrame([], "doc_path string")).first().pct == 0.0


def test_parents_of_the_whole_table(spark, tmp_path):
    keys = [*range(1, 30), *range(4990, 5040)]
    spark.createDataFrame([(k, f"B{k % 3}", f"n {k}") for k in keys], "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.ordinal: (r.level, r.parent) for r in registry.queries()["w8_parents"](spark, str(tmp_path)).collect()}
    assert got == {k: (k % 4 + 1, max((j for j in keys if j < k and j % 3 == k % 3 and j % 4 < k % 4), default=None)) for k in keys}
    rows = [(d, i, (i * i * 7 + d * 5) % 11) for d in range(3) for i in range(60)]  # more than six levels
    want = sorted((d, i, max((j for e, j, m in rows if e == d and j < i and m < v), default=-1)) for d, i, v in rows)
    found = quality.parents(spark.createDataFrame(rows, "doc_uid long, ordinal long, level long")).collect()
    assert sorted((r.doc_uid, r.ordinal, -1 if r.parent is None else r.parent) for r in found) == want


def test_contained_short_slugs(spark):
    slugs = spark.createDataFrame([("abc",), ("xy",), ("plan",), ("none",)], "slug string")
    files = spark.createDataFrame([("0123456789abc-file",), ("the-long-xy-a",), ("the-long-xy-b",), ("plan",), ("a-long-plan-too",)], "file string")
    got = {r.slug: (r.file, r.tier) for r in links.contained(slugs, files).collect()}
    assert got == {"abc": ("0123456789abc-file", 2), "xy": (None, None), "plan": ("plan", 1), "none": (None, None)}
