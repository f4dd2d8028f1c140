"""Lines, sections and rollups; versioned tables; gated inference; rebuilds; schemas; gates; plans; pages."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.functions import text as T
from docloom.operators import fixes, gates, graph, quality, rebuild, services
from docloom.plans import registry
from docloom.sources import files, schemas, sinks, versions

ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def texts():
    rng = random.Random(4)
    bits = ["# A", "## Metadane", "## Cel dokumentu i zakres", "##", "## ", "###### deep", "####### no", "- [ ] box", "* [x] x", "- item", "| a |", "see http://x", "[a](b)", "- Faza 3: x", "todo", "", "  ", "漢字 é", "#no"]
    out = ["", "\n", "a", "a\n", "a\n\n", "\r\n", "a\r\n\r\n", None]
    return out + ["".join(rng.choice(bits) + rng.choice(ENDS) for _ in range(rng.randrange(1, 14))) + rng.choice(["", "end", "# last"]) for _ in range(120)]


def cut(lines):
    """Sections by the rules, plainly: start, end, level, heading, body."""
    heads = [(i, len(m[1]), m[2].strip()) for i, x in enumerate(lines, 1) if (m := re.match(r"^(#{1,6})\s+(.*)$", x))]
    return [(i, heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines), level, h, "\n".join(lines[i : heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines)]).strip()) for k, (i, level, h) in enumerate(heads)]


def measured(body):
    count = lambda p, f=re.match: sum(bool(f(p, x)) for x in body)
    return (sum(map(len, body)), len(body), count(r"^\s*[-*]\s*\[\s*[xX ]\s*\]\s+"), count(r"^\s*[-*]\s+"), count(r"^\s*\|.+\|\s*$"), count(r"\[[^\]]+\]\([^)]+\)|https?://\S+", re.search), count(r"(?i)^\s*[-*]\s*Faza\s+(\d{1,2})\s*:"))


def test_splitlines(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, t string").select("t", T.splitlines("t").alias("x")).collect()
    assert all(list(r.x) == (r.t or "").splitlines() for r in rows)


def test_sections_and_metrics(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "doc_uid string, text string")
    secs = quality.sections(docs).persist()
    got = sorted((int(r.doc_uid), r.start_line, r.end_line, r.level, r.heading, r.status) for r in secs.collect())
    status = lambda b: "placeholder" if not b or "..." in b or "todo" in b.lower() or "tbd" in b.lower() else "filled"
    want = sorted((i, a, b, lv, h, status(body)) for i, t in enumerate(texts()) for a, b, lv, h, body in cut((t or "").splitlines()))
    assert got == want
    assert secs.select("section_uid").distinct().count() == len(want)
    m = secs.join(quality.section_metrics(secs, docs), ["section_uid", "doc_uid"])
    found = sorted((int(r.doc_uid), r.start_line, *(r[c] for c in quality.METRICS)) for r in m.collect())
    assert found == sorted((i, a, *measured((t or "").splitlines()[a - 1 : b])) for i, t in enumerate(texts()) for a, b, *_ in cut((t or "").splitlines()))
    whole = {r.doc_id: tuple(r)[1:] for r in quality.line_metrics(docs.select(F.col("doc_uid").cast("int").alias("doc_id"), "text")).collect()}
    assert whole == {i: measured((t or "").splitlines()) for i, t in enumerate(texts())}


def test_section_ranges(spark):
    docs = spark.createDataFrame([("d", "one\ntwo\nthree\n")], "doc_uid string, text string")
    ranges = [("a", "d", None, None), ("b", "d", 0, 0), ("c", "d", 2, 99), ("e", "d", 3, 2), ("f", "d", 2, 2), ("g", "d", 9, 12), ("h", "none", 1, 1)]
    got = quality.section_metrics(spark.createDataFrame(ranges, "section_uid string, doc_uid string, start_line int, end_line int"), docs)
    assert {r.section_uid: (r.chars, r.lines) for r in got.collect()} == {"a": (11, 3), "b": (11, 3), "c": (8, 2), "e": (0, 0), "f": (3, 1), "g": (0, 0)}


def test_rollup(spark):
    docs = spark.createDataFrame([("a", "core", "## Metadane i x\n- [ ] y\n- Faza 1: z\n## Cel dokumentu\n"), ("b", "other", ""), ("c", "core", None), ("d", "imported_template", "## Q\n")], "doc_uid string, origin string, text string")
    secs = quality.sections(docs)
    edges = spark.createDataFrame([("doc", "a", "required", " "), ("doc", "a", "required", "why"), ("section", "a", "required", None), ("doc", "b", "navigational", None)], "from_kind string, from_uid string, strength string, rationale string")
    out = {r.doc_uid: tuple(r)[2:] for r in quality.document_rollup(docs, quality.section_metrics(secs, docs, keep=("status", "heading_norm")), edges, 7).collect()}
    assert out == {"a": (2, 1, 1, 1, 4, 1, 7), "b": (0, 0, 0, 0, 0, 0, 7), "d": (1, 1, 0, 0, 0, 0, 7)}
    need = {r.doc_id: (r.n_required, r.n_missing) for r in quality.required_coverage(docs.withColumnRenamed("doc_uid", "doc_id")).collect()}
    assert need == {"a": (2, 4), "b": (0, 0), "c": (0, 6), "d": (0, 0)}


def test_levels_beyond(spark):
    with pytest.raises(Exception, match="level 13"):
        quality.parents(spark.createDataFrame([("d", 1, 13)], "doc_uid string, ordinal int, level int")).collect()
    assert quality.parents(spark.createDataFrame([("d", 1, 1), ("d", 2, None), ("d", 3, 2)], "doc_uid string, ordinal int, level int")).filter("parent is not null").select("ordinal", "parent").collect() == [(3, 1)]


def test_kinds(spark):
    nodes = spark.createDataFrame([("a", "doc"), ("s", "section")], "uid string, kind string")
    rows = [(1, "a", "doc"), (2, "a", "section"), (3, "s", "section"), (4, "zz", "standard"), (5, "zz", "doc"), (6, None, None)]
    e = spark.createDataFrame([(i, u, k, "required", "why") for i, u, k in rows], "id int, to_uid string, to_kind string, strength string, rationale string")
    assert {r.id: r.status for r in quality.edge_health(e, nodes).collect()} == {1: "ok", 2: "fail", 3: "ok", 4: "ok", 5: "fail", 6: "ok"}


# -- versions


def test_versions(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.read()
    t.refresh(lambda old: spark.range(5))
    t.refresh(lambda old: old.filter("id < 3").withColumn("x y", F.lit(1)))  # reads itself, and grows
    assert sorted(map(tuple, t.read().collect())) == [(i, 1) for i in range(3)] and t.read(1).count() == 5
    half = t.read().repartition(4).select(F.when(F.col("id") == 2, F.raise_error(F.lit("killed half-way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        t.refresh(lambda old: half)
    assert t.versions() == [1, 2] and t.read().count() == 3
    with pytest.raises(Exception, match="killed"):
        sinks.full_refresh(half, t.path)
    sinks.full_refresh(t.read().filter("id = 1"), t.path)
    assert t.read().count() == 1 and t.rollback(1) == 4 and t.read().count() == 5
    with pytest.raises(versions.Conflict):
        t._publish(4, {}, {}, {})
    assert len(t.vacuum(keep=2)) >= 2 and t.versions() == [3, 4] and t.read(3).count() == 1 and t.read().count() == 5


def test_parts(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"), "id", 8)
    t.replace_parts(spark.range(100), [str(i) for i in range(8)])
    before = t.entry()["parts"]
    touched = [r.p for r in spark.range(1).select(t.part(F.lit(7).cast("long")).alias("p")).collect()]
    rows = t.read(parts=touched).filter("id <> 7")
    t.replace_parts(rows, touched)
    after = t.entry()["parts"]
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(100) if i != 7]
    assert {p for p in before if before[p] != after[p]} == set(touched)
    t.replace_parts(spark.range(0), touched)
    assert touched[0] not in t.entry()["parts"] and t.read(parts=touched).isEmpty()
    with pytest.raises(ValueError):
        versions.Table(spark, "x", None, 3)


# -- inference


def test_inference_is_gated(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("a", "d")], "from_node string, to_node string")
    log, target = str(tmp_path / "log"), str(tmp_path / "inferred")
    go = lambda n: graph.infer_edges(spark, edges, log, target, f"r{n}", f"2026-01-0{n}T00:00:00Z")
    last = lambda: sinks.read_log(spark, log).filter("kind = 'graph_edges_inferred'").orderBy(F.desc("ran_at_utc")).first()
    assert go(1) is None
    assert last().status == "WARN" and "skip: gate:" in last().notes and "missing sync_runs kind=migrate_edges_manual" in last().notes
    assert not versions.Table(spark, target).versions()
    sinks.run_log(spark, "m", "2026-01-01T12:00:00Z", "migrate_edges_manual", "WARN", "", log)
    got = sorted((r.from_node, r.to_node) for r in go(2).collect())
    assert got == [("a", "c"), ("b", "a"), ("c", "b"), ("c", "d")]
    assert last().status == "OK" and last().notes == "gate=ok inserted_total=4 algorithm=infer_v1"
    sinks.run_log(spark, "n", "2026-01-03T00:00:00Z", "migrate_edges_manual", "FAIL", "", log)
    assert go(4) is None and "status=FAIL" in last().notes and versions.Table(spark, target).read().count() == 4


@pytest.mark.parametrize("cell", [1, 3, 256])
def test_two_hops_through_hubs(spark, cell):
    rng = random.Random(1)
    e = {(rng.randrange(30), rng.randrange(30)) for _ in range(60)} | {(i, 99) for i in range(25)} | {(99, i + 40) for i in range(20)}
    df = spark.createDataFrame([*e, *list(e)[:9], (None, 1), (1, None)], "from_node long, to_node long")
    want = {(a, d) for a, b in e for c, d in e if b == c and a != d} - e
    assert sorted(map(tuple, graph.two_hops(df, cell).collect())) == sorted(want)


# -- rebuilds


def test_rebuild_what_changed(spark, tmp_path):
    store = str(tmp_path / "s")
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    docs = {f"{i}.md": f"# T{i}\nx\n## A\nTODO\n##  \n" for i in range(40)}
    assert rebuild.rebuild(frame(docs), store) == {"added": 40}
    sections, manifest = rebuild.tables(spark, store)
    rows = sorted((r.path, r.start_line, r.end_line, r.heading, r.status) for r in sections.read().collect())
    assert rows == sorted(x for i in range(40) for x in ((f"{i}.md", 1, 2, f"T{i}", "unknown"), (f"{i}.md", 3, 5, "A", "placeholder")))
    before = sections.entry()
    assert rebuild.rebuild(frame(docs), store) == {} and sections.entry() == before
    docs["7.md"] = "# New\n"
    assert rebuild.rebuild(frame(docs), store) == {"changed": 1}
    after = sections.entry()
    moved = [p for p in before["parts"] if before["parts"][p] != after["parts"].get(p)]
    assert len(moved) == 1 and [r.heading for r in sections.read().filter("path = '7.md'").collect()] == ["New"] and sections.read().count() == 79
    gone = {k: v for k, v in docs.items() if k != "8.md"} | {"new.md": "no heading"}
    assert rebuild.rebuild(frame(gone), store) == {"removed": 1, "added": 1}
    assert sections.read().count() == 77 and manifest.read().count() == 40
    assert rebuild.rebuild(frame({"9.md": "# Nine"}), store, complete=False) == {"changed": 1} and sections.read().count() == 76


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = str(tmp_path / "s")

    def drop(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"path": p, "text": t}) + "\n" for p, t in rows))

    def go(checkpoint="c"):
        rebuild.watch(spark, str(tmp_path / "in"), store, str(tmp_path / checkpoint)).awaitTermination()

    drop("1.json", [("a", "# A\n## B\n"), ("b", "# C"), (None, "# no")])
    go()
    sections, _ = rebuild.tables(spark, store)
    heads = lambda: sorted((r.path, r.heading) for r in sections.read().collect())
    assert heads() == [("a", "A"), ("a", "B"), ("b", "C")]
    drop("2.json", [("a", "# A2"), ("c", "# D")])
    go()
    assert heads() == [("a", "A2"), ("b", "C"), ("c", "D")]
    at = sections.versions()
    go()
    assert sections.versions() == at
    (tmp_path / "in" / "1.json").unlink()
    go("lost")  # a stream whose checkpoint is lost takes the files again: their hashes are known
    assert sections.versions() == at and heads() == [("a", "A2"), ("b", "C"), ("c", "D")]


# -- schemas


def test_schemas(spark, tmp_path):
    for profile in ("legacy-runtime", "current-snapshot"):
        made = schemas.bootstrap(spark, str(tmp_path), profile)
        assert len(made) == len(schemas.TABLES[profile]) and not schemas.bootstrap(spark, str(tmp_path), profile)
        assert all(spark.read.parquet(p).schema.simpleString() == schemas.schema(p.rpartition("/")[2][:-8]).simpleString() for p in made)
        assert set(services.PROFILES[profile]) <= set(schemas.TABLES[profile])
    old = spark.createDataFrame([("ISO", "N", 1)], "code string, title string, extra int")
    got = schemas.conform(old, "standards")
    assert got.columns == ["standard_code", "standard_name", "extra"] and tuple(got.first()) == ("ISO", "N", 1)
    both = spark.createDataFrame([(None, "old"), ("new", "old")], "standard_code string, code string")
    assert [r.standard_code for r in schemas.conform(both, "standards").collect()] == ["old", "new"]
    typed = schemas.conform(spark.createDataFrame([("p", "0.5"), ("q", "junk")], "doc_path string, confidence string"), "mapping")
    assert {r.doc_path: r.confidence for r in typed.collect()} == {"p": 0.5, "q": None} and typed.columns == ["doc_path", "standard_code", "match_reason", "confidence"]
    grown = schemas.adopt(spark.createDataFrame([("p", "S")], "doc_path string, standard_code string"), spark.createDataFrame([("q", 0.25, "x")], "doc_path string, confidence double, note string"), "mapping")
    assert sorted(map(tuple, grown.collect())) == [("p", "S", None, None, None), ("q", None, None, 0.25, "x")]
    folder = tmp_path / "r" / "mapping.parquet"
    spark.createDataFrame([("p",)], "doc_path string").write.parquet(f"{folder}/a")
    spark.createDataFrame([("q", 0.5)], "doc_path string, confidence double").write.parquet(f"{folder}/b")
    read = schemas.conform(spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(str(folder)), "mapping")
    assert sorted((r.doc_path, r.confidence) for r in read.collect()) == [("p", None), ("q", 0.5)]
    with pytest.raises(KeyError):
        schemas.schema("nothing")


def test_old_mapping_still_answers(spark, tmp_path, capsys):
    spark.createDataFrame([("a.md", "ISO-1")], "doc_path string, standard_code string").write.parquet(str(tmp_path / "mapping.parquet"))
    spark.createDataFrame([("a.md", "A")], "path string, title string").write.parquet(str(tmp_path / "docs.parquet"))
    assert cli.main(["--tables", str(tmp_path), "report"], spark) == 0 and "| Mappings | 1 |" in capsys.readouterr().out


# -- gates


def test_gates(spark, tmp_path):
    files_ = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y \U0001f680"), ("d", "z")], "path string, text string")
    h = {r.path: r.h for r in files_.select("path", T.hash_v2("text").alias("h")).collect()}
    clean = [("a", "t", h["a"]), ("b", "t", h["b"]), ("c", "u", h["c"]), ("d", None, h["d"])]
    rec = lambda rows: spark.createDataFrame(rows, "path string, title_norm string, hash_sha256_v2 string")
    value = lambda df: {r.gate: r.value for r in df.collect()}
    none = spark.createDataFrame([], "kind string")
    got = value(gates.measure(files_, rec([clean[0], ("b", "t", None), ("c", "u", "other"), ("gone", "t", "h")]), none))
    assert got == {"emoji_files": 1, "files_without_record": 1, "records_without_file": 1, "hash_missing": 1, "hash_differs": 1, "collisions_title_norm": 3, "dup_content_hashes": 1, "anomalies_total": 0} and set(got) == set(gates.CHECKS)
    plain = files_.filter("path <> 'c'")
    known = rec([r for r in clean if r[0] != "c"])
    snaps = versions.Table(spark, str(tmp_path / "snaps"))
    first = gates.run(plain, known, snaps, "s1", "2026-01-01", none)
    assert gates.passed(first) and snaps.read().count() == len(gates.CHECKS) and {r.delta for r in first.collect()} == {None}
    many = spark.createDataFrame([(f"n{i}", f"text {i // 2}") for i in range(60)], "path string, text string")
    index = many.select("path", F.lit("same").alias("title_norm"), T.hash_v2("text").alias("hash_sha256_v2"))
    second = {r.gate: (r.value, r.delta, r.status) for r in gates.run(plain.unionByName(many), known.unionByName(index), snaps, "s2", "2026-01-02", none).collect()}
    assert second["collisions_title_norm"] == (62, 60, "WARN") and second["dup_content_hashes"] == (31, 30, "WARN") and snaps.read().select("snapshot_id").distinct().count() == 2
    bad = gates.run(files_, known, snaps, "s3", "2026-01-03", none)
    assert not gates.passed(bad) and snaps.read().select("snapshot_id").distinct().count() == 2
    empty = gates.measure(files_.limit(0), known.limit(0))
    assert {r.value for r in empty.collect()} == {0}


# -- files and plans


def test_git_log_of_any_length(spark, tmp_path):
    log = "".join(f"COMMIT|h{i}|2024-01-{i % 28 + 1:02}|a | bar {i}|Me\n\nM\td/{i}.md\n" + ("R087\told {0}.md\tnew {0}.md\n".format(i) if i % 3 == 0 else "") + ("A\tCOMMIT|x.md\n" if i % 5 == 0 else "") for i in range(3000))
    (tmp_path / "log.txt").write_text(log)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        x = files.git_log(spark, str(tmp_path / "log.txt"))
        tasks, rows = x.rdd.getNumPartitions(), x.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 4 and len(rows) == 3000 + 1000 + 600
    assert {r.subject for r in rows if r.hash == "h7"} == {"a | bar 7"} and {r.author for r in rows} == {"Me"}
    assert sorted((r.status, r.path, r.old_path) for r in rows if r.hash == "h15") == [("A", "COMMIT|x.md", None), ("M", "d/15.md", None), ("R", "new 15.md", "old 15.md")]
    (tmp_path / "none.txt").write_text("")
    assert files.git_log(spark, str(tmp_path / "none.txt")).isEmpty()


def test_plan_goes_out_and_comes_back(spark, tmp_path, capsys):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\ntitle: T\n---\n## Zakres i granice\n## Wejścia i wyjścia\n")
    (root / "b.md").write_text("no front ☀\n## Cel dokumentu\n## Zakres i granice\n## Wejścia i wyjścia\n")
    plan = str(tmp_path / "plan")
    fixes.run(spark, str(root), "analyze", plan, "r1")
    lines = [json.loads(x) for p in (tmp_path / "plan").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all(set(x) == {"schema_version", "run_id", "mode", "root", "total_files", "changes"} and x["total_files"] == 2 for x in lines)
    # By hand: one plan in one document, the emoji for review, a document that isn't there.
    changes = [c for x in lines for c in x["changes"]]
    for c in changes:
        c["safe_autofix"] = c["rule_id"] == "DOC.SECTION.MISSING"
    changes.append({"file": "gone.md", "rule_id": "X", "severity": "ERROR", "action": "strip_emoji", "detail": {"more": "kept"}, "safe_autofix": False})
    edited = tmp_path / "edited.json"
    edited.write_text(json.dumps({**lines[0], "changes": changes}, indent=2, ensure_ascii=False))
    run = lambda *a: (cli.main(["--tables", str(tmp_path), *a], spark), capsys.readouterr().out)
    assert run("review", str(edited), "--filter", "safe")[1] == "ERROR  DOC.SECTION.MISSING  1 in 1 files\n"
    out = run("review", str(edited), "--filter", "review", "--verbose")[1]
    assert "DOC.EMOJI.FORBIDDEN  1 in 1 files, for review" in out and "gone.md  X" in out
    where = lambda n: [*("--target", str(tmp_path / f"new{n}"), "--backup", str(tmp_path / f"old{n}"), "--write-diff", str(tmp_path / f"diff{n}"), "--write-result", str(tmp_path / f"result{n}"))]
    assert run("apply", str(edited), *where(1)) == (0, "changed  1\n")
    new = versions.Table(spark, str(tmp_path / "new1")).read().collect()
    assert len(new) == 1 and new[0].path.endswith("a.md") and "## Cel dokumentu" in new[0].text
    assert run("apply", str(edited), "--filter", "review", *where(2)) == (1, "changed  1\nerror  1\n")
    new = versions.Table(spark, str(tmp_path / "new2")).read().collect()
    assert len(new) == 1 and new[0].text.startswith("no front \n") and "☀" in versions.Table(spark, str(tmp_path / "old2")).read().first().text
    assert "-no front ☀" in "".join(p.read_text() for p in (tmp_path / "diff2").glob("part-*"))
    assert {r.status for r in spark.read.json(str(tmp_path / "result2")).collect()} == {"changed", "error"}
    assert run("apply", str(tmp_path / "nothing"), *where(3))[0] == 1
    with pytest.raises(ValueError):
        fixes.selected(fixes.load_plan(spark, plan), "some")


# -- pages


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_pages_by_key(spark, limit):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.5, 0.25, 1.0]), rng.choice(["a", None, "b"]), rng.choice("xy"), "r") for _ in range(40)]
    df = spark.createDataFrame(rows, "confidence double, doc_path string, standard_code string, match_reason string").repartition(3)
    got, after = [], None
    while True:
        page, after = services.page_after(df, services.BY_CONFIDENCE, limit, after)
        assert len(page) <= limit
        got += map(tuple, page)
        if after is None:
            break
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2])
    assert got == sorted(rows, key=key)
    for bad in ("x", "bnVsbA=="):
        with pytest.raises(ValueError):
            services.page_after(df, services.BY_CONFIDENCE, 5, bad)
    with pytest.raises(ValueError):
        services.page_after(df, services.BY_CONFIDENCE, 501)


def test_queries_are_there():
    assert {"a11_line_metrics", "w2_a11_section_metrics", "a12_rollup", "a13_required_coverage", "g6_two_hops"} <= set(registry.queries())


# -- similarity


@pytest.mark.parametrize("hot", [1, 3, 10_000])
@pytest.mark.parametrize("repeats", [True, False])
def test_similarity_with_frequent_tokens(spark, monkeypatch, hot, repeats):
    from docloom.operators import matching

    monkeypatch.setattr(matching, "HOT", hot)
    rng = random.Random(8)
    common, rare = ["plan", "doc", "it"], [f"r{i}" for i in range(30)]
    make = lambda: sorted({*rng.choices(common, k=rng.randrange(4)), *rng.choices(rare, k=rng.choice([0, 0, 1, 3]))})
    left, right = [(i, make()) for i in range(60)], [(i, make(), rng.choice("pq")) for i in range(80)]
    for group in (None, "g"):
        for least, k in ((0.05, 3), (0.4, 2)):
            want = []
            for a, x in left:
                for g in {r[2] for r in right} if group else [None]:
                    own = sorted((-len({*x} & {*y}) / len({*x} | {*y}), b) for b, y, h in right if (g is None or h == g) and {*x} & {*y})
                    want += [(a, g, b, round(-s, 9), i) for i, (s, b) in enumerate([o for o in own if -o[0] >= least][:k], 1)]
            l, r = spark.createDataFrame(left, "a long, tokens array<string>"), spark.createDataFrame(right, "b long, tokens array<string>, g string")
            got = matching.top_similar(l, r, least, k, repeats, group).collect()
            assert sorted(((x.a, x.g if group else None, x.b, round(x.score, 9), x["rank"]) for x in got), key=str) == sorted(want, key=str)


def test_collisions_of_nulls(spark):
    from docloom.operators import analytics

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "i int, k string")
    assert sorted(r.i for r in analytics.collisions(df, "k").collect()) == [1, 2, 3, 4]
