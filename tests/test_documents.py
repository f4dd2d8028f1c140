"""Small cases of references, edges, templates, fix plans, files against tables, audits and guidance."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import unicode as U
from docloom.operators import audit, fixes, graph, guidance, history, links, quality, raci, sync, templates
from docloom.sources import sinks, versions

UID = "01ABCDEFGHJKMNPQRSTVWXYZ00"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.fixture(scope="module")
def sections(spark):
    data = [("s1", UID, "cel dokumentu", "cel-dokumentu", 1), ("s2", UID, "cel dokumentu", "cel-dokumentu", 2), ("s3", UID, "b c", "b-c", 1), ("s4", "other", "b c", "bc", 1), ("s5", "other", "zakres", "zakres", 1)]
    return spark.createDataFrame(data, "section_uid string, doc_uid string, heading_norm string, anchor string, ordinal int")


def test_references_of_every_form(spark, sections):
    data = [(1, f"doc::{UID}::section::cel-dokumentu", None), (2, f" DOC::{UID}::SECTION::cel-dokumentu::2 ", None), (3, f"doc::{UID}::section::none", "other"), (4, "section::B  C", UID), (5, "section::1. b c", None), (6, "section::Meta - zakres", UID), (7, "section::over", None), (8, "doc::short::section::a", None), (9, None, None), (10, "section::cel dokumentu", UID)]
    refs = spark.createDataFrame(data, "id long, ref string, context_doc_uid string")
    over = spark.createDataFrame([("over", "s9")], "label_norm string, section_uid string")
    got = {r.id: (r.to_uid, r.method, r.confidence) for r in links.resolve_refs(refs, sections, over).collect()}
    assert got == {1: ("s1", "explicit", 1.0), 2: ("s2", "explicit", 1.0), 3: (None, "missing", 0.0), 4: ("s3", "context_doc", 0.95), 5: (None, "ambiguous", 0.0), 6: ("s5", "global_unique", 0.9), 7: ("s9", "manual", 1.0), 10: (None, "ambiguous", 0.0)}


def test_titled_references(spark, sections):
    docs = spark.createDataFrame([(UID, " The Plan "), ("zz", "the plan"), ("other", "Rest"), ("n", None)], "doc_uid string, title string")
    refs = spark.createDataFrame([(1, "document::THE plan::section::B c"), (2, "document::Rest::section::nope"), (3, "document::x::section::y"), (4, "section::b c")], "id long, ref string")
    got = {r.id: (r.to_uid, r.method, r.confidence) for r in links.resolve_titled(refs, docs, sections).collect()}
    assert got == {1: ("s3", "context_doc", 0.85), 2: (None, "missing_section", 0.0), 3: (None, "missing_doc", 0.0)}


def test_document_dependencies(spark):
    docs = spark.createDataFrame([("a", "A"), ("b", "b "), ("b2", "B")], "doc_uid string, title string")
    data = [("document", "document::a", "document::B", 0, None), ("document", "document::a", "document:: b", 1, None), ("document", "document::x", "document::A", 0, "c"), ("document", "document::x", "document::A", 0, None), ("document", "document::a", "document::A", 1, None), ("section", "document::a", "document::b", 1, None)]
    refs = spark.createDataFrame(data, "to_type string, from_ref string, to_ref string, required int, context_doc_uid string")
    assert rows(links.document_dependencies(refs, docs)) == [("a", "b2", "requires"), ("c", "a", "relates_to")]


def test_edges(spark, sections):
    docs = spark.createDataFrame([(UID, "Plan"), ("other", " Rest")], "doc_uid string, title string")
    doc = spark.createDataFrame([(1, "plan", "REST", "Needs", None), (2, "plan", "gone", None, None), (3, "Rest", "Plan", "", "why")], "id long, doc_title string, depends_on_title string, dependency_type string, rationale string")
    sec = spark.createDataFrame([(7, "Plan", "Cel  dokumentu", "about", "both", None), (8, "Plan", "zakres", "about", "both", None)], "id long, doc_title string, section_title string, link_type string, direction string, rationale string")
    raw = spark.createDataFrame([(9, "section", "section::x", "file", "y", "sees", "forward", None, 1)], "id long, from_type string, from_ref string, to_type string, to_ref string, link_type string, direction string, rationale string, required int")
    edges, new = links.materialize_edges(doc, sec, raw, docs, sections, spark.createDataFrame([("needs",)], "code string"))
    got = {r.source_row_id: (r.from_kind, r.from_uid, r.to_kind, r.to_uid, r.link_type, r.strength) for r in edges.collect()}
    assert got == {1: ("doc", UID, "doc", "other", "needs", "navigational"), 3: ("doc", "other", "doc", UID, "depends_on", "navigational"), 7: ("doc", UID, "section", "s1", "about", "navigational"), 9: ("section", "section::x", "doc", "y", "sees", "required")}
    assert {r.code for r in new.collect()} == {"depends_on", "about", "sees"}


GOOD = "---\ntitle: T\nstatus: s\naligned: 1\n---\n## cel dokumentu\nx\n## Zakres i granice\n## Wejścia i wyjścia\n"


def test_template_validation(spark):
    docs = spark.createDataFrame([("good", GOOD), ("none", "# x"), ("open", "---\ntitle: T\n"), ("bad", "---\ntitle: T\n---\n## Cel dokumentu [OSOBA/rola] 漢\n")], "path string, text string")

    def no_x(t):
        return ["x in body"] if "x" in t["body"] else None

    def broken(t):
        raise ValueError(t["headings"][0])

    got = rows(templates.validate(docs, [no_x, broken]))
    assert ("good", "x in body") in got and ("good", "validator broken: cel dokumentu") in got
    assert [g for g in got if g[0] in ("none", "open")] == [("none", "front matter missing"), ("open", "front matter not closed")]
    assert {e for p, e in got if p == "bad"} == {"missing field: status", "missing field: aligned", "missing section: ## Zakres i granice", "missing section: ## Wejścia i wyjścia", "forbidden placeholder: [osoba/rola]", "emoji", "validator broken: Cel dokumentu [OSOBA/rola] 漢"}
    assert not templates.validate(docs.filter("path = 'good'")).collect()
    assert templates.required_sections("minimal") == ["## Cel dokumentu"] and len(templates.required_sections()) == 3
    with pytest.raises(ValueError):
        templates.required_sections("nope")


def test_emoji_sets(spark):
    chars = {"rules": "☀️\U0001f1e6\U0001f680", "gate": "⌚\U0001f004\U0001fb01", "template": "漢Ⓜ", "astral": "\U00020000"}
    for which, some in chars.items():
        assert all(one(spark, c, lambda x: x.rlike(T.emoji(which))) for c in some)
    assert not one(spark, "漢⌚\U0001f650", lambda x: x.rlike(T.emoji("rules"))) and not one(spark, "a\U00020000漢", lambda x: x.rlike(T.emoji("gate")))
    lines = templates.emoji_lines(spark.createDataFrame([("p", "a\nb ☀\n\n\U0001f680")], "path string, text string"))
    assert rows(lines) == [("p", 2, "b ☀"), ("p", 4, "\U0001f680")]


def test_plan_and_apply(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\ntitle: T\n---\n## Zakres i granice\n\n\n")
    (root / "b.md").write_text(GOOD.replace("cel", "Cel"))
    (root / "c.md").write_bytes(b"\xff\xfe bad")
    (root / "d.md").write_text("no front ☀\n## Cel dokumentu\n## Zakres i granice\n## Wejścia i wyjścia\n")
    name = lambda p: p.rpartition("/")[2]
    plan = fixes.run(spark, str(root), "analyze", str(tmp_path / "plan"), "r1")
    assert sorted((name(r.path), r.rule_id, r.section) for r in plan.collect()) == [("a.md", "DOC.SECTION.MISSING", "## Cel dokumentu"), ("a.md", "DOC.SECTION.MISSING", "## Wejścia i wyjścia"), ("c.md", "DOC.PARSE.ERROR", None), ("d.md", "DOC.EMOJI.FORBIDDEN", None), ("d.md", "DOC.FRONTMATTER.MISSING", None)]
    diffs = {name(r.path): r["diff"] for r in fixes.run(spark, str(root), "dry-run", str(tmp_path / "plan"), "r2").collect()}
    assert set(diffs) == {"a.md", "d.md"} and "+## Cel dokumentu\n" in diffs["a.md"] and "-no front ☀\n+no front \n" in diffs["d.md"]
    done = fixes.run(spark, str(root), "apply", str(tmp_path / "plan"), "r3", target=str(tmp_path / "new"), backup=str(tmp_path / "old"))
    assert {name(r.path): r.status for r in done.collect()} == {"a.md": "changed", "c.md": "error", "d.md": "changed"}
    new = {name(r.path): r.text for r in versions.Table(spark, str(tmp_path / "new")).read().collect()}
    want = "---\ntitle: T\n---\n## Zakres i granice\n\n## Cel dokumentu\n" + fixes.PLACEHOLDERS["## Cel dokumentu"].rstrip("\n") + "\n\n## Wejścia i wyjścia\n" + fixes.PLACEHOLDERS["## Wejścia i wyjścia"]
    assert new["a.md"] == want and versions.Table(spark, str(tmp_path / "old")).read().count() == 2
    again = fixes.apply_plan(spark.createDataFrame([("a.md", want)], "path string, text string"), spark.createDataFrame([("a.md", 0, "strip_emoji", None, True), ("gone", 0, "report_only", None, False)], "path string, seq int, action string, section string, safe boolean"))
    assert {r.path: r.status for r in again.collect()} == {"a.md": "skipped", "gone": "error"}
    with pytest.raises(ValueError):
        fixes.run(spark, str(root), "write", "x", "r")
    assert fixes.rules(spark).count() == 4


def test_sections_by_contract(spark):
    s = spark.createDataFrame([("a", "d", "filled"), ("b", "d", "placeholder"), ("c", "d", "filled")], "section_uid string, doc_uid string, status string")
    m = spark.createDataFrame([("a", 5, 1), ("b", 2, 0)], "section_uid string, lines int, checkboxes int")
    g = spark.createDataFrame([("doc", "d", '[{"gate":"min_checkboxes","min":2}]'), ("section", "b", "[bad")], "scope_kind string, scope_uid string, gates_json string")
    assert rows(quality.scan_sections(s, m, g)) == [("a", 90, "needs_content"), ("b", 40, "needs_content"), ("c", 0, "needs_structure")]
    missing = quality.gates_missed(m.withColumn("doc_uid", F.lit("d")), g)
    assert {r.section_uid: json.loads(r.missing_json) for r in missing.collect()} == {"a": [{"gate": "min_checkboxes", "min": 2, "have": 1}], "b": []}


def test_nodes_and_walks(spark):
    docs = spark.createDataFrame([("x", "X")], "doc_uid string, title string")
    s = spark.createDataFrame([(f"s{i}", "x", h, lv, i) for i, (h, lv) in enumerate([("A", 2), ("A.1", 3), ("A.2", 3), ("B", 2), ("B.1.1", 4)], 1)], "section_uid string, doc_uid string, heading string, level int, ordinal int")
    got = {r.node_uid: (r.kind, r.parent_node_uid) for r in graph.nodes(docs, s).collect()}
    assert got == {"x": ("doc", None), "s1": ("sec", "x"), "s2": ("subsec", "s1"), "s3": ("subsec", "s1"), "s4": ("sec", "x"), "s5": ("subsec", "s4")}
    e = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 4, "a"), (2, 1, "a")], "from_node int, to_node int, edge_type string")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(graph.walk(e, start, 2)) == [(1, 1, 2, "a"), (2, 2, 1, "a"), (2, 2, 3, "b")]
    assert rows(graph.walk(e, spark.createDataFrame([(4,)], "node int"), 2, up=True)) == [(1, 3, 4, "a"), (2, 2, 3, "b")]


def test_files_against_tables(spark):
    manifest = spark.createDataFrame([("core/a.md", "h"), ("core/b.md", None), ("core/gone.md", None), ("imported/c.md", None)], "path string, hash_sha256_v2 string")
    texts = spark.createDataFrame([("core/a.md", "# One\n"), ("core/b.md", "# Two"), ("imported/c.md", "---\ntitle: two\n---\n"), ("core/d.md", "# not named")], "path string, text string")
    index = sync.file_index(manifest, texts)
    assert {r.path: (r.title_norm, r.source) for r in index.collect()} == {"core/a.md": ("one", "core"), "core/b.md": ("two", "core"), "imported/c.md": ("two", "imported_other")}
    assert {r.path for r in sync.title_collisions(index).collect()} == {"core/b.md", "imported/c.md"}
    docs = spark.createDataFrame([(1, " ONE"), (2, "two"), (3, "three")], "id long, title string")
    got = {r.id: (r.path, r.origin, r.method, r.confidence) for r in sync.match_documents(docs, index).collect()}
    assert got == {1: ("core/a.md", "core", "title_norm", 1.0), 2: (None, "unknown", "ambiguous", 0.0), 3: (None, "unknown", "missing", 0.0)}
    named = spark.createDataFrame([("core/a.md",), ("core/x.md",), (None,), ("ORPHAN",)], "p string")
    assert rows(sync.missing_on_disk([named, named], texts)) == [("core/x.md",)] and not sync.missing_on_disk([], texts).collect()


def test_ghosts_and_targets(spark):
    docs = spark.createDataFrame([("a", "Risk Management", None), ("b", "Zażółć plan", None), ("c", "Nothing like it", None), ("d", "There", "core/t.md")], "doc_uid string, title string, path string")
    files = spark.createDataFrame([("x/the-risk-management-guide.md",), ("core/zazolc_plan.md",)], "path string")
    assert {r.doc_uid: (r.path, r.mended) for r in sync.mend_ghosts(docs, files).collect()} == {"a": ("core/the-risk-management-guide.md", True), "b": ("core/zazolc_plan.md", True), "c": ("ORPHAN", True), "d": ("core/t.md", False)}
    t = spark.createDataFrame([("Security A", "core/security_a.md"), ("Plan", "core/plan.md"), ("Security", None)], "title string, path string")
    assert rows(sync.targets(t)) == [("Plan", "core/plan.md"), ("Security A", "core/security_a.md")]
    assert rows(sync.targets(t, "security")) == rows(sync.targets(t, None, "core/sec*_[!b].md")) == [("Security A", "core/security_a.md")]


def test_effects_of_changes(spark):
    docs = spark.createDataFrame([("u1", "Security Policy", "p1"), ("u2", "Guide", "p2")], "doc_uid string, title string, path string")
    names = spark.createDataFrame([("RODO", "Data"), ("KSC", "Net")], "regulation_code string, regulation_name string")
    m = spark.createDataFrame([("p1", "RODO", "direct"), ("p2", "KSC", "x")], "doc_path string, regulation_code string, match_reason string")
    assert rows(sync.affected("regulation_code", "rod", names, m, docs)) == [("RODO", "Data", "p1", "Security Policy", "direct")]
    assert not sync.affected("regulation_code", "none", names, m, docs).collect()
    s = spark.createDataFrame([("u1", "Standards", 2), ("u1", "Scope", 1), ("u2", "Standards", 1)], "doc_uid string, heading string, ordinal int")
    x = spark.createDataFrame([("u2", "document::Security Policy::section-1"), ("u1", "section::standards")], "from_ref string, to_ref string")
    assert rows(sync.affected_by_section("standards", s, docs, x)) == [("p1", "Standards", 1), ("p2", "Standards", 1)]
    std = spark.createDataFrame([("p1", "ISO"), ("p1", "ISO"), ("p1", "A")], "doc_path string, standard_code string")
    got = sync.affected_by_document("policy", docs, s, std, x).first()
    assert (got.incoming_links, got.outgoing_links, got.standards, got.sections) == (1, 1, ["A", "ISO"], ["Scope", "Standards"])


def test_audit(spark):
    m = spark.createDataFrame([("a", "ISO-1", "R", 0.5), ("b", "iso-2", "R", None), ("a", "X", "M", 0.1)], "doc_path string, standard_code string, match_reason string, confidence double")
    assert [r.standard_code for r in audit.by_standard(m, "iso", "R", 5).collect()] == ["ISO-1", "iso-2"] and audit.by_standard(m, limit=2).count() == 2
    regs = spark.createDataFrame([("a", "RODO"), ("a", "RODO")], "doc_path string, regulation_code string")
    assert rows(audit.listed(m, regs, regulation="RODO", reason="M")) == [("a", "X", "M", 0.1)]
    v = spark.createDataFrame([("p", "ERROR"), ("p", "WARNING"), ("q", "ERROR")], "path string, severity string")
    assert tuple(audit.statistics(m, v).first()) == (3, 1, 2, 1) and tuple(audit.statistics(None, v).first()) == (0, 0, 2, 1) and tuple(audit.statistics(None, None).first()) == (0, 0, 0, 0)
    said = []
    assert audit.table_or_none(spark, "no_such_table", said.append) is None and said == ["no table no_such_table"]
    cat = spark.createDataFrame([("I", "P"), ("I", "Q")], "standard_code string, doc_title string")
    gaps = spark.createDataFrame([("I", "P", "present", 0, "low"), ("I", "Q", "missing", 1, None), ("G", "R", "missing", 0, None)], "standard_code string, doc_title string, status string, is_required int, confidence string")
    summary = audit.gap_summary(cat, gaps)
    assert rows(summary) == [("G", 0, 0, 0, 1, 0, 0.0, "GAPS"), ("I", 2, 1, 1, 0, 1, 50.0, "GAPS")]
    docs = spark.createDataFrame([("a", "A"), ("z", "Extra"), ("ORPHAN", "O")], "path string, title string")
    text = audit.report(summary, gaps, audit.unmapped(docs, m))
    assert "50.0% (1 of 2)" in text and "REQUIRED: I: Q" in text and "recommended: G: R" in text and "- Extra (z)" in text and "Orphan" not in text and "## 4." in text
    std = spark.createDataFrame([("ISO-1",), ("ISO-3",)], "standard_code string")
    assert {r.gate: (r.value, r.ok) for r in audit.continuous(audit.statistics(m, v), m, std, "iso%").collect()} == {"error violations": (2.0, False), "coverage iso%": (50.0, True)}
    filled = audit.backfill(m, spark.createDataFrame([("iso-2", "b words")], "standard_code string, description string"), m.select("doc_path", "standard_code"))
    assert {(r.doc_path, r.standard_code): (r.confidence, r.filled) for r in filled.collect()} == {("a", "ISO-1"): (0.5, False), ("b", "iso-2"): (0.1, True), ("a", "X"): (0.1, False)}


def test_guidance(spark):
    title = lambda s: one(spark, s, guidance.guidance_for)
    assert "QKD" in title("Quantum Key Distribution") and "CO2" in title("Carbon Offset Tracking") and "KPI" in title("Budget Tracking") and "Zupełnie Nowy" in title("Zupełnie  Nowy")
    assert one(spark, "Zupelnie Nieznany", guidance.archetype) is None and "  " not in title("Bot Development Standards")
    docs = spark.createDataFrame([("core/exact.md", "Risk Management Plan"), ("core/similar.md", "Risk Management Planning Document"), ("core/m.md", "Incident Response Procedure"), (None, "Ghost")], "path string, title string")
    ask = spark.createDataFrame([(1, "risk management PLAN"), (2, "Incident Management Procedure"), (3, "Unrelated Xyz Qwerty"), (4, "Polityka bezpieczenstwa")], "entry int, doc_title string")
    more = docs.unionByName(spark.createDataFrame([("core/p.md", "Polityka bezpieczeństwa")], "path string, title string"))
    got = {r.entry: (r.path, r.confidence) for r in guidance.match_catalogue(ask, more, more.filter("path = 'core/m.md'").select("path")).collect()}
    assert got == {1: ("core/exact.md", "exact"), 2: ("core/m.md", "high"), 4: ("core/p.md", "exact")}
    bare = {r.entry: r.confidence for r in guidance.match_catalogue(ask, more).collect()}
    assert bare[2] == "medium" and not guidance.match_catalogue(ask, docs.limit(0)).collect()
    empty = guidance.controls(spark).limit(0)
    first = guidance.seed(empty, guidance.controls(spark), ["standard_code", "control_id"])
    assert first.count() == guidance.seed(first, guidance.controls(spark), ["standard_code", "control_id"]).count() == guidance.seed(first, guidance.controls(spark), ["standard_code", "control_id"], replace=True).count() == 115


def test_confidences(spark):
    std = spark.createDataFrame([("I", "Information security controls isms")], "standard_code string, description string")
    m = spark.createDataFrame([("information_security_controls_isms.md", "I"), ("cooking_pasta.md", "I"), ("x.md", "none")], "doc_path string, standard_code string")
    got = {r.doc_path: (r.confidence, r.evidence) for r in guidance.mapping_confidence(m, std, m.limit(1)).collect()}
    assert got["information_security_controls_isms.md"] == (1.0, "tokens:controls,isms guidance_refs:1") and got["cooking_pasta.md"] == (0.0, "tokens: guidance_refs:0") and got["x.md"][0] == 0.0


def test_donors(spark):
    body = "## Cel\n{}\n## Inne\nkeep\n## Zakres\nfull text\n"
    docs = spark.createDataFrame([("a/x_guide.md", "aligned_rev: 3\n# Risk guide\n" + body.format("[Termin 1]")), ("a/d.md", "# Risk guide large\n" + body.format("rich\nlines") + "y" * 100), ("a/e.md", "# Other thing\n" + body.format("not this") + "y" * 100)], "path string, text string")
    got = guidance.fill_from_donors(docs, ("Cel", "Zakres"), 100, 2).collect()
    assert [(r.path, r.donor) for r in got] == [("a/x_guide.md", "a/d.md")]
    assert got[0].text == "aligned_rev: 4\n# Risk guide\n" + body.format("rich\nlines")


def test_roles_come_from_their_section(spark):
    table = "| Działanie | Responsible |\n| {} | A |\n"
    docs = spark.createDataFrame([("a", "x", "# T\n" + table.format("no") + "## RACI i role\n" + table.format("yes") + "## Next\n" + table.format("no")), ("b", "Test", table.format("no"))], "doc_id string, title string, text string")
    assert {r.doc_id: (r.action, r.responsible) for r in raci.derive(docs).collect()} == {"a": ("yes", "A"), "b": ("Ogólna odpowiedzialność", "QA")}


def test_norms_and_markers(spark):
    assert one(spark, " ﻿Meta: 1. Żółć  X", U.key_norm) == "zołc x" and one(spark, " 2) Meta –  Żółć", T.norm_label) == "żółć"
    assert [one(spark, s, T.rebuilt_status) for s in ("TODO", "todo", "a...")] == ["placeholder", "unknown", "placeholder"]
    assert [one(spark, s, T.placeholder_body) for s in ("", " \n", "[a]\n- [b]\nc", "[a]\nb", "x [Termin 1] y", "- [ ] a")] == [True, True, True, False, True, False]
    assert [one(spark, s, T.path_norm) for s in ("./../a.md", ".generated_templates/x", "/generated_templates/x", "a/../b")] == ["a.md", "x", "x", "a/../b"]
    assert [one(spark, s, T.after_first) for s in ("a::b::c", "::x", "none")] == ["b::c", "x", None]
    x = spark.createDataFrame([("a\nb", "a\nb"), ("a", "b"), (None, None)], "p string, q string")
    assert [r.s for r in x.select(U.line_similarity("p", "q").alias("s")).collect()] == [1.0, 0.0, 1.0]


def test_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (4, "n"), (3, None)], "id int, v string")
    assert rows(sinks.upsert(old, new, ["id"], [F.desc("v")])) == [(1, "a"), (2, "y"), (3, None), (4, "n")]
    assert rows(sinks.update_by_key(old, new, ["id"], ["v"], [F.desc("v")])) == [(1, "a"), (2, "y"), (3, None)]
    assert rows(sinks.update_by_key(old, spark.createDataFrame([(1, None)], "id int, v string"), ["id"], ["v"], blank=True)) == [(1, None), (2, "b"), (3, None)]
    assert rows(sinks.delete_by_key(old, new, ["id"], unless=F.col("v") == "b")) == [(1, "a"), (2, "b")]
    snaps = spark.createDataFrame([(i, f"2024-{m:02}-15") for i, m in enumerate([1, 5, 6], 1)], "snapshot_id int, at string").withColumn("at", F.to_timestamp("at"))
    assert {r.snapshot_id for r in history.retention(snaps, 1, 1, baseline=1).collect()} == {1, 3}
    a, b = (spark.createDataFrame(x, "path string, hash string") for x in ([("k", "1"), ("a", "1"), ("b", "1")], [("k", "1"), ("c", "1")]))
    assert rows(history.transitions(a, b)) == [("a", "c", "moved"), ("b", None, "removed"), ("k", "k", "kept")]
    n = spark.createDataFrame([("m", "1", 1), ("m", "2", 9), ("o", "1", 5), ("o", "2", 6)], "metric string, snapshot_id string, n int")
    assert rows(history.deltas(n, {"m": (2, 5), "o": (2, 5)})) == [("m", "1", 1, None, "OK"), ("m", "2", 9, 8, "FAIL"), ("o", "1", 5, None, "OK"), ("o", "2", 6, 1, "OK")]
