"""Queries over the structure of documents: lines, sections, their metrics and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import dimensions, fixes, gates, graph, guidance, matching, quality, rebuild, services
from docloom.sources import files, sinks, versions

from . import bindings as B
from .bindings import with_views as V
from .registry import query

# Lines and sections ----------------------------------------------------------------------------
_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_HEAD = r"^(#{1,6})[\s\x{a0}]+(.*)$"


def _split(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_END}'), lambda x, i: x <> '' OR i < len(string_split_regex({text}, '{_END}')))"


_KINDS = ", ".join(f"count(*) FILTER (regexp_matches(line, '{p}')) AS {n}" for n, p in quality.LINES.items())
_MARKS = f"coalesce(sum(length(line)), 0)::BIGINT AS chars, count(line) AS lines, {_KINDS}"
_NOTES = V("notes", f", ls AS (SELECT doc_uid, origin, {_split('text')} AS ls FROM notes), ln AS (SELECT doc_uid, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line, len(ls) AS n FROM ls), sec AS (SELECT doc_uid, i AS start_line, coalesce(lead(i) OVER (PARTITION BY doc_uid ORDER BY i) - 1, n) AS end_line, length(regexp_extract(line, '{_HEAD}', 1)) AS level, trim(regexp_extract(line, '{_HEAD}', 2)) AS heading FROM ln WHERE regexp_matches(line, '{_HEAD}')), body AS (SELECT s.doc_uid, start_line, end_line, level, heading, regexp_replace(lower(heading), '^([0-9]+[.)] +)+', '') AS norm, lower(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i > start_line), '')) AS body, {_MARKS} FROM sec s JOIN ln l ON l.doc_uid = s.doc_uid AND i BETWEEN start_line AND end_line GROUP BY ALL), st AS (SELECT *, CASE WHEN trim(regexp_replace(body, '\\s', ' ', 'g')) = '' OR contains(body, '...') OR contains(body, 'todo') OR contains(body, 'tbd') THEN 'placeholder' ELSE 'filled' END AS status FROM body)").replace(" , ls AS", ", ls AS")

query("a11_line_metrics", f"SELECT doc_id, {_MARKS} FROM documents LEFT JOIN (SELECT doc_id, unnest({_split('text')}) AS line FROM documents) USING (doc_id) GROUP BY doc_id")(lambda s, d: quality.line_metrics(B.read(s, d, "documents")))


def _metrics(s, d):
    docs = B.notes(s, d)
    secs = quality.sections(docs)
    return docs, quality.section_metrics(secs, docs, keep=("status", "heading_norm"))


@query("w2_a11_section_metrics", _NOTES + f" SELECT doc_uid, start_line::INT AS start_line, end_line::INT AS end_line, level::INT AS level, heading, norm AS heading_norm, status, chars, lines, {', '.join(quality.LINES)} FROM st")
def _sections(s, d):
    docs = B.notes(s, d)
    facts = ("start_line", "end_line", "level", "heading", "heading_norm", "status")
    return quality.section_metrics(quality.sections(docs), docs, keep=facts).select("doc_uid", *facts, *quality.METRICS)


_HAS = " + ".join(f"bool_or(starts_with(norm, '{r}'))::INT" for r in quality.REQUIRED)
_ROLL = f", roll AS (SELECT doc_uid, count(*) AS sections, count(*) FILTER (status = 'placeholder') AS placeholders, sum(checkboxes)::BIGINT AS checkboxes, sum(phases)::BIGINT AS phase_bullets, {_HAS} AS has FROM st GROUP BY 1), rolled AS (SELECT doc_uid, origin, sections, placeholders, checkboxes, phase_bullets, CASE WHEN origin = 'core' THEN {len(quality.REQUIRED)} - has ELSE 0 END::BIGINT AS missing_required FROM roll JOIN notes USING (doc_uid))"


def _edges(s, d):
    k = F.col("doc_id")
    return B.read(s, d, "documents").select(F.lit("doc").alias("from_kind"), k.cast("string").alias("from_uid"), F.when(k % 4 == 0, "required").otherwise("navigational").alias("strength"), F.when(k % 8 != 0, "why").otherwise(" ").alias("rationale"))


def _rollup(s, d):
    docs, m = _metrics(s, d)
    return quality.document_rollup(docs, m, edges=_edges(s, d), unresolved=3)


query("a12_rollup", _NOTES + _ROLL + " SELECT *, (doc_uid::BIGINT % 8 = 0)::BIGINT AS links_without_rationale, 3::BIGINT AS unresolved FROM rolled")(_rollup)


@query("r19_a12_document_quality", _NOTES + _ROLL + " SELECT doc_uid, greatest(100 - (sections < 6)::INT * 20 - (placeholders / sections > 0.1)::INT * 25 - (missing_required > 0)::INT * 30 - (checkboxes < 2)::INT * 10 - (phase_bullets < 2)::INT * 20 - (doc_uid::BIGINT % 8 = 0)::INT * 10 - 5, 0)::BIGINT AS score, CASE WHEN missing_required > 0 OR sections < 6 THEN 'needs_structure' WHEN placeholders / sections > 0.1 OR checkboxes < 2 THEN 'needs_content' WHEN doc_uid::BIGINT % 8 = 0 THEN 'needs_links' ELSE 'ok' END AS status FROM rolled")
def _quality(s, d):
    bounds = {"min_sections": 6, "max_placeholder_ratio": 0.1, "min_checkboxes": 2, "require_phases": True, "min_phase_bullets": 2}
    return quality.document_score(_rollup(s, d).withColumns({k: F.lit(v) for k, v in bounds.items()}))


query("a13_required_coverage", _NOTES + f" SELECT doc_uid, ({_HAS})::BIGINT AS n_required, (CASE WHEN any_value(origin) = 'core' THEN {len(quality.REQUIRED)} - ({_HAS}) ELSE 0 END)::BIGINT AS n_missing FROM st JOIN notes USING (doc_uid) GROUP BY doc_uid")(lambda s, d: quality.required_coverage(B.notes(s, d), "doc_uid"))


def _kinds(s, d):
    """Edges to documents, sections, standards and nothing, checked each among its own kind."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, "doc").when(k % 4 == 1, "section").when(k % 4 == 2, "standard")
    e = B.read(s, d, "documents").select(k.alias("id"), F.concat(F.when(k % 8 < 4, "D").otherwise("S"), (k % 50).cast("string")).alias("to_uid"), kind.alias("to_kind"), F.when(k % 3 == 0, "required").otherwise("blocking").alias("strength"), F.when(k % 5 != 0, "why").alias("rationale"))
    i = B.read(s, d, "benchmark").select(F.col("item_id").cast("string").alias("i"))
    nodes = i.select(F.concat(F.lit("D"), "i").alias("uid"), F.lit("doc").alias("kind")).unionByName(i.select(F.concat(F.lit("S"), "i").alias("uid"), F.lit("section").alias("kind")))
    return quality.edge_health(e, nodes)


query("j18_r20_kinds", "WITH e AS (SELECT doc_id AS id, doc_id % 5 = 0 AS blank, doc_id % 3 = 0 AS req, (doc_id % 4 = 0 AND (doc_id % 8 >= 4 OR doc_id % 50 NOT IN (SELECT item_id FROM benchmark)) OR doc_id % 4 = 1 AND (doc_id % 8 < 4 OR doc_id % 50 NOT IN (SELECT item_id FROM benchmark))) AS gone FROM documents) SELECT id, CASE WHEN gone OR blank AND NOT req THEN 'fail' WHEN blank THEN 'warn' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN gone THEN 'TARGET_MISSING' END, CASE WHEN blank THEN 'MISSING_RATIONALE' END) AS reasons FROM e")(_kinds)

# Tables in versions, rebuilds, gates -----------------------------------------------------------


def _orders(s, d):
    return B.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))


@query("k1_k13_versions", "SELECT o_orderkey AS id, o_custkey AS k, o_totalprice * 2 AS v, 2 AS version FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 1 FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 3 FROM orders")
def _versions(s, d):
    """A table refreshed from itself, read at each version, and rolled back."""
    t = versions.Table(s, versions.scratch(s, "orders"))
    t.refresh(lambda _: _orders(s, d))
    t.refresh(lambda old: old.filter("id % 3 <> 0").withColumn("v", F.col("v") * 2))
    t.rollback(1)
    return t.read(1).withColumn("version", F.lit(1)).unionByName(t.read(2).withColumn("version", F.lit(2))).unionByName(t.read().withColumn("version", F.lit(3)))


@query("k2_parts", "SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_custkey % 10 = 3 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders")
def _parts(s, d):
    """The rows of some keys replaced in a table cut into parts: only their parts are written."""
    t = versions.Table(s, versions.scratch(s, "parts"), "k", 32)
    t.replace_parts(_orders(s, d), [str(i) for i in range(32)])
    new = _orders(s, d).filter("k % 10 = 3").withColumn("v", -F.col("v"))
    touched = [r.p for r in new.select(t.part().alias("p")).distinct().collect()]  # 32 at most
    t.replace_parts(t.read(parts=touched).filter("k % 10 <> 3").unionByName(new), touched)
    return t.read()


def _before(s, d):
    """The notes as they were: some with another text, some not there yet, some that have gone since."""
    k = F.col("doc_uid").try_cast("long")
    n = B.notes(s, d)
    old = n.filter(k % 7 != 1).select(F.col("doc_uid").alias("path"), F.when(k % 5 == 2, F.concat(F.lit("# Old\n"), "text")).otherwise(F.col("text")).alias("text"))
    return old.unionByName(n.filter(k % 50 == 4).select(F.concat(F.lit("gone-"), "doc_uid").alias("path"), "text")), n.select(F.col("doc_uid").alias("path"), "text")


query("s4_manifest_changes", V("notes", "SELECT doc_uid AS path, CASE WHEN doc_uid::BIGINT % 7 = 1 THEN 'added' ELSE 'changed' END AS change FROM notes WHERE doc_uid::BIGINT % 7 = 1 OR doc_uid::BIGINT % 5 = 2 UNION ALL SELECT 'gone-' || doc_uid, 'removed' FROM notes WHERE doc_uid::BIGINT % 50 = 4"))(
    lambda s, d: (lambda old, new: rebuild.changes(rebuild.manifest(new), rebuild.manifest(old)).select("path", "change"))(*_before(s, d))
)


@query("s4_x21_k2_rebuild", _NOTES.replace("WHERE regexp_matches(line", "WHERE trim(regexp_extract(line, '" + _HEAD + "', 2)) <> '' AND regexp_matches(line").replace("lower(coalesce(string_agg", "(coalesce(string_agg") + " SELECT doc_uid AS path, start_line::INT AS start_line, end_line::INT AS end_line, level::INT AS level, heading, CASE WHEN contains(body, 'TODO') OR contains(body, '...') THEN 'placeholder' ELSE 'unknown' END AS status FROM body")
def _rebuilt(s, d):
    """Sections after a second run over changed documents: only those were cut anew."""
    old, new = _before(s, d)
    store = versions.scratch(s, "sections")
    rebuild.rebuild(old, store)
    rebuild.rebuild(new, store)
    return rebuild.tables(s, store)[0].read().select("path", "start_line", "end_line", "level", "heading", "status")


@query("g6_gated_inference", "WITH d AS (SELECT DISTINCT ps AS a, pt AS b FROM (SELECT l_partkey AS ps, l_suppkey + 1000000 AS pt FROM lineitem UNION ALL SELECT l_suppkey + 1000000, l_suppkey % 7 FROM lineitem)) SELECT a AS from_node, b AS to_node, 'infer_v1' AS source FROM (SELECT DISTINCT x.a, y.b FROM d x JOIN d y ON x.b = y.a WHERE x.a <> y.b) WHERE (a, b) NOT IN (SELECT (a, b) FROM d)")
def _inferred(s, d):
    """Inference after its predecessor's row in the run log: parts to groups of suppliers by way of the suppliers, who are hubs."""
    x = B.read(s, d, "lineitem")
    sup = F.col("l_suppkey") + 1_000_000
    e = x.select(F.col("l_partkey").alias("from_node"), sup.alias("to_node")).unionByName(x.select(sup.alias("from_node"), (F.col("l_suppkey") % 7).alias("to_node")))
    log = versions.scratch(s, "log")
    sinks.run_log(s, "1", "2026-01-01T00:00:00Z", graph.PREDECESSOR, "OK", "", log)
    return graph.infer_edges(s, e, log, versions.scratch(s, "inferred"), "2", "2026-01-01T00:01:00Z")


def _gate_tables(s, d):
    """Files and what is known of them: some without a record, some records stale, without a hash or without a file."""
    k = F.col("doc_uid").cast("long")
    n = B.notes(s, d)
    files_ = n.filter(k % 11 != 3).select(F.col("doc_uid").alias("path"), F.when(k % 13 == 5, F.concat("text", F.lit("\U0001f680"))).when(k % 17 == 8, "copy").otherwise(F.col("text")).alias("text"))
    title = F.concat(F.lit("t"), (k - k % 2).cast("string"))
    known = n.filter(k % 19 != 7).select(F.col("doc_uid").alias("path"), F.when(k % 3 == 0, title).alias("title_norm"), F.when(k % 23 == 9, None).when(k % 29 == 6, "stale").otherwise(T.hash_v2("text")).alias("hash_sha256_v2"))
    return files_, known, n.filter(k % 31 == 0)


_GATED = (
    "WITH n AS (SELECT doc_id AS k FROM documents), f AS (SELECT k FROM n WHERE k % 11 <> 3), r AS (SELECT k FROM n WHERE k % 19 <> 7), g AS ("
    "SELECT 'emoji_files' AS gate, count(*) FILTER (k % 13 = 5) AS value FROM f UNION ALL SELECT 'files_without_record', count(*) FILTER (k % 19 = 7) FROM f UNION ALL SELECT 'records_without_file', count(*) FILTER (k % 11 = 3) FROM r "
    "UNION ALL SELECT 'hash_missing', count(*) FILTER (k % 23 = 9) FROM r UNION ALL SELECT 'hash_differs', count(*) FILTER (k % 11 <> 3 AND k % 23 <> 9 AND (k % 29 = 6 OR k % 13 = 5 OR k % 17 = 8)) FROM r "
    "UNION ALL SELECT 'collisions_title_norm', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM r WHERE k % 3 = 0 GROUP BY k - k % 2) "
    "UNION ALL SELECT 'dup_content_hashes', count(*) FROM (SELECT 1 FROM f WHERE k % 17 = 8 AND k % 13 <> 5 HAVING count(*) > 1) UNION ALL SELECT 'anomalies_total', count(*) FILTER (k % 31 = 0) FROM n)"
    " SELECT gate, value, CASE WHEN gate IN ('anomalies_total', 'hash_missing') THEN value - 1 END AS before, CASE WHEN gate IN ('anomalies_total', 'hash_missing') THEN 1::BIGINT END AS delta, CASE WHEN value > 0 AND gate IN ('emoji_files', 'files_without_record', 'records_without_file', 'hash_missing', 'hash_differs') THEN 'FAIL' ELSE 'OK' END AS status FROM g"
)


@query("r25_gates", _GATED)
def _gated(s, d):
    values = gates.measure(*_gate_tables(s, d))
    return gates.judge(values, values.filter("gate in ('anomalies_total', 'hash_missing')").withColumn("value", F.col("value") - 1))


@query("s11_git_log", "SELECT 'h' || o_orderkey AS hash, strftime(o_orderdate, '%Y-%m-%d') AS date, 'set | ' || o_orderpriority AS subject, o_clerk AS author, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['M'] ELSE ['R', 'A'] END) AS status, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['core/' || o_custkey || '.md'] ELSE ['new ' || o_custkey || '.md', 'COMMIT|' || o_orderkey] END) AS path, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [NULL] ELSE ['old.md', NULL] END) AS old_path FROM (SELECT *, 'Me' AS o_clerk FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders))")
def _git(s, d):
    """A log written by many tasks and read by many."""
    o, lit = B.read(s, d, "orders"), F.lit
    files_ = F.when(F.col("o_orderkey") % 2 == 0, F.concat(lit("M\tcore/"), "o_custkey", lit(".md"))).otherwise(F.concat(lit("R097\told.md\tnew "), "o_custkey", lit(".md\nA\tCOMMIT|"), "o_orderkey"))
    path = versions.scratch(s, "gitlog")
    o.select(F.concat(lit("COMMIT|h"), "o_orderkey", lit("|"), F.date_format("o_orderdate", "yyyy-MM-dd"), lit("|set | "), "o_orderpriority", lit("|Me\n\n"), files_).alias("value")).write.text(path)
    return files.git_log(s, path)


@query("s7_k15_saved_plan", V("markdown", "SELECT path, 0 AS seq, CASE WHEN starts_with(text, '---') THEN 'DOC.FRONTMATTER.NO_TITLE' ELSE 'DOC.FRONTMATTER.MISSING' END AS rule_id, CASE WHEN starts_with(text, '---') THEN 'WARNING' ELSE 'ERROR' END AS severity, 'report_only' AS action, NULL AS section FROM markdown WHERE NOT starts_with(text, '---') OR NOT contains(text, 'title:')"))
def _plan(s, d):
    """Findings written as a plan and read again, those for review alone."""
    path = versions.scratch(s, "plan")
    fixes.save_plan(fixes.findings(B.markdown(s, d)), path, "r1", "analyze", "core")
    return fixes.selected(fixes.load_plan(s, path), "review").select("path", "seq", "rule_id", "severity", "action", "section")


@query("o1_pages_by_key", V("mapping", "SELECT * FROM (SELECT DISTINCT * FROM mapping) ORDER BY confidence DESC NULLS LAST, doc_path NULLS FIRST, standard_code, match_reason LIMIT 60"))
def _pages(s, d):
    """Three pages of twenty, each found by the last one's cursor."""
    m, rows, after = B.mapping(s, d).distinct(), [], None
    for _ in range(3):
        page, after = services.page_after(m, services.BY_CONFIDENCE, 20, after)
        rows += page
    return s.createDataFrame(rows, m.schema)


# Dimensions that come with the library, over the given tables ------------------------------------


def _values(rows) -> str:
    """SQL of rows of text and numbers."""
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


_ISIC = list(dimensions.ISIC)
_KEYS = list(dimensions.SECTION_STANDARDS)
_PAIRS = [(k, i, c) for k, codes in dimensions.SECTION_STANDARDS.items() for i, c in enumerate(codes)]


def _pick(values: list[str], column: str):
    """One of some values by a number; null beyond them."""
    return F.try_element_at(F.lit(values), (F.col(column) % (len(values) + 3) + 1).cast("int"))


@query("s12_j27_industries", f"SELECT c_custkey, coalesce(name, 'no code') AS name FROM (SELECT c_custkey, list_extract({[*_ISIC]}, c_custkey % {len(_ISIC) + 3} + 1) AS code FROM customer) LEFT JOIN {_values(dimensions.ISIC.items())} i(code, name) USING (code)")
def _industries(s, d):
    """Customers with the names of the industries of the shipped table."""
    rows = B.read(s, d, "customer").select("c_custkey", F.coalesce(_pick(_ISIC, "c_custkey"), F.concat(F.lit("none "), "c_custkey")).alias("code"))
    names = guidance.branch_names(rows.select("code", F.lit(" no  code ").alias("tag")).distinct(), dimensions.industries(s))
    return rows.join(names, "code").select("c_custkey", "name")


@query("s12_r14_section_codes", f"WITH k AS (SELECT o_orderkey AS id, list_extract({_KEYS}, o_orderkey % {len(_KEYS) + 3} + 1) AS section_norm FROM orders), c AS (SELECT section_norm, list(code ORDER BY seq) AS l FROM {_values(_PAIRS)} p(section_norm, seq, code) WHERE code <> 'NIS2' GROUP BY 1) SELECT id, '[\"' || array_to_string(l, '\",\"') || '\"]' AS codes FROM k LEFT JOIN c USING (section_norm)")
def _section_codes(s, d):
    """Guidance of sections enriched with the standards of the shipped table, those that are known."""
    o = B.read(s, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("id"), F.lit("none").alias("doc_title"), F.upper(F.coalesce(_pick(_KEYS, "o_orderkey"), F.lit("?"))).alias("section_title"))
    extra = dimensions.section_codes(s)
    none = o.select(F.lit("x").alias("doc_path"), F.lit("x").alias("standard_code")).limit(0)
    return guidance.enrich(asked, none.select(F.col("doc_path").alias("path"), F.col("doc_path").alias("title")), none, extra, extra.filter("standard_code <> 'NIS2'").select("standard_code"), "standard_code")


_TITLES = [r[3] for r in dimensions.control_rows()]
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({1}, t)))"


@query("s13_j21_controls", f"WITH d AS (SELECT 'p' || p_partkey || '.md' AS path, list_extract({_TITLES}, p_partkey % {len(_TITLES) + 3} + 1) || ' ' || p_name AS t FROM part), x AS (SELECT path, {_WORDS.format('t', list(T.CONTROL_STOP))} AS a FROM d WHERE t IS NOT NULL), c AS (SELECT *, {_WORDS.format('title', list(T.CONTROL_STOP))} AS b FROM {_values(dimensions.control_rows())} v(standard_code, seq, control_id, title, theme)), s AS (SELECT path, standard_code, seq, control_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) AS s FROM x, c) SELECT path, standard_code, control_id, round_even(s, 4) AS confidence, row_number() OVER (PARTITION BY path, standard_code ORDER BY s DESC, seq)::INT AS rank FROM s WHERE s >= 0.05 QUALIFY rank <= 5")
def _controls(s, d):
    """Documents mapped to the controls that come with the library."""
    docs = B.read(s, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), F.concat(_pick(_TITLES, "p_partkey"), F.lit(" "), "p_name").alias("title")).filter("title is not null")
    return matching.map_controls(docs, guidance.controls(s))


_ITEMS = [(f"{code} {e[0]}", e[1]) for code, entries in dimensions.CATALOGUE.items() for e in entries]


@query("s13_j23_catalogue", f"WITH e AS (SELECT * FROM {_values(_ITEMS)} v(entry, t)), d AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0') AS path, list_extract({[t for _, t in _ITEMS]}, p_partkey % {len(_ITEMS) + 5} + 1) AS title FROM part) SELECT entry, min(path) AS path, t AS title, 'exact' AS confidence FROM e JOIN d ON title = t GROUP BY 1, 3")
def _catalogue(s, d):
    """The best document for each entry of the shipped catalogue."""
    titles = [t for _, t in _ITEMS]
    docs = B.read(s, d, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"), F.try_element_at(F.lit(titles), (F.col("p_partkey") % (len(titles) + 5) + 1).cast("int")).alias("title"))
    entries = dimensions.catalogue(s).select(F.concat_ws(" ", "standard_code", "item_code").alias("entry"), F.col("title").alias("doc_title"))
    return guidance.match_catalogue(entries, docs.filter("title is not null"))
