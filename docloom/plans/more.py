"""Further queries: references in all forms, edges, fixes, templates, files against tables, audits, guidance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.functions import unicode as U
from docloom.operators import analytics, audit, fixes, graph, guidance, links, matching, quality, sections, services, sync, templates

from . import bindings as B
from .bindings import with_views as V
from .registry import over, query

# References ------------------------------------------------------------------------------------
_ENDS = "ends AS (SELECT id, 'from' AS side, from_ref AS ref, context_doc_uid FROM refs UNION ALL SELECT id, 'to', to_ref, context_doc_uid FROM refs)"
_LABELS = r"lab AS (SELECT id, side, context_doc_uid, replace(trim(regexp_replace(regexp_replace(lower(trim(substr(ref, 10))), '^(\d+[.)]\s+)+', ''), '^meta\s*[:\-–—]\s*', '')), ' ', '-') AS key FROM ends WHERE ref ILIKE 'section::%'), idx AS (SELECT DISTINCT doc_uid, section_uid, unnest([heading_norm, replace(heading_norm, ' ', '-'), lower(anchor)]) AS key FROM usections), own AS (SELECT doc_uid, key, count(*) AS n, min(section_uid) AS uid FROM idx GROUP BY 1, 2), alls AS (SELECT key, count(*) AS n, min(section_uid) AS uid FROM idx GROUP BY 1), res AS (SELECT id, side, CASE WHEN own.n = 1 THEN 'context_doc' WHEN own.n > 1 THEN 'ambiguous' WHEN alls.n = 1 THEN 'global_unique' WHEN alls.n > 1 THEN 'ambiguous' ELSE 'missing' END AS method, own.uid AS u1, alls.uid AS u2 FROM lab LEFT JOIN own ON own.doc_uid = context_doc_uid AND own.key = lab.key LEFT JOIN alls ON alls.key = lab.key)"
_EXPLICIT = "ex AS (SELECT id, side, regexp_extract(ref, '(?i)^doc::([0-9A-Z]{26})::', 1) AS du, regexp_extract(ref, '(?i)::section::([a-z0-9-]+)', 1) AS an, coalesce(try_cast(regexp_extract(ref, '::([0-9]+)$', 1) AS INT), 1) AS o FROM ends WHERE ref ILIKE 'doc::%')"
_RESOLVED = f"{_ENDS}, {_LABELS}, {_EXPLICIT}, out AS (SELECT ex.id, side, section_uid AS to_uid, CASE WHEN section_uid IS NULL THEN 'missing' ELSE 'explicit' END AS method, CASE WHEN section_uid IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM ex LEFT JOIN usections ON doc_uid = du AND anchor = an AND ordinal = o UNION ALL SELECT id, side, CASE method WHEN 'context_doc' THEN u1 WHEN 'global_unique' THEN u2 END, method, CASE method WHEN 'context_doc' THEN 0.95::DOUBLE WHEN 'global_unique' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END FROM res)"


def _with(views: str, ctes: str, body: str) -> str:
    return V(views, "").rstrip() + ", " + ctes + " " + body


def _sides(f, x):
    """f of the origins and of the targets, told apart by ``side``."""
    ends = [f(x.select("id", F.col(f"{s}_ref").alias("ref"), "context_doc_uid")).withColumn("side", F.lit(s)) for s in ("from", "to")]
    return ends[0].unionByName(ends[1])


query("j10_j11_references", _with("refs usections", _RESOLVED, "SELECT * FROM out"))(lambda s, d: _sides(lambda r: links.resolve_refs(r, B.usections(s, d)), B.refs(s, d)))
query("j13_both_ends_of_references", _with("refs usections", _RESOLVED, "SELECT a.id, a.to_uid AS from_uid, b.to_uid, CASE WHEN a.method = b.method THEN a.method ELSE 'mixed' END AS method, least(a.confidence, b.confidence) AS confidence, CASE WHEN a.method = 'context_doc' AND b.method = 'context_doc' THEN context_doc_uid END AS notes FROM out a JOIN out b ON a.id = b.id AND a.side = 'from' AND b.side = 'to' JOIN refs r ON r.id = a.id AND from_type = 'section' AND to_type = 'section' WHERE a.to_uid IS NOT NULL AND b.to_uid IS NOT NULL"))(
    lambda s, d: links.both_ends(*(links.resolve_refs(B.refs(s, d).select("id", F.col(c).alias("ref"), "context_doc_uid"), B.usections(s, d)) for c in ("from_ref", "to_ref")), B.refs(s, d))
)
query("j14_titled_references", _with("refs udocs usections", _ENDS, "SELECT e.id, e.side, s.section_uid AS to_uid, CASE WHEN u IS NULL THEN 'missing_doc' WHEN s.section_uid IS NULL THEN 'missing_section' ELSE 'context_doc' END AS method, CASE WHEN s.section_uid IS NULL THEN 0.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM (SELECT id, side, lower(trim(regexp_extract(ref, '^document::(.+?)::section::', 1))) AS t, replace(lower(trim(regexp_extract(ref, '::section::(.+)$', 1))), ' ', '-') AS a FROM ends WHERE ref ILIKE 'document::%::section::%') e LEFT JOIN (SELECT lower(title) AS t, min(doc_uid) AS u FROM udocs GROUP BY 1) USING (t) LEFT JOIN (SELECT doc_uid, anchor, max(section_uid) AS section_uid FROM usections GROUP BY 1, 2) s ON s.doc_uid = u AND anchor = a"))(
    lambda s, d: _sides(lambda r: links.resolve_titled(r, B.udocs(s, d), B.usections(s, d)), B.refs(s, d))
)
over("j15_document_dependencies", "refs udocs", links.document_dependencies, "SELECT f AS from_doc, u AS to_doc, CASE WHEN max(required) = 1 THEN 'requires' ELSE 'relates_to' END AS dependency_type FROM (SELECT coalesce(a.u, context_doc_uid) AS f, b.u, required FROM refs LEFT JOIN (SELECT lower(title) AS t, max(doc_uid) AS u FROM udocs GROUP BY 1) a ON a.t = lower(trim(substr(from_ref, 11))) JOIN (SELECT lower(title) AS t, max(doc_uid) AS u FROM udocs GROUP BY 1) b ON b.t = lower(trim(substr(to_ref, 11))) WHERE to_type = 'document') WHERE f <> u GROUP BY 1, 2")


def _edge_tables(s, d):
    """Title links from the references between documents, section links from those by title and section, and all of them raw."""
    x = B.refs(s, d).withColumn("rationale", F.when(F.col("id") % 4 != 0, "why")).withColumn("direction", F.lit("both"))
    doc = x.filter("to_type = 'document'").select("id", F.trim(T.after_first("from_ref")).alias("doc_title"), F.trim(T.after_first("to_ref")).alias("depends_on_title"), F.when(F.col("id") % 16 == 5, "Requires").when(F.col("id") % 3 == 0, "").alias("dependency_type"), "rationale")
    titled = F.regexp_extract("to_ref", links.TITLED, 1), F.regexp_extract("to_ref", links.TITLED, 2)
    sec = x.filter(F.col("to_ref").rlike(links.TITLED)).select("id", titled[0].alias("doc_title"), titled[1].alias("section_title"), "link_type", "direction", "rationale")
    known = s.createDataFrame([("refers_to",)], "code string")
    return links.materialize_edges(doc, sec, x, B.udocs(s, d), B.usections(s, d), known)


_EDGES = "dm AS (SELECT lower(title) AS t, max(doc_uid) AS u FROM udocs GROUP BY 1), sm AS (SELECT doc_uid, heading_norm, coalesce(max(section_uid) FILTER (ordinal = 1), min(section_uid)) AS u FROM usections GROUP BY 1, 2), x AS (SELECT *, CASE WHEN id % 4 <> 0 THEN 'why' END AS rationale FROM refs), e AS (SELECT 'doc' AS from_kind, a.u AS from_uid, 'doc' AS to_kind, b.u AS to_uid, CASE WHEN id % 16 = 5 THEN 'requires' ELSE 'depends_on' END AS link_type, 'forward' AS direction, rationale, 'navigational' AS strength, 'doc_doc_links' AS source, id AS source_row_id FROM x JOIN dm a ON a.t = lower(trim(substr(from_ref, 11))) JOIN dm b ON b.t = lower(trim(substr(to_ref, 11))) WHERE to_type = 'document' UNION ALL SELECT 'doc', dm.u, 'section', sm.u::VARCHAR, link_type, 'both', rationale, 'navigational', 'doc_section_links', id FROM x JOIN dm ON t = lower(trim(regexp_extract(to_ref, '^document::(.+?)::section::', 1))) JOIN sm ON doc_uid = dm.u AND heading_norm = lower(trim(regexp_extract(to_ref, '::section::(.+)$', 1))) WHERE to_ref ILIKE 'document::%::section::%' UNION ALL SELECT CASE from_type WHEN 'section' THEN 'section' ELSE 'doc' END, from_ref, CASE to_type WHEN 'section' THEN 'section' ELSE 'doc' END, to_ref, link_type, 'both', rationale, CASE required WHEN 1 THEN 'required' ELSE 'navigational' END, 'content_links', id FROM x)"
query("j8_j9_r21_edges", _with("refs udocs usections", _EDGES, "SELECT * FROM e"))(lambda s, d: _edge_tables(s, d)[0])
query("r21_link_types", _with("refs udocs usections", _EDGES, "SELECT DISTINCT link_type AS code, 'auto-imported from doc_doc_links' AS description FROM e WHERE link_type NOT IN ('refers_to')"))(lambda s, d: _edge_tables(s, d)[1])
over("f7_structured_references", "refs", links.structured, "SELECT id FROM refs WHERE from_ref ILIKE 'document::%::section::%' OR to_ref ILIKE 'document::%::section::%'")
over("x44_after_first", "refs", lambda x: x.select("id", T.after_first("to_ref").alias("rest")), "SELECT id, CASE WHEN contains(to_ref, '::') THEN substr(to_ref, instr(to_ref, '::') + 2) END AS rest FROM refs")

# Fixes and templates ---------------------------------------------------------------------------
_FRONT = "starts_with(text, '---')"
_LACK = {h: f"NOT contains(text, '{h}' || chr(10))" for h in templates.REQUIRED}
_SUN = "regexp_matches(text, '[☀\U0001f680]')"
_FOUND = (
    "f AS (SELECT path, unnest(list_filter([CASE WHEN NOT " + _FRONT + " THEN ['DOC.FRONTMATTER.MISSING', 'ERROR', 'report_only', NULL, 'n'] END, CASE WHEN " + _FRONT + " AND NOT contains(text, 'title:') THEN ['DOC.FRONTMATTER.NO_TITLE', 'WARNING', 'report_only', NULL, 'n'] END, "
    + ", ".join(f"CASE WHEN {c} THEN ['DOC.SECTION.MISSING', 'ERROR', 'insert_section', '{h}', 'y'] END" for h, c in _LACK.items())
    + ", CASE WHEN " + _SUN + " THEN ['DOC.EMOJI.FORBIDDEN', 'WARNING', 'strip_emoji', NULL, 'y'] END], lambda x: x IS NOT NULL)) AS f FROM markdown)"
)
query("r2_findings", _with("markdown", _FOUND, "SELECT path, row_number() OVER (PARTITION BY path ORDER BY CASE f[1] WHEN 'DOC.FRONTMATTER.MISSING' THEN 0 WHEN 'DOC.FRONTMATTER.NO_TITLE' THEN 0 WHEN 'DOC.SECTION.MISSING' THEN 1 ELSE 2 END, CASE f[4] WHEN '## Cel dokumentu' THEN 1 WHEN '## Zakres i granice' THEN 2 ELSE 3 END)::INT - 1 AS seq, f[1] AS rule_id, f[2] AS severity, f[3] AS action, f[4] AS section, f[5] = 'y' AS safe FROM f"))(lambda s, d: fixes.findings(B.markdown(s, d)))
query("a17_counts_by_rule", _with("markdown", _FOUND, "SELECT f[1] AS rule_id, f[2] AS severity, f[5] = 'y' AS safe, count(*) AS n, count(DISTINCT path) AS files FROM f GROUP BY 1, 2, 3"))(lambda s, d: fixes.plan_summary(fixes.findings(B.markdown(s, d))))
_FIXED = "CASE WHEN " + " OR ".join([*_LACK.values(), "FALSE"]) + " THEN rtrim(text, chr(10)) || " + " || ".join(f"CASE WHEN {c} THEN chr(10) || chr(10) || '{h}' || chr(10) || '{fixes.PLACEHOLDERS[h].rstrip()}' ELSE '' END" for h, c in _LACK.items()) + " || chr(10) ELSE text END"
query("r4_r5_apply_safe", V("markdown", f"SELECT path, sha256(text) AS hash_before, sha256(regexp_replace({_FIXED}, '[☀\U0001f680]', '', 'g')) AS hash_after FROM markdown"))(lambda s, d: fixes.apply_safe(B.markdown(s, d), fixes.findings(B.markdown(s, d))).select("path", "hash_before", "hash_after"))
query("r5_apply_plan", _with("markdown", _FOUND, "SELECT status, count(*) AS n FROM (SELECT path, CASE WHEN path LIKE '%7.md' THEN 'error' WHEN bool_or(f[5] = 'y') THEN 'changed' ELSE 'skipped' END AS status FROM f GROUP BY 1) GROUP BY 1"))(
    lambda s, d: fixes.apply_plan(B.markdown(s, d).filter("path not like '%7.md'"), fixes.findings(B.markdown(s, d))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)
over("r9_violations", "markdown", fixes.violations, "SELECT path, v[1] AS violation_type, v[2] AS severity FROM (SELECT path, unnest(list_filter([CASE WHEN NOT " + _FRONT + " THEN ['FRONTMATTER_MISSING', 'ERROR'] END, CASE WHEN " + _FRONT + " AND NOT contains(text, 'title:') THEN ['NO_TITLE', 'WARNING'] END, " + ", ".join(f"CASE WHEN {c} THEN ['SECTION_MISSING:{h[3:]}', 'ERROR'] END, CASE WHEN contains(text, '{h}' || chr(10) || '##') OR ends_with(text, '{h}' || chr(10)) THEN ['EMPTY_SECTION:{h[3:]}', 'WARNING'] END" for h, c in _LACK.items()) + "], lambda x: x IS NOT NULL)) AS v FROM markdown)")
over("r7_validate_templates", "markdown", templates.validate, "SELECT path, unnest(list_filter([CASE WHEN NOT " + _FRONT + " THEN 'front matter missing' END, CASE WHEN " + _FRONT + " AND NOT contains(text, 'title:') THEN 'missing field: title' END, CASE WHEN " + _FRONT + " THEN 'missing field: aligned' END, " + ", ".join(f"CASE WHEN {_FRONT} AND {c} THEN 'missing section: {h}' END" for h, c in _LACK.items()) + ", CASE WHEN " + _FRONT + " AND contains(text, '[osoba/rola]') THEN 'forbidden placeholder: [osoba/rola]' END, CASE WHEN " + _FRONT + " AND regexp_matches(text, '[☀\U0001f680漢]') THEN 'emoji' END], lambda x: x IS NOT NULL)) AS error FROM markdown")
over("x28_x29_emoji_lines", "markdown", templates.emoji_lines, "SELECT path, i::INT AS line_no, l[i] AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM markdown), unnest(range(1, len(l) + 1)) AS u(i) WHERE regexp_matches(l[i], '[☀\U0001f680]')")
over("x14_title_of_file", "markdown", lambda m: m.select("doc_id", T.title_of_file(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("none"), F.concat(F.lit("a/My_"), "doc_id", F.lit(".md_x.md"))).alias("title")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN p_name ELSE 'My ' || doc_id || ' x' END AS title FROM markdown JOIN part ON p_partkey = doc_id")
over("x21_x22_placeholders", "markdown", lambda m: m.select("doc_id", T.rebuilt_status(F.col("text")).alias("rebuilt"), T.placeholder_body(F.when(F.col("doc_id") % 3 == 0, F.lit("[a]\n- [b]\nc")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x\n[Termin 1] "), F.lit("y"))).otherwise(F.lit("[a]\nb"))).alias("hollow")), "SELECT doc_id, CASE WHEN contains(text, 'TODO') OR contains(text, '...') THEN 'placeholder' ELSE 'unknown' END AS rebuilt, doc_id % 3 <> 2 AS hollow FROM markdown")
over("x51_path_norm", "docs", lambda x: x.select("doc_uid", T.path_norm(F.concat(F.lit("./../generated_templates/"), "path")).alias("path")), "SELECT doc_uid, coalesce(path, '') AS path FROM docs")
query("x8_x9_x10_norms", "SELECT p_partkey, lower(p_name) AS plain, lower(p_name) AS label, lower(p_name) || ' ecole' AS key FROM part")(
    lambda s, d: B.read(s, d, "part").select("p_partkey", T.title_norm_plain(F.concat(F.lit("  "), F.upper("p_name"))).alias("plain"), T.norm_label(F.concat(F.lit(" 1. Meta:  "), "p_name")).alias("label"), U.key_norm(F.concat(F.lit("META - 2) "), "p_name", F.lit(" École"))).alias("key"))
)
query("x23_x24_words", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 2))), ' ') AS control, array_to_string(list_sort(list_distinct(list_filter(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 2) || ['żółć'], lambda t: TRUE))), ' ') AS title FROM part")(
    lambda s, d: B.read(s, d, "part").select("p_partkey", F.array_join(F.array_sort(T.control_words(F.concat(F.lit("The information of "), "p_name"))), " ").alias("control"), F.array_join(F.array_sort(T.title_words(F.concat(F.lit("Plan dla żółć "), "p_name"))), " ").alias("title"))
)
query("x2_x3_x4_anchors", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS trimmed, 'faza-3-' || replace(lower(p_name), ' ', '-') AS plain, replace(lower(p_name), ' ', '-') AS section FROM part")(
    lambda s, d: B.read(s, d, "part").select("p_partkey", T.to_anchor(F.concat(F.lit("- "), "p_name", F.lit(" -")), trim=True).alias("trimmed"), T.to_anchor(F.concat(F.lit("Faza 3: "), "p_name"), phases=False).alias("plain"), T.slug_section(F.concat(F.lit("1. "), "p_name")).alias("section"))
)
query("x27_line_similarity", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS ratio FROM part")(
    lambda s, d: B.read(s, d, "part").select("p_partkey", U.line_similarity(F.concat("p_name", F.lit("\nb")), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("\nb"))).when(F.col("p_partkey") % 3 == 1, F.lit("c\nd")).otherwise(F.concat("p_name", F.lit("\nc")))).alias("ratio"))
)
_HEADINGS = r"WITH_VIEW, h AS (SELECT doc_id, i::INT AS line_no, len(l) AS n_lines, length(regexp_extract(l[i], '^(#+)', 1))::INT AS level, trim(regexp_extract(l[i], '^#+ (.*)$', 1)) AS heading, p_name AS h1 FROM (SELECT doc_id, p_name, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM markdown JOIN part ON p_partkey = doc_id), unnest(range(1, len(l) + 1)) AS u(i) WHERE regexp_matches(l[i], '^#{1,6} \S')), a AS (SELECT *, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(heading), '^(\d+\. )+', ''), '\s+', ' ', 'g'), '[^a-z0-9 -]', '', 'g'), ' ', '-'), '^-+|-+$', '', 'g') AS anchor, CASE WHEN level = 1 THEN heading WHEN level = 2 THEN h1 || ' > ' || heading ELSE h1 || ' > ' || last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) || ' > ' || heading END AS heading_path FROM h) SELECT doc_id, line_no, lead(line_no - 1, 1, n_lines) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS end_line, level, heading, anchor, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY line_no)::INT AS ordinal, heading_path FROM a"
query("w1_w4_headings", _HEADINGS.replace("WITH_VIEW", V("markdown", "").rstrip()))(lambda s, d: quality.headings(B.markdown(s, d)))

# Sections and their contracts ------------------------------------------------------------------


def _contracts(s, d):
    k = F.col("p_partkey")
    x = B.read(s, d, "part")
    sec = x.select(k.alias("section_uid"), F.col("p_brand").alias("doc_uid"), F.when(k % 5 == 0, "placeholder").otherwise("filled").alias("status"))
    met = x.filter(k % 7 != 0).select(k.alias("section_uid"), (k % 6).alias("lines"), (k % 4).alias("checkboxes"))
    gates = x.filter(k % 3 == 0).select(F.lit("section").alias("scope_kind"), k.cast("string").alias("scope_uid"), F.when(k % 2 == 0, '[{"gate":"min_checkboxes","min":2},{"gate":"other","min":9}]').otherwise("[bad").alias("gates_json"))
    return sec.withColumn("section_uid", F.col("section_uid").cast("string")), met.withColumn("section_uid", F.col("section_uid").cast("string")), gates.unionByName(x.select(F.lit("doc").alias("scope_kind"), F.col("p_brand").alias("scope_uid"), F.lit('[{"gate":"min_checkboxes","min":1}]').alias("gates_json")).filter("scope_uid < 'Brand#2'").distinct())


query("j1_x42_r18_scan_sections", "SELECT k::VARCHAR AS section_uid, (CASE WHEN l = 0 THEN 0 ELSE greatest(100 - CASE WHEN p THEN 40 ELSE 0 END - CASE WHEN l < 3 THEN 20 ELSE 0 END - CASE WHEN g THEN 10 ELSE 0 END, 0) END)::BIGINT AS score, CASE WHEN l = 0 THEN 'needs_structure' WHEN p OR l < 3 OR g THEN 'needs_content' ELSE 'ok' END AS status FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey % 6 END AS l, p_partkey % 5 = 0 AS p, CASE WHEN p_partkey % 6 = 0 THEN (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey % 4 END) < 2 WHEN p_partkey % 3 = 0 THEN FALSE WHEN p_brand < 'Brand#2' THEN (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey % 4 END) < 1 ELSE FALSE END AS g FROM part)")(lambda s, d: quality.scan_sections(*_contracts(s, d)))
over("r20_content_link_health", "refs", lambda x: quality.edge_health(links.raw_edges(x.withColumns({"rationale": F.when(F.col("id") % 4 != 0, "why"), "direction": F.lit("x")})).withColumnRenamed("source_row_id", "id"), x.select(F.lit("none").alias("uid")).limit(0)).groupBy("status", "reasons").agg(F.count(F.lit(1)).alias("n")), "SELECT 'warn' AS status, CASE WHEN required = 1 AND id % 4 = 0 THEN 'CONTENT_LINK_UNRESOLVED,MISSING_RATIONALE' ELSE 'CONTENT_LINK_UNRESOLVED' END AS reasons, count(*) AS n FROM refs GROUP BY 2")


def _graph_sections(s, d):
    k = F.col("p_partkey")
    return B.read(s, d, "part").select(F.concat(F.lit("s"), k).alias("section_uid"), F.col("p_brand").alias("doc_uid"), F.col("p_name").alias("heading"), (k % 3 + 2).alias("level"), k.alias("ordinal"))


query("g4_nodes", "SELECT DISTINCT p_brand AS node_uid, 'doc' AS kind, NULL AS parent_node_uid, p_brand AS title FROM part UNION ALL SELECT 's' || k, CASE WHEN l = 0 THEN 'sec' ELSE 'subsec' END, CASE WHEN l = 1 AND a0 IS NOT NULL THEN 's' || a0 WHEN l = 2 AND greatest(a0, a1) IS NOT NULL THEN 's' || greatest(a0, a1) ELSE p_brand END, p_name FROM (SELECT p_partkey AS k, p_brand, p_name, p_partkey % 3 AS l, max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) OVER w AS a0, max(CASE WHEN p_partkey % 3 = 1 THEN p_partkey END) OVER w AS a1 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")(
    lambda s, d: graph.nodes(B.read(s, d, "part").select(F.col("p_brand").alias("doc_uid"), F.col("p_brand").alias("title")).distinct(), _graph_sections(s, d))
)
for _name, _near, _far in (("g1_downstream_edges", "from_node", "to_node"), ("g2_upstream_edges", "to_node", "from_node")):
    query(_name, V("edges", f"SELECT DISTINCT 1 AS distance, from_node, to_node, t AS edge_type FROM (SELECT *, CASE WHEN weight > 0.05 THEN 'feeds' ELSE 'informs' END AS t FROM edges) WHERE {_near} = 1 UNION ALL SELECT DISTINCT 2, from_node, to_node, t FROM (SELECT *, CASE WHEN weight > 0.05 THEN 'feeds' ELSE 'informs' END AS t FROM edges) WHERE {_near} <> 1 AND {_near} IN (SELECT {_far} FROM edges WHERE {_near} = 1)"))(
        lambda s, d, up=_near == "to_node": graph.walk(B.edges(s, d).select("from_node", "to_node", F.when(F.col("weight") > 0.05, "feeds").otherwise("informs").alias("edge_type")), s.sql("SELECT CAST(1 AS BIGINT) AS node"), 2, up)
    )
over("g7_influence", "edges", lambda e: graph.influence(e).select("node", "degree", F.round("weight", 2).alias("weight")), "SELECT node, count(*) AS degree, round(sum(weight), 2) AS weight FROM (SELECT from_node AS node, weight FROM edges UNION ALL SELECT to_node, weight FROM edges) GROUP BY 1")

# Files against tables, effects of changes ------------------------------------------------------


def _index(s, d):
    """An index of all files, whose titles repeat."""
    return B.udocs(s, d).select("path", "title", T.title_norm_plain(F.col("title")).alias("title_norm"), T.source_of(F.col("path")).alias("source"), F.lit(None).cast("string").alias("hash_sha256_v2"))


query("j30_match_documents", V("udocs", "SELECT c_custkey AS id, lower(c_title) AS title_norm, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n = 1 THEN 'core' ELSE 'unknown' END AS origin, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'title_norm' END AS method, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN n IS NULL THEN 'no match in file_index' WHEN n > 1 THEN 'title_norm collision in file_index' END AS notes FROM (SELECT c_custkey, p_name || ' ' || (p_partkey % 500) || CASE WHEN c_custkey % 4 = 0 THEN ' annex' ELSE '' END AS c_title FROM customer JOIN part ON p_partkey = c_custkey) LEFT JOIN (SELECT lower(title) AS t, count(*) AS n, min(path) AS p FROM udocs GROUP BY 1) ON t = lower(c_title)"))(
    lambda s, d: sync.match_documents(B.read(s, d, "customer").join(B.read(s, d, "part"), F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_partkey") % 500, F.when(F.col("c_custkey") % 4 == 0, " Annex").otherwise("")).alias("title")), _index(s, d))
)
query("k_title_collisions", V("udocs", "SELECT path, lower(title) AS title_norm FROM udocs QUALIFY count(*) OVER (PARTITION BY lower(title)) > 1"))(lambda s, d: sync.title_collisions(_index(s, d)).select("path", "title_norm"))
over("j34_missing_on_disk", "docs mapping", lambda x, m: sync.missing_on_disk([x.select("path"), m.select("doc_path")], x.filter("path like '%5.md'").select("path")), "SELECT path FROM (SELECT path FROM docs UNION SELECT doc_path FROM mapping) WHERE path IS NOT NULL AND path <> 'ORPHAN' AND path NOT IN (SELECT path FROM docs WHERE path LIKE '%5.md')")
over("f16_targets", "docs", lambda x: sync.targets(x, "RED", "core/g[1-3]/*2?.md"), "SELECT * FROM docs WHERE contains(lower(title), 'red') AND regexp_full_match(path, 'core/g[1-3]/.*2.[.]md')")
over("j31_affected_by_standard", "standards mapping docs", lambda st, m, x: sync.affected("standard_code", "std-1", st, m, x).groupBy("code", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_path").alias("docs")), "SELECT standard_code AS code, standard_name AS name, count(*) AS n, count(DISTINCT doc_path) AS docs FROM mapping JOIN standards USING (standard_code) WHERE standard_code ILIKE '%std-1%' GROUP BY 1, 2")
over("j31_affected_by_section", "usections udocs refs", lambda sc, x, r: sync.affected_by_section("Cel", sc.withColumnRenamed("heading_norm", "heading"), x, r), "SELECT path, heading_norm AS heading, (SELECT count(*) FROM refs WHERE contains(lower(to_ref), 'cel')) AS n_links FROM usections JOIN udocs USING (doc_uid) WHERE contains(heading_norm, 'cel')")
over("j31_affected_by_document", "udocs usections mapping refs", lambda x, sc, m, r: sync.affected_by_document("red", x, sc.withColumnRenamed("heading_norm", "heading").withColumn("ordinal", F.col("section_uid")), m, r.withColumn("from_ref", F.col("context_doc_uid"))).select("doc_uid", "incoming_links", "outgoing_links", F.array_join("standards", ",").alias("standards"), F.array_join("sections", ",").alias("sections")), "SELECT doc_uid, coalesce(i, 0) AS incoming_links, coalesce(o, 0) AS outgoing_links, coalesce(c, '') AS standards, h AS sections FROM udocs LEFT JOIN (SELECT lower(trim(regexp_extract(to_ref, '(?i)^document::(.+?)(?:::.*)?$', 1))) AS t, count(*) AS i FROM refs WHERE to_ref ILIKE 'document::%' GROUP BY 1) ON t = lower(title) LEFT JOIN (SELECT context_doc_uid AS doc_uid, count(*) AS o FROM refs GROUP BY 1) USING (doc_uid) LEFT JOIN (SELECT doc_path AS path, string_agg(DISTINCT standard_code, ',' ORDER BY standard_code) AS c FROM mapping GROUP BY 1) USING (path) LEFT JOIN (SELECT doc_uid, string_agg(heading_norm, ',' ORDER BY section_uid) AS h FROM usections GROUP BY 1) USING (doc_uid) WHERE contains(lower(title), 'red')")

# Audits ----------------------------------------------------------------------------------------
over("f5_by_standard", "mapping", lambda m: audit.by_standard(m.select("doc_path", "standard_code", "match_reason").distinct(), "std-1", "R", 40), "SELECT DISTINCT doc_path, standard_code, match_reason FROM mapping WHERE standard_code ILIKE '%std-1%' AND match_reason = 'R' ORDER BY standard_code, doc_path LIMIT 40")
over("f6_listed", "mapping", lambda m: audit.listed(m, m.select("doc_path", F.col("match_reason").alias("regulation_code")), "STD-3", "N", "R"), "SELECT * FROM mapping WHERE standard_code = 'STD-3' AND match_reason = 'R' AND doc_path IN (SELECT doc_path FROM mapping WHERE match_reason = 'N')")
over("a8_unresolved", "links udocs", lambda x, u: audit.unresolved(x, x.filter("id % 3 = 0").select("id"), u), "SELECT doc_uid, (SELECT count(*) FROM links) - (SELECT count(DISTINCT id) FROM links WHERE id % 3 = 0) AS unresolved FROM udocs")
over("a21_statistics", "mapping markdown", lambda m, x: audit.statistics(m, fixes.violations(x)), "SELECT count(*) AS total_mappings, count(*) FILTER (confidence IS NULL) AS null_confidence, any_value(e) AS error_violations, any_value(w) AS warning_violations FROM mapping, (SELECT sum((NOT starts_with(text, '---'))::INT + " + " + ".join(f"({c})::INT" for c in _LACK.values()) + ")::BIGINT AS e, sum((starts_with(text, '---') AND NOT contains(text, 'title:'))::INT + " + " + ".join(f"(contains(text, '{h}' || chr(10) || '##') OR ends_with(text, '{h}' || chr(10)))::INT" for h in _LACK) + ")::BIGINT AS w FROM markdown)")


def _gaps(s, d):
    k = F.col("p_partkey")
    x = B.read(s, d, "part")
    cat = x.select(F.when(F.col("p_size") < 40, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("x"))).alias("standard_code"), F.col("p_name").alias("doc_title"))
    return cat, x.select(F.col("p_brand").alias("standard_code"), F.col("p_name").alias("doc_title"), F.when(k % 3 == 0, "missing").otherwise("present").alias("status"), (k % 2).cast("int").alias("is_required"), F.when(k % 5 == 0, "low").otherwise("exact").alias("confidence"))


query("a24_gap_summary", "SELECT standard_code, coalesce(e, 0) AS entries, coalesce(p, 0) AS present, coalesce(mr, 0) AS missing_required, coalesce(mo, 0) AS missing_recommended, coalesce(lo, 0) AS low_confidence, CASE WHEN e > 0 THEN round_even(coalesce(p, 0) * 100.0::DOUBLE / e, 1) ELSE 0.0::DOUBLE END AS coverage, CASE WHEN coalesce(mr, 0) + coalesce(mo, 0) = 0 THEN 'OK' ELSE 'GAPS' END AS status FROM (SELECT p_brand AS standard_code, count(*) FILTER (p_partkey % 3 <> 0) AS p, count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 2 = 1) AS mr, count(*) FILTER (p_partkey % 6 = 0) AS mo, count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 5 = 0) AS lo FROM part GROUP BY 1) FULL JOIN (SELECT CASE WHEN p_size < 40 THEN p_brand ELSE p_brand || 'x' END AS standard_code, count(*) AS e FROM part GROUP BY 1) USING (standard_code)")(lambda s, d: audit.gap_summary(*_gaps(s, d)))
over("a24_unmapped", "docs mapping", lambda x, m: audit.unmapped(x, m.filter("confidence > 0.9")), "SELECT path, title FROM docs WHERE path IS NOT NULL AND path <> 'ORPHAN' AND path NOT IN (SELECT doc_path FROM mapping WHERE confidence > 0.9)")
over("e7_continuous", "mapping standards markdown", lambda m, st, t: audit.continuous(audit.statistics(m, fixes.violations(t)), m, st, "%std-1%"), "SELECT 'error violations' AS gate, sum((NOT starts_with(text, '---'))::INT + " + " + ".join(f"({c})::INT" for c in _LACK.values()) + ")::DOUBLE AS value, FALSE AS ok FROM markdown UNION ALL SELECT 'coverage %std-1%', 100.0::DOUBLE * m / n, 100.0::DOUBLE * m / n >= 5 FROM (SELECT count(*) AS m FROM (SELECT DISTINCT doc_path, standard_code FROM mapping WHERE confidence >= 0.5 AND standard_code IN (SELECT standard_code FROM standards WHERE standard_code ILIKE '%std-1%'))), (SELECT count(*) AS n FROM standards WHERE standard_code ILIKE '%std-1%')")
over("r22_flow_summary", "sections docs", lambda sc, x: audit.flow_summary(sections=(sc, "status"), docs=(x, "origin")), "SELECT 'sections' AS \"table\", status AS value, count(*) AS n FROM sections GROUP BY 2 UNION ALL SELECT 'docs', origin, count(*) FROM docs GROUP BY 2")

# Guidance --------------------------------------------------------------------------------------


def _enrich(s, d):
    p = B.read(s, d, "part")
    g = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("doc_title"), F.when(F.col("p_partkey") % 2 == 0, " Cel dokumentu").otherwise("x").alias("section_title"))
    docs = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_name").alias("title"))
    m = p.select(F.concat(F.lit("f"), "p_partkey").alias("doc_path"), F.col("p_brand").alias("standard_code"))
    extra = s.createDataFrame([("cel dokumentu", 1, "Brand#9"), ("cel dokumentu", 2, "Brand#1"), ("cel dokumentu", 3, "no")], "section_norm string, seq int, standard_code string")
    return guidance.enrich(g, docs, m, extra, p.filter("p_size < 45 or p_brand in ('Brand#1', 'Brand#9')").select(F.col("p_brand").alias("standard_code")), "standard_code")


query("r14_enrich_guidance", "WITH v AS (SELECT DISTINCT p_brand AS c FROM part WHERE p_size < 45 OR p_brand IN ('Brand#1', 'Brand#9')), b AS (SELECT p_name, list_sort(list_distinct(list(p_brand))) AS l FROM part JOIN v ON c = p_brand WHERE p_partkey % 3 = 0 GROUP BY 1), e AS (SELECT list_filter(['Brand#9', 'Brand#1'], lambda x: list_contains(vs, x)) AS x FROM (SELECT list(c) AS vs FROM v)), r AS (SELECT p_partkey AS id, coalesce(l, []) AS l, CASE WHEN p_partkey % 2 = 0 THEN x ELSE [] END AS x FROM part LEFT JOIN b USING (p_name), e) SELECT id, CASE WHEN len(l) + len(x) > 0 THEN '[' || array_to_string(list_transform(l || list_filter(x, lambda y: NOT list_contains(l, y)), lambda y: '\"' || y || '\"'), ',') || ']' END AS codes FROM r")(_enrich)
query("r16_lifecycle", "SELECT p_partkey AS doc_uid, i::INT AS seq, ['draft', 'review', 'approved', 'active', 'archived'][i + 1] AS state FROM part, range(5) t(i)")(lambda s, d: guidance.lifecycle(B.read(s, d, "part").select(F.col("p_partkey").alias("doc_uid"))))
query("j26_branches", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND n_name IS NOT NULL THEN c_nationkey WHEN c_custkey % 4 = 0 THEN 999 WHEN c_custkey % 4 = 1 AND 3 IN (SELECT n_nationkey FROM nation) THEN 3 WHEN c_custkey % 4 = 2 AND 4 IN (SELECT n_nationkey FROM nation) THEN 4 END AS branch_id, CASE WHEN c_custkey % 4 = 0 THEN n_name WHEN c_custkey % 4 = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) WHEN c_custkey % 4 = 2 THEN (SELECT n_name FROM nation WHERE n_nationkey = 4) END AS isic_code FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")(
    lambda s, d: guidance.branches(B.read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 1, "By title").when(F.col("c_custkey") % 4 == 2, "By Slüg").otherwise("none").alias("title"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("branch_id")), s.createDataFrame([("By title", 3)], "title string, branch_id int"), s.createDataFrame([("by_slug", 4)], "slug string, branch_id int"), B.read(s, d, "nation").select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("isic_code"))).drop("title")
)
query("j27_branch_names", "SELECT c_custkey::VARCHAR AS code, coalesce(n_name, 'a tag') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")(lambda s, d: guidance.branch_names(B.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("code"), F.lit(" a  tag ").alias("tag")), B.read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))))
query("x49_guidance_texts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Metrics (KPI) of ' || lower(p_name) || ', their source and rhythm.' ELSE 'Purpose, scope and owner of: ' || p_name || '.' END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'Fill an AI canvas and plan a pilot.' END AS archetype FROM part")(
    lambda s, d: B.read(s, d, "part").select("p_partkey", guidance.pattern_guidance(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Tracking").otherwise(""))).alias("text"), guidance.archetype(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Blockchain").otherwise(""))).alias("archetype"))
)
query("j23_match_catalogue", "SELECT p_partkey AS entry, path, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'high' END AS confidence FROM part JOIN (SELECT p_name, min('core/' || p_partkey) AS path FROM part GROUP BY 1) USING (p_name)")(
    lambda s, d: guidance.match_catalogue(B.read(s, d, "part").select(F.col("p_partkey").alias("entry"), F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" template")).alias("doc_title")), B.read(s, d, "part").select(F.concat(F.lit("core/"), "p_partkey").alias("path"), F.col("p_name").alias("title")))
)
query("x46_mapping_confidence", "WITH m AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS c FROM lineitem), w AS (SELECT k, c, string_split(lower(n.p_name), ' ') AS a, string_split(lower(t.p_name), ' ') AS b FROM m JOIN part n ON n.p_partkey = k LEFT JOIN part t ON t.p_partkey = c), x AS (SELECT k, c, list_sort(list_distinct(list_intersect(list_filter(a, lambda y: length(y) > 2), list_filter(coalesce(b, []), lambda y: length(y) > 2)))) AS i, len(list_distinct(list_filter(a || coalesce(b, []), lambda y: length(y) > 2))) AS u FROM w) SELECT k, c, round_even(least(1, 2 * len(i)::DOUBLE / greatest(u, 1) + CASE WHEN k % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END), 4) AS confidence, 'tokens:' || array_to_string(i, ',') || ' guidance_refs:' || CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS evidence FROM x")(
    lambda s, d: (lambda m: guidance.mapping_confidence(m.select(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "k", F.lit(".md")).alias("doc_path"), F.col("c").cast("string").alias("standard_code")), B.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("standard_code"), F.col("p_name").alias("description")), m.filter("k % 2 = 0").select(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "k", F.lit(".md")).alias("doc_path"), F.col("c").cast("string").alias("standard_code"))).select(F.regexp_extract("doc_path", r"(\d+)\.md$", 1).cast("long").alias("k"), F.col("standard_code").cast("long").alias("c"), "confidence", "evidence"))(
        B.read(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("c")).distinct().join(B.read(s, d, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k")
    )
)
over("r11_fill_from_donors", "markdown", lambda m: guidance.fill_from_donors(m.select(F.concat(F.lit("f/"), "doc_id").alias("path"), F.concat(F.lit("aligned_rev: 1\n"), F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit("Text.\n- [ ] a"), F.lit("[Termin 1]"))).otherwise(F.col("text"))).alias("text")), templates.PLAIN, 60, 2).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id"), F.regexp_extract("text", r"aligned_rev: (\d+)", 1).alias("rev"), F.col("text").contains("Text.").alias("filled")), "SELECT doc_id, '2' AS rev, TRUE AS filled FROM markdown WHERE doc_id % 7 = 0 AND doc_id % 4 <> 0")

# Smaller ones ----------------------------------------------------------------------------------
over("a23_mapping_statistics", "mapping", lambda m: analytics.mapping_statistics(m, 0.3, ("N",)), "SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM mapping UNION ALL SELECT 'reason', match_reason, count(*) FROM mapping GROUP BY 2 UNION ALL SELECT 'tier', CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END, count(*) FROM mapping GROUP BY 2 UNION ALL SELECT 'pending', NULL, count(*) FROM mapping WHERE confidence < 0.3 AND match_reason NOT IN ('N')")
over("j5_not_in", "docs mapping", lambda x, m: analytics.not_in(x, "path", m.filter("confidence > 0.8").select("doc_path")), "SELECT * FROM docs WHERE path NOT IN (SELECT doc_path FROM mapping WHERE confidence > 0.8)")
over("j33_label_audit_keys", "refs usections", lambda x, sc: links.label_audit(x.select("id", F.col("to_ref").alias("ref")), sc).drop("raw"), r"SELECT label, first_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM (SELECT trim(regexp_replace(regexp_replace(lower(trim(substr(to_ref, 10))), '^meta\s*[:\-–—]\s*', ''), '^(\d+[.)]\s+)+', '')) AS label, min(id) AS first_id FROM refs WHERE to_ref ILIKE 'section::%' GROUP BY 1) LEFT JOIN (SELECT heading_norm AS label, count(*) AS n FROM usections GROUP BY 1) USING (label)")
query("j21_map_controls", "WITH d AS (SELECT 'a/' || replace(p_name, ' ', '_') || '.md' AS path, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 2)) AS x FROM part GROUP BY ALL), c AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'E' ELSE 'O' END AS standard_code, p_partkey AS seq, p_partkey::VARCHAR AS control_id, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda t: length(t) > 2)) AS y FROM part), s AS (SELECT path, standard_code, control_id, seq, len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)) AS s FROM d, c) SELECT path, standard_code, control_id, round_even(s, 4) AS confidence, row_number() OVER (PARTITION BY path, standard_code ORDER BY s DESC, seq)::INT AS rank FROM s WHERE s >= 0.3 QUALIFY rank <= 5")(
    lambda s, d: matching.map_controls(B.read(s, d, "part").select(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("title")).distinct(), B.read(s, d, "part").select(F.when(F.col("p_size") % 2 == 0, "E").otherwise("O").alias("standard_code"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("control_id"), F.concat_ws(" ", "p_name", "p_type").alias("title")), 0.3)
)
query("w4_short_paths", V("markdown", r"SELECT doc_id, i::INT AS line_no, level, heading, CASE WHEN level = 2 THEN p_name || ' > ' || heading ELSE p_name || ' > ' || above || ' > ' || heading END AS heading_path, regexp_replace(replace(regexp_replace(lower(heading), '[^a-z0-9 -]', '', 'g'), ' ', '-'), '-+', '-', 'g') AS anchor FROM (SELECT *, last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM (SELECT doc_id, p_name, i, length(regexp_extract(l[i], '^(#+)', 1))::INT AS level, trim(regexp_extract(l[i], '^#+ (.*)$', 1)) AS heading FROM (SELECT doc_id, p_name, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM markdown JOIN part ON p_partkey = doc_id), unnest(range(1, len(l) + 1)) AS u(i) WHERE regexp_matches(l[i], '^#{2,3} ')))"))(lambda s, d: quality.short_paths(B.markdown(s, d).withColumn("title", F.lit("none"))))
over("x40_json_errors", "guidance", lambda g: g.select("id", F.when(F.col("id") % 5 == 0, '{"a":1}').otherwise(F.col("refs")).alias("refs")).select("id", T.json_list_error("refs").alias("error")), "SELECT id, CASE WHEN id % 5 = 0 THEN 'not a list' WHEN refs IS NOT NULL AND NOT json_valid(refs) THEN 'bad JSON' END AS error FROM guidance")
over("x36_heading_forms", "markdown", lambda m: m.select("doc_id", F.size(T.headings_of("text")).alias("n_all"), F.size(T.headings_of("text", "second")).alias("n_second"), F.size(T.headings_of(F.concat("text", F.lit("##Tight\n#\n")), "loose")).alias("n_loose")), "SELECT doc_id, len(regexp_extract_all(text, '(?m)^#+ '))::INT AS n_all, len(regexp_extract_all(text, '(?m)^## '))::INT AS n_second, (len(regexp_extract_all(text, '(?m)^#+ ')) + 1)::INT AS n_loose FROM markdown")
query("o4_nocase_order", "SELECT n_name, row_number() OVER (ORDER BY translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), n)::INT AS i FROM (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END || 'Ż' AS n FROM nation)")(
    lambda s, d: B.read(s, d, "nation").select("n_name", F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")), F.lit("Ż")).alias("n")).select("n_name", F.row_number().over(Window.orderBy(T.nocase(F.col("n")), "n")).alias("i"))
)
_BODY = "'Text.' || chr(10) || '- [ ] a' || chr(10)"
for _op, _args, _new in (
    ("replace", ("new",), "'new' || chr(10)"), ("replace_part", ("b", "a"), "'Text.' || chr(10) || '- [ ] b' || chr(10)"), ("prepend", ("first",), "'first' || chr(10) || " + _BODY), ("delete", (), None), ("rename", ("Goal",), None), ("deduplicate", (), "'Text.' || chr(10) || '- [ ] a' || chr(10)"),
):
    _h = "'## Cel dokumentu' || chr(10) || "
    _to = {"delete": "''", "rename": "'## Goal' || chr(10) || " + _BODY}.get(_op) or _h + _new
    query(f"r12_patch_{_op}", V("markdown", f"SELECT doc_id, sha256(replace(text, {_h}{_BODY}, {_to})) AS h FROM markdown"))(
        lambda s, d, op=_op, a=_args: B.markdown(s, d).select("doc_id", F.sha2(sections.patch("text", "Cel dokumentu", op.partition("_")[0], *a).cast("binary"), 256).alias("h"))
    )
query("r25_gates", "SELECT 'duplicates' AS gate, count(*)::DOUBLE AS value, CASE WHEN count(*) > 200 THEN 'FAIL' WHEN count(*) > 10 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")(
    lambda s, d: services.gates(analytics.duplicates(B.read(s, d, "documents"), "text", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("duplicates").alias("gate"), "value"), 10, 200)
)
query("r27_repair_columns", "SELECT c_custkey, c_name || ' żółć' AS a, c_name AS b, CASE WHEN c_custkey % 2 = 0 THEN 'ł' END AS c, TRUE AS changed FROM customer")(
    lambda s, d: U.repair(B.read(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" żółć".encode().decode("cp1252"))).alias("a"), F.col("c_name").alias("b"), F.when(F.col("c_custkey") % 2 == 0, "ł".encode().decode("cp1252")).alias("c")), ["a", "b", "c"])
)
query("f17_safe_changes", _with("markdown", _FOUND, "SELECT f[5] = 'y' AS safe, count(*) AS n FROM f GROUP BY 1"))(lambda s, d: fixes.findings(B.markdown(s, d)).groupBy("safe").agg(F.count(F.lit(1)).alias("n")))
over("x18_x19_small", "links", lambda x: x.select("id", T.strength("required").alias("strength"), T.profile_of(F.when(F.col("id") % 3 == 0, "core").when(F.col("id") % 3 == 1, "imported_template").otherwise("odd")).alias("profile")), "SELECT id, CASE required WHEN 1 THEN 'required' ELSE 'navigational' END AS strength, CASE id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'imported_template' ELSE 'default' END AS profile FROM links")
query("x48_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")(lambda s, d: B.read(s, d, "events").select("event_id", T.utc_text(F.col("ts").cast("timestamp")).alias("at")))


def _slugs(s, d):
    p, name = B.read(s, d, "part"), F.replace("p_name", F.lit(" "), F.lit("_"))
    slugs = p.select(F.concat(name, F.element_at(F.array(F.lit(""), F.lit("_guide"), F.lit("_guide_long"), F.concat(F.lit("_"), F.col("p_partkey") % 9)), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("slug")).unionByName(p.select(F.substring("p_type", 1, 3).alias("slug")))
    files = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("the_"), name, F.lit("_"), F.col("p_partkey") % 9, F.lit("_"), F.lower("p_brand")).alias("file")).unionByName(p.filter("p_partkey % 3 = 1").select(F.concat(name, F.lit("_guide")).alias("file"))).unionByName(p.filter("p_partkey < 5").select(F.concat(F.lit("x"), "p_type", F.lit("y")).alias("file")))
    return slugs, files


query("j20_contained", "WITH s AS (SELECT DISTINCT replace(p_name, ' ', '_') || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_guide' WHEN 2 THEN '_guide_long' ELSE '_' || (p_partkey % 9) END AS slug FROM part UNION SELECT substr(p_type, 1, 3) FROM part), f AS (SELECT 'the_' || replace(p_name, ' ', '_') || '_' || (p_partkey % 9) || '_' || lower(p_brand) AS file FROM part WHERE p_partkey % 3 = 0 UNION SELECT replace(p_name, ' ', '_') || '_guide' FROM part WHERE p_partkey % 3 = 1 UNION SELECT 'x' || p_type || 'y' FROM part WHERE p_partkey < 5), p AS (SELECT slug, file, CASE WHEN slug = file THEN 1 WHEN contains(file, slug) THEN 2 WHEN contains(slug, file) AND length(file) >= 8 THEN 3 END AS tier FROM s, f), t AS (SELECT slug, tier, min(file) AS file FROM p WHERE tier IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) SELECT slug, arg_min(file, tier) AS file, min(tier) AS tier FROM s LEFT JOIN t USING (slug) GROUP BY 1")(
    lambda s, d: links.contained(*_slugs(s, d))
)
query("r13_mend_ghosts", "SELECT 'D' || p_partkey AS doc_uid, CASE WHEN p_partkey % 17 <> 0 THEN CASE WHEN p_partkey % 19 = 0 THEN 'ORPHAN' ELSE 'core/g' || (p_partkey % 7) || '/' || p_partkey || '.md' END WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) THEN 'core/' || replace(p_name, ' ', '-') || '.md' ELSE 'ORPHAN' END AS path, p_partkey % 17 = 0 AS mended FROM part")(
    lambda s, d: sync.mend_ghosts(B.docs(s, d), B.read(s, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md")).alias("path")).distinct())
)
query("g3_contract", "SELECT 'u' AS scope_uid, 1 AS version, p_brand || ',' || p_type AS inputs, '' AS gates FROM part WHERE p_partkey = 1")(
    lambda s, d: services.contract(B.guidance(s, d).select(F.when(F.col("id") == 1, "u").otherwise("v").alias("scope_uid"), F.lit(1).alias("version"), F.col("refs").alias("inputs_json"), F.lit("[bad").alias("gates_json")), "u").select("scope_uid", "version", F.array_join("inputs", ",").alias("inputs"), F.array_join("gates", ",").alias("gates"))
)
