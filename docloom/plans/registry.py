"""Queries of the library by name (inventory id first), each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.functions import unicode as U
from docloom.operators import analytics as A
from docloom.operators import graph, guidance, history, links, matching, packages, quality, raci, sections, services
from docloom.sources import sinks

from . import bindings as B
from .bindings import with_views as V

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def over(name: str, views: str, f, sql: str | None = None) -> None:
    """A query over views of the model, in the order in which f takes them."""
    query(name, V(views, sql) if sql else None)(lambda s, d: f(*(getattr(B, v)(s, d) for v in views.split())))


LIVE = "path IS NOT NULL AND path <> '' AND path <> 'ORPHAN'"
over("a1_coverage_by_standard", "mapping", A.coverage_by_standard, "SELECT standard_code, count(DISTINCT doc_path) AS n_docs FROM mapping GROUP BY 1")
over("a2_count_by_reason", "mapping", A.count_by_reason, "SELECT match_reason, count(*) AS n FROM mapping GROUP BY 1")
over("a3_below_threshold", "mapping", lambda m: A.below(m, 500), "SELECT standard_code, count(DISTINCT doc_path) AS n_docs FROM mapping GROUP BY 1 HAVING count(DISTINCT doc_path) < 500")
over("a4_totals", "docs mapping", A.totals, f"SELECT total, mapped, total - mapped AS unmapped, CASE WHEN total > 0 THEN mapped * 100.0::DOUBLE / total ELSE 0.0::DOUBLE END AS pct FROM (SELECT count(*) AS total FROM docs WHERE {LIVE}), (SELECT count(DISTINCT doc_path) AS mapped FROM mapping)")
over("a5_standard_summary", "mapping", lambda m: A.standard_summary(m, "STD-3"), "SELECT standard_code, count(*) AS total, count(*) FILTER (confidence >= 0.5) AS sure, count(*) FILTER (confidence >= 0.7) AS very_sure, count(*) FILTER (confidence IS NULL) AS unknown, round_even(100.0::DOUBLE * count(*) FILTER (confidence >= 0.5) / count(*), 1) AS pct FROM mapping WHERE standard_code = 'STD-3' GROUP BY 1")
over("a6_histograms", "sections docs", lambda s, d: A.histogram(s, "status", "section").unionByName(A.histogram(d, "origin", "doc")), "SELECT 'section' AS kind, status, count(*) AS n FROM sections GROUP BY 2 UNION ALL SELECT 'doc', origin, count(*) FROM docs GROUP BY 2")
over("a7_filtered_count", "links", A.required_without_rationale, "SELECT context_doc_uid, count(*) AS n FROM links WHERE required = 1 AND trim(coalesce(rationale, '')) = '' GROUP BY 1")
_IDX = "idx AS (SELECT DISTINCT unnest([heading_norm, replace(heading_norm, ' ', '-'), lower(anchor)]) AS key, doc_uid, section_uid FROM sections), own AS (SELECT doc_uid, key, count(*) AS n, min(section_uid) AS uid FROM idx GROUP BY 1, 2), alls AS (SELECT key, count(*) AS n, min(section_uid) AS uid FROM idx GROUP BY 1), res AS (SELECT id, CASE WHEN own.n = 1 THEN 'context_doc' WHEN own.n > 1 THEN 'ambiguous' WHEN alls.n = 1 THEN 'global_unique' WHEN alls.n > 1 THEN 'ambiguous' ELSE 'missing' END AS method, own.uid AS u1, alls.uid AS u2 FROM links LEFT JOIN own ON own.doc_uid = context_doc_uid AND own.key = replace(to_ref, ' ', '-') LEFT JOIN alls ON alls.key = replace(to_ref, ' ', '-')), out AS (SELECT id, CASE method WHEN 'context_doc' THEN u1 WHEN 'global_unique' THEN u2 END AS to_uid, method, CASE method WHEN 'context_doc' THEN 0.95::DOUBLE WHEN 'global_unique' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM res)"


def _res(sql: str) -> str:
    return V("links sections", "").rstrip() + ", " + _IDX + " " + sql


query("j11_resolve_links", _res("SELECT * FROM out"))(lambda s, d: links.resolve(B.links(s, d), B.sections(s, d)))
query("j12_label_index", V("sections", "SELECT key, count(DISTINCT section_uid) AS n, min(section_uid) AS uid FROM (SELECT unnest([heading_norm, replace(heading_norm, ' ', '-'), lower(anchor)]) AS key, section_uid FROM sections) GROUP BY 1"))(lambda s, d: links.label_index(B.sections(s, d), False))


def _resolution(s, d):
    x = B.links(s, d)
    return A.resolution(x, links.resolve(x, B.sections(s, d)).filter("to_uid is not null"))


query("a9_a10_resolution_sla", _res("SELECT count(*) AS total, count(to_uid) AS resolved, count(*) - count(to_uid) AS missing, CASE WHEN count(*) > 0 THEN count(to_uid)::DOUBLE / count(*) ELSE 0.0::DOUBLE END AS ratio, count(to_uid)::DOUBLE / count(*) >= 0.999 AS pass FROM out"))(_resolution)
query("j33_label_audit", _res("SELECT method, count(*) AS n FROM res GROUP BY 1"))(lambda s, d: links.resolve(B.links(s, d), B.sections(s, d)).groupBy("method").agg(F.count(F.lit(1)).alias("n")))

over("f1_live_docs", "docs", A.live, f"SELECT * FROM docs WHERE {LIVE}")
over("f2_ghost_docs", "docs", A.ghosts, "SELECT * FROM docs WHERE path IS NULL")
over("f3_threshold", "mapping", lambda m: A.confident(m, "STD-7", 0.9), "SELECT * FROM mapping WHERE confidence >= 0.9 AND standard_code = 'STD-7'")
over("f4_search_log", "changelog", lambda c: A.search_log(c, path="t1", kind="click").drop("ts"), "SELECT id, template_path, changed_at, change_type FROM changelog WHERE template_path ILIKE '%t1%' AND change_type = 'click'")
over("f10_blank_rationale", "links", A.without_rationale, "SELECT id FROM links WHERE rationale IS NULL OR trim(rationale) = ''")
over("f13_weight_range", "edges", lambda e: A.out_of_range(e, 0, 0.09), "SELECT count(*) AS n FROM edges WHERE weight < 0 OR weight > 0.09")
over("f14_bad_json", "guidance", lambda g: A.bad_json(g, "id", "refs"), "SELECT id FROM guidance WHERE refs IS NOT NULL AND NOT json_valid(refs)")
over("f15_pending", "mapping", lambda m: A.pending(m, 0.3, ("N",)), "SELECT * FROM mapping WHERE confidence < 0.3 AND match_reason NOT IN ('N')")
over("f9_in_list", "mapping", lambda m: A.count_of(m, "standard_code", ("STD-1", "STD-2")), "SELECT standard_code, count(*) AS n FROM mapping WHERE standard_code IN ('STD-1', 'STD-2') GROUP BY 1")
over("j2_mapping_docs", "mapping docs", A.mapped_by_origin, "SELECT origin, standard_code, count(*) AS n FROM mapping JOIN docs ON doc_path = path GROUP BY 1, 2")
over("j3_a22_family_coverage", "mapping standards", lambda m, s: A.family_coverage(m, s, "std-1%", 0.5), "SELECT standards, mapped, mapped * 100.0::DOUBLE / standards AS pct FROM (SELECT count(*) AS standards FROM standards WHERE standard_code ILIKE 'std-1%'), (SELECT count(*) AS mapped FROM (SELECT DISTINCT doc_path, standard_code FROM mapping WHERE confidence >= 0.5 AND standard_code IN (SELECT standard_code FROM standards WHERE standard_code ILIKE 'std-1%')))")
over("j5_j6_orphan_mappings", "mapping docs", A.orphans, "SELECT DISTINCT doc_path FROM mapping WHERE NOT EXISTS (SELECT 1 FROM docs WHERE path = doc_path)")
over("j7_unmapped_by_category", "docs mapping", lambda d, m: A.unmapped_by_category(d, m.filter("standard_code < 'STD-12' and confidence > 0.8")), f"SELECT split_part(path, '/', 2) AS category, count(*) AS n FROM docs WHERE {LIVE} AND path NOT IN (SELECT doc_path FROM mapping WHERE standard_code < 'STD-12' AND confidence > 0.8) GROUP BY 1")
over("j15_dependencies", "edges", lambda e: links.dependencies(e.select(F.col("from_node").alias("from_doc"), F.col("to_node").alias("to_doc"), (F.col("weight") > 0.05).cast("int").alias("required"))), "SELECT from_node AS from_doc, to_node AS to_doc, CASE WHEN max((weight > 0.05)::INT) = 1 THEN 'requires' ELSE 'relates_to' END AS dependency_type FROM edges WHERE from_node <> to_node GROUP BY 1, 2")
over("j16_g5_migrate_edges", "edges sections", lambda e, s: links.migrate(e.select(F.col("to_node").alias("id"), F.when(F.col("to_node") % 3 == 0, "doc").when(F.col("to_node") % 3 == 1, "section").otherwise("file").alias("kind"), F.when(F.col("to_node") % 10 == 0, F.lit("section::x")).otherwise(F.col("to_node").cast("string")).alias("uid")).distinct(), s.select(F.lit("section").alias("kind"), F.col("section_uid").cast("string").alias("uid"), F.concat(F.lit("n"), "section_uid").alias("node_uid"))), "SELECT DISTINCT to_node AS id, CASE WHEN to_node % 10 <> 0 AND to_node % 3 = 1 AND section_uid IS NOT NULL THEN 'n' || to_node END AS node_uid, CASE WHEN to_node % 10 = 0 THEN 'raw_section_ref' WHEN to_node % 3 = 2 THEN 'unsupported_kind' WHEN to_node % 3 = 1 AND section_uid IS NOT NULL THEN NULL ELSE 'missing_map' END AS reason FROM edges LEFT JOIN sections ON section_uid = to_node")
over("j18_r20_edge_health", "edges sections", lambda e, s: quality.edge_health(e.select(F.col("from_node").alias("id"), F.col("to_node").alias("to_uid"), F.when(F.col("weight") > 0.07, "blocking").when(F.col("weight") > 0.03, "required").otherwise("navigational").alias("strength"), F.when(F.col("weight") < 0.09, "x").alias("rationale")), s.filter("ordinal <> 2").select(F.col("section_uid").alias("uid"))).groupBy("status", "reasons").agg(F.count(F.lit(1)).alias("n")), "SELECT status, reasons, count(*) AS n FROM (SELECT CASE WHEN to_node % 3 = 2 OR (weight >= 0.09 AND weight > 0.07) THEN 'fail' ELSE 'ok' END AS status, CASE WHEN to_node % 3 = 2 AND weight >= 0.09 THEN 'TARGET_MISSING,MISSING_RATIONALE' WHEN to_node % 3 = 2 THEN 'TARGET_MISSING' WHEN weight >= 0.09 THEN 'MISSING_RATIONALE' ELSE '' END AS reasons FROM edges) GROUP BY 1, 2")
over("j19_blockers", "edges sections", lambda e, s: quality.blockers(e.select(F.col("from_node").alias("from_uid"), F.col("to_node").alias("to_uid"), F.when(F.col("weight") > 0.07, "blocking").when(F.col("weight") > 0.03, "required").alias("strength")), s.select("section_uid", F.when(F.col("status") == "filled", "ok").otherwise("bad").alias("status"))), "SELECT to_node AS blocked_uid, from_node AS blocker_uid, CASE WHEN max((weight > 0.07)::INT) = 1 THEN 'H' ELSE 'M' END AS severity, 'UPSTREAM_REQUIRED_NOT_OK' AS reason_code, CASE WHEN max((weight > 0.07)::INT) = 1 THEN '{\"strength\":\"blocking\"}' ELSE '{\"strength\":\"required\"}' END AS evidence_json FROM edges WHERE weight > 0.03 AND from_node % 5 = 0 GROUP BY 1, 2")
over("j29_collisions", "sections", lambda s: A.collisions(s.withColumn("k", F.concat("doc_uid", F.lit("|"), "heading_norm")), "k").select("section_uid", "k"), "SELECT section_uid, doc_uid || '|' || heading_norm AS k FROM sections QUALIFY count(*) OVER (PARTITION BY doc_uid, heading_norm) > 1")
over("j32_find_by_standard", "mapping docs standards", lambda m, d, s: A.find(m, d, s, "std-1"), "SELECT doc_path, title, standard_code, count(*) AS n FROM mapping JOIN docs ON doc_path = path JOIN standards USING (standard_code) WHERE standard_code ILIKE '%std-1%' GROUP BY 1, 2, 3")
over("j24_keyword_rules", "sections", lambda s: matching.keyword_rules(s, [("metal", "M"), ("red", "R"), ("green", "G"), ("small", "S")], "section_uid", "heading_norm"), "SELECT section_uid, array_to_string(list_sort(list_filter([CASE WHEN contains(heading_norm, 'metal') THEN 'M' END, CASE WHEN contains(heading_norm, 'red') THEN 'R' END, CASE WHEN contains(heading_norm, 'green') THEN 'G' END, CASE WHEN contains(heading_norm, 'small') THEN 'S' END], lambda x: x IS NOT NULL)), ',') AS codes FROM sections WHERE heading_norm SIMILAR TO '.*(metal|red|green|small).*'")
over("j17_fallback_lookup", "links sections", links.first_section, "SELECT id, coalesce((SELECT min(section_uid) FROM sections WHERE doc_uid = context_doc_uid), 0) AS uid FROM links")
over("w6_last_wins", "edges", lambda e: links.one_of(e, ["from_node"], ["to_node", "weight"], last=True), "SELECT from_node, max(to_node) AS to_node, arg_max(weight, to_node * 100 + weight) AS weight FROM edges GROUP BY 1")
over("w7_prefer_ordinal", "sections", lambda s: links.one_of(s, ["doc_uid", "heading_norm"], [F.desc(F.col("ordinal") == 1), "section_uid"]).select("doc_uid", "heading_norm", "section_uid"), "SELECT doc_uid, heading_norm, section_uid FROM sections QUALIFY row_number() OVER (PARTITION BY doc_uid, heading_norm ORDER BY (ordinal = 1) DESC, section_uid) = 1")
over("w10_sessions", "changelog", lambda c: history.sessions(c.withColumn("user", F.col("template_path")), "user", "ts", 60).groupBy("user").agg(F.max("session").alias("n")), "SELECT template_path AS user, sum(x)::BIGINT AS n FROM (SELECT template_path, CASE WHEN ts - lag(ts) OVER (PARTITION BY template_path ORDER BY ts, id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS x FROM changelog) GROUP BY 1")
over("w9_retention", "changelog", lambda c: history.retention(c.select(F.col("id").alias("snapshot_id"), F.col("ts").alias("at"))), "SELECT DISTINCT snapshot_id FROM ((SELECT arg_min(id, (ts, id)) AS snapshot_id, date_trunc('week', ts) AS p FROM changelog GROUP BY p ORDER BY p DESC LIMIT 12) UNION ALL (SELECT arg_min(id, (ts, id)), date_trunc('month', ts) AS p FROM changelog GROUP BY p ORDER BY p DESC LIMIT 12))")
query("w13_snapshot_deltas", V("changelog", "SELECT metric, snapshot_id, n, n - lag(n) OVER w AS delta, CASE WHEN metric = 'click' AND n - lag(n) OVER w > 50 OR metric = 'view' AND n - lag(n) OVER w > 20 THEN 'FAIL' WHEN metric = 'click' AND n - lag(n) OVER w > 5 OR metric = 'view' AND n - lag(n) OVER w > 2 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT change_type AS metric, substr(changed_at, 1, 10) AS snapshot_id, count(*) AS n FROM changelog GROUP BY 1, 2) WINDOW w AS (PARTITION BY metric ORDER BY snapshot_id)"))(lambda s, d: history.deltas(B.changelog(s, d).groupBy(F.col("change_type").alias("metric"), F.substring("changed_at", 1, 10).alias("snapshot_id")).agg(F.count(F.lit(1)).alias("n")), {"click": (5, 50), "view": (2, 20)}))
query("w14_transitions", "WITH o AS (SELECT DISTINCT p_name || p_size AS hash, 'a/' || p_partkey AS path FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_name || p_size AS hash, CASE WHEN p_partkey % 4 = 0 THEN 'a/' ELSE 'b/' END || p_partkey AS path FROM part WHERE p_partkey % 3 = 0), k AS (SELECT * FROM o INTERSECT SELECT * FROM n), x AS (SELECT hash, path AS from_path, row_number() OVER (PARTITION BY hash ORDER BY path) AS i FROM o ANTI JOIN k USING (hash, path)), y AS (SELECT hash, path AS to_path, row_number() OVER (PARTITION BY hash ORDER BY path) AS i FROM n ANTI JOIN k USING (hash, path)) SELECT path AS from_path, path AS to_path, 'kept' AS kind FROM k UNION ALL SELECT from_path, to_path, CASE WHEN from_path IS NULL THEN 'added' WHEN to_path IS NULL THEN 'removed' ELSE 'moved' END FROM x FULL JOIN y USING (hash, i)")(
    lambda s, d: history.transitions(*(B.read(s, d, "part").filter(f"p_partkey % {k} = 0").select(F.concat("p_name", "p_size").alias("hash"), F.concat(p, "p_partkey").alias("path")) for k, p in ((2, F.lit("a/")), (3, F.when(F.col("p_partkey") % 4 == 0, "a/").otherwise("b/")))))
)
over("a14_top_templates", "changelog", lambda c: A.top(c, "template_path", 10), "SELECT template_path, count(*) AS n FROM changelog GROUP BY 1 ORDER BY n DESC, template_path LIMIT 10")
over("a15_per_day", "changelog", A.per_day, "SELECT substr(changed_at, 1, 10) AS day, count(*) AS n FROM changelog GROUP BY 1")
query("a16_longest_tag", "SELECT p_size, sum(n)::BIGINT AS n, arg_min(t, (-length(t), t)) AS tag FROM (SELECT p_size, p_type AS t, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")(lambda s, d: A.longest_tag(B.read(s, d, "part"), "p_size", "p_type"))
query("a20_duplicate_content", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")(lambda s, d: A.duplicates(B.read(s, d, "documents"), "text", "doc_id"))
over("a23_tiers", "mapping", A.tiers, "SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM mapping GROUP BY 1")
over("a25_cap_violations", "mapping", lambda m: A.cap_violations(m, ["doc_path", "standard_code"], 5), "SELECT doc_path, standard_code, count(*) AS n FROM mapping GROUP BY 1, 2 HAVING count(*) > 5")
over("w8_parents", "sections", lambda s: quality.parents(s.select("doc_uid", F.col("section_uid").alias("ordinal"), (F.col("section_uid") % 4 + 1).alias("level"))), "SELECT doc_uid, ordinal, level, CASE level WHEN 2 THEN m1 WHEN 3 THEN greatest(m1, m2) WHEN 4 THEN greatest(m1, m2, m3) END AS parent, CASE WHEN level = 2 THEN 'sec' ELSE 'subsec' END AS kind FROM (SELECT doc_uid, section_uid AS ordinal, section_uid % 4 + 1 AS level, max(CASE WHEN section_uid % 4 = 0 THEN section_uid END) OVER w AS m1, max(CASE WHEN section_uid % 4 = 1 THEN section_uid END) OVER w AS m2, max(CASE WHEN section_uid % 4 = 2 THEN section_uid END) OVER w AS m3 FROM sections WINDOW w AS (PARTITION BY doc_uid ORDER BY section_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
over("r18_section_score", "sections", lambda s: quality.section_score(s.select("section_uid", (F.col("section_uid") % 6).alias("lines"), (F.col("status") == "placeholder").alias("placeholder"), (F.col("section_uid") % 4).alias("gates_missed"))), "SELECT section_uid, (CASE WHEN l = 0 THEN 0 ELSE greatest(100 - CASE WHEN p THEN 40 ELSE 0 END - CASE WHEN l < 3 THEN 20 ELSE 0 END - 10 * g, 0) END)::BIGINT AS score, CASE WHEN l = 0 THEN 'needs_structure' WHEN p OR l < 3 OR g > 0 THEN 'needs_content' ELSE 'ok' END AS status FROM (SELECT section_uid, section_uid % 6 AS l, status = 'placeholder' AS p, section_uid % 4 AS g FROM sections)")
query("x41_x40_guidance_links", V("guidance", "SELECT DISTINCT id, unnest(CASE WHEN json_valid(refs) THEN from_json(refs, '[\"VARCHAR\"]') END) AS code FROM guidance"))(lambda s, d: guidance.code_links(B.guidance(s, d)))
over("u5_ordered_union", "guidance", lambda g: g.select("id", F.array_join(F.filter(F.array_distinct(F.concat(T.json_list("refs"), F.array(F.lit("Z"), F.lit("Brand#11")))), lambda x: x != "Brand#12"), ",").alias("codes")), "SELECT id, array_to_string(list_filter(l || CASE WHEN list_contains(l, 'Brand#11') THEN ['Z'] ELSE ['Z', 'Brand#11'] END, lambda x: x <> 'Brand#12'), ',') AS codes FROM (SELECT id, coalesce(CASE WHEN json_valid(refs) THEN from_json(refs, '[\"VARCHAR\"]') END, []) AS l FROM guidance)")
query("x1_anchor", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' -- ' || p_type)), '\s+', '-', 'g'), '-+', '-', 'g') AS anchor FROM part")(lambda s, d: B.read(s, d, "part").select("p_partkey", T.to_anchor(F.concat_ws(" -- ", "p_name", "p_type")).alias("anchor")))
query("x5_snake_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '#' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")(lambda s, d: B.read(s, d, "part").select("p_partkey", T.to_slug(F.concat_ws("#", "p_name", "p_brand")).alias("slug")))
query("x7_heading_norm", r"SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') AS norm FROM part")(lambda s, d: B.read(s, d, "part").select("p_partkey", T.heading_norm(F.concat(F.lit("  1. 2)  "), "p_name", F.lit("  "))).alias("norm")))
over("x16_x17_path_parts", "docs", lambda x: x.select("doc_uid", T.source_of(F.col("path")).alias("source"), T.category_of(F.col("path")).alias("category"), T.title_of_path(F.col("path")).alias("name")), "SELECT doc_uid, CASE WHEN starts_with(coalesce(path, ''), 'core/') THEN 'core' ELSE 'unknown' END AS source, CASE WHEN contains(coalesce(path, ''), '/') THEN split_part(path, '/', -2) ELSE 'root' END AS category, replace(split_part(coalesce(path, ''), '/', -1), '.md', '') AS name FROM docs")
query("x20_placeholder", "SELECT doc_id, CASE WHEN trim(text) = '' OR contains(lower(text), '...') OR contains(lower(text), 'todo') OR contains(lower(text), 'tbd') THEN 'placeholder' ELSE 'filled' END AS status FROM documents")(lambda s, d: B.read(s, d, "documents").select("doc_id", T.placeholder_status(F.col("text")).alias("status")))
query("x23_x26_title_jaccard", "SELECT a.p_partkey AS a, (len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y))) AS score FROM (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda t: length(t) > 2)) AS x, list_distinct(list_filter(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+'), lambda t: length(t) > 2)) AS y FROM part) a")(lambda s, d: B.read(s, d, "part").select(F.col("p_partkey").alias("a"), T.jaccard(T.tokens(F.col("p_name")), T.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("score")))
query("x30_x32_hashes", "SELECT p_partkey, sha256(p_name) AS h, upper(substr(sha256(p_brand || '|' || p_name || '|' || p_size), 1, 26)) AS uid FROM part")(lambda s, d: B.read(s, d, "part").select("p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("h"), T.section_uid(F.col("p_brand"), F.col("p_name"), F.col("p_size")).alias("uid")))
query("x31_hash_v2", "SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS h FROM documents")(lambda s, d: B.read(s, d, "documents").select("doc_id", T.hash_v2(F.col("text")).alias("h")))
over("x13_title", "markdown", lambda m: m.select("doc_id", T.title_of_text(F.col("text")).alias("title")), "SELECT doc_id, p_name AS title FROM markdown JOIN part ON p_partkey = doc_id")


def _similar(s, d):
    stop = ("the", "and", "of")
    left = B.read(s, d, "documents").select(F.col("doc_id").alias("a"), T.tokens(F.substring("text", 1, 1 << 30), 5, stop).alias("tokens"))
    right = B.read(s, d, "benchmark").select(F.col("item_id").alias("b"), T.tokens(F.col("text"), 5, stop).alias("tokens"))
    return matching.top_similar(left, right, 0.02, 5, repeats=False)


query("j21_w5_top_similar", "WITH l AS (SELECT doc_id AS a, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 5)) AS x FROM documents), r AS (SELECT item_id AS b, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 5)) AS y FROM benchmark), p AS (SELECT a, b, len(x) AS n, len(y) AS m, t FROM (SELECT a, x, unnest(x) AS t FROM l) JOIN (SELECT b, y, unnest(y) AS t FROM r) USING (t)), s AS (SELECT a, b, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS score FROM p GROUP BY 1, 2) SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS rank FROM s WHERE score >= 0.02 QUALIFY rank <= 5")(_similar)


def _walk(up: bool):
    def run(s, d):
        f = graph.upstream if up else graph.downstream
        e = B.edges(s, d)
        return f(e, s.sql("SELECT CAST(1 AS BIGINT) AS node"), 2)

    return run


for _name, _a, _b in (("g1_downstream", "from_node", "to_node"), ("g2_upstream", "to_node", "from_node")):
    query(_name, V("edges", f"SELECT {_b} AS node, 1 AS distance FROM edges WHERE {_a} = 1 AND {_b} <> 1 UNION SELECT f.{_b}, 2 FROM edges e JOIN edges f ON e.{_b} = f.{_a} WHERE e.{_a} = 1 AND f.{_b} <> 1 AND f.{_b} NOT IN (SELECT {_b} FROM edges WHERE {_a} = 1)"))(_walk(_name.startswith("g2")))
over("g6_two_hops", "edges", lambda e: graph.two_hops(e).groupBy("from_node").agg(F.count(F.lit(1)).alias("n")), "SELECT from_node, count(*) AS n FROM (SELECT a.from_node, b.to_node FROM (SELECT DISTINCT from_node, to_node FROM edges) a JOIN (SELECT DISTINCT from_node, to_node FROM edges) b ON a.to_node = b.from_node WHERE a.from_node <> b.to_node EXCEPT SELECT from_node, to_node FROM edges) GROUP BY 1")
over("g7_degree", "edges", lambda e: graph.influence(e).select("node", "degree"), "SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM edges UNION ALL SELECT to_node FROM edges) GROUP BY 1")


def _state(s, d):
    o = B.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return o.filter("id % 3 <> 0"), o.filter("id % 2 = 0").withColumn("v", F.concat("v", F.lit("*")))


_OLD = "old AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority || '*' AS v FROM orders WHERE o_orderkey % 2 = 0)"
for _name, _f, _sql in (
    ("k2_scoped_refresh", lambda o, n: sinks.scoped_refresh(o, n, F.col("k") % 2 == 0), "SELECT * FROM old WHERE k % 2 <> 0 UNION ALL SELECT * FROM new"),
    ("k3_insert_if_absent", lambda o, n: sinks.insert_if_absent(o, n, ["id"], ["v", "k"]), "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)"),
    ("k4_upsert", lambda o, n: sinks.upsert(o, n, ["id"]), "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new"),
    ("k5_update_by_key", lambda o, n: sinks.update_by_key(o, n, ["id"], ["v"]), "SELECT old.id, old.k, coalesce(new.v, old.v) AS v FROM old LEFT JOIN new USING (id)"),
    ("k6_delete_by_key", lambda o, n: sinks.delete_by_key(o, n, ["id"]), "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)"),
):
    query(_name, f"WITH {_OLD} {_sql}")(lambda s, d, f=_f: f(*_state(s, d)))


def _review(s, d):
    m = B.read(s, d, "documents").select("doc_id", ((F.col("doc_id") % 10) / 10).alias("confidence"), F.lit("pending").alias("match_reason"))
    decided = B.read(s, d, "labels").filter("quality is not null").select("doc_id", (F.col("quality") == 1).alias("approve"), F.lit(None).cast("double").alias("confidence"))
    return services.review(m, decided, ["doc_id"])


query("r24_x45_review_import", "SELECT doc_id, CASE WHEN quality = 1 THEN greatest((doc_id % 10)::DOUBLE / 10, 0.8::DOUBLE) ELSE (doc_id % 10)::DOUBLE / 10 END AS confidence, CASE WHEN quality = 1 THEN 'expert_reviewed' ELSE 'pending' END AS match_reason FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")(_review)
over("u1_union_all", "edges links", lambda e, x: e.select(F.col("to_node").cast("string").alias("to_uid"), F.lit("doc_doc").alias("source")).unionByName(x.select(F.col("to_ref").alias("to_uid"), F.lit("content").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT source, count(*) AS n FROM (SELECT 'doc_doc' AS source FROM edges UNION ALL SELECT 'content' FROM links) GROUP BY 1")
over("u2_set_difference", "docs mapping", lambda d, m: d.filter("path is not null").select("path").subtract(m.select(F.col("doc_path").alias("path"))), "SELECT path FROM docs WHERE path IS NOT NULL EXCEPT SELECT doc_path FROM mapping")
over("o1_page", "mapping", lambda m: m.distinct().orderBy(F.desc_nulls_last("confidence"), "doc_path", "standard_code", "match_reason").offset(20).limit(50), "SELECT * FROM (SELECT DISTINCT * FROM mapping) ORDER BY confidence DESC NULLS LAST, doc_path, standard_code, match_reason LIMIT 50 OFFSET 20")
over("o6_limit_per_group", "mapping", lambda m: A.first_of_each(m, "standard_code", "doc_path", 3), "SELECT standard_code, doc_path, row_number() OVER (PARTITION BY standard_code ORDER BY doc_path)::INT AS n FROM (SELECT DISTINCT standard_code, doc_path FROM mapping) QUALIFY n <= 3")


def _raci_docs(s, d):
    """Every third part has a table with a separator, a row and a long action; the others only a title."""
    k = F.col("p_partkey")
    table = F.concat(F.lit("# T\n| Responsible |\n| not | here |\n## RACI i role\nx\n| Działanie | Informed | Responsible |\n|---|:-:|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), "p_type", F.lit(" |\n| " + "long " * 21 + "| a | b |\nend\n| not | read |\n## Next\n| Responsible |\n| no | no |\n"))
    title = F.concat(F.when(k % 2 == 0, "Test ").otherwise("Plan "), "p_name")
    return B.read(s, d, "part").select(k.alias("doc_id"), title.alias("title"), F.when(k % 3 == 0, table).otherwise("no table").alias("text"))


query("r15_x38_raci", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Ogólna odpowiedzialność' END AS action, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN 'QA' ELSE 'DEV' END AS responsible, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'PM' END AS accountable, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'DEV' ELSE 'BA' END AS consulted, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN 'BA' ELSE 'OPS' END AS informed FROM part")(lambda s, d: raci.derive(_raci_docs(s, d)))


def _scores(s, d):
    o = B.read(s, d, "orders").withColumn("k", F.col("o_orderkey"))
    m = o.select(F.col("k").alias("doc_uid"), (F.col("k") % 7).alias("sections"), (F.col("k") % 3).alias("placeholders"), (F.col("k") % 5 == 0).cast("int").alias("missing_required"), (F.col("k") % 4).alias("checkboxes"), (F.col("k") % 2).alias("phase_bullets"), (F.col("k") % 11 == 0).cast("int").alias("links_without_rationale"), F.lit(0).alias("unresolved"), F.when(F.col("k") % 3 == 0, "core").otherwise("else").alias("origin"))
    p = s.createDataFrame([("core", 3, 0.4, 2, True, 1), ("default", 1, 0.8, 1, False, 0)], "origin string, min_sections int, max_placeholder_ratio double, min_checkboxes int, require_phases boolean, min_phase_bullets int")
    return quality.document_score(quality.with_profile(m, p))


query("r19_j35_document_score", "WITH m AS (SELECT o_orderkey AS k, o_orderkey % 7 AS s, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 3)::DOUBLE / (o_orderkey % 7) ELSE 1 END AS r, o_orderkey % 3 = 0 AS core FROM orders), f AS (SELECT k, s < CASE WHEN core THEN 3 ELSE 1 END AS few, r > CASE WHEN core THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS hollow, k % 5 = 0 AS gaps, k % 4 < CASE WHEN core THEN 2 ELSE 1 END AS unchecked, core AND k % 2 < 1 AS nophase, k % 11 = 0 AS bare FROM m) SELECT k AS doc_uid, greatest(0, 100 - 20 * few::INT - 25 * hollow::INT - 30 * gaps::INT - 10 * unchecked::INT - 20 * nophase::INT - 10 * bare::INT)::BIGINT AS score, CASE WHEN gaps OR few THEN 'needs_structure' WHEN hollow OR unchecked THEN 'needs_content' WHEN bare THEN 'needs_links' ELSE 'ok' END AS status FROM f")(_scores)
query("r17_x43_phases", "SELECT DISTINCT p_brand AS doc_uid, (p_size % 12) * 10 AS phase_id FROM part WHERE p_size % 12 BETWEEN 1 AND 6")(lambda s, d: quality.phase_mapping(B.read(s, d, "part").select(F.col("p_brand").alias("doc_uid"), F.concat(F.lit("phase-"), F.lpad((F.col("p_size") % 12).cast("string"), 2, "0")).alias("anchor")), B.read(s, d, "part").select(F.col("p_brand").alias("doc_uid")), s.range(7).select(F.col("id").cast("int").alias("phase_number"), (F.col("id") * 10).alias("phase_id"))))
over("x34_front_matter", "markdown", lambda m: m.select("doc_id", sections.front_matter("text")["title"].alias("title"), sections.front_matter("text")["status"].alias("status")), "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 AND doc_id % 8 <> 0 THEN p_name END AS title, CASE WHEN doc_id % 9 <> 0 THEN 'x' END AS status FROM markdown JOIN part ON p_partkey = doc_id")
over("x37_section_map", "markdown", lambda m: m.select("doc_id", sections.section_map("text")["Cel dokumentu"].alias("body"), F.size(sections.section_map("text")).cast("long").alias("n")), "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Text.' || chr(10) || '- [ ] a' END AS body, (1 + (doc_id % 4 <> 0)::INT + (doc_id % 6 <> 0)::INT + (doc_id % 10 = 0)::INT + (doc_id % 5 <> 0)::INT)::BIGINT AS n FROM markdown")
over("r12_patch_append", "markdown", lambda m: m.select("doc_id", F.sha2(sections.patch("text", "Cel dokumentu", "append", "more").cast("binary"), 256).alias("h")), "SELECT doc_id, sha256(replace(text, 'Text.' || chr(10) || '- [ ] a' || chr(10), 'Text.' || chr(10) || '- [ ] a' || chr(10) || 'more' || chr(10))) AS h FROM markdown")
over("r10_inject", "markdown", lambda m: m.select("doc_id", F.sha2(sections.inject("text", "Nowa", "b", ("Zakres",)).cast("binary"), 256).alias("h")), "SELECT doc_id, sha256(CASE WHEN contains(text, '## Zakres') THEN replace(text, '## Zakres', '## Nowa' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || '## Zakres') ELSE rtrim(text, chr(10)) || chr(10) || chr(10) || '## Nowa' || chr(10) || chr(10) || 'b' || chr(10) END) AS h FROM markdown")
query("j22_best_donor", "WITH w AS (SELECT p_name, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda t: length(t) > 2)) AS x, count(*) AS n, min(p_partkey) AS d1, min(p_partkey) FILTER (p_partkey > m) AS d2 FROM part JOIN (SELECT p_name, min(p_partkey) AS m FROM part GROUP BY 1) USING (p_name) GROUP BY 1), c AS (SELECT a.p_name, s.score, unnest([b.d1, b.d2]) AS donor FROM w a, w b, LATERAL (SELECT len(list_intersect(a.x, b.x))::DOUBLE / len(list_distinct(a.x || b.x)) AS score) s WHERE s.score >= 0.01) SELECT p_partkey, donor, score FROM part JOIN c USING (p_name) WHERE donor <> p_partkey QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, donor) = 1")(lambda s, d: sections.best_donors(B.read(s, d, "part"), B.read(s, d, "part"), "p_partkey", "p_name"))
query("x33_r27_mojibake", "SELECT c_custkey, c_name || ' żółć' AS name FROM customer")(lambda s, d: U.repair(B.read(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" \u017c\u00f3\u0142\u0107".encode().decode("cp1252"))).alias("name")), ["name"]).drop("changed"))
query("x6_dash_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-ecole' AS slug FROM part")(lambda s, d: B.read(s, d, "part").select("p_partkey", U.dash_slug(F.concat("p_name", F.lit("  \u00c9cole!"))).alias("slug")))
_CODES = "c AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS code, count(*) AS n, row_number() OVER (ORDER BY lpad(c_nationkey::VARCHAR, 2, '0')) AS i, (SELECT ceil(count(*) / 10) FROM customer) AS most FROM customer GROUP BY 1), w AS (SELECT i, code, n, 1 AS package, n AS size FROM c WHERE i = 1 UNION ALL SELECT c.i, c.code, c.n, CASE WHEN size + c.n > most AND package < 10 THEN package + 1 ELSE package END, CASE WHEN size + c.n > most AND package < 10 THEN c.n ELSE size + c.n END FROM w JOIN c ON c.i = w.i + 1)"
query("w11_r23_packages", f"WITH RECURSIVE {_CODES} SELECT package::INT AS package, code, 't' AS tag, n FROM w")(lambda s, d: packages.packages(B.read(s, d, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit("t"))))
over("e4_templates_page", "mapping", lambda m: services.templates(m.distinct(), "STD-3", 0.5, 50, 10), "SELECT * FROM (SELECT DISTINCT * FROM mapping) WHERE confidence >= 0.5 AND standard_code = 'STD-3' ORDER BY confidence DESC, doc_path, standard_code, match_reason LIMIT 50 OFFSET 10")
over("e4_review", "mapping", lambda m: services.review(m, m.select("doc_path", "standard_code").distinct().select("doc_path", "standard_code", (F.col("standard_code") != "STD-1").alias("approve"), F.when(F.col("standard_code") == "STD-2", 0.9).alias("confidence")).filter("standard_code in ('STD-1', 'STD-2', 'STD-3')"), ["doc_path", "standard_code"]), "SELECT doc_path, standard_code, CASE WHEN standard_code IN ('STD-2', 'STD-3') THEN 'expert_reviewed' ELSE match_reason END AS match_reason, CASE standard_code WHEN 'STD-2' THEN 0.9::DOUBLE WHEN 'STD-3' THEN greatest(coalesce(confidence, 0), 0.8::DOUBLE) ELSE confidence END AS confidence FROM mapping WHERE standard_code <> 'STD-1'")


from . import more, structure  # noqa: E402, F401  register their own queries


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
