"""The documentation model's relations as views of the analytic tables, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _path(key: str):
    return F.concat(F.lit("core/g"), F.col(key) % 7, F.lit("/"), F.col(key), F.lit(".md"))


def docs(spark, sf_dir) -> DataFrame:
    """doc_uid, title, path, origin; some paths are null or ORPHAN."""
    k = F.col("p_partkey")
    path = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit("ORPHAN")).otherwise(_path("p_partkey"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("D"), k).alias("doc_uid"), F.col("p_name").alias("title"), path.alias("path"), F.when(k % 3 == 0, "core").when(k % 3 == 1, "imported_template").otherwise("other").alias("origin"))


def mapping(spark, sf_dir) -> DataFrame:
    """doc_path, standard_code, match_reason, confidence (some null)."""
    return read(spark, sf_dir, "lineitem").select(_path("l_partkey").alias("doc_path"), F.concat(F.lit("STD-"), F.col("l_suppkey") % 25).alias("standard_code"), F.col("l_returnflag").alias("match_reason"), F.when(F.col("l_tax") != 0, F.col("l_discount") * 10).alias("confidence"))


def standards(spark, sf_dir) -> DataFrame:
    """standard_code, standard_name: more codes than are mapped."""
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("STD-"), "s_suppkey").alias("standard_code"), F.col("s_name").alias("standard_name"))


def sections(spark, sf_dir) -> DataFrame:
    """section_uid, doc_uid, heading_norm, anchor, ordinal, status."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("section_uid"), F.col("p_brand").alias("doc_uid"), F.lower("p_name").alias("heading_norm"), F.regexp_replace(F.lower("p_name"), " ", "-").alias("anchor"), (k % 3).alias("ordinal"), F.when(k % 5 == 0, "placeholder").otherwise("filled").alias("status"))


def links(spark, sf_dir) -> DataFrame:
    """id, from_ref (a label), to_ref (a label), context_doc_uid, required, rationale."""
    o = read(spark, sf_dir, "orders")
    p = read(spark, sf_dir, "part")
    name = p.select("p_partkey", F.lower("p_name").alias("name"), F.col("p_brand").alias("brand"))
    n = F.greatest(p.select(F.max("p_partkey").alias("m")).scalar(), F.lit(1))
    src = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % n).alias("p_partkey"), F.when(F.col("o_orderkey") % 15 == 0, F.lit("no such label")).alias("bad"), (F.col("o_orderkey") % 2).cast("int").alias("required"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("rationale"))
    return src.join(name, "p_partkey").select("id", F.coalesce("bad", "name").alias("to_ref"), F.when(F.col("id") % 7 != 0, F.col("brand")).alias("context_doc_uid"), "required", "rationale")


def edges(spark, sf_dir) -> DataFrame:
    """from_node, to_node, weight: consecutive parts of an order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_node"), F.lead("l_partkey").over(w).alias("to_node"), F.col("l_discount").alias("weight")).filter("to_node is not null")


def changelog(spark, sf_dir) -> DataFrame:
    """id, template_path, changed_at (UTC text), change_type, value."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("core/T"), F.col("user_id"), F.lit(".md")).alias("template_path"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"), F.col("event_type").alias("change_type"), "ts")


def guidance(spark, sf_dir) -> DataFrame:
    """id, refs: JSON lists, some null, some bad."""
    k = F.col("p_partkey")
    good = F.concat(F.lit('["'), F.col("p_brand"), F.lit('","'), F.col("p_type"), F.lit('"]'))
    return read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("[bad")).otherwise(good).alias("refs"))


def markdown(spark, sf_dir) -> DataFrame:
    """path, text: small documents with front matter and headings, parts of which are missing by key."""
    k = F.col("p_partkey")
    text = F.concat(
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("---\n"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("title: "), "p_name", F.lit("\n"))), F.lit("status: x\n---\n"))),
        F.concat(F.lit("# "), "p_name", F.lit("\n")), F.when(k % 4 == 0, "").otherwise("## Cel dokumentu\nText.\n- [ ] a\n"),
        F.when(k % 6 == 0, "").otherwise("## Zakres i granice\n"), F.when(k % 10 == 0, "## 1. Extra\n### Sub\n- x\n").otherwise(""),
        F.concat(F.lit("## "), "p_brand", F.lit("\ntodo\n")), F.when(k % 5 == 0, "").otherwise("## Wejścia i wyjścia\nLast | line |\n"),
        F.when(k % 5 == 1, "### 2. Fazy  cyklu życia\n- faza 1: a\n").when(k % 12 == 3, "\u2600 sun\n").when(k % 12 == 7, "\U0001f680 [osoba/rola]\n").when(k % 12 == 9, "\u6f22\n").otherwise(""),
    )
    return read(spark, sf_dir, "part").select(k.alias("doc_id"), _path("p_partkey").alias("path"), text.alias("text"))


def notes(spark, sf_dir) -> DataFrame:
    """doc_uid, origin, text: whole documents below and above headings, with every kind of line end, with and without a last one."""
    k, lit = F.col("doc_id"), F.lit
    head = F.concat(lit("# T"), k.cast("string"), lit("\r\n## Cel dokumentu i zakres\n"))
    tail = F.concat(
        lit("\u2028- [ ] done\n### 1. Metadane dokumentu\u0085* item\n##  \n| a | b |\n- Faza 1: plan\rsee https://x.y and [a](b)"),
        F.when(k % 5 == 0, "\n\n## Fazy cyklu \u017cycia\ntodo\x0c").when(k % 2 == 0, "\n").when(k % 7 == 0, "\r\n\n").otherwise(""),
    )
    origin = F.when(k % 3 == 0, "core").when(k % 3 == 1, "imported_template").otherwise("other")
    return read(spark, sf_dir, "documents").select(k.cast("string").alias("doc_uid"), origin.alias("origin"), F.concat(head, F.coalesce("text", lit("")), tail).alias("text"))


def _uid(key) -> F.Column:
    return F.upper(F.substring(F.sha2(F.concat(F.lit("D"), key.cast("string")).cast("binary"), 256), 1, 26))


def _title(name, key) -> F.Column:
    return F.concat(name, F.lit(" "), (key % 500).cast("string"))


def udocs(spark, sf_dir) -> DataFrame:
    """doc_uid of 26 characters, title (repeated beyond 500 parts), path."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(_uid(k).alias("doc_uid"), _title(F.col("p_name"), k).alias("title"), _path("p_partkey").alias("path"))


def usections(spark, sf_dir) -> DataFrame:
    """Three sections a document; in every fourth one two have the same heading."""
    k, o = F.col("p_partkey"), F.col("o")
    again = (o == 1) | ((o == 3) & (k % 4 == 0))
    heading = F.when(again, "cel dokumentu").when(o == 2, F.lower("p_type")).otherwise(F.lower("p_brand"))
    x = read(spark, sf_dir, "part").select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("o"))
    return x.select((k * 10 + o).alias("section_uid"), _uid(k).alias("doc_uid"), heading.alias("heading_norm"), F.replace(F.replace(heading, F.lit(" "), F.lit("-")), F.lit("#"), F.lit("")).alias("anchor"), F.when((o == 3) & (k % 4 == 0), 2).otherwise(1).alias("ordinal"))


def refs(spark, sf_dir) -> DataFrame:
    """Links whose ends are given in every form: by uid and anchor, by label, by title and section, by title, and badly."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    n = F.greatest(p.select(F.max("p_partkey").alias("m")).scalar(), F.lit(1))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % n).alias("k"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n).alias("j"))
    # Parts grow with the references, so they aren't sent whole to every task (see operators/links.py).
    x = o.join(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("kn")).hint("merge"), "k").join(p.select(F.col("p_partkey").alias("j"), F.col("p_name").alias("jn"), F.col("p_brand").alias("jb")).hint("merge"), "j")
    i, k, j = F.col("id"), F.col("k"), F.col("j")
    form, lit = i % 8, F.lit
    own = _title(F.col("kn"), k)
    to = (
        F.when(form == 0, F.concat(lit("doc::"), _uid(j), lit("::section::cel-dokumentu")))
        .when(form == 1, F.concat(lit("DOC::"), _uid(j), lit("::section::cel-dokumentu::2")))
        .when(form == 2, "section:: 1. Cel dokumentu")
        .when(form == 3, F.concat(lit("section::Meta: "), "jb"))
        .when(form == 4, F.concat(lit("document::"), F.upper(_title(F.col("jn"), j)), lit("::section::Cel Dokumentu")))
        .when(form == 5, F.concat(lit("document:: "), _title(F.col("jn"), j)))
        .when(form == 6, "section::no such")
        .otherwise("plain")
    )
    frm = F.when(form == 5, F.when(i % 3 == 0, "document::nothing").otherwise(F.concat(lit("document::"), own))).when(i % 3 == 0, F.concat(lit("doc::"), _uid(k), lit("::section::cel-dokumentu"))).when(i % 3 == 1, "section::cel dokumentu").otherwise(F.concat(lit("document::"), own, lit("::section::cel dokumentu")))
    kind = F.when(form == 5, "document").otherwise("section")
    return x.select("id", kind.alias("from_type"), frm.alias("from_ref"), kind.alias("to_type"), to.alias("to_ref"), F.when(form == 5, "depends_on").otherwise("refers_to").alias("link_type"), (i % 2).cast("int").alias("required"), F.when(i % 5 != 0, _uid(k)).alias("context_doc_uid"))


#: The same as DuckDB common table expressions.
SQL = {
    "notes": "notes AS (SELECT doc_id::VARCHAR AS doc_uid, CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'imported_template' ELSE 'other' END AS origin, '# T' || doc_id || chr(13) || chr(10) || '## Cel dokumentu i zakres' || chr(10) || coalesce(text, '') || chr(8232) || '- [ ] done' || chr(10) || '### 1. Metadane dokumentu' || chr(133) || '* item' || chr(10) || '##  ' || chr(10) || '| a | b |' || chr(10) || '- Faza 1: plan' || chr(13) || 'see https://x.y and [a](b)' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '## Fazy cyklu życia' || chr(10) || 'todo' || chr(12) WHEN doc_id % 2 = 0 THEN chr(10) WHEN doc_id % 7 = 0 THEN chr(13) || chr(10) || chr(10) ELSE '' END AS text FROM documents)",
    "docs": "docs AS (SELECT 'D' || p_partkey AS doc_uid, p_name AS title, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'ORPHAN' ELSE 'core/g' || (p_partkey % 7) || '/' || p_partkey || '.md' END AS path, CASE p_partkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'imported_template' ELSE 'other' END AS origin FROM part)",
    "mapping": "mapping AS (SELECT 'core/g' || (l_partkey % 7) || '/' || l_partkey || '.md' AS doc_path, 'STD-' || (l_suppkey % 25) AS standard_code, l_returnflag AS match_reason, CASE WHEN l_tax <> 0 THEN l_discount * 10 END AS confidence FROM lineitem)",
    "standards": "standards AS (SELECT 'STD-' || s_suppkey AS standard_code, s_name AS standard_name FROM supplier)",
    "sections": "sections AS (SELECT p_partkey AS section_uid, p_brand AS doc_uid, lower(p_name) AS heading_norm, replace(lower(p_name), ' ', '-') AS anchor, p_partkey % 3 AS ordinal, CASE WHEN p_partkey % 5 = 0 THEN 'placeholder' ELSE 'filled' END AS status FROM part)",
    "links": "links AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 15 = 0 THEN 'no such label' ELSE lower(p_name) END AS to_ref, CASE WHEN o_orderkey % 7 <> 0 THEN p_brand END AS context_doc_uid, (o_orderkey % 2)::INT AS required, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS rationale FROM orders JOIN part ON p_partkey = o_custkey % greatest((SELECT max(p_partkey) FROM part), 1))",
    "edges": "edges AS (SELECT from_node, to_node, weight FROM (SELECT l_partkey AS from_node, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS to_node, l_discount AS weight FROM lineitem) WHERE to_node IS NOT NULL)",
    "changelog": "changelog AS (SELECT event_id AS id, 'core/T' || user_id || '.md' AS template_path, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS changed_at, event_type AS change_type, ts FROM events)",
    "udocs": "udocs AS (SELECT upper(substr(sha256('D' || p_partkey), 1, 26)) AS doc_uid, p_name || ' ' || (p_partkey % 500) AS title, 'core/g' || (p_partkey % 7) || '/' || p_partkey || '.md' AS path FROM part)",
    "usections": "usections AS (SELECT section_uid, doc_uid, h AS heading_norm, replace(replace(h, ' ', '-'), '#', '') AS anchor, ordinal FROM (SELECT p_partkey * 10 + o AS section_uid, upper(substr(sha256('D' || p_partkey), 1, 26)) AS doc_uid, CASE WHEN o = 1 OR (o = 3 AND p_partkey % 4 = 0) THEN 'cel dokumentu' WHEN o = 2 THEN lower(p_type) ELSE lower(p_brand) END AS h, CASE WHEN o = 3 AND p_partkey % 4 = 0 THEN 2 ELSE 1 END AS ordinal FROM part, range(1, 4) t(o)))",
    "refs": "refs AS (SELECT i AS id, kind AS from_type, CASE WHEN i % 8 = 5 THEN CASE WHEN i % 3 = 0 THEN 'document::nothing' ELSE 'document::' || own END WHEN i % 3 = 0 THEN 'doc::' || ku || '::section::cel-dokumentu' WHEN i % 3 = 1 THEN 'section::cel dokumentu' ELSE 'document::' || own || '::section::cel dokumentu' END AS from_ref, kind AS to_type, CASE i % 8 WHEN 0 THEN 'doc::' || ju || '::section::cel-dokumentu' WHEN 1 THEN 'DOC::' || ju || '::section::cel-dokumentu::2' WHEN 2 THEN 'section:: 1. Cel dokumentu' WHEN 3 THEN 'section::Meta: ' || jb WHEN 4 THEN 'document::' || upper(other) || '::section::Cel Dokumentu' WHEN 5 THEN 'document:: ' || other WHEN 6 THEN 'section::no such' ELSE 'plain' END AS to_ref, CASE WHEN i % 8 = 5 THEN 'depends_on' ELSE 'refers_to' END AS link_type, (i % 2)::INT AS required, CASE WHEN i % 5 <> 0 THEN ku END AS context_doc_uid FROM (SELECT o_orderkey AS i, upper(substr(sha256('D' || a.p_partkey), 1, 26)) AS ku, upper(substr(sha256('D' || b.p_partkey), 1, 26)) AS ju, a.p_name || ' ' || (a.p_partkey % 500) AS own, b.p_name || ' ' || (b.p_partkey % 500) AS other, b.p_brand AS jb, CASE WHEN o_orderkey % 8 = 5 THEN 'document' ELSE 'section' END AS kind FROM (SELECT o_orderkey, o_custkey % m AS k, (o_custkey * 7 + o_orderkey) % m AS j FROM orders, (SELECT greatest(max(p_partkey), 1) AS m FROM part)) JOIN part a ON a.p_partkey = k JOIN part b ON b.p_partkey = j))",
    "guidance": "guidance AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '[bad' ELSE '[\"' || p_brand || '\",\"' || p_type || '\"]' END AS refs FROM part)",
    "markdown": "markdown AS (SELECT p_partkey AS doc_id, 'core/g' || (p_partkey % 7) || '/' || p_partkey || '.md' AS path, (CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '---' || chr(10) || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'title: ' || p_name || chr(10) END || 'status: x' || chr(10) || '---' || chr(10) END) || '# ' || p_name || chr(10) || (CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '## Cel dokumentu' || chr(10) || 'Text.' || chr(10) || '- [ ] a' || chr(10) END) || (CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '## Zakres i granice' || chr(10) END) || (CASE WHEN p_partkey % 10 = 0 THEN '## 1. Extra' || chr(10) || '### Sub' || chr(10) || '- x' || chr(10) ELSE '' END) || '## ' || p_brand || chr(10) || 'todo' || chr(10) || (CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '## Wejścia i wyjścia' || chr(10) || 'Last | line |' || chr(10) END) || (CASE WHEN p_partkey % 5 = 1 THEN '### 2. Fazy  cyklu życia' || chr(10) || '- faza 1: a' || chr(10) WHEN p_partkey % 12 = 3 THEN chr(9728) || ' sun' || chr(10) WHEN p_partkey % 12 = 7 THEN chr(128640) || ' [osoba/rola]' || chr(10) WHEN p_partkey % 12 = 9 THEN chr(28450) || chr(10) ELSE '' END) AS text FROM part)",
}


def with_views(names: str, body: str) -> str:
    """SQL with the views that it names."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
