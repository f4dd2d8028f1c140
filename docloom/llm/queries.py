"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, manifest, mixing, ngram_join, packing, pii, substring_dedup, token_count, toxicity, url_filter, warc
from .store import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at least once, no source more than twice; blocks of a million words."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=_fold() != 1)
    held = _fold() == 1
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "n_toxic_tokens", "spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each verified overlap of a document with a benchmark item."""
    found = decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), min_words=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), RULES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_chunks(spark, path, with_data=False))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(_read(spark, sf_dir, "documents"), manifest.tampered_leaf())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_mixing, op2_toxicity, op3_decontaminate, op4_ngram_jaccard, op5_substring_dedup, op6_url_filter, op7_exact_dedup, op8_warc, op9_pii, op10_token_count, op11_filter_audit, op12_packing, op13_manifest, pipeline)
    return {f.__name__: f for f in own}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
g AS (SELECT sh, min(doc_id) AS rep, any_value(len(sh)) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
m AS (SELECT s.doc_id, g.rep, g.n FROM s JOIN g ON list_sort(s.sh) = g.sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM g WHERE n > 0),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep AND a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS seen FROM g UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE c.component_id END AS component_id FROM m JOIN c ON m.rep = c.node""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS x FROM w WHERE len(ws) >= 13),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS d FROM g) WHERE d < doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS cut FROM f GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN cut IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(cut, i)), lambda i: ws[i]) END AS kept
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op6_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
j AS (SELECT page_id, host, path, rh || rp AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS p, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, sha256(t) AS text_sha256, count(*) OVER (PARTITION BY t) AS group_size,
        first_value(doc_id) OVER (PARTITION BY t ORDER BY p DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op8_warc": r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
}


ORACLES["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
d AS (SELECT part, doc_id, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) AS c,
        regexp_matches(x, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
        count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before, filter_order[1:step] AS upto FROM o, range(1, 6) g(step)),
j AS (SELECT part, filter_order, step, f, n, good, toxic, failed = f AS only_this, contains(failed, f) AS fails,
        failed <> '' AND translate(failed, before, '') <> failed AS gone, translate(failed, upto, '') = failed AS stays FROM s, h),
r AS (SELECT part, filter_order, step, f, sum(n * stays::INT)::BIGINT AS kept, sum(n * (fails AND NOT gone)::INT)::BIGINT AS removed, sum(n * (fails AND gone)::INT)::BIGINT AS redundant,
        sum(n * only_this::INT)::BIGINT AS unique_fails, sum(good * (fails AND NOT gone)::INT)::BIGINT AS good_lost, sum(toxic * (fails AND NOT gone)::INT)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

ORACLES["op13_manifest"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS part, n_chars,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
    list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, c: list_reduce(list_concat([xor(x, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS crc FROM documents),
e AS (SELECT doc_id, part, [coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-') for x in v] AS f,
    (coalesce(xor(crc, 4294967295) % 7 = 0, false) AND n_chars IS NOT NULL) AS t, octet_length(encode((n_chars + 1)::VARCHAR))::VARCHAR || ':' || (n_chars + 1)::VARCHAR AS g FROM d),
l AS (SELECT doc_id, part, sha256(array_to_string(f, '')) AS leaf, CASE WHEN t THEN sha256(f[1] || f[2] || f[3] || g || f[5]) ELSE sha256(array_to_string(f, '')) END AS claim,
    row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS idx FROM e),
t AS (SELECT part, 0 AS lvl, idx, leaf AS h FROM l UNION ALL
    SELECT part, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM t) WHERE c > 1 GROUP BY part, lvl, idx // 2),
s AS (SELECT part, h, lvl, row_number() OVER (ORDER BY part) - 1 AS idx FROM (SELECT part, h, lvl FROM t QUALIFY lvl = max(lvl) OVER (PARTITION BY part))),
u AS (SELECT 0 AS lvl, idx, h FROM s UNION ALL
    SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY lvl, idx // 2),
p AS (SELECT doc_id, part, leaf, 0 AS lvl, idx, claim AS node, '' AS proof FROM l UNION ALL
    SELECT p.doc_id, p.part, p.leaf, p.lvl + 1, p.idx // 2, sha256(CASE WHEN p.idx % 2 = 0 THEN p.node || coalesce(t.h, '') ELSE t.h || p.node END), p.proof || coalesce(t.h, '')
    FROM p JOIN s ON p.part = s.part AND p.lvl < s.lvl LEFT JOIN t ON t.part = p.part AND t.lvl = p.lvl AND t.idx = xor(p.idx, 1)),
q AS (SELECT p.doc_id, p.leaf, s.h AS subroot, 0 AS lvl, s.idx, p.node, p.proof FROM p JOIN s ON p.part = s.part AND p.lvl = s.lvl UNION ALL
    SELECT q.doc_id, q.leaf, q.subroot, q.lvl + 1, q.idx // 2, sha256(CASE WHEN q.idx % 2 = 0 THEN q.node || coalesce(u.h, '') ELSE u.h || q.node END), q.proof || coalesce(u.h, '')
    FROM q LEFT JOIN u ON u.lvl = q.lvl AND u.idx = xor(q.idx, 1) WHERE q.lvl < (SELECT max(lvl) FROM u))
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.h AS verified FROM q JOIN u ON q.lvl = u.lvl WHERE u.lvl = (SELECT max(lvl) FROM u)"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
