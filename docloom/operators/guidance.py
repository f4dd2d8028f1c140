"""Guidance of sections: enriched with standards, written by archetype, filled from donors; catalogue matches and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import unicode as U

from . import dimensions
from . import sections as S
from .matching import top_similar

#: Our own thresholds of title similarity: they aren't documented anywhere. A mapped document needs less.
HIGH, MEDIUM, BOOST = 0.6, 0.4, 0.15
#: States that a document passes through.
STATES = ("draft", "review", "approved", "active", "archived")
#: Keywords of titles and the guidance for them; the texts are our own. The first that fits counts.
ARCHETYPES = (
    ("quantum", "Describe the key exchange (QKD, BB84) and how keys are renewed."),
    ("aircraft|aviation", "Name the EASA rules and MRO steps that apply."),
    ("cargo|maritime", "List the EDI messages for cargo and who answers for each."),
    (r"\bota\b|firmware", "Describe how firmware is signed, rolled out by OTA and rolled back; secure boot."),
    ("alarm", "Set alarm classes after ISA-18.2 and their handling in SCADA."),
    ("clinical", "State the ICH GCP duties and what the eCRF records."),
    ("attorney|privilege", "Say what attorney privilege covers and who may waive it."),
    (r"\bats\b|recruit", "Describe the ATS stages and the time to fill (TTF)."),
    ("carbon|emission", "Give GHG scopes in CO2 equivalents and the net-zero path."),
    ("autonomous", "State the SAE level and the SOTIF analysis."),
    ("attribution", "Compare Last-Click with data-driven models and give ROAS."),
    ("blockchain|use case", "Fill an AI canvas and plan a pilot."),
)
PATTERNS = (
    ("^common (.+?) issues", "Frequent problems of {}: symptom, cause, remedy."),
    ("^access control for (.+)$", "Roles, reviews and withdrawal of rights for {}."),
    ("^(.+?) failure", "Outage of {}: severity P1 to P4, first steps, escalation."),
    ("^(.+?) tracking", "Metrics (KPI) of {}, their source and rhythm."),
    ("^(.+?) analytics", "Questions, BI data sources and KPI of {}."),
    ("^(.+?) operations", "Duties, shifts and SLA of {}."),
    ("^(.+?) development", "Standards, review and release of {}."),
)


def archetype(title: str | Column) -> Column:
    """Guidance for the first archetype whose keyword the title has, else null."""
    t, out = F.lower(T._s(title)), None
    for pattern, text in ARCHETYPES:
        out = F.when(t.rlike(pattern), text) if out is None else out.when(t.rlike(pattern), text)
    return out


def pattern_guidance(title: str | Column) -> Column:
    """Guidance by the form of a title, which it names; for other titles a general one."""
    t = T.collapse(T.strip(T._s(title)))
    low, out = F.lower(t), None
    for pattern, text in PATTERNS:
        a, _, b = text.partition("{}")
        filled = F.concat(F.lit(a), F.regexp_extract(low, pattern, 1), F.lit(b))
        out = F.when(low.rlike(pattern), filled) if out is None else out.when(low.rlike(pattern), filled)
    return out.otherwise(F.concat(F.lit("Purpose, scope and owner of: "), t, F.lit(".")))


def guidance_for(title: str | Column) -> Column:
    return F.coalesce(archetype(title), pattern_guidance(title))


def enrich(guidance: DataFrame, docs: DataFrame, mapping: DataFrame, extra: DataFrame, valid: DataFrame, code: str) -> DataFrame:
    """guidance (id, doc_title, section_title): a JSON list of codes of the document, then those of the section, each once and only valid ones; null if none.

    mapping (doc_path, code), extra (section_norm, seq, code), valid (code). Codes come in order of
    the code for documents and of seq for sections.
    """
    ok = valid.select(F.col(code).alias("c")).distinct()
    by_doc = mapping.select("doc_path", F.col(code).alias("c")).distinct().join(ok, "c").join(docs.select(F.col("path").alias("doc_path"), F.col("title").alias("doc_title")), "doc_path")
    by_doc = by_doc.groupBy("doc_title").agg(F.array_sort(F.collect_set("c")).alias("a"))
    by_sec = extra.select("section_norm", "seq", F.col(code).alias("c")).join(ok, "c").groupBy("section_norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]).alias("b"))
    x = guidance.withColumn("section_norm", T.title_norm_plain(F.col("section_title"))).join(by_doc, "doc_title", "left").join(by_sec, "section_norm", "left")
    none = F.array().cast("array<string>")
    codes = F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    return x.select("id", F.when(F.size(codes) > 0, F.to_json(codes)).alias("codes"))


def match_catalogue(entries: DataFrame, docs: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """entries (entry, doc_title), docs (path, title) -> entry, path, title, confidence of the best document; entries without one have no row.

    exact: the titles are equal without accents and case; else by words in common, high
    from HIGH on, medium from MEDIUM on. A document that is mapped already gets BOOST.
    """
    key = lambda c: U.key_norm(F.col(c))
    e = entries.select("entry", F.col("doc_title"), key("doc_title").alias("k"))
    d = docs.filter("path is not null").select("path", "title", key("title").alias("k"))
    exact = e.join(d.groupBy("k").agg(F.min(F.struct("path", "title")).alias("d")), "k").select("entry", "d.path", "d.title", F.lit("exact").alias("confidence"))
    rest = e.join(exact.select("entry"), "entry", "left_anti")
    asked = rest.select(F.col("entry").alias("a"), T.title_words(F.col("k")).alias("tokens"))
    best = lambda x: top_similar(asked, x.select(F.struct("path", "title").alias("b"), T.title_words(F.col("k")).alias("tokens")), MEDIUM - BOOST, 1).select(F.col("a").alias("entry"), "b.path", "b.title", "score")
    near = best(d)
    if mapped is not None:
        near = near.unionByName(best(d.join(mapped.select(F.col(mapped.columns[0]).alias("path")).distinct(), "path", "left_semi")).withColumn("score", F.col("score") + BOOST))
    best = near.filter(F.col("score") >= MEDIUM).groupBy("entry").agg(F.min(F.struct((-F.col("score")).alias("less"), "path", "title")).alias("d"))
    return exact.unionByName(best.select("entry", "d.path", "d.title", F.when(F.col("d.less") <= -HIGH, "high").otherwise("medium").alias("confidence")))


def mapping_confidence(mapping: DataFrame, standards: DataFrame, guided: DataFrame, weight: float = 2.0, bonus: float = 0.1) -> DataFrame:
    """mapping (doc_path, standard_code) -> confidence and the evidence for it.

    Words of the path against those of the standard's description, by Jaccard times ``weight``, and
    ``bonus`` for each piece of guidance (doc_path, standard_code) that names both, 0.3 at most;
    1 at most. The formula is our own.
    """
    words = T.plain_words(T.title_of_path(F.col("doc_path")))
    n = guided.groupBy("doc_path", "standard_code").agg(F.count(F.lit(1)).alias("n_guidance"))
    x = mapping.join(standards.select("standard_code", T.plain_words(F.col("description")).alias("b")), "standard_code", "left").join(n, ["doc_path", "standard_code"], "left")
    b, n_guidance = F.coalesce("b", F.array().cast("array<string>")), F.coalesce("n_guidance", F.lit(0))
    score = F.least(F.lit(1.0), T.jaccard(words, b) * weight + F.least(n_guidance * bonus, F.lit(0.3)))
    evidence = F.concat(F.lit("tokens:"), F.array_join(F.array_sort(F.array_intersect(words, b)), ","), F.lit(" guidance_refs:"), n_guidance.cast("string"))
    return x.select("doc_path", "standard_code", F.bround(score, 4).alias("confidence"), evidence.alias("evidence"))


def branches(rows: DataFrame, titles: DataFrame, slugs: DataFrame, dimension: DataFrame) -> DataFrame:
    """rows (title, branch_id or null) with branch_id and isic_code: of the row, else by title, else by slug; unknown branches change nothing."""
    x = rows.withColumn("__slug", U.snake_slug(F.col("title")))
    x = x.join(titles.select("title", F.col("branch_id").alias("__t")), "title", "left").join(slugs.select(F.col("slug").alias("__slug"), F.col("branch_id").alias("__s")), "__slug", "left")
    x = x.withColumn("__b", F.coalesce("branch_id", "__t", "__s")).join(dimension.select(F.col("branch_id").alias("__b"), F.col("isic_code").alias("__code")), "__b", "left")
    known = F.col("__code").isNotNull()
    return x.withColumns({"branch_id": F.when(known, F.col("__b")).otherwise(F.col("branch_id")), "isic_code": F.col("__code")}).drop("__slug", "__t", "__s", "__b", "__code")


def branch_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (code, tag): the code's name, else the tag with single spaces."""
    return rows.join(names.select("code", "name"), "code", "left").select("code", F.coalesce("name", T.collapse(T.strip(T._s("tag")))).alias("name"))


def lifecycle(docs: DataFrame) -> DataFrame:
    """Every document in every state, in order."""
    return docs.select(F.col("doc_uid"), F.posexplode(F.array(*map(F.lit, STATES)))).select("doc_uid", F.col("pos").alias("seq"), F.col("col").alias("state"))


def controls(spark: SparkSession) -> DataFrame:
    """standard_code, seq, control_id, title, theme of the controls of two public standards."""
    return spark.createDataFrame(dimensions.control_rows(), "standard_code string, seq int, control_id string, title string, theme string")


def seed(old: DataFrame, new: DataFrame, key: list[str], replace: bool = False) -> DataFrame:
    """A table after loading its seed rows: loading twice adds nothing; ``replace`` drops what was there."""
    if replace:
        return new.dropDuplicates(key)
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti").select(old.columns))


def fill_from_donors(docs: DataFrame, targets: tuple[str, ...], least_bytes: int = 8000, least_rich: int = 5, least: float = 0.01) -> DataFrame:
    """path, text: documents whose placeholder sections (of ``targets``) are filled from the best donor; aligned_rev goes up by one.

    A donor has ``least_bytes`` bytes and ``least_rich`` filled target sections; the most similar
    title counts, never the document itself. Documents that nothing is filled in have no row.
    """
    x = docs.select("path", "text", T.title_of_file(F.col("text"), F.col("path")).alias("title"), S.section_map("text").alias("m"))
    is_target = lambda k: k.isin(*targets)
    x = x.withColumn("rich", F.map_filter("m", lambda k, v: is_target(k) & ~T.placeholder_body(v))).withColumn("hollow", F.map_keys(F.map_filter("m", lambda k, v: is_target(k) & T.placeholder_body(v))))
    ask = x.filter(F.size("hollow") > 0)
    give = x.filter((F.octet_length("text") >= least_bytes) & (F.size("rich") >= least_rich))
    near = top_similar(ask.select(F.col("path").alias("a"), T.title_words(F.col("title")).alias("tokens")), give.select(F.col("path").alias("b"), T.title_words(F.col("title")).alias("tokens")), least, 2)
    best = near.filter("a <> b").groupBy("a").agg(F.min_by("b", "rank").alias("donor"))
    y = ask.join(best, ask.path == best.a).join(give.select(F.col("path").alias("donor"), F.col("rich").alias("gift")), "donor")
    y = y.withColumn("todo", F.filter("hollow", lambda h: F.col("gift")[h].isNotNull())).filter(F.size("todo") > 0)
    # The text cut before each second-level heading; pieces with a heading to fill get the donor's body.
    pieces = F.split("text", r"(?m)^(?=## )")
    head = lambda p: T.strip(F.regexp_extract(p, r"\A##[ \t]+([^\n]*)", 1))
    filled = F.transform(pieces, lambda p: F.when(F.array_contains("todo", head(p)), F.concat(F.regexp_extract(p, r"\A([^\n]*\n?)", 1), F.col("gift")[head(p)], F.lit("\n"))).otherwise(p))
    text = F.array_join(filled, "")
    rev = F.regexp_extract(text, r"aligned_rev:\s*(\d+)", 1)
    bumped = F.when(rev != "", F.regexp_replace(text, F.lit(r"aligned_rev:\s*\d+"), F.concat(F.lit("aligned_rev: "), (rev.try_cast("long") + 1).cast("string")))).otherwise(text)
    return y.select("path", "donor", bumped.alias("text"))


def code_links(guidance: DataFrame, column: str = "refs") -> DataFrame:
    """id, code: each code of a guidance's JSON list once; null and bad lists have none."""
    return guidance.select("id", F.explode(T.json_list(column)).alias("code")).distinct()
