"""Resolution of labels to sections, document dependencies and edges.

Each strategy is one equi-join against an index that is aggregated beforehand, so a
label costs one row however many sections carry it. An index grows with the library, so joins
with one are sorted merges by hint: by its files' compressed size Spark would
send it whole to the driver and to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.functions import unicode as U


def _keys():
    return F.array_distinct(F.array("heading_norm", F.regexp_replace("heading_norm", " ", "-"), F.lower("anchor")))


def label_index(sections: DataFrame, by_doc: bool, exact: bool = True) -> DataFrame:
    """key (and doc_uid) -> number of sections and the smallest one; keys are heading, heading with dashes, anchor.

    Without ``exact`` the number is 1 or 2 for more: told by the smallest and the largest, it needs one shuffle of one row a key and task.
    """
    rows = sections.select("section_uid", "doc_uid", F.explode(_keys()).alias("key")).filter("key is not null and key <> ''")
    return rows.groupBy(*(["doc_uid"] if by_doc else []), "key").agg((F.countDistinct("section_uid") if exact else F.when(F.min("section_uid") == F.max("section_uid"), 1).otherwise(2)).alias("n"), F.min("section_uid").alias("uid"))


def resolve(links: DataFrame, sections: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """links (id, to_ref, context_doc_uid) -> id, to_uid, method, confidence.

    An override comes first; then the label in its context document if it is unique
    there; if it is ambiguous there, that ends the search; then the whole library.
    """
    own = label_index(sections, True, exact=False).select(F.col("doc_uid").alias("context_doc_uid"), "key", F.col("n").alias("n_doc"), F.col("uid").alias("uid_doc"))
    whole = label_index(sections, False, exact=False).select("key", F.col("n").alias("n_all"), F.col("uid").alias("uid_all"))
    # Whatever a label with spaces finds, its dashed form finds too, as every heading is indexed by both.
    x = links.withColumn("key", F.replace("to_ref", F.lit(" "), F.lit("-"))).join(own.hint("merge"), ["context_doc_uid", "key"], "left").join(whole.hint("merge"), "key", "left")
    if overrides is not None:
        x = x.join(overrides.select(F.col("label_norm").alias("to_ref"), F.col("section_uid").alias("uid_over")), "to_ref", "left")
    else:
        x = x.withColumn("uid_over", F.lit(None).cast("long"))
    over, n_doc, n_all = F.col("uid_over").isNotNull(), F.coalesce("n_doc", F.lit(0)), F.coalesce("n_all", F.lit(0))
    method = F.when(over, "manual").when(n_doc == 1, "context_doc").when(n_doc > 1, "ambiguous").when(n_all == 1, "global_unique").when(n_all > 1, "ambiguous").otherwise("missing")
    x = x.withColumn("method", method)
    uid = F.when(F.col("method") == "manual", F.col("uid_over")).when(F.col("method") == "context_doc", F.col("uid_doc")).when(F.col("method") == "global_unique", F.col("uid_all"))
    conf = F.when(F.col("method") == "manual", 1.0).when(F.col("method") == "context_doc", 0.95).when(F.col("method") == "global_unique", 0.9).otherwise(0.0)
    return x.select("id", uid.alias("to_uid"), "method", conf.alias("confidence"))


def both_ends(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """Links of which both ends are resolved: the smaller confidence; ``mixed`` if the methods differ; notes: the context document if it decided.

    a, b: resolved origins and targets (id, to_uid, method, confidence); links (id, context_doc_uid; of those with
    from_type and to_type only links between sections count).
    """
    x = a.filter("to_uid is not null").select("id", F.col("to_uid").alias("from_uid"), F.col("method").alias("m1"), F.col("confidence").alias("c1"))
    y = b.filter("to_uid is not null").select("id", "to_uid", F.col("method").alias("m2"), F.col("confidence").alias("c2"))
    for kind in {"from_type", "to_type"} & set(links.columns):
        links = links.filter(F.col(kind) == "section")
    both = x.join(y.hint("merge"), "id").join(links.select("id", "context_doc_uid").hint("merge"), "id")
    method = F.when(F.col("m1") == F.col("m2"), F.col("m1")).otherwise("mixed")
    return both.select("id", "from_uid", "to_uid", method.alias("method"), F.least("c1", "c2").alias("confidence"), F.when(method == "context_doc", F.col("context_doc_uid")).alias("notes"))


def label_audit(links: DataFrame, sections: DataFrame) -> DataFrame:
    """links (id, ref): every normalised label with the first link that has it, the number of sections and whether that is unique, ambiguous or missing."""
    label = F.regexp_extract(F.trim("ref"), LABEL, 1)
    x = links.filter(F.trim("ref").rlike(LABEL)).select("id", label.alias("raw"), U.key_norm(label).alias("label"))
    first = x.groupBy("label").agg(F.min(F.struct("id", "raw")).alias("f"))
    known = sections.groupBy(U.key_norm(F.col("heading_norm")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    y = first.join(known, "label", "left").select("label", "f.raw", F.col("f.id").alias("first_id"), F.coalesce("n", F.lit(0)).alias("n"))
    return y.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous"))


#: The forms of a reference. Letters of any case.
EXPLICIT = r"(?i)^doc::([0-9A-Z]{26})::section::([a-z0-9\-]+)(?:::(\d+))?$"
LABEL = r"(?i)^section::(.+)$"
TITLED = r"(?i)^document::(.+?)::section::(.+)$"


def explicit(refs: DataFrame) -> DataFrame:
    """``doc::<uid>::section::<anchor>[::n]`` taken apart; the ordinal is 1 if absent."""
    part = lambda i: F.regexp_extract("ref", EXPLICIT, i)
    return refs.filter(F.col("ref").rlike(EXPLICIT)).select("ref", part(1).alias("doc_uid"), part(2).alias("anchor"), F.coalesce(part(3).try_cast("int"), F.lit(1)).alias("ordinal"))


def resolve_refs(refs: DataFrame, sections: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """refs (id, ref, context_doc_uid) of the first two forms -> id, to_uid, method, confidence; other refs have no row.

    An explicit reference is a place (uid, anchor, ordinal) and is there or missing; a
    label is normalised and resolved as ``resolve`` does.
    """
    refs = refs.select("id", F.trim("ref").alias("ref"), "context_doc_uid")
    at = explicit(refs.select("ref").distinct())
    there = sections.groupBy("doc_uid", "anchor", "ordinal").agg(F.min("section_uid").alias("uid"))
    found = at.join(there.hint("merge"), ["doc_uid", "anchor", "ordinal"], "left").select("ref", "uid")
    direct = refs.join(found.hint("merge"), "ref").select("id", F.col("uid").alias("to_uid"), F.when(F.col("uid").isNull(), "missing").otherwise("explicit").alias("method"), F.when(F.col("uid").isNull(), 0.0).otherwise(1.0).alias("confidence"))
    label = T.norm_label(F.regexp_extract("ref", LABEL, 1))
    named = refs.filter(F.col("ref").rlike(LABEL)).select("id", label.alias("to_ref"), "context_doc_uid")
    return direct.unionByName(resolve(named, sections, overrides))


def resolve_titled(refs: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """refs (id, ref) of the form title and section -> id, to_uid, method (context_doc, missing_doc, missing_section), confidence.

    Titles are compared lower-cased and trimmed, the first uid of equal titles counts;
    of sections with one anchor the last does.
    """
    title = lambda c: F.trim(F.lower(c))
    asked = refs.filter(F.col("ref").rlike(TITLED)).select("id", title(F.regexp_extract("ref", TITLED, 1)).alias("t"), T.to_anchor(F.regexp_extract("ref", TITLED, 2), phases=False).alias("anchor"))
    known = docs.filter("title is not null").groupBy(title(F.col("title")).alias("t")).agg(F.min("doc_uid").alias("doc_uid"))
    there = sections.filter("anchor is not null").groupBy("doc_uid", "anchor").agg(F.max("section_uid").alias("uid"))
    x = asked.join(known, "t", "left").join(there, ["doc_uid", "anchor"], "left")
    method = F.when(F.col("doc_uid").isNull(), "missing_doc").when(F.col("uid").isNull(), "missing_section").otherwise("context_doc")
    return x.select("id", F.col("uid").alias("to_uid"), method.alias("method"), F.when(F.col("uid").isNull(), 0.0).otherwise(0.85).alias("confidence"))


def document_dependencies(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Dependencies from links between ``document::Title`` ends; an unknown origin falls back to the context document.

    Of equal titles the last uid counts.
    """
    known = docs.filter("title <> ''").groupBy(F.trim(F.lower("title")).alias("t")).agg(F.max("doc_uid").alias("uid"))
    title = lambda c: F.trim(F.lower(F.regexp_replace(c, r"^.*?::", "")))
    x = refs.filter(F.expr("to_type = 'document' and from_ref ilike 'document::%' and to_ref ilike 'document::%'"))
    x = x.select(title("from_ref").alias("f"), title("to_ref").alias("t"), "context_doc_uid", "required")
    x = x.join(known.select(F.col("t").alias("f"), F.col("uid").alias("from_uid")), "f", "left").join(known.withColumnRenamed("uid", "to_doc"), "t")
    return dependencies(x.select(F.coalesce("from_uid", "context_doc_uid").alias("from_doc"), "to_doc", "required"))


EDGE = ["from_kind", "from_uid", "to_kind", "to_uid", "link_type", "direction", "rationale", "strength", "source", "source_row_id"]


def doc_edges(doc_links: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_links (id, doc_title, depends_on_title, dependency_type, rationale): edges where both titles are known; of equal titles the last uid counts."""
    known = docs.groupBy(T.title_norm_plain(F.col("title")).alias("t")).agg(F.max("doc_uid").alias("uid"))
    x = doc_links.withColumns({"a": T.title_norm_plain(F.col("doc_title")), "b": T.title_norm_plain(F.col("depends_on_title"))})
    x = x.join(known.select(F.col("t").alias("a"), F.col("uid").alias("from_uid")), "a").join(known.select(F.col("t").alias("b"), F.col("uid").alias("to_uid")), "b")
    kind = F.lower(F.coalesce(F.nullif("dependency_type", F.lit("")), F.lit("depends_on")))
    return x.select(F.lit("doc").alias("from_kind"), "from_uid", F.lit("doc").alias("to_kind"), "to_uid", kind.alias("link_type"), F.lit("forward").alias("direction"), "rationale", F.lit("navigational").alias("strength"), F.lit("doc_doc_links").alias("source"), F.col("id").alias("source_row_id"))


def section_edges(section_links: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """section_links (id, doc_title, section_title, link_type, direction, rationale): edges to a document's section, that with ordinal 1 first."""
    known = docs.groupBy(T.title_norm_plain(F.col("title")).alias("t")).agg(F.max("doc_uid").alias("from_uid"))
    # The first of equal headings unless another one has ordinal 1; of several with it the last.
    best = F.coalesce(F.max(F.when(F.col("ordinal") == 1, F.col("section_uid"))), F.min("section_uid"))
    there = sections.groupBy(F.col("doc_uid").alias("from_uid"), F.col("heading_norm").alias("h")).agg(best.cast("string").alias("to_uid"))
    x = section_links.withColumns({"t": T.title_norm_plain(F.col("doc_title")), "h": T.title_norm_plain(F.col("section_title"))}).join(known, "t").join(there, ["from_uid", "h"])
    return x.select(F.lit("doc").alias("from_kind"), "from_uid", F.lit("section").alias("to_kind"), "to_uid", "link_type", "direction", "rationale", F.lit("navigational").alias("strength"), F.lit("doc_section_links").alias("source"), F.col("id").alias("source_row_id"))


def raw_edges(content_links: DataFrame) -> DataFrame:
    """Content links as edges between their raw references."""
    kind = lambda c: F.when(F.col(c) == "section", "section").otherwise("doc")
    return content_links.select(kind("from_type").alias("from_kind"), F.col("from_ref").alias("from_uid"), kind("to_type").alias("to_kind"), F.col("to_ref").alias("to_uid"), "link_type", "direction", "rationale", T.strength("required").alias("strength"), F.lit("content_links").alias("source"), F.col("id").alias("source_row_id"))


def materialize_edges(doc_links: DataFrame, section_links: DataFrame, content_links: DataFrame, docs: DataFrame, sections: DataFrame, link_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of all three sources, link types that aren't registered yet)."""
    edges = doc_edges(doc_links, docs).unionByName(section_edges(section_links, docs, sections)).unionByName(raw_edges(content_links)).select(EDGE)
    new = edges.select(F.col("link_type").alias("code")).filter("code is not null").distinct().join(link_types.select("code").distinct(), "code", "left_anti")
    return edges, new.withColumn("description", F.lit("auto-imported from doc_doc_links"))


def one_of(df: DataFrame, key: list[str], order: list, last: bool = False) -> DataFrame:
    """First (or last) row of each key by an explicit order."""
    cols = [F.desc(c) if isinstance(c, str) else c for c in order] if last else order
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*cols))).filter("__n = 1").drop("__n")


def dependencies(links: DataFrame) -> DataFrame:
    """(from_doc, to_doc, required) rows -> one row per pair without self links; requires beats relates_to."""
    pairs = links.filter("from_doc is not null and to_doc is not null and from_doc <> to_doc").groupBy("from_doc", "to_doc").agg(F.max("required").alias("r"))
    return pairs.select("from_doc", "to_doc", F.when(F.col("r") == 1, "requires").otherwise("relates_to").alias("dependency_type"))


def migrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (id, kind, uid) with node_uid, or the reason why there is none.

    Of several reasons the first counts: raw reference, unsupported kind, missing uid, missing node.
    """
    x = edges.join(nodes.select("kind", "uid", "node_uid"), ["kind", "uid"], "left")
    reason = F.when(F.col("uid").startswith("section::"), "raw_section_ref").when(~F.col("kind").isin("doc", "section"), "unsupported_kind").when(F.col("uid").isNull(), "missing_uid").when(F.col("node_uid").isNull(), "missing_map")
    return x.select("id", F.when(reason.isNull(), F.col("node_uid")).alias("node_uid"), reason.alias("reason"))


def contained(slugs: DataFrame, files: DataFrame, least: int = 8) -> DataFrame:
    """slug -> file: equal, else the only file that contains it, else the only file (of ``least`` letters) that it contains.

    Whatever contains a text has all its eight-letter grams, so it is looked for by the rarest of
    them alone; a gram that the other side lacks rules the text out. Shorter slugs are found by
    the files' grams of their own length.
    """
    s, f = slugs.select("slug").distinct(), files.select("file").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    of = lambda x, c: x.filter(F.length(c) >= least).select(c, F.explode(grams(F.col(c))).alias("g"))
    sg, fg = of(s, "slug"), of(f, "file")

    def inside(inner: DataFrame, c: str, outer: DataFrame) -> DataFrame:
        many = outer.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        rare = inner.join(many, "g", "left").groupBy(c).agg(F.count_if(F.col("n").isNull()).alias("none"), F.min_by("g", "n").alias("g")).filter("none = 0")
        return rare.select(c, "g").join(outer, "g").select("slug", "file")

    parts = F.expr(f"array_distinct(flatten(transform(sequence(1, {least - 1}), n -> transform(sequence(1, greatest(length(file) - n + 1, 1)), i -> substring(file, i, n)))))")
    short = s.filter(F.length("slug") < least).join(f.select("file", F.explode(parts).alias("slug")), "slug").select("slug", "file")
    pairs = inside(sg, "slug", fg).unionByName(inside(fg, "file", sg)).unionByName(short).distinct()
    pairs = pairs.withColumn("tier", F.when(F.col("slug") == F.col("file"), 1).when(F.expr("contains(file, slug)"), 2).when(F.expr("contains(slug, file)") & (F.length("file") >= least), 3)).filter("tier is not null")
    tiers = pairs.groupBy("slug", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).filter("n = 1")
    best = tiers.groupBy("slug").agg(F.min(F.struct("tier", "file")).alias("b"))
    return s.join(best, "slug", "left").select("slug", F.col("b.file").alias("file"), F.col("b.tier").alias("tier"))


def structured(refs: DataFrame) -> DataFrame:
    """Links of which an end is given by title and section, by id."""
    like = lambda c: F.col(c).ilike("document::%::section::%")
    return refs.filter(like("from_ref") | like("to_ref")).select("id")


def first_section(links: DataFrame, sections: DataFrame, default: int = 0) -> DataFrame:
    """id, uid: the first section of a link's context document, else ``default``."""
    first = sections.groupBy(F.col("doc_uid").alias("context_doc_uid")).agg(F.min("section_uid").alias("first"))
    return links.select("id", "context_doc_uid").join(first, "context_doc_uid", "left").select("id", F.coalesce("first", F.lit(default)).alias("uid"))
