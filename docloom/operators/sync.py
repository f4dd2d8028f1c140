"""Files against tables: an index of files by title, documents matched to it, ghosts found and mended, and what a change affects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import unicode as U

from .links import contained

#: Origins by the source of a path.
ORIGINS = ("core", "imported_template", "imported_other")


def file_index(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """manifest (path, hash_sha256_v2) and texts (path, text) -> path, title, title_norm, source, hash_sha256_v2 of the files that are there."""
    title = T.title_of_text(F.col("text"))
    x = manifest.join(texts, "path").withColumn("title", title)
    return x.select("path", "title", T.title_norm_plain(F.col("title")).alias("title_norm"), T.source_of(F.col("path")).alias("source"), "hash_sha256_v2").withColumn("title_norm", F.when(F.col("title").isNotNull(), F.col("title_norm")))


def title_collisions(index: DataFrame) -> DataFrame:
    """Files of titles that several files have."""
    many = index.filter("title_norm is not null").groupBy("title_norm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("title_norm")
    return index.join(many, "title_norm", "left_semi").select(index.columns)


def match_documents(documents: DataFrame, index: DataFrame) -> DataFrame:
    """documents (id, title) -> id, title_norm, path, origin, method (title_norm, ambiguous, missing), confidence, notes.

    A title that several files have is ambiguous and gets no path. The index is aggregated by title first.
    """
    by_title = index.filter("title_norm is not null").groupBy("title_norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "source")).alias("f"))
    x = documents.select("id", T.title_norm_plain(F.col("title")).alias("title_norm")).join(by_title, "title_norm", "left")
    one = F.col("n") == 1
    origin = F.when(one & F.col("f.source").isin(*ORIGINS), F.col("f.source")).otherwise("unknown")
    method = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("title_norm")
    notes = F.when(F.col("n").isNull(), "no match in file_index").when(F.col("n") > 1, "title_norm collision in file_index")
    return x.select("id", "title_norm", F.when(one, F.col("f.path")).alias("path"), origin.alias("origin"), method.alias("method"), F.when(one, 1.0).otherwise(0.0).alias("confidence"), notes.alias("notes"))


def missing_on_disk(paths: list[DataFrame], files: DataFrame) -> DataFrame:
    """Paths that tables name and no file has. Tables that aren't there are left out by the caller; none gives nothing."""
    named = None
    for p in paths:
        one = p.select(F.col(p.columns[0]).alias("path")).filter("path is not null and path <> '' and path <> 'ORPHAN'")
        named = one if named is None else named.unionByName(one)
    return files.select("path").limit(0) if named is None else named.distinct().join(files.select("path").distinct(), "path", "left_anti")


def slug_map(files: DataFrame) -> DataFrame:
    """path -> slug of the file's stem; of equal slugs the last path counts."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.md$", "")
    return files.groupBy(U.snake_slug(stem).alias("slug")).agg(F.max("path").alias("path")).filter("slug <> ''")


def mend_ghosts(docs: DataFrame, files: DataFrame) -> DataFrame:
    """docs without a path get that of the file whose slug their title matches, else ORPHAN; other rows stay. -> doc_uid, path, mended."""
    ghosts = docs.filter("path is null").select("doc_uid", U.snake_slug(F.col("title")).alias("slug"))
    known = slug_map(files)
    match = contained(ghosts.filter("slug <> ''").select("slug"), known.select(F.col("slug").alias("file")))
    match = match.join(known.select(F.col("slug").alias("file"), "path"), "file").select("slug", F.concat(F.lit("core/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("path"))
    mended = ghosts.join(match, "slug", "left").select("doc_uid", F.coalesce("path", F.lit("ORPHAN")).alias("path"), F.lit(True).alias("mended"))
    return mended.unionByName(docs.filter("path is not null").select("doc_uid", "path", F.lit(False).alias("mended")))


def targets(docs: DataFrame, title: str | None = None, glob: str | None = None) -> DataFrame:
    """Documents with a path, by a part of the title (any case) and a glob over the whole path."""
    x = docs.filter("path is not null")
    if title:
        x = x.filter(F.lower("title").contains(title.lower()))
    if glob:
        x = x.filter(F.col("path").rlike(glob_pattern(glob)))
    return x


def glob_pattern(glob: str) -> str:
    """A glob of ``*``, ``?`` and ``[...]`` as a regular expression for whole paths."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner, i = glob[i:end], end + 1
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
        else:
            out += "\\" + c if not c.isalnum() else c
    return rf"(?s)\A{out}\z"


def affected(code: str, text: str, names: DataFrame, mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """What a standard or regulation affects: every code that contains ``text`` (any case) -> code, name, doc_path, title, match_reason.

    names (code, name), mapping (code, doc_path, match_reason). No rows means unknown.
    """
    m = mapping.select(F.col(code).alias("code"), "doc_path", "match_reason").filter(F.lower("code").contains(text.lower()))
    n = names.select(F.col(code).alias("code"), F.col(names.columns[1]).alias("name"))
    return m.join(n, "code", "left").join(docs.select(F.col("path").alias("doc_path"), "title"), "doc_path", "left").select("code", "name", "doc_path", "title", "match_reason")


def affected_by_section(text: str, sections: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents with a section whose heading contains ``text``, and how many links name it: path, heading, n_links."""
    low = F.lit(text.lower())
    n = links.agg(F.count_if(F.lower("to_ref").contains(low)).alias("n_links"))
    hit = sections.filter(F.lower("heading").contains(low)).join(docs.select("doc_uid", "path"), "doc_uid").select("path", "heading")
    return hit.crossJoin(F.broadcast(n))  # one row


def affected_by_document(text: str, docs: DataFrame, sections: DataFrame, mapping: DataFrame, links: DataFrame) -> DataFrame:
    """Documents whose title contains ``text``: links that name the title and links from the document, standards, headings.

    Incoming links are found by the titles of references, so no reference meets more than the documents it names.
    """
    d = docs.filter(F.lower("title").contains(text.lower())).select("doc_uid", "title", "path")
    named = F.regexp_extract("to_ref", r"(?i)^document::(.+?)(?:::.*)?$", 1)
    coming = links.select(F.trim(F.lower(named)).alias("t")).filter("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("incoming_links"))
    going = links.groupBy(F.col("from_ref").alias("doc_uid")).agg(F.count(F.lit(1)).alias("outgoing_links"))
    codes = mapping.groupBy(F.col("doc_path").alias("path")).agg(F.array_sort(F.collect_set("standard_code")).alias("standards"))
    heads = sections.groupBy("doc_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "heading"))), lambda x: x["heading"]).alias("sections"))
    x = d.withColumn("t", F.trim(F.lower("title"))).join(coming, "t", "left").join(going, "doc_uid", "left").join(codes, "path", "left").join(heads, "doc_uid", "left")
    none = F.array().cast("array<string>")
    return x.select("doc_uid", "title", "path", F.coalesce("incoming_links", F.lit(0)).alias("incoming_links"), F.coalesce("outgoing_links", F.lit(0)).alias("outgoing_links"), F.coalesce("standards", none).alias("standards"), F.coalesce("sections", none).alias("sections"))
