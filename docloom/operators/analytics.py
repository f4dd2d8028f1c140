"""Coverage, counts and ratios over mappings, documents, links and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T


def live(docs: DataFrame) -> DataFrame:
    return docs.filter("path is not null and path <> '' and path <> 'ORPHAN'")


def ghosts(docs: DataFrame) -> DataFrame:
    return docs.filter("path is null")


def coverage_by_standard(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("standard_code").agg(F.countDistinct("doc_path").alias("n_docs"))


def count_by_reason(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("match_reason").agg(F.count(F.lit(1)).alias("n"))


def below(mapping: DataFrame, least: int) -> DataFrame:
    """Mapped standards with fewer than ``least`` documents; standards without rows never appear."""
    return coverage_by_standard(mapping).filter(F.col("n_docs") < least)


def totals(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: documents, mapped paths, the rest (negative if mappings have paths that documents lack), share in percent."""
    d, m = live(docs).agg(F.count(F.lit(1)).alias("total")), mapping.agg(F.countDistinct("doc_path").alias("mapped"))
    return d.crossJoin(m).select("total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"), F.when(F.col("total") > 0, F.col("mapped") * 100.0 / F.col("total")).otherwise(0.0).alias("pct"))


def standard_summary(mapping: DataFrame, code: str, edges: tuple[float, float] = (0.5, 0.7)) -> DataFrame:
    """A row of one standard: its mappings, those at or above two confidences, those without one, and the first share in percent. No row if unknown."""
    m = mapping.filter(F.col("standard_code") == code).groupBy("standard_code")
    x = m.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("confidence") >= e).alias(n) for e, n in zip(edges, ("sure", "very_sure"), strict=True)), F.count_if(F.col("confidence").isNull()).alias("unknown"))
    return x.withColumn("pct", F.bround(F.col("sure") * 100.0 / F.col("total"), 1))


def mapping_statistics(mapping: DataFrame, threshold: float, audited: tuple[str, ...]) -> DataFrame:
    """kind (total, reason, tier, pending), value, n."""
    total = mapping.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value"), "n")
    reasons = mapping.groupBy(F.col("match_reason").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "value", "n")
    by_tier = tiers(mapping).select(F.lit("tier").alias("kind"), F.col("tier").alias("value"), "n")
    wait = pending(mapping, threshold, audited).agg(F.count(F.lit(1)).alias("n")).select(F.lit("pending").alias("kind"), F.lit(None).cast("string").alias("value"), "n")
    return total.unionByName(reasons).unionByName(by_tier).unionByName(wait)


def not_in(df: DataFrame, column: str, other: DataFrame) -> DataFrame:
    """Rows whose value isn't in the first column of other, as SQL's NOT IN: none at all if that has a null, and none with a null."""
    return df.sparkSession.sql(f"SELECT * FROM {{a}} WHERE `{column}` NOT IN (SELECT `{other.columns[0]}` FROM {{b}})", a=df, b=other)


def health_report(docs: DataFrame, mapping: DataFrame, least: int = 5, most: int = 10) -> str:
    """The state of the library as Markdown: totals, most mapped standards, reasons, standards below ``least``, unmapped categories."""
    t, n = totals(docs, mapping).first(), mapping.count()
    cov = coverage_by_standard(mapping)
    top_, few = cov.orderBy(F.desc("n_docs"), "standard_code").limit(most).collect(), below(mapping, least).orderBy("n_docs", "standard_code").limit(most).collect()
    reasons = count_by_reason(mapping).orderBy(F.desc("n"), "match_reason").collect()
    cats = unmapped_by_category(docs, mapping).orderBy(F.desc("n"), "category").limit(most).collect()
    table = lambda head, rows: "\n".join([f"| {' | '.join(head)} |", "|" + "-|" * len(head), *(f"| {' | '.join(str(v) for v in r)} |" for r in rows)])
    parts = [
        "# Health of the library",
        "## Summary\n\n" + table(("Metric", "Value"), [("Documents", t.total), ("Mapped", f"{t.mapped} ({t.pct:.1f}%)"), ("Unmapped", t.unmapped), ("Mappings", n), ("Standards", cov.count())]),
        "## Standards\n\n" + table(("Standard", "Documents"), [(r.standard_code, r.n_docs) for r in top_]),
        "## Reasons\n\n" + table(("Reason", "Mappings"), [(r.match_reason or "(none)", r.n) for r in reasons]),
    ]
    parts += [f"## Below {least} documents\n\n" + table(("Standard", "Documents"), [(r.standard_code, r.n_docs) for r in few])] if few else []
    parts += ["## Unmapped categories\n\n" + table(("Category", "Documents"), [(r.category, r.n) for r in cats])] if cats else []
    return "\n\n".join(parts) + "\n"


def tiers(mapping: DataFrame) -> DataFrame:
    """Mappings by confidence tier; the edges 0.4 and 0.8 are our own."""
    c = F.col("confidence")
    tier = F.when(c.isNull(), "none").when(c >= 0.8, "high").when(c >= 0.4, "medium").otherwise("low")
    return mapping.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def pending(mapping: DataFrame, threshold: float, audited: tuple[str, ...]) -> DataFrame:
    return mapping.filter((F.col("confidence") < threshold) & ~F.col("match_reason").isin(*audited))


def unmapped_by_category(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    rest = live(docs).join(mapping.select(F.col("doc_path").alias("path")).distinct(), "path", "left_anti")
    return rest.groupBy(T.category_of(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def family_coverage(mapping: DataFrame, standards: DataFrame, like: str, least: float) -> DataFrame:
    """Confident mappings of a family of standards against its standards, in percent (may exceed 100)."""
    fam = standards.filter(F.col("standard_code").ilike(like))
    n = fam.agg(F.count(F.lit(1)).alias("standards"))
    m = mapping.join(fam.select("standard_code").distinct(), "standard_code", "left_semi").filter(F.col("confidence") >= least).agg(F.countDistinct("doc_path", "standard_code").alias("mapped"))
    return n.crossJoin(m).select("standards", "mapped", F.when(F.col("standards") > 0, F.col("mapped") * 100.0 / F.col("standards")).otherwise(0.0).alias("pct"))


def histogram(df: DataFrame, column: str, what: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("kind"), "status", "n")


def resolution(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: links, links with a resolved row, missing, ratio (0.0 without links), pass (at least 0.999)."""
    hit = links.join(resolved.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("resolved"))
    both = links.agg(F.count(F.lit(1)).alias("total")).crossJoin(hit)
    ratio = F.when(F.col("total") > 0, F.col("resolved") / F.col("total")).otherwise(0.0)
    return both.select("total", "resolved", F.greatest(F.col("total") - F.col("resolved"), F.lit(0)).alias("missing"), ratio.alias("ratio"), (ratio >= 0.999).alias("pass"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.substring("changed_at", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def search_log(log: DataFrame, path: str | None = None, since: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Conditions are joined by AND; the path is a substring, ASCII letters of any case; newest first."""
    if path:
        log = log.filter(F.col("template_path").ilike(f"%{path}%"))
    if since:
        log = log.filter(F.col("changed_at") >= since)
    if kind:
        log = log.filter(F.col("change_type") == kind)
    log = log.orderBy(F.desc("changed_at"), "id")
    return log.limit(limit) if limit else log


def duplicates(df: DataFrame, text: str, key: str) -> DataFrame:
    """Hash, size and smallest key of texts that occur more than once."""
    return df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def collisions(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once; nulls are one key.

    Keys are counted in each task before they are shuffled, and rows find theirs by a semi join that may be split where a key is hot.
    """
    many = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__key")
    return df.join(many, F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def longest_tag(df: DataFrame, code: str, tag: str) -> DataFrame:
    """Per code the sum of counts and the longest tag (the first in order on ties)."""
    g = df.groupBy(code, tag).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(code).agg(F.sum("n").alias("n"), F.min(F.struct((-F.length(tag)).alias("l"), F.col(tag).alias("t"))).alias("b")).select(code, "n", F.col("b.t").alias("tag"))


def cap_violations(df: DataFrame, key: list[str], cap: int) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)


# Lookups and filters by name -------------------------------------------------------------------


def confident(mapping: DataFrame, code: str, least: float) -> DataFrame:
    """Mappings of a standard from a confidence on; unknown confidences don't count."""
    return mapping.filter((F.col("confidence") >= least) & (F.col("standard_code") == code))


def count_of(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows of each of some values."""
    return df.filter(F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def blank(column: str):
    """Whether a text is null or has nothing but blanks."""
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def without_rationale(links: DataFrame) -> DataFrame:
    """Links that don't say why, by id."""
    return links.filter(blank("rationale")).select("id")


def required_without_rationale(links: DataFrame, by: str = "context_doc_uid") -> DataFrame:
    """How many required links of each document don't say why."""
    return links.filter((F.col("required") == 1) & blank("rationale")).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def out_of_range(edges: DataFrame, low: float, high: float) -> DataFrame:
    """How many edges have a weight outside a range; unknown weights aren't."""
    return edges.agg(F.count_if((F.col("weight") < low) | (F.col("weight") > high)).alias("n"))


def bad_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of rows whose text is there and isn't JSON."""
    return df.filter(F.expr(f"`{column}` IS NOT NULL AND try_parse_json(`{column}`) IS NULL")).select(key)


def mapped_by_origin(mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """Mappings by the origin of their document and by standard; those without a document don't count.

    Mappings are counted by path and standard before they meet the documents.
    """
    m = mapping.groupBy(F.col("doc_path").alias("path"), "standard_code").agg(F.count(F.lit(1)).alias("m"))
    return m.join(docs.select("path", "origin"), "path").groupBy("origin", "standard_code").agg(F.sum("m").alias("n"))


def orphans(mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """Paths that are mapped and no document has."""
    return mapping.select("doc_path").distinct().join(docs.filter("path is not null").select(F.col("path").alias("doc_path")), "doc_path", "left_anti")


def find(mapping: DataFrame, docs: DataFrame, standards: DataFrame, text: str) -> DataFrame:
    """Documents mapped to known standards whose code has the text, ASCII letters of any case: doc_path, title, standard_code, n."""
    m = mapping.filter(F.col("standard_code").ilike(f"%{text}%")).groupBy("doc_path", "standard_code").agg(F.count(F.lit(1)).alias("m"))
    x = m.join(docs.select(F.col("path").alias("doc_path"), "title"), "doc_path").join(standards.select("standard_code"), "standard_code")
    return x.groupBy("doc_path", "title", "standard_code").agg(F.sum("m").alias("n"))


def first_of_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct values of ``order`` for each ``by``, with their place."""
    return df.select(by, order).distinct().withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("n") <= n)
