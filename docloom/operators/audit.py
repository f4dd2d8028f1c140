"""Audits of the mappings: lists by filters, statistics that bear missing tables, coverage of a catalogue, gates for continuous checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analytics, guidance

#: Coverage in percent that a continuous check asks for, and what a review may set.
LEAST_COVERAGE = 5.0
CONFIDENCES = ("exact", "high", "medium", "low")


def by_standard(mapping: DataFrame, standard: str | None = None, reason: str | None = None, limit: int = 50) -> DataFrame:
    """Mappings whose standard contains a text (any case of ASCII), with one reason; in order, at most ``limit``."""
    x = mapping if standard is None else mapping.filter(F.col("standard_code").ilike(f"%{standard}%"))
    x = x if reason is None else x.filter(F.col("match_reason") == reason)
    return x.orderBy("standard_code", "doc_path", "match_reason").limit(limit)


def listed(mapping: DataFrame, regulations: DataFrame, standard: str | None = None, regulation: str | None = None, reason: str | None = None) -> DataFrame:
    """Mappings of one standard, of documents under one regulation, with one reason."""
    x = mapping if standard is None else mapping.filter(F.col("standard_code") == standard)
    if regulation is not None:
        x = x.join(regulations.filter(F.col("regulation_code") == regulation).select("doc_path").distinct(), "doc_path", "left_semi").select(mapping.columns)
    return x if reason is None else x.filter(F.col("match_reason") == reason)


def unresolved(links: DataFrame, resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document with the number of links of the whole library that aren't resolved (0 at least)."""
    n = links.agg(F.count(F.lit(1)).alias("a")).crossJoin(resolved.agg(F.countDistinct("id").alias("b"))).select(F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("unresolved"))
    return docs.select("doc_uid").crossJoin(F.broadcast(n))  # one row


def table_or_none(spark: SparkSession, name: str, on_error: Callable[[str], None] | None = None) -> DataFrame | None:
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if on_error:
        on_error(f"no table {name}")
    return None


def statistics(mapping: DataFrame | None, violations: DataFrame | None) -> DataFrame:
    """One row: mappings, those without confidence, violations by severity; 0 where a table isn't there."""
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    some = next((x for x in (mapping, violations) if x is not None), None)
    if some is None:
        return SparkSession.active().range(1).select(*zero("total_mappings", "null_confidence", "error_violations", "warning_violations"))
    m = some.limit(0).agg(*zero("total_mappings", "null_confidence")) if mapping is None else mapping.agg(F.count(F.lit(1)).alias("total_mappings"), F.count_if(F.col("confidence").isNull()).alias("null_confidence"))
    v = some.limit(0).agg(*zero("error_violations", "warning_violations")) if violations is None else violations.agg(F.count_if(F.col("severity") == "ERROR").alias("error_violations"), F.count_if(F.col("severity") == "WARNING").alias("warning_violations"))
    return m.crossJoin(v)


def gap_summary(catalogue: DataFrame, gaps: DataFrame) -> DataFrame:
    """catalogue (standard_code, doc_title), gaps (standard_code, status, is_required, confidence) -> one row a standard.

    entries, present, missing_required, missing_recommended, low_confidence, coverage in percent (0 without
    entries) and status: OK without gaps, else GAPS.
    """
    c = catalogue.groupBy("standard_code").agg(F.count(F.lit(1)).alias("entries"))
    gone = F.col("status") == "missing"
    g = gaps.groupBy("standard_code").agg(
        F.count_if(F.col("status") == "present").alias("present"), F.count_if(gone & (F.col("is_required") == 1)).alias("missing_required"),
        F.count_if(gone & (F.coalesce("is_required", F.lit(0)) != 1)).alias("missing_recommended"), F.count_if((F.col("status") == "present") & (F.col("confidence") == "low")).alias("low_confidence"),
    )
    names = ("present", "missing_required", "missing_recommended", "low_confidence")
    x = c.join(g, "standard_code", "full").select("standard_code", F.coalesce("entries", F.lit(0)).alias("entries"), *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    status = F.when(F.col("missing_required") + F.col("missing_recommended") == 0, "OK").otherwise("GAPS")
    return x.select("*", F.when(F.col("entries") > 0, F.bround(F.col("present") * 100.0 / F.col("entries"), 1)).otherwise(0.0).alias("coverage"), status.alias("status"))


def unmapped(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents on disk that no standard has."""
    return docs.filter("path is not null and path <> 'ORPHAN'").join(mapping.select(F.col("doc_path").alias("path")).distinct(), "path", "left_anti").select("path", "title")


def report(summary: DataFrame, gaps: DataFrame, extra: DataFrame, most: int = 50) -> str:
    """The audit as Markdown: coverage, what is missing, further documents (``most`` of each at most, and the whole number), low confidence, standards."""
    total = summary.agg(F.sum("entries").alias("e"), F.sum("present").alias("p")).first()
    share = f"{100 * total.p / total.e:.1f}%" if total.e else "0%"

    def some(df: DataFrame, order: list[str], line) -> list[str]:
        n, rows = df.count(), df.orderBy(*order).limit(most).collect()
        return [line(r) for r in rows] + [f"Total: {n}"]

    gone = gaps.filter("status = 'missing'")
    low = gaps.filter("status = 'present' and confidence = 'low'")
    parts = [
        ("## 1. Coverage", [f"{share} ({total.p or 0} of {total.e or 0})"]),
        ("## 2. Missing templates", some(gone, ["standard_code", "doc_title"], lambda r: f"- {'REQUIRED' if r.is_required == 1 else 'recommended'}: {r.standard_code}: {r.doc_title}")),
        ("## 3. Documents without a standard", some(extra, ["path"], lambda r: f"- {r.title} ({r.path})")),
        ("## 4. Low confidence", some(low, ["standard_code", "doc_title"], lambda r: f"- {r.standard_code}: {r.doc_title}")),
        ("## 5. Standards", some(summary, ["standard_code"], lambda r: f"- {r.standard_code}: {r.coverage}% {r.status}")),
    ]
    return "\n\n".join(f"{head}\n\n" + "\n".join(lines) for head, lines in parts) + "\n"


def continuous(stats: DataFrame, mapping: DataFrame, standards: DataFrame, like: str = "%27001%", least: float = LEAST_COVERAGE) -> DataFrame:
    """gate, value, ok: no violations of severity ERROR, and the coverage of a family of standards by mappings of 0.5 or more, in percent."""
    share = analytics.family_coverage(mapping, standards, like, 0.5).select(F.lit(f"coverage {like}").alias("gate"), F.col("pct").cast("double").alias("value"))
    errors = stats.select(F.lit("error violations").alias("gate"), F.col("error_violations").cast("double").alias("value"))
    return errors.withColumn("ok", F.col("value") == 0).unionByName(share.withColumn("ok", F.col("value") >= least))


def backfill(mapping: DataFrame, standards: DataFrame, guided: DataFrame) -> DataFrame:
    """The mappings with confidence and evidence where there was no confidence; ``filled`` tells which."""
    key = ["doc_path", "standard_code"]
    todo = mapping.filter("confidence is null").select(*key).distinct()
    new = guidance.mapping_confidence(todo, standards, guided).select(*key, F.col("confidence").alias("__new"), F.col("evidence").alias("__why"))
    x = mapping.join(new, key, "left").withColumn("filled", F.col("confidence").isNull() & F.col("__new").isNotNull())
    return x.withColumns({"evidence": F.when(F.col("filled"), F.col("__why")), "confidence": F.coalesce("confidence", "__new")}).drop("__new", "__why")


def flow_summary(**tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows per value of one column of each table: table, value, n."""
    out = None
    for name, (df, column) in tables.items():
        x = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "value", "n")
        out = x if out is None else out.unionByName(x)
    return out
