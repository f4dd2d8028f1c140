"""Contracts, schema profiles, checks and the answers behind service endpoints, as DataFrames."""

from __future__ import annotations

import base64
import hmac
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

from . import analytics

#: The tables that a profile needs.
PROFILES = {
    "legacy-runtime": ("docs", "sections", "standards", "compliance_regulations", "content_links", "content_links_resolved", "rhythm_edges", "contracts", "flags", "_schema_version"),
    "current-snapshot": ("documents_current", "documents_snapshot", "anomalies_current", "document_tags_current", "snapshots", "current_build", "runs"),
}
LEAST_LIMIT, MOST_LIMIT, LIMIT = 1, 500, 50


class SchemaError(RuntimeError):
    """A table that is needed isn't there."""


class QueryError(LookupError):
    """What was asked for isn't there."""


def tables(spark: SparkSession, database: str | None = None) -> set[str]:
    return {t.name for t in spark.catalog.listTables(database)}


def missing(there: set[str], profile: str) -> list[str]:
    return sorted(set(PROFILES.get(profile, ())) - there)


def detect(there: set[str]) -> tuple[str, list[str]]:
    """The first profile whose tables are all there, else unknown with what the nearest one lacks."""
    lacks = {p: missing(there, p) for p in PROFILES}
    return next(((p, []) for p, m in lacks.items() if not m), ("unknown", min(lacks.values(), key=len)))


def require(there: set[str], profile: str) -> None:
    got, lacks = detect(there)
    if profile not in ("unknown", got):
        raise RuntimeError(f"expected profile {profile}, found {got}; missing: {lacks}")


def has_tables(there: set[str], names: set[str]) -> bool:
    return names <= there


def validate(spark: SparkSession, profile: str = "legacy-runtime", on_error: Callable[[str], None] | None = None) -> list[str]:
    """What is wrong with a profile's tables: another profile, or else every empty one (told by its first row)."""
    got, lacks = detect(tables(spark))
    errors = [f"expected profile {profile}, found {got}; missing: {lacks}"] if got != profile else [f"empty table: {t}" for t in sorted(PROFILES[profile]) if spark.table(t).isEmpty()]
    for e in errors if on_error else ():
        on_error(e)
    return errors


def link_resolution(spark: SparkSession) -> DataFrame:
    """Links, resolved ones and their ratio from the tables of that name; without the tables an error."""
    lacks = sorted({"content_links", "content_links_resolved"} - tables(spark))
    if lacks:
        raise SchemaError(f"no tables {', '.join(lacks)}")
    links = spark.table("content_links").select("id")
    return analytics.resolution(links, spark.table("content_links_resolved").select(F.col("content_link_id").alias("id")))


def coverage(mapping: DataFrame, code: str) -> DataFrame:
    """The summary of a standard; an unknown one is an error."""
    x = analytics.standard_summary(mapping, code)
    if x.isEmpty():
        raise QueryError(f"no standard {code}")
    return x


def violations(found: DataFrame | None, spark: SparkSession, severity: str | None = None) -> DataFrame:
    """Violations by severity and path; none if there is no such table."""
    if found is None:
        return spark.createDataFrame([], "path string, violation_type string, severity string")
    x = found if severity is None else found.filter(F.col("severity") == severity.upper())
    return x.orderBy("severity", "path", "violation_type")


def health(spark: SparkSession) -> dict[str, object]:
    """Whether the session answers, and how many tables there are."""
    return {"status": "ok" if spark.range(1).count() == 1 else "failed", "tables": len(tables(spark))}


def allowed(token: str | None, secret: str | None) -> None:
    """Reviews need the token; without a secret none are taken."""
    if not secret or not hmac.compare_digest((token or "").encode(), secret.encode()):
        raise PermissionError("token missing or wrong")


def doctor(spark: SparkSession, profiles: dict[str, str | None], paths: dict[str, str], policy: dict | None = None) -> DataFrame:
    """check, status, note: the profile of each database, whether each path is there, and that the policy's scripts are.

    ``profiles``: profile by check's name and database (null: the current one); ``policy`` is the
    parsed policy, whose ``commands`` are lists of words.
    """
    rows = []
    for database, profile in profiles.items():
        got, lacks = detect(tables(spark, None if database == "current" else database))
        rows.append((database, "OK" if got == profile else "FAIL", got if got == profile else "missing: " + ", ".join(missing(tables(spark, None if database == "current" else database), profile) or lacks)))
    scripts = {f"policy: {w}": w for words in (policy or {}).get("commands", {}).values() for w in words if w.endswith(".py")}
    jvm = spark.sparkContext._jvm
    for name, path in sorted({**paths, **scripts}.items()):
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        rows.append((name, "OK" if there else "FAIL", path if there else f"missing: {path}"))
    return spark.createDataFrame(rows, "check string, status string, note string")


def exit_code(checks: DataFrame, strict: bool) -> int:
    return int(strict and not checks.filter("status = 'FAIL'").isEmpty())


def contract(contracts: DataFrame, uid: str) -> DataFrame:
    """scope_uid, version and the lists of a contract; an unknown one is an error."""
    own = contracts.filter(F.col("scope_uid") == uid)
    if own.isEmpty():
        raise QueryError(f"no contract of {uid}")
    return own.select("scope_uid", "version", *(T.json_list(c).alias(c[:-5]) for c in ("inputs_json", "outputs_json", "gates_json", "impact_json") if c in contracts.columns))


def templates_of(mapping: DataFrame, standard: str | None = None, least: float = 0.0) -> DataFrame:
    x = mapping.filter(F.col("confidence") >= least)
    return x.filter(F.col("standard_code") == standard) if standard is not None else x


def templates(mapping: DataFrame, standard: str | None = None, least: float = 0.0, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    """A page of mapped documents by confidence; ties by the other columns."""
    if not LEAST_LIMIT <= limit <= MOST_LIMIT or offset < 0:
        raise ValueError(f"limit must be {LEAST_LIMIT} to {MOST_LIMIT}, offset 0 or more")
    x = templates_of(mapping, standard, least)
    return x.orderBy(F.desc("confidence"), "doc_path", "standard_code", "match_reason").offset(offset).limit(limit)


#: How pages of mapped documents are ordered: columns, and whether the greatest come first (nulls last) or the least (nulls first).
BY_CONFIDENCE = (("confidence", True), ("doc_path", False), ("standard_code", False), ("match_reason", False))


def page_after(df: DataFrame, order: tuple[tuple[str, bool], ...], limit: int = LIMIT, after: str | None = None) -> tuple[list[Row], str | None]:
    """A page of at most ``limit`` rows and the cursor of what follows (null at the end).

    The cursor holds the order key of the last row and how many rows with that key were given, so
    rows that tie are neither lost nor repeated. A page is the top of what isn't before the cursor:
    no page is sorted through to reach the next, and the filter goes to the scan.
    """
    if not LEAST_LIMIT <= limit <= MOST_LIMIT:
        raise ValueError(f"limit must be {LEAST_LIMIT} to {MOST_LIMIT}")
    key, seen = None, 0
    if after:
        try:
            key, seen = json.loads(base64.urlsafe_b64decode(after.encode()))
            if len(key) != len(order) or seen < 1:
                raise ValueError
        except (ValueError, TypeError) as e:
            raise ValueError("bad cursor") from e
        same, later = F.lit(True), F.lit(False)
        for (c, down), v in zip(order, key, strict=True):
            at = F.lit(v).cast(df.schema[c].dataType)
            beyond = (F.col(c).isNotNull() if v is None else F.col(c) > at) if not down else (F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < at))
            later |= same & beyond
            same &= F.col(c).isNull() if v is None else F.coalesce(F.col(c) == at, F.lit(False))
        df = df.filter(later | same)
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    rows = df.orderBy(*by).limit(seen + limit + 1).collect()[seen:]
    more, rows = len(rows) > limit, rows[:limit]
    if not more:
        return rows, None
    last = [rows[-1][c] for c, _ in order]
    given = sum([r[c] for c, _ in order] == last for r in rows)
    return rows, base64.urlsafe_b64encode(json.dumps([last, given + (seen if last == key else 0)], default=str).encode()).decode()


def mappings_of(mapping: DataFrame, path: str) -> DataFrame:
    return mapping.filter(F.col("doc_path") == path).orderBy("standard_code", "match_reason")


def review(mapping: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """mapping after decisions (key, approve boolean, confidence): rejected rows go, approved ones count as reviewed."""
    d = decisions.select(*key, F.col("approve").alias("__yes"), F.col("confidence").alias("__new"))
    x = mapping.join(d, key, "left").filter("__yes is null or __yes")
    yes = F.coalesce("__yes", F.lit(False))
    x = x.withColumns({"confidence": F.when(yes, T.approved_confidence(F.col("__new"), F.col("confidence"))).otherwise(F.col("confidence")), "match_reason": F.when(yes, "expert_reviewed").otherwise(F.col("match_reason"))})
    return x.select(mapping.columns)


def gates(checks: DataFrame, warn: float, fail: float) -> DataFrame:
    """(gate, value) -> status by two bounds."""
    return checks.withColumn("status", F.when(F.col("value") > fail, "FAIL").when(F.col("value") > warn, "WARN").otherwise("OK"))
