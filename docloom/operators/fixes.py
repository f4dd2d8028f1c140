"""Rules over Markdown documents: findings, plans, and their application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import files, sinks, versions

from .templates import REQUIRED

#: Rules (id, severity, may be applied without review, action), and what a missing section is filled with.
RULES = (
    ("DOC.SECTION.MISSING", "ERROR", True, "insert_section"),
    ("DOC.EMOJI.FORBIDDEN", "WARNING", True, "strip_emoji"),
    ("DOC.FRONTMATTER.MISSING", "ERROR", False, "report_only"),
    ("DOC.FRONTMATTER.NO_TITLE", "WARNING", False, "report_only"),
)
PARSE_ERROR = ("DOC.PARSE.ERROR", "ERROR", False, "report_only")
PLACEHOLDERS = {
    "## Cel dokumentu": "<!-- TODO: Opisz cel dokumentu -->\n",
    "## Zakres i granice": "<!-- TODO: Opisz zakres i granice -->\n",
    "## Wejścia i wyjścia": "<!-- TODO: Opisz wejścia i wyjścia -->\n",
}
OTHER_PLACEHOLDER = "<!-- TODO -->\n"
MODES = ("analyze", "dry-run", "apply")
EMOJI = T.emoji("rules")
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, severity string, safe boolean, action string")


def findings(docs: DataFrame) -> DataFrame:
    """path, seq, rule_id, severity, action, section, safe: front matter first, then missing sections, then emoji. A null text can't be parsed."""
    t = F.col("text")
    front = t.rlike(FRONT)
    titled = F.regexp_extract(t, FRONT, 1).rlike(r"(?m)^\s*title\s*:")
    body = F.regexp_replace(t, FRONT, "")
    known = {r[0]: r for r in (*RULES, PARSE_ERROR)}

    def row(rule: str, section: str | None = None) -> Column:
        name, severity, safe, action = known[rule]
        return F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), F.lit(section).cast("string").alias("section"), F.lit(safe).alias("safe"))

    found = [F.when(t.isNull(), row("DOC.PARSE.ERROR")), F.when(~front, row("DOC.FRONTMATTER.MISSING")), F.when(front & ~titled, row("DOC.FRONTMATTER.NO_TITLE"))]
    found += [F.when(~body.rlike(rf"(?m)^\Q{h}\E\s*$"), row("DOC.SECTION.MISSING", h)) for h in REQUIRED]
    found.append(F.when(t.rlike(EMOJI), row("DOC.EMOJI.FORBIDDEN")))
    x = docs.select("path", F.posexplode(F.array_compact(F.array(*found))).alias("seq", "f"))
    return x.select("path", "seq", "f.*")


def _todo(plan: DataFrame, only_safe: bool) -> DataFrame:
    """path and its changes in order, as structs."""
    use = (F.col("action") != "report_only") & (F.col("safe") | F.lit(not only_safe))
    return plan.groupBy("path").agg(F.array_sort(F.collect_list(F.when(use, F.struct("seq", "action", "section")))).alias("todo"))


def _changed(text: str, todo: str) -> Column:
    """The text after its changes; a null text, or none to do, leaves it as it is."""
    filled = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))

    def one(text: Column, c: Column) -> Column:
        grown = F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n\n"), c["section"], F.lit("\n"), F.coalesce(filled[c["section"]], F.lit(OTHER_PLACEHOLDER)))
        return F.when(c["action"] == "insert_section", grown).when(c["action"] == "strip_emoji", F.regexp_replace(text, EMOJI, "")).otherwise(text)

    return F.when(F.size(todo) > 0, F.aggregate(todo, F.col(text), one)).otherwise(F.col(text))


def _hash(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def apply_plan(docs: DataFrame, plan: DataFrame, only_safe: bool = True) -> DataFrame:
    """The documents of a plan (path, seq, action, section, safe), each changed in order.

    path, text, new_text, hash_before, hash_after, status: changed, skipped (nothing to do,
    or no difference) or error (no such document).
    """
    x = _todo(plan, only_safe).join(docs.select("path", "text"), "path", "left").withColumn("new_text", _changed("text", "todo"))
    status = F.when(F.col("text").isNull(), "error").when(F.col("text") == F.col("new_text"), "skipped").otherwise("changed")
    return x.select("path", "text", "new_text", _hash("text").alias("hash_before"), _hash("new_text").alias("hash_after"), status.alias("status"))


def apply_safe(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """All documents after a plan's safe changes, with hashes before and after. Texts meet their changes in one join."""
    x = docs.select("path", "text").join(_todo(plan, True), "path", "left").withColumn("new_text", _changed("text", "todo"))
    return x.select("path", "text", "new_text", _hash("text").alias("hash_before"), _hash("new_text").alias("hash_after"))


#: Which changes of a plan: all, those that may be applied without review, or the others.
FILTERS = ("all", "safe", "review")
VERSION = "1.0"


def selected(plan: DataFrame, which: str = "all") -> DataFrame:
    """The changes of a plan that a filter names."""
    if which not in FILTERS:
        raise ValueError(f"filter {which!r} is none of {', '.join(FILTERS)}")
    return plan if which == "all" else plan.filter(F.col("safe") if which == "safe" else ~F.col("safe"))


def save_plan(plan: DataFrame, path: str, run_id: str, mode: str, root: str, total_files: int | None = None) -> None:
    """A plan as JSON lines: a document's changes a line, in the form in which plans are read.

    A change's details are a map, so an action with other details needs no other form. No line holds
    more than one document's changes, so a plan of any size is written by many tasks.
    """
    detail = F.map_from_entries(F.array_compact(F.array(F.when(F.col("section").isNotNull(), F.struct(F.lit("section"), F.col("section"))))))
    change = F.struct("seq", F.struct(F.col("path").alias("file"), "rule_id", "severity", "action", detail.alias("detail"), F.col("safe").alias("safe_autofix")).alias("c"))
    # Ordered by seq alone: maps can't be compared.
    own = F.transform(F.array_sort(F.collect_list(change), lambda x, y: x["seq"] - y["seq"]), lambda x: x["c"])
    rows = plan.groupBy("path").agg(own.alias("changes"))
    head = {"schema_version": VERSION, "run_id": run_id, "mode": mode, "root": root, "total_files": total_files}
    rows.select(*(F.lit(v).alias(k) for k, v in head.items()), "changes").write.mode("overwrite").json(path)


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """A saved plan, edited or not: run_id, mode, root, path, seq, rule_id, severity, action, section, safe."""
    x = files.plan(spark, path)
    return x.select("run_id", "mode", "root", F.col("file").alias("path"), "seq", "rule_id", "severity", "action", F.col("detail")["section"].alias("section"), F.coalesce("safe_autofix", F.lit(False)).alias("safe"))


def run(spark: SparkSession, root: str, mode: str, output_plan: str, run_id: str, only_safe: bool = True, target: str | None = None, backup: str | None = None, on_error: Callable[[str], None] | None = None) -> DataFrame:
    """Plan, save the plan, and by ``mode`` stop there, show diffs, or write the changed documents.

    analyze returns the plan; dry-run path and diff of each document that would change;
    apply path, hashes and status. apply writes the changed texts to ``target`` and the old ones to
    ``backup`` as versioned tables (path, text): each version appears as a whole or not at all, the
    backup first. ``on_error`` is told of documents that aren't there.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    if mode == "apply" and not (target and backup):
        raise ValueError("apply needs a target and a backup folder")
    docs = files.texts(spark, root, [".md"], [], keep_bad=True)
    save_plan(findings(docs), output_plan, run_id, mode, root, docs.select("path").count())
    plan = load_plan(spark, output_plan)
    if mode == "analyze":
        return plan
    if mode == "dry-run":
        done = apply_plan(docs, plan, True)
        return sinks.unified_diff(done.filter("status = 'changed'"), "text", "new_text", "path").select("path", "diff")
    return write_changes(docs, plan, target, backup, on_error, only_safe=only_safe)


def write_changes(docs: DataFrame, plan: DataFrame, target: str, backup: str, on_error: Callable[[str], None] | None = None, diff: str | None = None, result: str | None = None, only_safe: bool = False) -> DataFrame:
    """Apply the changes of a plan, or the safe ones: path, hash_before, hash_after, status of its documents.

    ``backup`` and then ``target`` get a new version with the old and the new texts of what changes.
    ``diff`` gets the unified diffs as text, ``result`` the returned rows as JSON lines.
    """
    spark = docs.sparkSession
    done = apply_plan(docs, plan, only_safe).persist()
    try:
        changed = done.filter("status = 'changed'")
        versions.Table(spark, backup).refresh(lambda _: changed.select("path", "text"))
        versions.Table(spark, target).refresh(lambda _: changed.select("path", F.col("new_text").alias("text")))
        out = done.select("path", "hash_before", "hash_after", "status")
        if diff:
            sinks.unified_diff(changed, "text", "new_text", "path").sortWithinPartitions("path").select("diff").write.mode("overwrite").text(diff)
        if result:
            out.write.mode("overwrite").json(result)
        if on_error:
            for r in out.filter("status = 'error'").toLocalIterator():
                on_error(f"{r.path}: not found")
    finally:
        done.unpersist()
    return out


def apply_saved(spark: SparkSession, plan: str, which: str, target: str, backup: str, on_error: Callable[[str], None] | None = None, diff: str | None = None, result: str | None = None) -> DataFrame:
    """Apply a saved plan, as it was reviewed: the changes of a filter, to the documents below the plan's root."""
    todo = load_plan(spark, plan)
    root = todo.select("root").first()
    if root is None:
        docs = spark.createDataFrame([], "path string, text string")
    else:
        docs = files.texts(spark, root.root, [".md"], [], keep_bad=True)
    return write_changes(docs, selected(todo, which), target, backup, on_error, diff, result)


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("rule_id", "severity", "safe").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


def violations(docs: DataFrame) -> DataFrame:
    """path, violation_type, severity of the schema: front matter, title, required sections, empty sections."""
    t = F.col("text")
    front = t.startswith("---")
    head = F.regexp_extract(t, r"(?s)^---(.*?)\n---", 1)
    v = lambda k, s: F.struct(F.lit(k).alias("violation_type"), F.lit(s).alias("severity"))
    found = [F.when(~front, v("FRONTMATTER_MISSING", "ERROR")), F.when(front & ~head.rlike("(?m)^title:"), v("NO_TITLE", "WARNING"))]
    for h in REQUIRED:
        name = h.removeprefix("## ")
        found.append(F.when(~t.rlike(rf"(?m)^\Q{h}\E\s*$"), v(f"SECTION_MISSING:{name}", "ERROR")))
        found.append(F.when(t.rlike(rf"(?m)^\Q{h}\E\s*(?:\n##|\z)"), v(f"EMPTY_SECTION:{name}", "WARNING")))
    return docs.select("path", F.explode(F.array_compact(F.array(*found))).alias("v")).select("path", "v.*")
