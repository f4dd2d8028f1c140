"""Sections, line metrics, quality scores, edge health and blockers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

#: Headings that every document should have, normalised.
REQUIRED = ("metadane", "cel dokumentu", "fazy cyklu życia", "szybkie powiązania", "checklisty jakości", "jak używać dokumentu")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), line."""
    return docs.select(key, F.posexplode(T.splitlines(text))).select(key, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


#: Fixed value: a line that is a heading, its marks and its text (which may be empty).
HEADING = r"(?U)^(#{1,6})\s+(.*)$"


def headings(docs: DataFrame, key: str = "doc_id", empty: bool = True, judge: Callable[[Column], Column] | None = None) -> DataFrame:
    """Headings (those without a text too, if ``empty``) with level, text, line, end line (the line before the next heading, else the last), anchor, ordinal among equal anchors, and the path of headings above.

    With ``judge`` also the status that it gives a heading's body, the lines up to the end line. A text is cut into lines once and only its headings become rows.
    """
    line = lambda x, i: F.struct((i + 1).alias("line_no"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), T.strip(F.regexp_extract(x, HEADING, 2)).alias("heading"))
    x = docs.select(key, T.splitlines("text").alias("ls"))
    found = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(HEADING), line(x, i))), lambda h: h.isNotNull() & (F.lit(empty) | (h["heading"] != "")))
    x = x.select(key, "ls", F.size("ls").alias("n_lines"), found.alias("hs"))

    def row(h: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at("hs", i + 2)["line_no"] - 1, F.col("n_lines"))
        body = T.strip(F.array_join(F.slice("ls", h["line_no"] + 1, F.greatest(end - h["line_no"], F.lit(0))), "\n"))
        more = [] if judge is None else [judge(body).alias("status")]
        return F.struct(h["line_no"].alias("line_no"), end.alias("end_line"), h["level"].alias("level"), h["heading"].alias("heading"), *more)

    x = x.select(key, F.explode(F.transform("hs", row)).alias("h")).select(key, "h.*").withColumn("anchor", T.slug_section(F.col("heading")))
    w = Window.partitionBy(key).orderBy("line_no")
    x = x.withColumn("ordinal", F.row_number().over(Window.partitionBy(key, "anchor").orderBy("line_no")))
    top = lambda k: F.last(F.when(F.col("level") == k, F.struct("line_no", "heading")), ignorenulls=True).over(w)
    for k in range(1, 7):
        x = x.withColumn(f"__{k}", top(k))
    path, low = F.array(), None
    parts = []
    for k in range(1, 7):  # the last heading of a level counts unless a higher one came later
        above = [F.col(f"__{j}.line_no") for j in range(1, k)]
        fresh = F.col(f"__{k}.line_no") > F.coalesce(F.greatest(*above) if len(above) > 1 else above[0], F.lit(0)) if above else F.lit(True)
        parts.append(F.when((F.col("level") >= k) & F.col(f"__{k}").isNotNull() & fresh, F.col(f"__{k}.heading")))
    path = F.array_join(F.array_compact(F.array(*parts)), " > ")
    return x.select(key, "line_no", "end_line", "level", "heading", "anchor", "ordinal", path.alias("heading_path"), *([] if judge is None else ["status"]))


def sections(docs: DataFrame, key: str = "doc_uid", rebuilt: bool = False) -> DataFrame:
    """The section table of Markdown texts: section_uid, key, start_line, end_line, level, heading, heading_norm, anchor, ordinal, heading_path, status.

    A section reaches to the line before the next heading, whatever its level. Its status is that of
    its body, the lines below its heading. ``rebuilt`` has the rules by which single documents are done anew: marks without a
    text are no headings, and a section is a placeholder by fewer signs and else unknown.
    """
    x = headings(docs.select(key, "text"), key, not rebuilt, T.rebuilt_status if rebuilt else T.placeholder_status)
    return x.select(T.section_uid(F.col(key), F.col("anchor"), F.col("ordinal")).alias("section_uid"), key, F.col("line_no").alias("start_line"), "end_line", "level", "heading", T.heading_norm(F.col("heading")).alias("heading_norm"), "anchor", "ordinal", "heading_path", "status")


def short_paths(docs: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """Second- and third-level headings with their path: the first top heading (else the title), the last second-level one, the heading."""
    top = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+([^\n]+)$", 1))
    x = docs.select(key, F.when(top != "", top).otherwise(F.col(title)).alias("top"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    x = x.filter(F.col("line").rlike(r"^#{2,3}\s+\S")).select(key, "top", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+\s+(.*)$", 1)).alias("heading"))
    x = x.withColumn("anchor", T.to_anchor(F.col("heading"), phases=False)).filter("anchor <> ''")
    above = F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no"))
    path = F.when(F.col("level") == 2, F.concat_ws(" > ", "top", "heading")).otherwise(F.concat_ws(" > ", "top", F.coalesce("above", "top"), "heading"))
    return x.withColumn("above", above).select(key, (F.col("line_no") + 1).alias("line_no"), "level", "heading", path.alias("heading_path"), "anchor")


LEVELS = range(13)


def parents(sections: DataFrame) -> DataFrame:
    """doc_uid, ordinal, level -> ordinal of the nearest section above with a lower level (null: the document) and kind.

    The last section of each level is carried along an ordered window; of the lower ones the
    greatest ordinal is the parent. A section without a level has no parent and is none; levels
    beyond 12 are an error.
    """
    above = Window.partitionBy("doc_uid").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    known = F.when(level.isNull() | level.between(LEVELS[0], LEVELS[-1]), level).otherwise(F.raise_error(F.format_string("no heading has level %s", level.cast("string"))))
    last = {f"__{k}": F.max(F.when(level == k, F.col("ordinal"))).over(above) for k in LEVELS}
    lower = [F.when(level > k, F.col(f"__{k}")) for k in LEVELS]
    x = sections.select("doc_uid", "ordinal", known.alias("level")).withColumns(last)
    return x.select("doc_uid", "ordinal", "level", F.greatest(*lower).alias("parent"), F.when(level == 2, "sec").otherwise("subsec").alias("kind"))


#: What makes a line a checkbox, a bullet, part of a table, a link, and a phase.
LINES = {
    "checkboxes": r"^\s*[-*]\s*\[\s*[xX ]\s*\]\s+",
    "bullets": r"^\s*[-*]\s+",
    "tables": r"^\s*\|.+\|\s*$",
    "links": r"\[[^\]]+\]\([^)]+\)|https?://\S+",
    "phases": r"(?i)^\s*[-*]\s*Faza\s+(\d{1,2})\s*:",
}


def _marks(line: Column) -> Column:
    """What a line adds to a section's metrics."""
    return F.struct(F.length(line).cast("long").alias("chars"), F.lit(1).cast("long").alias("lines"), *(line.rlike(p).cast("long").alias(n) for n, p in LINES.items()))


METRICS = ("chars", "lines", *LINES)


def _total(marks: Column) -> Column:
    zero = F.struct(*(F.lit(0).cast("long").alias(m) for m in METRICS))
    return F.aggregate(marks, zero, lambda a, x: F.struct(*((a[m] + x[m]).alias(m) for m in METRICS)))


def line_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chars (without line ends), lines, and how many lines are of each kind in LINES, of whole documents; counted in place without exploding."""
    return docs.select(key, _total(F.transform(T.splitlines(text), _marks)).alias("m")).select(key, "m.*")


def section_metrics(sections: DataFrame, docs: DataFrame, key: str = "doc_uid", keep: tuple[str, ...] = ()) -> DataFrame:
    """section_uid, key, the columns to ``keep`` and the metrics of a section's lines, from its start line to its end line.

    sections (section_uid, key, start_line, end_line), docs (key, text). A missing start is the first line; a
    missing end, 0 or one beyond the text is the last. Each document is cut into lines once; its
    sections are slices of these, so neither lines nor texts are repeated by section. Sections
    without a document have no metrics.
    """
    own = F.collect_list(F.struct("section_uid", F.coalesce("start_line", F.lit(0)).alias("a"), F.coalesce("end_line", F.lit(0)).alias("b"), *keep)).alias("s")
    x = docs.select(key, F.col("text")).join(sections.groupBy(key).agg(own), key)
    x = x.select(key, "s", F.transform(T.splitlines("text"), _marks).alias("m"))

    def of(s: Column) -> Column:
        first = F.greatest(s["a"], F.lit(1))
        last = F.when(s["b"] == 0, F.size("m")).otherwise(F.least(s["b"], F.size("m")))
        return F.struct(s["section_uid"].alias("section_uid"), *(s[c].alias(c) for c in keep), _total(F.slice("m", first, F.greatest(last - first + 1, F.lit(0)))).alias("m"))

    return x.select(key, F.explode(F.transform("s", of)).alias("x")).select("x.section_uid", key, *(f"x.{c}" for c in keep), "x.m.*")


def document_rollup(docs: DataFrame, metrics: DataFrame, edges: DataFrame | None = None, unresolved: int = 0, key: str = "doc_uid") -> DataFrame:
    """One row per document with a text: sections, placeholders, checkboxes, phase_bullets, missing_required, links_without_rationale, unresolved.

    docs (key, origin, text); metrics of sections with their status and heading_norm. ``edges`` (from_kind, from_uid,
    strength, rationale): required ones of documents without a reason are counted. ``unresolved`` is one number for all.
    Required headings are asked of origin ``core`` alone; a heading that begins with one counts.
    """
    c = F.col
    begins = [F.max(c("heading_norm").startswith(r)).alias(f"r{i}") for i, r in enumerate(REQUIRED)]
    own = metrics.groupBy(key).agg(F.count(F.lit(1)).alias("sections"), F.count_if(c("status") == "placeholder").alias("placeholders"), F.sum("checkboxes").alias("checkboxes"), F.sum("phases").alias("phase_bullets"), *begins)
    out = docs.filter("text is not null").select(key, "origin").join(own, key, "left")
    if edges is None:
        out = out.withColumn("bare", F.lit(0))
    else:
        bare = edges.filter((c("from_kind") == "doc") & (c("strength") == "required") & (F.trim(F.coalesce("rationale", F.lit(""))) == "")).groupBy(c("from_uid").alias(key)).agg(F.count(F.lit(1)).alias("bare"))
        out = out.join(bare, key, "left")
    lacking = F.lit(len(REQUIRED)) - sum((F.coalesce(c(f"r{i}"), F.lit(False)).cast("int") for i in range(len(REQUIRED))), F.lit(0))
    count = lambda n, as_: F.coalesce(n, F.lit(0)).cast("long").alias(as_)
    return out.select(
        key, "origin", *(count(n, n) for n in ("sections", "placeholders", "checkboxes", "phase_bullets")),
        F.when(T.profile_of(c("origin")) == "core", lacking).otherwise(0).cast("long").alias("missing_required"), count("bare", "links_without_rationale"), F.lit(unresolved).cast("long").alias("unresolved"),
    )


def section_score(m: DataFrame) -> DataFrame:
    """section_uid, lines, placeholder, gates_missed -> score, status (the first downgrade counts)."""
    score = 100 - F.when(F.col("placeholder"), 40).otherwise(0) - F.when(F.col("lines") < 3, 20).otherwise(0) - 10 * F.col("gates_missed")
    score = F.when(F.col("lines") == 0, 0).otherwise(F.greatest(score, F.lit(0)))
    status = F.when(F.col("lines") == 0, "needs_structure").when(F.col("placeholder"), "needs_content").when(F.col("lines") < 3, "needs_content").when(F.col("gates_missed") > 0, "needs_content").otherwise("ok")
    return m.select("section_uid", score.cast("long").alias("score"), status.alias("status"))


def required_coverage(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many of the required headings a document has, a longer heading that begins with one counting, and how many it lacks.

    Where docs has an ``origin``, they are asked of the core documents alone: others lack none.
    """
    heads = F.filter(T.splitlines("text"), lambda x: x.rlike(HEADING))
    hs = F.transform(heads, lambda x: T.heading_norm(F.regexp_extract(x, HEADING, 2)))
    begun = lambda r: F.exists("hs", lambda h: h.startswith(r)).cast("long")
    n = sum(map(begun, REQUIRED), F.lit(0).cast("long"))
    asked = T.profile_of(F.col("origin")) == "core" if "origin" in docs.columns else F.lit(True)
    return docs.select(key, hs.alias("hs"), asked.alias("asked")).select(key, n.alias("n_required"), F.when(F.col("asked"), F.lit(len(REQUIRED)) - n).otherwise(0).alias("n_missing"))


def edge_health(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (id, to_uid, strength, rationale; to_kind and source if there are) -> status and reasons against the existing nodes (uid; kind if there is one).

    With kinds, a target is looked for among the documents or the sections as its edge says, and
    targets of other kinds aren't looked for. Nor are those of content links: they hold raw references, so they are unresolved (warn).
    """
    kinds = "to_kind" in edges.columns and "kind" in nodes.columns
    there = nodes.select(F.col("uid").alias("to_uid"), *([F.col("kind").alias("to_kind")] if kinds else [])).distinct().withColumn("there", F.lit(True))
    x = edges.join(there, ["to_uid", "to_kind"] if kinds else ["to_uid"], "left")
    raw = F.col("source") == "content_links" if "source" in edges.columns else F.lit(False)
    looked = F.coalesce(F.col("to_kind").isin("doc", "section"), F.lit(False)) if kinds else F.lit(True)
    blank = F.trim(F.coalesce("rationale", F.lit(""))) == ""
    missing, blocked, weak = ~raw & looked & F.col("there").isNull(), blank & (F.col("strength") == "blocking"), blank & (F.col("strength") == "required")
    reasons = F.array(F.when(raw, "CONTENT_LINK_UNRESOLVED"), F.when(missing, "TARGET_MISSING"), F.when(blocked | weak, "MISSING_RATIONALE"))
    return x.select("id", F.when(missing | blocked, "fail").when(raw | weak, "warn").otherwise("ok").alias("status"), F.array_join(F.array_compact(reasons), ",").alias("reasons"))


def blockers(edges: DataFrame, quality: DataFrame) -> DataFrame:
    """Required or blocking edges from a section that isn't ok (an unknown one counts as not ok), one per pair, with the strongest edge's strength."""
    x = edges.filter(F.col("strength").isin("required", "blocking") & ~F.coalesce(F.col("to_uid").cast("string"), F.lit("")).startswith("section::"))
    x = x.join(quality.select(F.col("section_uid").alias("from_uid"), F.col("status").alias("q")), "from_uid", "left").filter("q is null or q <> 'ok'")
    # "blocking" comes before "required".
    x = x.groupBy(F.col("to_uid").alias("blocked_uid"), F.col("from_uid").alias("blocker_uid")).agg(F.min("strength").alias("strength"))
    return x.select("blocked_uid", "blocker_uid", F.when(F.col("strength") == "blocking", "H").otherwise("M").alias("severity"), F.lit("UPSTREAM_REQUIRED_NOT_OK").alias("reason_code"), F.to_json(F.struct("strength")).alias("evidence_json"))


def gates_missed(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """metrics (section_uid, doc_uid, checkboxes), gates (scope_kind, scope_uid, gates_json) -> section_uid, gates_missed, missing_json.

    A section's own contract counts, else its document's, of several of one scope the last version;
    bad JSON has no gates. The only known gate is ``min_checkboxes`` with ``min``.
    """
    kind = "array<struct<gate:string,min:int>>"
    known = gates.select("scope_kind", "scope_uid", (F.col("version") if "version" in gates.columns else F.col("gates_json")).alias("by"), F.coalesce(F.from_json("gates_json", kind), F.array().cast(kind)).alias("g"))
    pick = lambda k, n: known.filter(F.col("scope_kind") == k).groupBy(F.col("scope_uid").alias(n)).agg(F.max_by("g", "by").alias(f"g_{k}"))
    x = metrics.join(pick("section", "section_uid"), "section_uid", "left").join(pick("doc", "doc_uid"), "doc_uid", "left")
    x = x.withColumn("g", F.coalesce("g_section", "g_doc", F.array().cast(kind)))
    have = F.coalesce("checkboxes", F.lit(0))
    missed = F.filter("g", lambda g: (g["gate"] == "min_checkboxes") & (have < F.coalesce(g["min"], F.lit(0))))
    return x.select("section_uid", F.size(missed).alias("gates_missed"), F.to_json(F.transform(missed, lambda g: F.struct(g["gate"].alias("gate"), F.coalesce(g["min"], F.lit(0)).alias("min"), have.alias("have")))).alias("missing_json"))


def scan_sections(sections: DataFrame, metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """sections (section_uid, doc_uid, status), metrics (section_uid, lines, checkboxes; may lack some) and contracts -> score and status of each."""
    m = sections.join(metrics.select("section_uid", "lines", "checkboxes"), "section_uid", "left").select("section_uid", "doc_uid", (F.col("status") == "placeholder").alias("placeholder"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("checkboxes", F.lit(0)).alias("checkboxes"))
    return section_score(m.join(gates_missed(m, gates).select("section_uid", "gates_missed"), "section_uid"))


def document_score(m: DataFrame) -> DataFrame:
    """One row per document with its profile's bounds -> score, status.

    m: doc_uid, sections, placeholders, missing_required, checkboxes, phase_bullets, links_without_rationale,
    unresolved, and of the profile min_sections, max_placeholder_ratio, min_checkboxes, require_phases, min_phase_bullets.
    """
    c = F.col
    ratio = F.when(c("sections") > 0, c("placeholders") / c("sections")).otherwise(1.0)
    few, hollow, gaps, unchecked, bare = c("sections") < c("min_sections"), ratio > c("max_placeholder_ratio"), c("missing_required") > 0, c("checkboxes") < c("min_checkboxes"), c("links_without_rationale") > 0
    lost = ((few, 20), (hollow, 25), (gaps, 30), (unchecked, 10), (c("require_phases") & (c("phase_bullets") < c("min_phase_bullets")), 20), (bare, 10), (c("unresolved") > 0, 5))
    score = F.lit(100)
    for cond, points in lost:
        score = score - F.when(cond, points).otherwise(0)
    status = F.when(gaps | few, "needs_structure").when(hollow | unchecked, "needs_content").when(bare, "needs_links").otherwise("ok")
    return m.select("doc_uid", F.greatest(score, F.lit(0)).cast("long").alias("score"), status.alias("status"))


def with_profile(docs: DataFrame, profiles: DataFrame, name: str = "origin") -> DataFrame:
    """docs with the columns of their profile (profiles has one row a name, and one named default)."""
    cols = [c for c in profiles.columns if c != name]
    known = profiles.select(F.col(name).alias("__known"))
    x = docs.join(known, docs[name] == F.col("__known"), "left").withColumn("__use", F.coalesce("__known", F.lit("default")))
    return x.join(profiles.withColumnRenamed(name, "__name"), F.col("__use") == F.col("__name")).select(*docs.columns, *cols)


def phase_mapping(sections: DataFrame, docs: DataFrame, phases: DataFrame) -> DataFrame:
    """doc_uid, phase_id of sections whose anchor is ``phase-N``; phases: phase_number, phase_id."""
    x = sections.filter(F.col("anchor").ilike("phase-%") & (F.length("anchor") <= 9)).select("doc_uid", F.expr("try_cast(substring(anchor, 7) as int)").alias("phase_number")).distinct()
    return x.join(docs.select("doc_uid").distinct(), "doc_uid", "left_semi").join(phases.filter("phase_id is not null and phase_id <> 0"), "phase_number").select("doc_uid", "phase_id")
