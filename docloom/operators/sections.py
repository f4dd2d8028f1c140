"""Sections of Markdown texts: taken apart, patched, put in, and filled from similar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

from . import quality
from .matching import top_similar

OPERATIONS = ("replace", "append", "prepend", "delete", "rename", "deduplicate")


def section_map(text) -> Column:
    """Second-level headings to bodies, stripped; the first of equal headings counts."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), T._s(text)), r"\n##[ \t]+(?=\S)"), F.lit(2), F.lit(1 << 30))
    pair = F.transform(parts, lambda p: F.struct(T.strip(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("key"), T.strip(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("value")))
    first = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(first)


def front_matter(text) -> Column:
    """``key: value`` lines of a closed front matter as a map, the last of equal keys counts; null if absent or not closed."""
    inner = F.regexp_extract(T._s(text), r"(?s)\A[ \t]*---[ \t\r]*\n(.*?\n)??[ \t]*---[ \t\r]*(?:\n|\z)", 1)
    closed = T._s(text).rlike(r"(?s)\A[ \t]*---[ \t\r]*\n(?:.*?\n)??[ \t]*---[ \t\r]*(?:\n|\z)")
    lines = F.filter(F.split(inner, "\n"), lambda s: s.contains(":"))
    pair = F.transform(lines, lambda s: F.struct(T.strip(F.substring_index(s, ":", 1)).alias("key"), T.strip(F.regexp_replace(s, r"\A[^:]*:", "")).alias("value")))
    last = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda y: y["key"] == x["key"]))
    return F.when(closed, F.map_from_entries(last))


def patch(text, section: str, operation: str, value: str = "", old: str | None = None) -> Column:
    """One operation on the first section with this heading; a text without it stays as it is.

    replace: the body, or in it each ``old``; append and prepend: a line of the body;
    delete: heading and body; rename: the heading; deduplicate: each line of the body once.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; one of {', '.join(OPERATIONS)}")
    rule = rf"(?ms)\A(.*?)(^##[ \t]+\Q{section}\E[ \t]*(?:\n|\z))(.*?)((?:^## .*)?)\z"
    before, head, body, after = (F.regexp_extract(T._s(text), rule, i) for i in range(1, 5))
    if operation == "delete":
        new = F.concat(before, after)
    elif operation == "rename":
        new = F.concat(before, F.lit(f"## {value}\n"), body, after)
    else:
        line = F.lit(value.rstrip("\n") + "\n")
        if operation == "replace":
            body = line if old is None else F.replace(body, F.lit(old), F.lit(value))
        elif operation == "append":
            body = F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n"), line)
        elif operation == "prepend":
            body = F.concat(line, body)
        else:
            body = F.array_join(F.array_distinct(F.split(body, "\n")), "\n")
        new = F.concat(before, F.when(head.endswith("\n"), head).otherwise(F.concat(head, F.lit("\n"))), body, after)
    return F.when(head != "", new).otherwise(F.col(text) if isinstance(text, str) else text)


def inject(text, section: str, body: str, anchors: tuple[str, ...]) -> Column:
    """The section before the first heading that starts with an anchor, else at the end; nothing if it is there already."""
    t = T._s(text)
    put = f"## {section}\n\n{body}\n"
    at = F.regexp_instr(t, F.lit(r"(?m)^##[ \t]+(?:" + "|".join(rf"\Q{a}\E" for a in anchors) + ")"))
    inside = F.concat(F.substring(t, F.lit(1), at - 1), F.lit(put + "\n"), F.substring(t, at, F.length(t)))
    end = F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n\n" + put))
    return F.when(t.rlike(rf"(?m)^##[ \t]+\Q{section}\E[ \t]*$"), t).when(at > 0, inside).otherwise(end)


# Fixed values of the documents' language: the section of phases and the word before a phase's number.
PHASES, PHASE = "Fazy cyklu życia", "Faza"


def phase_bullets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phases listed as bullets below the heading of phases: key, start_line, end_line, level, heading, anchor, ordinal, status.

    A bullet is ``- Faza 2: name``; what follows a second colon isn't part of the name. It
    counts as a section one level below, up to the end of its heading's, always as the
    first of its kind and as a placeholder. Both sides are filtered before they meet.
    """
    docs = docs.select(key, F.col(text).alias("text"))
    bullet = rf"(?iu)^\s*[-*]\s*{PHASE}\s+(\d{{1,2}})\s*:\s*(\S.*?)\s*$"
    heads = quality.headings(docs, key).filter(T.heading_norm(F.col("heading")) == T.heading_norm(F.lit(PHASES))).select(key, F.col("line_no").alias("__from"), "end_line", (F.col("level") + 1).alias("level"))
    found = quality.lines(docs, key).filter(F.col("line").rlike(bullet)).select(key, F.col("line_no").alias("start_line"), F.regexp_extract("line", bullet, 1).cast("int").alias("__n"), T.strip(F.substring_index(F.regexp_extract("line", bullet, 2), ":", 1)).alias("__name"))
    both = found.join(heads, key).filter(F.col("start_line").between(F.col("__from"), F.col("end_line")))
    return both.select(key, "start_line", "end_line", "level", F.concat(F.lit(f"{PHASE} "), F.col("__n").cast("string"), F.lit(": "), F.col("__name")).alias("heading"), F.format_string("phase-%02d", "__n").alias("anchor"), F.lit(1).alias("ordinal"), F.lit("placeholder").alias("status"))


def best_donors(docs: DataFrame, donors: DataFrame, key: str, title: str, least: float = 0.01, stop: tuple[str, ...] = ()) -> DataFrame:
    """key, donor, score: the donor with the most similar title; ties go to the smallest key, never the document itself."""
    words = T.tokens(F.col(title), 3, stop)
    # One more than asked for: the document may be its own best donor.
    near = top_similar(docs.select(F.col(key).alias("a"), words.alias("tokens")), donors.select(F.col(key).alias("b"), words.alias("tokens")), least, 2)
    best = near.filter("a <> b").groupBy("a").agg(F.min_by(F.struct("b", "score"), "rank").alias("d"))
    return best.select(F.col("a").alias(key), F.col("d.b").alias("donor"), F.col("d.score").alias("score"))
