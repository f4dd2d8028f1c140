"""Checks of templates: required fields and sections, placeholders, emoji, and checks of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

from .sections import front_matter

#: Required headings, the sets of them, required fields, and placeholders that must not be left.
REQUIRED = ("## Cel dokumentu", "## Zakres i granice", "## Wejścia i wyjścia")
PLAIN = ("Cel dokumentu", "Zakres i granice", "Wejścia i wyjścia")
SECTION_SETS = {
    "core": ("## Cel dokumentu", "## Zakres i granice", "## Wejścia i wyjścia"),
    "minimal": ("## Cel dokumentu",),
    "extended": ("## Cel dokumentu", "## Zakres i granice", "## Wejścia i wyjścia", "## Metadane"),
}
FIELDS = ("title", "status", "aligned")
FORBIDDEN = ("[Rola / interesariusz]", "[osoba/rola]")
HEADING = r"(?m)^##\s+(.+)$"
NO_FRONT, OPEN_FRONT = "front matter missing", "front matter not closed"


def required_sections(name: str | None = None) -> list[str]:
    """The headings of a set, ``core`` by default; sets may be added to SECTION_SETS."""
    if name is not None and name not in SECTION_SETS:
        raise ValueError(f"unknown section set {name!r}; one of {', '.join(SECTION_SETS)}")
    return list(REQUIRED if name is None else SECTION_SETS[name])


def load(docs: DataFrame) -> DataFrame:
    """path, text -> path, frontmatter, body, headings, error (why the front matter can't be read, else null)."""
    t = F.regexp_replace(T._s("text"), "\r\n", "\n")
    opened = t.rlike(r"\A[ \t]*---[ \t]*(?:\n|\z)")
    front = front_matter(t)
    body = F.regexp_replace(t, r"(?s)\A[ \t]*---[ \t]*\n(?:.*?\n)??[ \t]*---[ \t]*(?:\n|\z)", "")
    error = F.when(~opened, NO_FRONT).when(front.isNull(), OPEN_FRONT)
    x = docs.select("path", front.alias("frontmatter"), body.alias("body"), error.alias("error"))
    return x.withColumn("headings", F.regexp_extract_all("body", F.lit(HEADING), F.lit(1)))


def validate(docs: DataFrame, validators: list[Callable[[dict], list[str]]] = (), section_set: str | None = None) -> DataFrame:
    """path, error of every fault. A template without readable front matter has that fault alone.

    ``validators`` get a dict of path, frontmatter, body and headings and return messages; one
    that raises adds a message. They run on Arrow batches, everything else in the JVM.
    """
    x = load(docs)
    b = F.col("body")
    found = [F.when(F.col("error").isNotNull(), F.col("error"))]
    ok = F.col("error").isNull()
    found += [F.when(ok & F.col("frontmatter")[f].isNull(), F.lit(f"missing field: {f}")) for f in FIELDS]
    found += [F.when(ok & ~b.rlike(rf"(?iu)\Q{h}\E"), F.lit(f"missing section: {h}")) for h in required_sections(section_set)]
    found += [F.when(ok & b.rlike(rf"(?iu)\Q{p}\E"), F.lit(f"forbidden placeholder: {p}")) for p in FORBIDDEN]
    found.append(F.when(ok & b.rlike(T.emoji("template")), F.lit("emoji")))
    errors = x.select("path", F.explode(F.array_compact(F.array(*found))).alias("error"))
    if not validators:
        return errors
    own = list(validators)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                template = {"path": r.path, "frontmatter": dict(r.frontmatter or {}), "body": r.body, "headings": list(r.headings)}
                for v in own:
                    try:
                        rows += [(r.path, m) for m in v(template) or ()]
                    except Exception as e:
                        rows.append((r.path, f"validator {getattr(v, '__name__', '?')}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return errors.unionByName(x.filter("error is null").select("path", "frontmatter", "body", "headings").mapInPandas(run, "path string, error string"))


def emoji_lines(docs: DataFrame, which: str = "gate") -> DataFrame:
    """path, line_no (from 1), line of every line with an emoji."""
    x = docs.select("path", F.posexplode(F.split(T._s("text"), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("at", "line"))
    return x.filter(F.col("line").rlike(T.emoji(which))).select("path", (F.col("at") + 1).alias("line_no"), "line")
