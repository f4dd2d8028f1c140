"""Responsibility tables in Markdown: the first one of a text, or a default by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Words of a header, then for each column the words that name it (the first column that fits takes a cell).
HEADER = ("responsible", "accountable", "consulted", "informed", "odpowiedzial", "akceptuj")
COLUMNS = {
    "action": ("działani", "czynno", "zadani"),
    "responsible": ("responsible", "realizuj"),
    "accountable": ("accountable", "akceptuj", "zatwierdz"),
    "consulted": ("consulted", "konsult"),
    "informed": ("informed", "informow"),
}
DEFAULTS = {
    "bezpiecze": ("SEC", "CISO", "ARCH", "DEVOPS"),
    "architekt": ("ARCH", "CTO", "DEV", "OPS"),
    "test": ("QA", "PM", "DEV", "BA"),
    "incident": ("SRE", "CISO", "OPS", "MGR"),
    "zmian": ("PM", "CTO", "DEV", "OPS"),
    "dane": ("DPO", "CISO", "DEV", "LEGAL"),
    "wymagani": ("BA", "PM", "DEV", "CLIENT"),
    "zgodnos": ("AUDIT", "CISO", "MGR", "LEGAL"),
}
DEFAULT = ("DEV", "PM", "BA", "OPS")
DEFAULT_ACTION = "Ogólna odpowiedzialność"
#: The section of roles, up to the next heading of its level.
SECTION = r"(?isu)##\s+RACI\s+i\s+role\b(.*?)(?=\n##\s|\z)"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LONGEST_ACTION = 100


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda c: c != "")


def _before(lines: Column, stop) -> Column:
    """The lines before the first for which ``stop`` holds."""
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull()))
    return F.slice(lines, F.lit(1), F.coalesce(at, F.size(lines)))


def _last(head: Column, name: str) -> Column:
    """Position of the last header cell that names the column and none before it in COLUMNS."""
    order = list(COLUMNS)
    earlier = sum((COLUMNS[n] for n in order[: order.index(name)]), ())
    fits = lambda c: _any(F.lower(c), COLUMNS[name]) & ~_any(F.lower(c), earlier)
    return F.array_max(F.filter(F.transform(head, lambda c, i: F.when(fits(c), i)), lambda i: i.isNotNull()))


def table_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq and the five columns of the first table whose header names roles.

    Empty cells count for nothing, so later cells move up; a long action is guidance
    and no row. The array of a document's lines stays in the JVM and nothing is shuffled.
    """
    x = docs.select(key, F.transform(F.split(T._s(text), LINE_ENDS), T.strip).alias("ls"))
    is_head = lambda s: s.startswith("|") & _any(F.lower(F.array_join(_cells(s), " ")), HEADER)
    x = x.withColumn("at", F.array_min(F.filter(F.transform("ls", lambda s, i: F.when(is_head(s), i)), lambda i: i.isNotNull()))).filter("at is not null")
    x = x.select(key, _cells(F.element_at("ls", F.col("at") + 1)).alias("head"), F.slice("ls", F.col("at") + 2, F.size("ls")).alias("rest"))
    named = [_last(F.col("head"), name).alias(f"at_{name}") for name in COLUMNS]
    x = x.select(key, *named, F.posexplode(_before(F.col("rest"), lambda s: ~s.startswith("|"))).alias("pos", "line")).withColumn("cells", _cells(F.col("line")))
    x = x.filter((F.size("cells") >= 2) & ~F.forall("cells", lambda c: c.rlike("^[-:]*$")))
    out = []
    for i, name in enumerate(COLUMNS):
        other = F.element_at("cells", 1) if name == "action" else F.lit("")
        out.append(F.coalesce(F.get("cells", F.coalesce(f"at_{name}", F.lit(i))), other).alias(name))
    x = x.select(key, "pos", *out).filter(F.length("action") <= LONGEST_ACTION)
    return x.select(key, F.col("pos").alias("seq"), *COLUMNS)


def default_roles(title: str = "title") -> list[Column]:
    """The four roles by the first keyword in the title."""
    low, out = F.lower(T._s(title)), []
    for i, name in enumerate(list(COLUMNS)[1:]):
        c = None
        for word, roles in DEFAULTS.items():
            c = F.when(low.contains(word), roles[i]) if c is None else c.when(low.contains(word), roles[i])
        out.append(c.otherwise(DEFAULT[i]).alias(name))
    return out


def derive(docs: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """Rows of the table in each document's section of roles, else one default row by the title."""
    rows = table_rows(docs.select(key, F.regexp_extract(T._s(text), SECTION, 1).alias(text)), key, text)
    bare = docs.select(key, title).join(rows.select(key).distinct(), key, "left_anti")
    return rows.unionByName(bare.select(key, F.lit(0).alias("seq"), F.lit(DEFAULT_ACTION).alias("action"), *default_roles(title)))
