"""Scalar text functions as Column expressions; everything stays in the JVM.

Regular expressions are Java's. ``(?d)`` makes only line feeds line ends, ``(?U)``
makes classes Unicode-aware, as the functions' definitions need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
NUMBER_PREFIX = r"^(\d+[.)]\s+)+"
META_PREFIX = r"^meta\s*[:\-–—]\s*"
POLISH, PLAIN = "ąćęłńóśźż", "acelnoszz"
PLACEHOLDERS = ("...", "todo", "tbd")
#: Code points that count as emoji, by who asks.
EMOJI = {
    "template": ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x2702, 0x27B0), (0x24C2, 0x1F251)),
    "rules": ((0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0xFE00, 0xFE0F), (0x1F1E6, 0x1F1FF)),
    "gate": ((0x1F300, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x1FB00, 0x1FBFF), (0x1F1E6, 0x1F1FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x2300, 0x23FF), (0x1F000, 0x1F02F), (0x1F0A0, 0x1F0FF), (0xFE00, 0xFE0F)),
    "astral": ((0x10000, 0x10FFFF),),
}
#: Words that don't count in titles of controls, and in titles of documents.
CONTROL_STOP = (
    "and", "or", "of", "the", "in", "to", "for", "a", "an", "with", "on",
    "at", "by", "from", "as", "is", "are", "be", "it", "its", "this", "that",
    "their", "other", "use", "used", "using", "within", "during", "after",
    "before", "not", "no", "any", "all", "each", "into", "via", "per",
    "information", "security",
)
TITLE_STOP = (
    "and", "or", "the", "a", "an", "of", "in", "for", "to", "with",
    "plan", "document", "dokumentu", "i", "w", "z", "do", "na", "dla",
    "oraz", "lub", "jak", "jest", "nie", "co", "sie",
)
#: What marks a section's body as not filled in.
BODY_MARKERS = (
    "Uzupełnij zgodnie z kontekstem", "Opisz co wchodzi w zakres", "Dla każdej fazy określ", "[akcja i odpowiedzialny]",
    "Faza 1 – Koncepcja i Wizja: [", "[Rola / interesariusz]", "[Wejścia:", "Wejścia: [dokumenty", "Konsumuje: [dokumenty wejściowe",
    "Dostarcza do: [dokumenty wyjściowe", "[Założenie 1", "[Pytanie 1", "Wymaga odniesienia do: [", "Konsumuje: [dokumenty", "[Termin 1]",
    "[Przykład 1", "[Ryzyko 1", "[Decyzja 1", "[Dokument A]", "[Dokument X", "[Pojęcie 1]", "[Standard 1", "[Sekcja A]", "[Wejście]",
    "[Artefakt 1", "[Decyzja]", "[Kto zatwierdza]", "[Metryka 1", "[Kryterium 1",
)


def _s(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def emoji(which: str) -> str:
    """A character class of one of the emoji sets."""
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in EMOJI[which]) + "]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def heading_norm(c) -> Column:
    """Strip, drop astral characters and list numbers, lower, collapse spaces."""
    x = F.regexp_replace(strip(_s(c)), ASTRAL, "")
    return collapse(F.lower(strip(F.regexp_replace(strip(x), NUMBER_PREFIX, ""))))


def title_norm_plain(c) -> Column:
    return collapse(F.lower(strip(_s(c))))


def norm_label(c) -> Column:
    x = F.regexp_replace(strip(_s(c)), ASTRAL, "")
    x = F.regexp_replace(strip(x), NUMBER_PREFIX, "")
    x = F.lower(F.regexp_replace(x, "﻿", ""))
    return collapse(strip(F.regexp_replace(x, META_PREFIX, "")))


def _slug(c: Column) -> Column:
    x = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    x = F.regexp_replace(x, r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-")


def to_anchor(c, phases: bool = True, trim: bool = False) -> Column:
    """Link anchor of a heading; ``faza N:`` becomes ``phase-0N`` with ``phases``; ``trim`` drops outer dashes."""
    x = F.lower(strip(_s(c)))
    if phases:
        n = F.regexp_extract(x, r"^faza\s+(\d+)", 1)
        x = F.when(n != "", F.concat(F.lit("phase-"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n), F.regexp_replace(x, r"^faza\s+\d+\s*:?.*$", ""))).otherwise(x)
    x = _slug(x)
    return F.regexp_replace(x, "^-+|-+$", "") if trim else x


def slug_section(c) -> Column:
    x = F.regexp_replace(F.regexp_replace(heading_norm(c), r"[^a-z0-9\s-]", ""), r"\s", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.when(x == "", "section").otherwise(x)


def polish_plain(c) -> Column:
    return F.translate(F.lower(F.trim(_s(c))), POLISH, PLAIN)


def to_slug(c) -> Column:
    """Snake case of a title with Polish letters spelt plainly."""
    x = F.regexp_replace(polish_plain(c), "[^a-z0-9]+", "_")
    return F.regexp_replace(x, "^_+|_+$", "")


def tokens(c, min_length: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-cased ASCII words of at least ``min_length`` letters without stop words."""
    got = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_s(c)), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= min_length))
    return F.array_except(got, F.array(*map(F.lit, stop))) if stop else got


def title_words(c) -> Column:
    """Distinct lower-cased words of Latin and Polish letters, three letters or more, without TITLE_STOP."""
    words = F.regexp_extract_all(F.lower(_s(c)), F.lit(f"[a-z{POLISH}]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda t: F.length(t) > 2)), F.array(*map(F.lit, TITLE_STOP)))


def control_words(c) -> Column:
    return tokens(c, 3, CONTROL_STOP)


def plain_words(c, stop: tuple[str, ...] = CONTROL_STOP) -> Column:
    """Tokens with Polish letters spelt plainly, as the backfill of confidences compares them."""
    return tokens(polish_plain(c), 3, stop)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / F.size(F.array_union(a, b)))


def placeholder_status(c) -> Column:
    x = F.lower(strip(_s(c)))
    bad = x == ""
    for p in PLACEHOLDERS:
        bad = bad | x.contains(p)
    return F.when(bad, "placeholder").otherwise("filled")


def rebuilt_status(c) -> Column:
    """A section's status when one document is rebuilt: only ``TODO`` in capitals and ``...`` count."""
    x = _s(c)
    return F.when(x.contains("TODO") | x.contains("..."), "placeholder").otherwise("unknown")


def placeholder_body(c) -> Column:
    """Whether a body is empty, has a marker, or consists of bracketed lines by more than half."""
    x = strip(_s(c))
    lines = F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), strip), lambda s: s != "")
    marked = F.lit(False)
    for m in BODY_MARKERS:
        marked = marked | x.contains(m)
    hollow = F.size(F.filter(lines, lambda s: s.rlike(r"^\[.+\]$|^-\s*\[.+\]$")))
    return (x == "") | marked | (hollow * 2 > F.size(lines))


def path_norm(path) -> Column:
    """Any run of dots and slashes off the front, then the folder of generated templates."""
    return F.regexp_replace(F.regexp_replace(_s(path), r"^[./]+", ""), "^generated_templates/", "")


def after_first(c, delimiter: str = "::") -> Column:
    """What follows the first delimiter, null without one."""
    x = F.col(c) if isinstance(c, str) else c
    at = F.instr(x, delimiter)
    return F.when(at > 0, F.substring(x, at + len(delimiter), F.length(x)))


def title_of_file(text, path) -> Column:
    """The first top heading, else the file's name with spaces for underscores and without ``.md`` anywhere."""
    h1 = strip(F.regexp_extract(_s(text), r"(?m)^# ([^\n]+)$", 1))
    name = F.replace(F.replace(F.regexp_extract(_s(path), "([^/]*)$", 1), F.lit("_"), F.lit(" ")), F.lit(".md"), F.lit(""))
    return F.when(h1 != "", h1).otherwise(name)


def source_of(path) -> Column:
    p = F.regexp_replace(_s(path), r"\\", "/")
    return (
        F.when(p.startswith("generated_templates/core/") | p.startswith("core/"), "core")
        .when(p.startswith("imported/templates/"), "imported_template")
        .when(p.startswith("imported/"), "imported_other")
        .otherwise("unknown")
    )


def category_of(path) -> Column:
    parts = F.split(_s(path), "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.size(parts) - 1)).otherwise("root")


def title_of_path(path) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(_s(path), "([^/]*)$", 1), r"\.md$", ""), "[-_]", " ")


def strength(required) -> Column:
    return F.when(F.col(required) == 1, "required").otherwise("navigational")


def profile_of(origin) -> Column:
    """The quality profile of an origin."""
    return F.when(origin.isin("core", "imported_template"), origin).otherwise("default")


def hash_v2(c) -> Column:
    """SHA-256 over line feeds only."""
    return F.sha2(F.regexp_replace(_s(c), "\r\n?", "\n").cast("binary"), 256)


def section_uid(doc, heading, ordinal) -> Column:
    return F.upper(F.substring(F.sha2(F.concat_ws("|", doc, heading, ordinal.cast("string")).cast("binary"), 256), 1, 26))


def title_of_text(c) -> Column:
    """Front matter title, else the first top heading, else null."""
    front = F.regexp_extract(_s(c), r"(?s)^---[ \t]*\n(.*?)\n---", 1)
    title = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?m)^title:[ \t]*([^\n]*)$", 1)), "^[\"']|[\"']$", "")
    h1 = F.trim(F.regexp_extract(_s(c), r"(?m)^# ([^\n]+)$", 1))
    return F.when(title != "", title).when(h1 != "", h1)


def json_list(c) -> Column:
    """A JSON text's list of strings; null, empty or bad JSON gives an empty list."""
    got = F.from_json(F.when(F.expr(f"try_parse_json(`{c}`) IS NOT NULL"), F.col(c)), "array<string>")
    return F.filter(F.coalesce(got, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def json_list_error(c) -> Column:
    """Why a text is no JSON list: ``bad JSON``, ``not a list``, or null if it is one, null or empty."""
    x = F.col(c)
    parsed = F.expr(f"try_parse_json(`{c}`)")
    return F.when(x.isNull() | (F.trim(x) == ""), None).when(parsed.isNull(), "bad JSON").when(~F.expr(f"schema_of_variant(try_parse_json(`{c}`))").startswith("ARRAY"), "not a list")


#: What ends a line, as Python's ``str.splitlines`` has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def splitlines(c) -> Column:
    """The lines of a text without their ends; an end of the text's last line starts no further one, and an empty text has none."""
    parts = F.split(_s(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


#: Forms of headings: any level, second level only, and second level with or without a space.
HEADING_FORMS = {"all": r"(?m)^(?:#{1,6})\s+(.+)$", "second": r"(?m)^##\s+(.+)$", "loose": r"(?m)^(?:#{1,6})\s*([^#\s].*)$"}


def headings_of(c, form: str = "all") -> Column:
    """The texts of a document's headings; fenced code isn't left out."""
    return F.regexp_extract_all(_s(c), F.lit(HEADING_FORMS[form]), F.lit(1))


def nocase(c) -> Column:
    """For ordering: A to Z as a to z, all other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utc_text(c) -> Column:
    """A timestamp as text to the second, in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def approved_confidence(override, current) -> Column:
    return F.coalesce(override, F.greatest(F.coalesce(current, F.lit(0.0)), F.lit(0.8)))
