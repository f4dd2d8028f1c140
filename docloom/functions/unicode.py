"""Text functions that need Unicode tables or code pages the JVM expressions lack: Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .text import ASTRAL, PLAIN, POLISH, _s, collapse, strip, to_slug


def _repaired(s: str | None) -> str | None:
    try:
        return s if s is None else s.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return s


def _plain(s: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def mojibake(c: pd.Series) -> pd.Series:
    """UTF-8 that was read as cp1252, read rightly; other texts as they are."""
    return c.map(_repaired)


@F.pandas_udf(StringType())
def dash_slug(c: pd.Series) -> pd.Series:
    """Lower-case words of a-z and 0-9 without accents, joined by dashes."""
    return c.map(lambda s: re.sub("[^a-z0-9]+", "-", _plain(s).lower()).strip("-"))


@F.pandas_udf(StringType())
def ascii_only(c: pd.Series) -> pd.Series:
    """Accents off, then everything that isn't ASCII dropped."""
    return c.map(lambda s: "".join(x for x in _plain(s) if x.isascii()))


def snake_slug(c):
    """``text.to_slug`` for letters of any alphabet: Polish ones spelt plainly, others without accents or dropped."""
    plain = F.translate(c, POLISH + POLISH.upper(), PLAIN + PLAIN.upper())
    return to_slug(ascii_only(plain))


@F.pandas_udf(StringType())
def without_accents(c: pd.Series) -> pd.Series:
    return c.map(_plain)


def key_norm(c):
    """Matching key of a label: no astral characters, ``meta:`` or list numbers, no accents, lower case, single spaces."""
    x = F.regexp_replace(F.regexp_replace(strip(_s(c)), "\ufeff", ""), ASTRAL, "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*meta\s*[:\-–—]\s*", ""), r"^\s*(\d+[.)]\s+)+", "")
    return strip(collapse(F.lower(without_accents(x))))


@F.pandas_udf(DoubleType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal lines in order, by difflib: 1 for equal texts, 0 for texts without a common line."""
    return pd.Series([SequenceMatcher(None, (x or "").splitlines(), (y or "").splitlines()).ratio() for x, y in zip(a, b, strict=True)])


def repair(df, columns: list[str]):
    """The columns repaired, with ``changed`` where any of them differs."""
    new = {c: mojibake(F.col(c)) for c in columns}
    out = df.withColumns({f"__{c}": v for c, v in new.items()})
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"__{c}").eqNullSafe(F.col(c))
    return out.withColumn("changed", differs).withColumns({c: F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))
