"""Personal data replaced by format-preserving Feistel pseudonyms, in SQL functions only.

Card numbers, telephone numbers, IP addresses, social security numbers and dates
are found by one pattern, validated (Luhn digit, area codes, number ranges, calendar) and
permuted by a keyed Feistel network within their format: a pseudonym is again
valid and has the same punctuation, and equal values get equal pseudonyms in every
document. Local parts of e-mail addresses become keyed digests. What isn't
valid stays. Each text is handled alone, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The patterns searched for.
EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-])(?!\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
ANY = "|".join((EMAIL, DATE, SSN, PHONE, IP, CARD))
FIRST_YEAR, YEARS = 1800, 400  # dates outside stay
WALK = 16  # tries to land on a valid date, each of which fails in 1 of 25 cases at most


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0))


def feistel(kind: str | Column, key: str, left: Column, right: Column, size_left: Column, size_right: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs (0..size_left-1, 0..size_right-1)."""

    def noise(i: Column, x: Column) -> Column:
        text = F.concat_ws(":", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), size_left.cast("string"), size_right.cast("string"), i.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("long")

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + noise(i, s["r"]), size_left).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + noise(i, s["l"]), size_right).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(kind: str, key: str, digits: Column) -> Column:
    """A string of 2 to 18 digits -> another of the same length."""

    def run(d: Column) -> Column:
        n, a = F.length(d), F.floor(F.length(d) / 2).cast("int")
        b = n - a
        return _with(
            feistel(kind, key, _number(d.substr(F.lit(1), a)), _number(d.substr(a + 1, b)), _power(a), _power(b)),
            lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), b, F.lit("0"))),
        )

    return _with(digits, run)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """``doubled``: whether the last digit counts double (0 or 1)."""
    def step(s: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when((i + doubled) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def refill(pattern: Column, digits: Column) -> Column:
    """The digits of ``pattern`` replaced by ``digits`` one by one; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], digits.substr(s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(F.split(pattern, ""), start, step, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = F.concat(d.substr(F.lit(1), F.lit(1)), permute_digits("card", key, d.substr(F.lit(2), F.length(d) - 2)))
        full = _with(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, _with(full, lambda f: refill(m, f)))

    return _with(F.regexp_replace(m, "[^0-9]", ""), run)


def _phone(m: Column, key: str) -> Column:
    """North American numbers (no country code, or 1): area and exchange start with 2 to 9. Of other countries the last ten digits."""

    def run(d: Column) -> Column:
        area, exchange, line = (_number(F.substring(F.right(d, F.lit(10)), i, n)) for i, n in ((1, 3), (4, 3), (7, 4)))
        home = F.length(d).isin(10, 11) & ((F.length(d) == 10) | (F.left(d, F.lit(1)) == "1"))
        s = feistel("phone", key, area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000))
        valid = (area >= 200) & (exchange >= 200)
        here = lambda v: F.concat((v["l"] + 200).cast("string"), (F.floor(v["r"] / 10000) + 200).cast("string"), F.lpad((v["r"] % 10000).cast("string"), 4, "0"))
        ten = F.when(home & valid, _with(s, here)).when(~home, permute_digits("phone", key, F.right(d, F.lit(10))))
        return _with(F.concat(d.substr(F.lit(1), F.length(d) - 10), ten), lambda f: refill(m, f))

    return _with(F.regexp_replace(m, "[^0-9]", ""), run)


def _ip(m: Column, key: str) -> Column:
    def run(o: Column) -> Column:
        s = feistel("ip", key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        return F.when(F.forall(o, lambda x: x < 256), _with(s, lambda v: F.concat_ws(".", *(F.expr("1") * 0 + F.floor(v[h] / d) % 256 for h, d in (("l", 256), ("l", 1), ("r", 256), ("r", 1))))))

    return _with(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), run)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def run(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        valid = (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        s = feistel("ssn", key, area, (p[1] - 1) * 9999 + p[2] - 1, F.lit(898), F.lit(99 * 9999))
        text = lambda v: F.concat_ws("-", F.lpad((v["l"] + F.when(v["l"] + 1 >= 666, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(v["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((v["r"] % 9999 + 1).cast("string"), 4, "0"))
        return F.when(valid, _with(s, text))

    return _with(F.transform(F.split(m, "-"), lambda x: x.cast("long")), run)


def _days(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _date(m: Column, key: str) -> Column:
    """Year-month-day, or day and month before the year; the day comes first unless only the other order is valid.

    A date is permuted among those of its form: the order of its parts, and for day and
    month how many digits they have (one: 1 to 9; two: up to 31 or 12). With the month first the
    day is above 12, before and after, so that no date can be read in two ways only one
    of which has this pseudonym.
    """
    p = F.split(m, r"[./-]")
    iso = m.rlike(r"^\d{4}-")

    def run(x: Column) -> Column:
        text, n = x["p"], F.transform(x["p"], _number)
        year = F.when(iso, n[0]).otherwise(n[2])
        ok = lambda month, day: (month >= 1) & (month <= 12) & (day >= 1) & (day <= _days(year, month))
        order = F.when(iso, F.when(ok(n[1], n[2]), "ymd")).when(ok(n[1], n[0]), "dmy").when(ok(n[0], n[1]), "mdy")
        at = lambda which: F.when(order == "ymd", which[0]).when(order == "dmy", which[1]).otherwise(which[2])
        month, day = at((n[1], n[1], n[0])), at((n[2], n[0], n[1]))
        wide_m, wide_d = F.length(at((text[1], text[1], text[0]))), F.length(at((text[2], text[0], text[1])))
        return F.struct(order.alias("order"), year.alias("y"), month.alias("m"), day.alias("d"), wide_m.alias("wm"), wide_d.alias("wd"))

    def permuted(x: Column) -> Column:
        months = F.when(x["wm"] == 1, 9).otherwise(12)
        first = F.when(x["order"] == "mdy", 13).otherwise(1)
        days = F.when(x["order"] == "mdy", 19).when(x["wd"] == 1, 9).otherwise(31)
        kind = F.concat(F.lit("date:"), x["order"], x["wm"].cast("string"), x["wd"].cast("string"))

        def step(s: Column, _: Column) -> Column:
            def checked(v: Column) -> Column:
                year, month = F.floor(v["l"] / months) + FIRST_YEAR, v["l"] % months + 1
                return F.struct(v["l"].alias("l"), v["r"].alias("r"), (v["r"] + first <= _days(year, month)).alias("done"))

            return F.when(s["done"], s).otherwise(_with(feistel(kind, key, s["l"], s["r"], months * YEARS, days), checked))

        start = F.struct(((x["y"] - FIRST_YEAR) * months + x["m"] - 1).cast("long").alias("l"), (x["d"] - first).cast("long").alias("r"), F.lit(False).alias("done"))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)

        def text(v: Column) -> Column:
            year = (F.floor(v["l"] / months) + FIRST_YEAR).cast("string")
            month, day = F.lpad((v["l"] % months + 1).cast("string"), x["wm"], F.lit("0")), F.lpad((v["r"] + first).cast("string"), x["wd"], F.lit("0"))
            digits = F.when(x["order"] == "ymd", F.concat(year, month, day)).when(x["order"] == "dmy", F.concat(day, month, year)).otherwise(F.concat(month, day, year))
            return F.when(v["done"], refill(m, digits))

        valid = x["order"].isNotNull() & x["y"].between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
        return F.when(valid, _with(new, text))

    return _with(F.struct(p.alias("p")), lambda x: _with(run(x), permuted))


EMAIL_DIGITS = 20  # 80 bits: two of 10**9 addresses hardly ever get one name


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lower(m)).cast("binary"), 256), 1, EMAIL_DIGITS), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match; null if it isn't valid."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(whole(DATE), _date(m, key))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(PHONE), _phone(m, key))
        .when(whole(IP), _ip(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str = "docloom", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, text with pseudonyms, n_found, n_replaced, one row per row of docs.

    A null text stays null with counts 0; a text without matches stays as it is.
    ``key`` is the secret of the permutation: the same key links equal values of
    different runs. Repeated rows are each handled.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text"))
    hit = F.expr("text rlike '[0-9@]'")
    src = src.withColumn("m", F.when(hit, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    src = src.withColumn("p", F.transform("m", lambda x: pseudonym(x, key)))
    gaps = F.split("text", ANY, -1)
    pieces = F.zip_with(gaps, F.transform(F.arrays_zip("m", "p"), lambda x: F.coalesce(x["p"], x["m"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("m") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return src.select(*[F.col(f"`{c}`") for c in keep], text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("m")).alias("n_found"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("p", lambda x: x.isNotNull()))).alias("n_replaced"))
