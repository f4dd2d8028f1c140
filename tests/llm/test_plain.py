"""Whole queries and pipeline stages against plain computations on the given tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import pii, queries, toxicity, words

from .test_brute_force import WORD, by_hand

# Pseudonyms ------------------------------------------------------------------------------------


def feistel(key, kind, left, right, a, b):
    for i in range(pii.ROUNDS):
        noise = lambda x: int(hashlib.sha256(f"{key}:{kind}:{a}:{b}:{i}:{x}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + noise(right)) % a
        else:
            right = (right + noise(left)) % b
    return left, right


def digits(key, kind, d):
    a = len(d) // 2
    x, y = feistel(key, kind, int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a))
    return f"{x:0{a}}{y:0{len(d) - a}}"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10


def refill(pattern, new):
    rest = iter(new)
    return "".join(next(rest) if c in "0123456789" else c for c in pattern)


def month_days(y, m):
    return [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]


def date(m, key):
    p = re.split("[./-]", m)
    iso = len(p[0]) == 4
    y = int(p[0] if iso else p[2])
    for order, (mo, d) in (("ymd", (p[1], p[2])),) if iso else (("dmy", (p[1], p[0])), ("mdy", (p[0], p[1]))):
        if 1 <= int(mo) <= 12 and 1 <= int(d) <= month_days(y, int(mo)):
            break
    else:
        return None
    if not 1800 <= y < 2200:
        return None
    months, first = (9 if len(mo) == 1 else 12), (13 if order == "mdy" else 1)
    days = 19 if order == "mdy" else 9 if len(d) == 1 else 31
    x, r = (y - 1800) * months + int(mo) - 1, int(d) - first
    for _ in range(pii.WALK):
        x, r = feistel(key, f"date:{order}{len(mo)}{len(d)}", x, r, months * 400, days)
        ny, nm, nd = x // months + 1800, x % months + 1, r + first
        if nd <= month_days(ny, nm):
            a, b = f"{nm:0{len(mo)}}", f"{nd:0{len(d)}}"
            return refill(m, {"ymd": f"{ny}{a}{b}", "dmy": f"{b}{a}{ny}", "mdy": f"{a}{b}{ny}"}[order])
    return None


def pseudonym(m, key):
    whole = lambda p: re.fullmatch(p, m, re.A)
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "u" + hashlib.sha256(f"{key}:{m.lower()}".encode()).hexdigest()[:20] + "@" + m.rpartition("@")[2]
    if whole(pii.DATE):
        return date(m, key)
    if whole(pii.SSN):
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        x, y = feistel(key, "ssn", a - (2 if a > 666 else 1), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        return f"{x + (2 if x + 1 >= 666 else 1):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if whole(pii.PHONE):
        if len(d) == 10 or (len(d) == 11 and d[0] == "1"):
            a, e, n = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
            if a < 200 or e < 200:
                return None
            x, y = feistel(key, "phone", a - 200, (e - 200) * 10000 + n, 800, 8_000_000)
            return refill(m, d[:-10] + f"{x + 200}{y // 10000 + 200}{y % 10000:04}")
        return refill(m, d[:-10] + digits(key, "phone", d[-10:]))
    if whole(pii.IP):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        x, y = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if luhn(d):
        return None
    body = d[0] + digits(key, "card", d[1:-1])
    return refill(m, body + str(-luhn(body + "0") % 10))


def pseudonymised(text, key):
    found, done = re.findall(pii.ANY, text, re.A), 0

    def put(m):
        nonlocal done
        new = pseudonym(m[0], key)
        done += new is not None
        return m[0] if new is None else new

    return re.sub(pii.ANY, put, text, flags=re.A), len(found), done


def test_pseudonyms_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: pseudonymised(r.text or "", "docloom") for r in docs.collect()}
    got = {r.doc_id: (r.text or "", r.n_found, r.n_replaced) for r in queries.op9_pii(spark, sf_dir).collect()}
    assert got == want and sum(w[2] for w in want.values()) > 10


def test_pseudonyms_of_awkward_values(spark):
    texts = [
        "3/4/2021 03/04/2021 12/31/2020 1.2.1999 13/1/2000 9/30/2001", "29.02.2000 29.02.1900 1799-12-31 2199-12-31 2200-01-01 0000-00-00", "(123) 456-7890 +1 200-200-0000 +48 123-456-7890 +12 000.000.0000 (999) 999-9999",
        "666-12-3456 899-99-9999 001-01-0001 900-11-1111", "0.0.0.0 255.255.255.255 1.2.3 1.2.3.4.5", "A.B@c.d a@b x@y.z1", "4111-1111-1111-1111 0000000000000 " + "1" * 19,
        "é1990-01-01漢 " * 3,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_found, r.n_replaced) for r in pii.pseudonymise(docs, "k").collect()}
    assert got == {i: pseudonymised(t, "k") for i, t in enumerate(texts)}


@pytest.mark.parametrize("form", ["{m}/{d}/2021", "{m:02}.{d:02}.2021", "{d}.{m:02}.2020"])
def test_dates_of_a_form_are_permuted(spark, form):
    """All dates of a year in one form: pseudonyms differ, have the form, and month-first ones stay so."""
    texts = sorted({form.format(m=m, d=d) for m in range(1, 13) for d in range(1, month_days(2020, m) + 1)})
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    assert got == [date(t, "k") or t for t in texts] and len(set(got)) == len(got)
    assert all([len(p) for p in re.split("[./]", a)] == [len(p) for p in re.split("[./]", b)] for a, b in zip(texts, got, strict=True))


# Toxicity --------------------------------------------------------------------------------------


def scored(model, text):
    """Score and spans by one pass of forward sums and one of backward sums."""
    raw = (text or "").encode()
    low = np.frombuffer(raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))), np.uint8)
    at = [m.span() for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
    s, e = (np.array([x[i] for x in at], np.int64) for i in (0, 1))
    if len(at):
        feats = [words.word_hashes(low, s, e)] + [words.mix(words.word_hashes(low, s, np.minimum(e, s + k)) + np.uint64(k)) for k in toxicity.PREFIXES]
        weight = lambda f: float(model["w"][f >> 64 - toxicity.BITS]) if model["mark"][f >> 64 - toxicity.BITS] == f & 0xFFFFFFFF else 0.0
        emission = [model["bias"] + sum(weight(int(f)) for f in of) for of in zip(*feats, strict=True)]
    else:
        emission = []
    m = np.exp(model["trans"])
    ahead, back = [], [np.ones(2)]
    for x in emission:
        y = np.array([1, math.exp(min(max(x, -30), 30))])
        f = y if not ahead else (ahead[-1] @ m) * y
        ahead.append(f / f.sum())
    for x in reversed(emission[1:]):
        b = m @ (np.array([1, math.exp(min(max(x, -30), 30))]) * back[-1])
        back.append(b / b.sum())
    p = [f[1] * b[1] / (f @ b) for f, b in zip(ahead, back[::-1], strict=False)]
    top = min(max(max(p, default=0), 1e-4), 1 - 1e-4)
    spans = []
    for (a, z), q in zip(at, p, strict=True):
        if q >= 0.5:
            a, z = len(raw[:a].decode(errors="ignore")), len(raw[:z].decode(errors="ignore"))
            if spans and a - spans[-1][1] <= 1:
                spans[-1][1] = z
            else:
                spans.append([a, z])
    return 1 / (1 + math.exp(-(np.array([1, math.log(top / (1 - top)), math.log1p(sum(p))]) @ model["top"]))), spans


def the_model(docs, spark, sf_dir):
    return toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def test_scores_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = the_model(docs, spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_toxicity(spark, sf_dir).collect():
        score, spans = scored(model, texts[r.doc_id])
        assert abs(r.score - score) < 1e-6 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert [[x.start, x.end] for x in r.spans] == spans


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + 40 * (i == 3))) for i in range(8)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels, max_bytes=1 << 20)
    assert set(whole) == set(toxicity.fit(docs, labels, max_bytes=30)) == set(toxicity.fit(docs, labels, max_bytes=0))


# Pipeline --------------------------------------------------------------------------------------


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def leaks(text, items):
    d = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    for b in items:
        size = min(len(b), 13)
        if size < 5 or len(d) < size:
            continue
        least, where = (size if len(b) < 9 else -(-size * 4 // 5)), {}
        for j, w in enumerate(b):
            where.setdefault(w, []).append(j)
        diagonals = {}
        for i, w in enumerate(d):
            for j in where.get(w, ()):
                diagonals.setdefault(i - j, []).append(j)
        for shift, hits in diagonals.items():
            hits = sorted(hits)
            for lo in {max(0, -shift), *(h - size + 1 for h in hits)}:
                if lo >= 0 and lo + shift >= 0 and lo + size <= len(b) and lo + shift + size <= len(d) and sum(lo <= h < lo + size for h in hits) >= least:
                    return True
    return False


def test_every_stage_by_hand(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        texts = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, texts, rows)
        docs = rows
    kept = {name: sorted(r.doc_id for r in x[2].select("doc_id").collect()) for name, x in seen.items()}
    source, texts, _ = seen["toxicity"]
    model = the_model(source, spark, sf_dir)
    assert kept["toxicity"] == sorted(i for i, t in texts.items() if scored(model, t)[0] < 0.7)
    _, texts, _ = seen["exact dedup"]
    best = {}
    for i, t in texts.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    assert kept["exact dedup"] == sorted(i for _, i in best.values())
    _, texts, _ = seen["n-gram Jaccard join"]
    assert kept["n-gram Jaccard join"] == sorted(set(near_groups(texts).values()))
    _, texts, _ = seen["benchmark decontamination"]
    items = [WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert kept["benchmark decontamination"] == sorted(i for i, t in texts.items() if not leaks(t, items)) != sorted(texts)
    source, texts, mixed = seen["mixing"]
    sources = {r.doc_id: r.source for r in source.collect()}
    weight, times = by_hand([(i, sources[i], len(WORD.findall(t or ""))) for i, t in texts.items()], 2.0, 1_000_000)
    many = {}
    for r in mixed.collect():
        many[r.doc_id] = many.get(r.doc_id, 0) + 1
        assert abs(r.weight - weight[sources[r.doc_id]]) < 1e-6
    assert many.keys() == times.keys() and all(times[i][0] <= n <= times[i][1] for i, n in many.items())


def test_rows_with_one_id_are_told_apart(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, a), (1, a + " more"), (1, b), (2, c), (2, c + " more"), (None, a + " other"), (None, "alone"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("clash")).withColumn("component_id", F.lit(1))
    out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got in (sorted([(0, a), (1, b), (2, x), (None, "alone"), (None, None), (3, None)], key=str) for x in (c, c + " more"))
