"""Each operator against a plain computation on small tables with nulls, empty texts, ties and repeats."""

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, decontaminate, exact_dedup, mixing, ngram_join, pii, queries, substring_dedup, token_count, toxicity, url_filter, warc

from ..conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 13, 14, 40, 80]))) for _ in range(n)]
    base = rng.choices(vocab, k=60)
    for _ in range(40):  # near copies of one text, some too far off
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    passage = " ".join(rng.choices(vocab, k=20))
    texts += [t + "\n" + passage + "\t" + u for t, u in zip(texts[:15], texts[15:30], strict=True)]
    texts += [None, "", "  \n", "Ä é 漢字 " * 3, "a\x0bb", texts[5], texts[5], "x " * 30_000]
    return list(enumerate(texts))


def frame(spark, rows):
    """With further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit(1).alias("cls"), F.lit("q").alias("h"), F.lit(2.0).alias("score"), F.lit("s").alias("row"), F.lit("en").alias("lang"), F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "b").otherwise("a").alias("source"))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def test_jaccard_groups(spark, docs):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted((i, len(s), find(i)) for i, s in sets.items())
    for bits in (64, 3):  # with three bits all sets share their first hash with others
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, class_bits=bits).collect()) == want
    assert len({w[2] for w in want}) < len(want) - 10


def test_divide_skip():
    rng = np.random.default_rng(3)
    for _ in range(60):
        q = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        t = rng.integers(1, 25, len(sets))
        assert ngram_join.divide_skip(q, sets, t).tolist() == [len(set(q.tolist()) & set(s.tolist())) >= k for s, k in zip(sets, t, strict=True)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_remove_repeats(spark, docs):
    rows = corpus()
    least = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][j : j + 13]), i)
    want = []
    for i, w in words.items():
        gone = {k for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    spread = docs.repartition(7, "text").sortWithinPartitions(F.desc("doc_id"))  # many tasks, each in falling order
    # A full filter changes nothing, nor does it whether anchors are extended or their windows are dealt one by one.
    for table, bits, hot in ((docs, 26, 4096), (docs, 9, 4096), (spread, 26, 1 << 40), (spread, 26, 0), (spread, 26, 5)):
        got = substring_dedup.remove_repeats(table, 13, log2_bits=bits, with_text=True, hot=hot).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == sorted(want)


def test_windows_of_one_anchor_are_told_apart(spark):
    """Different windows with the same least anchor, in pairs whose hashes agree in 40 bits."""
    anchor = " w35 w84 w225 w189 w234 w242"
    heads = ["w247 w286 w249 w183 w174 w231 w282", "w290 w140 w20 w55 w264 w167 w245", "w211 w87 w121 w58 w149 w194 w109", "w126 w219 w104 w273 w45 w4 w236", "w122 w53 w85 w262 w114 w115 w72", "w245 w266 w104 w63 w265 w152 w134"]
    rows = [(i, x + anchor) for i, x in enumerate([*heads, heads[0]])]
    for n, hot in ((1, 1 << 40), (7, 1 << 40), (1, 0), (7, 0)):  # windows meet in a task, or in the shuffle
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs, 13, hot=hot).collect()) == [(i, 13 * (i == 6)) for i in range(7)]
    h, d, a = np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 3, 4]), np.array([1, 3, 1, 3], np.uint64)
    assert substring_dedup.later(h, a, d).tolist() == [False, False, True, True]


def test_extension_decides(spark):
    """Texts around one shared gram: how far they agree to both sides, with different partners on each, is what counts."""
    core = "c1 c2 c3 c4 c5 c6 c7"
    left, right = [f"l{i}" for i in range(9)], [f"r{i}" for i in range(9)]
    shapes = [(9, 0), (0, 9), (3, 3), (2, 3), (9, 9), (3, 9), (9, 3), (1, 5), (6, 0), (5, 0)]
    rows = [(i, " ".join([*(f"u{i}x{j}" for j in range(9 - a)), *left[9 - a :], core, *right[:b], *(f"v{i}x{j}" for j in range(9 - b))])) for i, (a, b) in enumerate(shapes)]
    words = {i: t.split() for i, t in rows}
    least = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][j : j + 13]), i)
    want = [(i, len({k for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < i for k in range(j, j + 13)})) for i, w in words.items()]
    assert 0 < sum(n > 0 for _, n in want) < len(want) - 2
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs, 13, hot=1 << 40).collect()) == want


def test_partial_aggregation_of_windows():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        h, d = rng.integers(0, 9, size).astype(np.uint64), rng.integers(0, 7, size)
        own = {}
        for x, y in zip(h.tolist(), d.tolist(), strict=True):
            own.setdefault(x, []).append(y)
        assert substring_dedup.later(h, h, d).tolist() == [y > min(own[x]) for x, y in zip(h.tolist(), d.tolist(), strict=True)]
        got = sorted(zip(*(x.tolist() for x in substring_dedup.ends_of(h, d)), strict=True))
        assert [x[:2] for x in got] == sorted({(x, y) for x, ys in own.items() for y in (min(ys), max(ys))})
        assert {x: sum(n for z, _, n in got if z == x) for x in own} == {x: len(ys) for x, ys in own.items()}
    d, p, n = substring_dedup.runs_of(np.array([2, 1, 2, 2, 1]), np.array([4, 0, 3, 9, 1], np.int32))
    assert list(zip(d.tolist(), p.tolist(), n.tolist(), strict=True)) == [(1, 0, 2), (2, 3, 2), (2, 9, 1)]
    parts = [(np.arange(3), np.arange(3)), (np.arange(4), np.arange(4)), (np.arange(1), np.arange(1))]
    assert [len(x[0]) for x in substring_dedup.gathered(iter(parts), 5)] == [7, 1]


def test_exact_groups(spark, docs):
    groups = {}
    for i, t in corpus():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    twice = exact_dedup.exact_groups(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.group_size, r.kept) for r in twice) == [(1, True), (3, False), (3, False), (3, True)]


def test_overlaps(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 6, 10, 13, 30, 50])))) for k in range(30)] + [(99, None)]
    rows = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.choice([0, 5, 20, 60]))
        if i % 2:
            item = WORD.findall(items[i % 30][1])
            part = item[: rng.choice([len(item), 13, 20])]
            for _ in range(rng.choice([0, 1, 2, 3])):
                part[rng.randrange(len(part))] = "zz"
            w[3:3] = [x.upper() for x in part]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, "")]
    want = set()
    for i, t in rows:
        d = WORD.findall((t or "").lower())
        for k, text in items:
            b = WORD.findall(text or "")
            size = min(len(b), 13)
            if size < 5:
                continue
            least = size if len(b) < 9 else -(-size * 8 // 10)
            hit = any(sum(x == y for x, y in zip(d[p : p + size], b[q : q + size], strict=True)) >= least for p in range(len(d) - size + 1) for q in range(len(b) - size + 1))
            want |= {(i, k)} if hit else set()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("overlaps", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):  # sent to the tasks, and joined
        got = decontaminate.overlaps(docs, bench, ["doc_id"], max_bytes=most).select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.item_id").collect()
        got = {tuple(r) for r in got}
        assert got <= want
        assert {w for w in want if dict(items)[w[1]].count(" ") not in range(8, 12)} <= got  # items of 9 to 12 words have no guarantee with substitutions
    assert decontaminate.overlaps(docs, bench.limit(0), ["doc_id"]).filter("size(overlaps) > 0").isEmpty()


def test_overlaps_of_short_items(spark):
    """Items of 9 to 12 words with every allowed substitution; rows without doc_id and with a repeated one."""
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(9, 13)]
    rows, want = [], []
    for n, text in items:
        for many in range(4):
            for bad in itertools.combinations(range(n), many):
                w = ["no" if j in bad else x for j, x in enumerate(text.split())]
                k = len(rows)
                rows.append((None if k % 3 == 0 else 7 if k % 3 == 1 else k, k, " ".join(["a", "b", *w, "c"])))
                want += [(k, n, 2, 0, n, n - many)] if 5 * many <= n else []
    docs = spark.createDataFrame(rows, "doc_id long, key long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 0):
        got = decontaminate.overlaps(docs, bench, ["doc_id", "key"], max_bytes=most)
        assert sorted(r.key for r in got.collect()) == list(range(len(rows)))
        assert sorted(tuple(r) for r in got.select("key", F.explode("overlaps").alias("o")).select("key", "o.*").collect()) == want


def test_masks_hit_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(all(o + p not in bad for p, b in enumerate(m) if b == "1") for m in decontaminate.MASKS for o in range(5))


def test_token_counts(spark, docs):
    vocab = ["▁", "▁a", "▁ab", "a", "b", "ab", "abc", "abcd", "cde", "bc", "w1", "▁w", "12", "3", "漢", "xyzxyz"]
    known = set(vocab)

    def greedy(word):
        s, n = "▁" + word, 0
        while s:
            k = next((k for k in range(len(s), 0, -1) if s[:k] in known), 0)
            n, s = (n + 1, s[k:]) if k else (n + len(s[0].encode()), s[1:])
        return n

    auto = token_count.Automaton(vocab)
    rng = random.Random(6)
    for _ in range(2000):
        w = "".join(rng.choices("abcdexyz123w漢é", k=rng.randrange(0, 12)))
        assert auto.count("▁" + w) == greedy(w)
    want = sorted((i, len(ws), sum(map(greedy, ws))) for i, t in corpus() for ws in [WORD.findall(t or "")])
    assert sorted(tuple(r) for r in token_count.count_tokens(docs, vocab).collect()) == want


def test_marginals_and_training():
    rng = np.random.default_rng(7)
    first = np.array([0, 0, 3, 10, 210, 211])
    s, tr = rng.normal(0, 2, 211), rng.normal(0, 1, (2, 2))
    p = toxicity.marginals(s, first, tr)
    r, back = toxicity.ratios(s, first, tr)
    pairs = toxicity.pair_marginals(r[:-1], (np.exp(s) * back)[1:], tr)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e, m = [np.array([1, np.exp(x)]) for x in s[a:b]], np.exp(tr)
        f, g = [], [np.ones(2)]
        for k, x in enumerate(e):
            v = x if k == 0 else (f[-1] @ m) * x
            f.append(v / v.sum())
        for x in e[:0:-1]:
            v = m @ (x * g[-1])
            g.append(v / v.sum())
        for k, (x, y) in enumerate(zip(f, g[::-1], strict=True)) if b > a else ():
            assert abs(p[a + k] - x[1] * y[1] / (x @ y)) < 1e-9
        for k in range(b - a - 1):
            q = np.outer(f[k], e[k + 1] * g[::-1][k + 1]) * m
            assert np.allclose(pairs[:, a + k], (q / q.sum()).ravel(), atol=1e-9)
    r = random.Random(8)
    texts = [" ".join(r.choices([f"q{chr(97 + i)}{chr(97 + j)}x" for i in range(9) for j in range(9)], k=50)) for _ in range(300)]
    labels = [int(i % 3 == 0) for i in range(300)]
    texts = [t + (" badword foo evil" if y else "") for t, y in zip(texts, labels, strict=True)]
    model = toxicity.train(texts[:200], labels[:200])
    raw = [t.encode() for t in [*texts[200:], ""]]
    score, _, spans, _ = toxicity.score_batch(model, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert ((score[:-1] >= 0.7) == (np.array(labels[200:]) == 1)).mean() > 0.97 and score[-1] < 0.5
    assert any("badword" in texts[200 + i][x["start"] : x["end"]] for i in range(100) for x in spans[i])


def test_url_filter(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "q.net", "", "A.Com"]
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?x#y', '?q=/en/', '#f'])}") for i in range(300)] + [(900, None), (901, "nothing"), (902, "://")]
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("allow", "net", "/"), ("block", "", "/en/71"), ("block", "b.a.com", "")]
    want = {}
    for i, u in urls:
        rest = (u or "").partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want[i] = (host, path, best[2] if best else None, best[3] if best else "allow")
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("key", F.lit(1))
    for most in (100, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, max_rules=most).collect()}
        assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_warc_round_trip(spark, tmp_path):
    big = ("x" * 3000 + "\n") * 40 + "é"
    solid = "0a\r" * 14_000  # no line feed at all, and what looks like a chunk's size
    rows = [(20, "u", solid), (21, "u", solid), (22, "u", "é" * 5000), (23, "u", "x" * 10_000), (24, "u", "\n" * 10_001), (5, "http://a/ b\n", "one"), (3, None, "one"), (4, "u", None), (1, "u", ""), (7, "u", big), (9, "u", big), (11, "u", "a\r\n\r\nWARC/1.1\r\n\n"), (12, "u", "\n"), (13, "u", "no end\n\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"), chunk=10_000)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"), chunk=10_000)
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted(tuple(r) for r in warc.records(chunks).collect()) == want
    parts = sorted((r.record_id, r.chunk_no, bytes(r.data)) for r in chunks.filter("record_type = 'response'").collect())
    assert max(len(p[2]) for p in parts) <= 20_000
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "w"))
    assert lines.agg(F.max(F.octet_length("value"))).first()[0] <= 10_600
    back = {k: b"".join(x[2] for x in g) for k, g in itertools.groupby(parts, key=lambda p: p[0])}
    assert {int(k.rpartition(":")[2]): v.decode() for k, v in back.items()} == {first[h or ""]: h or "" for _, _, h in rows}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["Call +1 (377) 555-0271 or mail und.34@mail7.example.com now.", "card 4111 1111 1111 1111, not 4111111111111112", "ip 10.0.0.255 not 10.0.0.256, 1.2.3.4.", "born 1990-02-28 and 31/12/2020; never 2020-02-31", "ssn 123-45-6789 but 000-12-3456", "again 4111111111111111 and 10.0.0.255", None, "", "nothing 12 here", "é" * 50 + " 1990-02-28"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("m", F.lit(1))
    got = [r for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    out = [r.text for r in got]
    assert out[6] is None and out[7] == "" and out[8] == texts[8]
    assert [r.n_replaced for r in got] == [2, 1, 2, 2, 1, 2, 0, 0, 0, 1]
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or mail u[0-9a-f]{20}@mail7\.example\.com now\.", out[0]) and "377" not in out[0]
    card = re.search(r"card ((?:\d{4} ){3}\d{4}), not 4111111111111112", out[1])[1].replace(" ", "")
    assert luhn(card) and card != "4111111111111111" and card in out[5]
    assert re.search(r"and ([\d.]+)$", out[5])[1] in out[2] and "10.0.0.256" in out[2]
    assert re.search(r"born (\S+) and", out[3])[1] == out[9][51:] and out[3].endswith("2020-02-31")
    assert out[4].endswith("000-12-3456")
    again = pii.pseudonymise(docs, "other").collect()
    assert sorted(r.text or "" for r in again) != sorted(x or "" for x in out)


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(27 * 50).select((F.col("id") % 27).alias("l"), F.floor(F.col("id") / 27).alias("r"))
    out = pairs.select(pii.feistel("date", "k", F.col("l"), F.col("r"), F.lit(27), F.lit(50)).alias("s")).select("s.*").distinct()
    assert out.count() == 27 * 50 and not out.filter("l < 0 or l >= 27 or r < 0 or r >= 50").count()


def test_exponents():
    def bisect(tokens, **goal):
        shares = np.array([t for t in tokens if t]) / sum(tokens)
        moments = lambda xs: [((shares**a).sum(), (shares**a * np.log(shares)).sum()) for a in xs]
        return mixing.bisect_exponent(moments, sum(tokens), min(t for t in tokens if t), max(tokens), **goal), shares

    a, shares = bisect([900.0, 50, 50, 0], repetition_limit=3.0)
    w = shares**a / (shares**a).sum()
    passes = w / shares
    assert abs((passes / passes.min()).max() - 3) < 1e-6
    a, shares = bisect([900.0, 50, 50, 0], target_entropy=1.0)
    w = shares**a / (shares**a).sum()
    assert abs(-(w * np.log(w)).sum() - 1) < 1e-6
    a, shares = bisect([900.0, 90, 10], repetition_limit=4.0, budget=1000.0)
    w = shares**a / (shares**a).sum()
    assert abs((w * 1000 / (shares * 1000)).max() - 4) < 1e-6
    assert bisect([5.0, 5.0], repetition_limit=2.0)[0] == 0.0 and bisect([9.0, 1.0])[0] == 1.0


def by_hand(rows, limit, block_tokens):
    """Without a budget: weights, and how often each document comes, at least and at most. rows: id, source, tokens."""
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    some = [t for t in size.values() if t]
    lo, hi = 0.0, 1.0  # the smallest exponent whose smallest source has at most limit passes
    if some and (max(some) / min(some)) > limit:
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (max(some) / min(some)) ** (1 - mid) > limit else (lo, mid)
    else:
        hi = 0.0
    z = sum((t / sum(some)) ** hi for t in some)
    weight = {s: (t / sum(some)) ** hi / z if t else 0.0 for s, t in size.items()}
    passes = {s: (max(some) / t) ** (1 - hi) if t else 1.0 for s, t in size.items()}
    return weight, {i: ((1, 1) if not n else (int(passes[s] + 1e-9), math.ceil(passes[s] - 1e-9))) for i, s, n in rows}


@pytest.mark.parametrize("case", ["mixed", "bare", "one bare source", "one row", "repeated"])
def test_mix_by_hand(spark, case):
    """Every copy by a plain computation: which come, how often, what they weigh; every block is a permutation."""
    rng = random.Random(11)
    rows = {
        "mixed": [(i, rng.choice("abc") if i % 4 else None, rng.choice([0, 0, 1, 5, 30])) for i in range(400)],
        "bare": [(i, "a", 0) for i in range(50)],
        "one bare source": [(0, "a", 3), *((i, "a", 0) for i in range(1, 10)), *((i, "b", 0) for i in range(10, 20))],
        "one row": [(7, None, 4)],
        "repeated": [(1, "a", 2), (1, "a", 2), (1, "b", 9), (None, "b", 0), (None, "b", 0)],
    }[case]
    docs = spark.createDataFrame([(i, " ".join(["x"] * n) if n else (None if k % 2 else " \n"), s) for k, (i, s, n) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(docs.withColumn("u", F.lit(1)).withColumn("bucket", F.lit(2)), repetition_limit=2.0, block_tokens=100).collect()
    keyed = [((k,), s, n) for k, (_, s, n) in enumerate(rows)]
    weight, times = by_hand(keyed, 2.0, 100)
    want = {}
    for k, (i, s, n) in enumerate(rows):
        low, high = times[(k,)]
        a, b = want.get((i, s, n), (0, 0))
        want[i, s, n] = (a + low, b + high)
    seen = {}
    for r in got:
        seen[r.doc_id, r.source, r.n_tokens] = seen.get((r.doc_id, r.source, r.n_tokens), 0) + 1
        assert abs(r.weight - weight[r.source]) < 1e-6
    assert seen.keys() == want.keys() and all(want[k][0] <= n <= want[k][1] for k, n in seen.items())
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())
    assert case != "mixed" or len({r.block for r in got if not r.n_tokens}) > len(blocks) // 2


def test_mix(spark, docs):
    rows = {i: len(WORD.findall(t or "")) for i, t in corpus()}
    got = mixing.mix(docs.filter("doc_id < 170"), repetition_limit=2.0, block_tokens=2000).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.epoch), []).append(r)
        assert rows[r.doc_id] == r.n_tokens
    assert {r.doc_id for r in got} == set(range(170))  # every document at least once
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got) and max(r.epoch for r in got) <= 2
    size = {s: sum(v for i, v in rows.items() if i < 170 and (None if i % 5 == 0 else "b" if i % 3 == 0 else "a") == s) for s in (None, "a", "b")}
    total = sum(r.n_tokens for r in got)
    weight = {r.source: r.weight for r in got}
    longest = max(rows[i] for i in range(170))
    least = {s: weight[s] / size[s] for s in size}
    budget = 1 / min(least.values())
    for s in size:
        assert -1e-3 <= sum(r.n_tokens for r in got if r.source == s) - weight[s] * budget < longest + 1e-3
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values()) and len(blocks) == -(-int(total) // 2000) or abs(len(blocks) - total / 2000) < 2
    cut = mixing.mix(docs.filter("doc_id < 170"), repetition_limit=None, budget=1000.0).collect()
    assert 1000 <= sum(r.n_tokens for r in cut) < 1000 + 3 * longest


def test_empty_tables(spark):
    none = frame(spark, []).select("doc_id", "text", "source", "lang")
    assert ngram_join.jaccard_groups(none).isEmpty() and substring_dedup.remove_repeats(none, 13).isEmpty() and exact_dedup.exact_groups(none).isEmpty()
    assert mixing.mix(none).isEmpty() and token_count.count_tokens(none, ["a"]).isEmpty() and pii.pseudonymise(none).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, queries.RULES).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    got = duck.sql(queries.ORACLES[name])
    same_rows(df.collect(), df.columns, got.fetchall(), got.columns)
