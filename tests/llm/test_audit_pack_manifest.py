"""The filter audit, packing and the manifest against plain computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import filter_audit, manifest, packing, ranks
from docloom.llm.store import materialize

from .test_awkward import NAMES
from .test_brute_force import WORD


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def clashing(df):
    more = [*NAMES, "mask", "parts", "part", "salt", "n", "good", "toxic", "task", "nth", "rank", "base", "length", "idx", "node", "claim", "root", "path", "all", "b0", "head", "up_id", "bucket_id", "off"]
    return df.select("*", *(F.lit("?").alias(c) for c in dict.fromkeys(more) if c not in df.columns))


# -- filter audit


def audit_rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ab", "XYZ", "É", "a b"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 99, 100, 101, 150, 300]))) for _ in range(80)]
    texts += [None, "", " \t", "#", "ABC", "É" * 100, "x" * 90 + "A" * 10, "x" * 89 + "A" * 11, "漢字 A" * 40, "w " * 50_000, " ".join(f"w{i}" for i in range(80)) + " w0" * 20, " ".join(f"w{i}" for i in range(80)) + " w0" * 21]
    texts += rng.choices(texts, k=40) + ["same text |"] * 60
    rows = [(i, rng.choice(["en", "de", None, ""]), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[1], (rows[2][0], "fr", rows[2][2]), (5, "en", "same text |"), (5, "de", "same text |"), (None, "en", "same text |"), (None, None, "only here"), (None, "en", "only here")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (10_000, 1, 1)]
    return rows, labels


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, lang, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        facts.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order, 1):
                before = set(order[: k - 1])
                here = [x for x in own if f in x[1] and not x[1] & before]
                kept = sum(not x[1] & set(order[:k]) for x in own)
                out[part, order, k] = (kept, len(here), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here))
                share[part, f] += len(here)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows, labels = audit_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audited(rows, labels)
    for d, m in ((docs, marks), (clashing(docs).repartition(7), clashing(marks))):
        got = filter_audit.audit(d, m).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want) == 4 * 600
    assert filter_audit.audit(docs.limit(0), marks).isEmpty()
    assert {r.good_lost for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_audit_matrices():
    orders, m = filter_audit.matrices()
    assert len(orders) == 120 and {k: v.shape for k, v in m.items()} == dict.fromkeys(m, (32, 600)) and all(v.dtype == np.int64 for v in m.values())
    last = np.arange(600).reshape(120, 5)[:, -1]
    assert (m["kept"][:, last].sum(axis=0) == 1).all()  # only what fails nothing is left
    assert (sum(m["removed"][:, last - k] for k in range(5)).sum(axis=1) == np.where(np.arange(32) > 0, 120, 0)).all()


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def pack_rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "naïve", "don't", "x1y2", "漢字", " ", " ", "12345", "Straße", "...", "\t", "\n\n", "", "  ", "<b>", "'s"]) for _ in range(rng.choice([0, 1, 5, 100, 700]))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a  b", "a   b", "　 x", "x <|endoftext|> y  <|endoftext|>", "<|endoftext|>", " 's", "a" * 5000, "a " * 20_000, "é" * 3000, "\x85 a", "\x1c b \x1f c"] + ["hot text"] * 200
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (3, texts[3])]


def test_segments(tokenizer):
    """Ids segment by segment are those of the whole text, also with a cache of nothing and groups of three."""
    texts = [t or "" for _, t in pack_rows()]
    coder = packing.Segments(tokenizer.to_str())
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limit, group in ((packing.CACHE, packing.GROUP), (0, 3)):
        keep = packing.CACHE, packing.GROUP
        packing.CACHE, packing.GROUP = limit, group
        try:
            some = texts if group > 3 else texts[:40]
            ids, n = coder.encode(np.frombuffer(b"".join(raw[: len(some)]), np.uint8), off[: len(some) + 1])
        finally:
            packing.CACHE, packing.GROUP = keep
        cut = np.split(ids, np.cumsum(n)[:-1])
        assert [c.tolist() for c in cut] == want[: len(some)]


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(spark, tokenizer, capacity):
    rows = pack_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    want = []
    for i, ids in whole:
        lead = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(lead, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])), tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = packing.pack(clashing(docs), capacity=capacity)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=str) == sorted(want, key=str)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for slots in used.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(len(x) for _, x in whole)
    assert len(used) == best_fit(Counter(n for *_, n, _, _ in want), capacity) <= 1 + 11 * -(-total // capacity) / 9
    seqs = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(seqs) == len(used) and sum(len(r.ids) for r in seqs.values()) == total
    assert all(tuple(seqs[r.sequence_id].ids[r.offset : r.offset + r.length]) == tuple(r.ids) for r in got)
    plain = packing.pack(docs, capacity=capacity, with_ids=False)
    assert "ids" not in plain.columns and plain.count() == len(got)
    assert packing.pack(docs.limit(0), capacity=capacity).isEmpty()


def best_fit(counts, capacity):
    """Sequences that best fit takes piece by piece, longest first."""
    left = []
    for n in sorted(counts.elements(), reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        i = min(fits, key=lambda i: left[i], default=None)
        if i is None:
            left.append(capacity - n)
        else:
            left[i] -= n
    return len(left)


def test_plan():
    rng = random.Random(7)
    for capacity in (1, 2, 7, 32, 64):
        for _ in range(30):
            counts = Counter({n: rng.choice([0, 1, 2, 3, 40]) for n in range(1, capacity + 1)})
            rows = packing.plan(counts, capacity)
            used = defaultdict(list)
            for length, first, n, each, seq, offset in rows:
                for k in range(n):
                    used[seq + k // each].append((offset + k % each * length, length))
            for slots in used.values():
                at = 0
                for o, n in sorted(slots):
                    assert o == at
                    at += n
                assert at <= capacity
            assert Counter(n for x in used.values() for _, n in x) == +counts and len(used) == best_fit(counts, capacity)
            for n in +counts:  # ranks without gaps
                at = 0
                for _, first, k, *_ in sorted(r for r in rows if r[0] == n):
                    assert first == at
                    at += k
    big = packing.plan({n: rng.randrange(1, 10**9) for n in range(1, 1025)})
    assert len(big) <= 3 * 1024 * 10


# -- manifest


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def up(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def proved(rows, fanout):
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(r)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for p in order:
        parts[p].sort(key=lambda r: (-(2**63) if r[0] is None else r[0], leaf(*r)))
        trees[p] = up([leaf(*r) for r in parts[p]], fanout)
    top = up([trees[p][-1][0] for p in order], fanout)
    out = []
    for at, p in enumerate(order):
        for i, r in enumerate(parts[p]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, proof = leaf(*r[:3], r[3] + 1, r[4]) if bad else leaf(*r), ""
            for tree, k in ((trees[p], i), (top, at)):
                for level in tree[:-1]:
                    a = k - k % fanout
                    before, behind = "".join(level[a:k]), "".join(level[k + 1 : a + fanout])
                    node, proof, k = sha(before + node + behind), proof + before + behind, k // fanout
            out.append((r[0], leaf(*r), trees[p][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(11)
    ids = [*range(60), -5, 2**63 - 1, -(2**63), 2**40, 2**40 + 1, *(rng.randrange(2**62) for _ in range(30))]
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice(["en", "en", "de", "", None, "ß", "z" * 30, "z" * 30 + "a"]), rng.choice([None, 5, 9]), rng.choice(["t", "", None, "漢字", "x" * 10_000])) for i in ids]
    rows += [(7, "s", "fr", 1, "lone")] + [(3, "s", "en", 4, "again")] * 40 + [(3, "s", "en", k, "tie") for k in range(9)] + [(None, "s", "en", 4, f"{k % 5}") for k in range(20)]
    return rows


@pytest.mark.parametrize(("fanout", "run", "limit"), [(2, 1024, 8192), (2, 4, 3), (3, 9, 2)])
def test_manifest(spark, monkeypatch, fanout, run, limit):
    rows = manifest_rows()
    monkeypatch.setattr(manifest, "RUN", run)
    monkeypatch.setattr(manifest, "ranked", lambda *a: ranks.ranked(*a, limit=limit))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    got = manifest.prove(docs, manifest.tampered_leaf(), fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(proved(rows, fanout), key=str)
    assert got == want and {r[-1] for r in got} == {True, False}


def test_manifest_small(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.prove(spark.createDataFrame([], kind)).isEmpty()
    one = manifest.prove(spark.createDataFrame([(1, None, None, None, None)], kind)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1----") and one.proof_sha256 == sha("") and one.verified


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_ranks(spark, limit):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([rng.randrange(50), rng.randrange(2**62), -rng.randrange(2**63), 7]), rng.randrange(3), k) for k in range(400)]
    df = materialize(spark.createDataFrame(rows, "g string, a long, b long, c long"), "rows")
    got = ranks.ranked(df, "g", ["a", "b", "c"], ["a", "b", "c"], limit=limit).collect()
    want = {}
    for g in "abc":
        own = sorted(r[1:] for r in rows if r[0] == g)
        want |= {(g, *r): (i, len(own)) for i, r in enumerate(own)}
    assert {(r.g, r.a, r.b, r.c): (r["rank"], r["size"]) for r in got} == want
