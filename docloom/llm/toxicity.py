"""Toxicity by a linear-chain conditional random field with two states.

Training runs in one task on a bounded sample of labelled documents, so the driver gets the model and no text
(``max_toxic``, ``max_clean`` and ``max_bytes`` are its documented bounds). Document labels are
turned into token labels first: in toxic documents, tokens with a word or prefix
that is far more frequent among toxic than among clean documents count as toxic.
Near copies inside the sample are left out, as they would make every word of a
copied text look typical. The field's emissions are sums of weights of the word
and its prefixes; forward-backward marginals give the spans, and a small
logistic layer over the marginals gives the document's score.

Scoring is one pass over the texts without a shuffle; the model has a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize
from .words import LOWER, NOT_LETTER, U, gram_hashes, mix, owners, slices, spans, text_bytes, word_hashes

BITS = 20  # of the table of weights
PREFIXES = (3, 4, 5, 6)
SEGMENT = 64
NEAR = 1 << 20  # bytes of text scored at once
BLOCK = 1 << 17  # tokens of the sample worked off at once in training
OUT = "score double, n_tokens long, n_toxic_tokens long, spans array<struct<start:int,end:int>>"


def tokens(data: np.ndarray, off: np.ndarray):
    """Runs of letters, A-Z lower-cased: starts, ends, first token of each text, hashes of features (one row per kind, the word first)."""
    low = LOWER[data]
    starts, ends, first = spans(low, off, NOT_LETTER)
    feats = [word_hashes(low, starts, ends)]
    feats += [mix(word_hashes(low, starts, np.minimum(ends, starts + k)) + U(k)) for k in PREFIXES]
    return starts, ends, first, np.stack(feats)


def table_of(names: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by the upper bits of a feature's hash, with its lower ones to tell it; of two at one place the heavier stays."""
    order = np.argsort(np.abs(w), kind="stable")
    at = (names[order] >> U(64 - BITS)).astype(np.int64)
    out = {"w": np.zeros(1 << BITS, np.float32), "mark": np.zeros(1 << BITS, np.uint32)}
    out["w"][at], out["mark"][at] = w[order], names[order].astype(np.uint32)
    return out


def weights(model: dict, feats: np.ndarray) -> np.ndarray:
    """Weight of each feature; 0 for one that training hasn't seen."""
    at = (feats >> U(64 - BITS)).astype(np.int32)
    return np.where(model["mark"][at] == feats.astype(np.uint32), model["w"][at], np.float32(0))


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(first)
    count = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + k * SEGMENT
    return start, np.minimum(SEGMENT, first[1:][doc] - start), k == 0


def marginals(s: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) of each token by forward-backward over each whole text."""
    r, b = ratios(s, first, trans)
    x = r * b
    return x / (1 + x)


def pair_marginals(r: np.ndarray, eb: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(00), P(01), P(10), P(11) of tokens with forward ratios r and their next ones with emission times backward ratio eb."""
    a = np.exp(trans)
    p = np.stack([np.full(len(r), a[0, 0]), a[0, 1] * eb, a[1, 0] * r, a[1, 1] * r * eb])
    return p / p.sum(0)


def ratios(s: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums of state 1 over those of state 0.

    All segments of all texts are worked off side by side; what a segment passes
    to the next is fed back until nothing changes, so the chain isn't cut.
    """
    if not len(s):
        return np.zeros(0), np.zeros(0)
    e, a = np.exp(np.clip(s, -30, 30)), np.exp(trans)
    start, length, head = _segments(first)
    order = np.argsort(-length, kind="stable")
    start, length, head = start[order], length[order], head[order]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    prev, nxt = where[np.maximum(order - 1, 0)], where[np.minimum(order + 1, len(order) - 1)]
    tail = np.empty(len(order), bool)
    tail[where] = np.append(head[where][1:], True)
    active = [int((length > t).sum()) for t in range(int(length[0]))]
    r, b = np.empty(len(s)), np.empty(len(s))
    come = np.ones(len(order))
    for _ in range(len(order) + 1):
        q = np.where(head, 1.0, come)
        for t, k in enumerate(active):
            at = start[:k] + t
            if t == 0:
                x = np.where(head[:k], e[at], e[at] * (a[0, 1] + q[:k] * a[1, 1]) / (a[0, 0] + q[:k] * a[1, 0]))
            else:
                x = e[at] * (a[0, 1] + x[:k] * a[1, 1]) / (a[0, 0] + x[:k] * a[1, 0])
            r[at] = x
        new = r[start + length - 1][prev]
        if np.allclose(new[~head], come[~head], rtol=1e-9, atol=1e-12):
            break
        come = new
    come = np.ones(len(order))
    for _ in range(len(order) + 1):
        x = np.where(tail, 1.0, come)
        b[start + length - 1] = x
        for t in range(len(active) - 2, -1, -1):
            k = active[t + 1]
            at = start[:k] + t
            y = e[at + 1] * b[at + 1]
            b[at] = (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y)
        y = e[start] * b[start]
        new = ((a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y))[nxt]
        if np.allclose(new[~tail], come[~tail], rtol=1e-9, atol=1e-12):
            break
        come = new
    return r, b


def doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    sums = np.concatenate([[0], np.cumsum(p)])
    total = sums[first[1:]] - sums[first[:-1]]
    top = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(n)), np.log(top / (1 - top)), np.log1p(total)], 1)


def _distinct(w: np.ndarray, first: np.ndarray, judged: np.ndarray, share: float = 0.15) -> np.ndarray:
    """Which texts aren't near copies of an earlier one: of the ``judged`` ones, those with few word triples in common."""
    keep = np.ones(len(first) - 1, bool)
    grams = {d: np.unique(gram_hashes(w[first[d] : first[d + 1]], 3)) for d in np.flatnonzero(judged).tolist()}
    if not grams:
        return keep
    every, count = np.unique(np.concatenate(list(grams.values())), return_counts=True)
    shared = every[count > 1]  # what only one text has can't be common
    holders: list[list[int]] = [[] for _ in range(len(shared))]
    for d, g in grams.items():
        at = np.searchsorted(shared, g)
        own = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == g)] if len(shared) else at[:0]
        common = np.bincount(np.array([o for x in own.tolist() for o in holders[x]], np.int64)) if len(own) else np.zeros(1)
        if len(g) and common.max(initial=0) >= share * len(g):
            keep[d] = False
            continue
        for x in own.tolist():
            holders[x].append(d)
    return keep


def _blocks(first: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK`` tokens each, a longer text alone."""
    out, a = [], 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + BLOCK, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def train(texts: list[str], labels: list[int], rounds: int = 40) -> dict:
    """A model from labelled texts. Without texts of both labels every score is the share of label 1 (or 0)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return train_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), labels, rounds)


def train_bytes(data: np.ndarray, off: np.ndarray, labels: list[int], rounds: int = 40) -> dict:
    """``train`` on texts given as UTF-8 bytes and offsets. Beyond 12 bytes a token, memory is that of a block and of the words."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return {**table_of(np.zeros(0, U), np.zeros(0)), "bias": -4.0, "trans": np.zeros((2, 2)), "top": np.array([-9.0 if not len(y) or not y[0] else 9.0, 0, 0])}
    sizes, words, known, kinds, a = [], [], [], [], 0
    while a < len(off) - 1:  # about a MB at a time, to keep the driver small
        b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 20), "right")) - 1)
        _, _, f, feats = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
        own, one = np.unique(feats[0], return_index=True)
        sizes.append(np.diff(f))
        words.append(feats[0].copy())
        known.append(own)
        kinds.append(feats[:, one])
        a = b
    del data, feats
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    words = np.concatenate(words)
    # A word's features are those of its type, so sums over tokens are taken by type first.
    types, one = np.unique(np.concatenate(known), return_index=True)
    kind = np.searchsorted(types, words).astype(np.int32)
    feats = np.concatenate(kinds, 1)[:, one]
    names, feats = (lambda x: (x[0], x[1].reshape(feats.shape).astype(np.int32)))(np.unique(feats.ravel(), return_inverse=True))
    del known, kinds
    many = len(names)
    keep = _distinct(words, first, y == 1)
    del words
    blocks = _blocks(first)
    nt, nc = int((keep & (y == 1)).sum()), int((keep & (y == 0)).sum())
    bad = np.zeros(len(types), bool)  # types that are typical of label 1
    held = [np.unique(owners(first[a : b + 1]).astype(np.int64) << 32 | kind[first[a] : first[b]]) for a, b in blocks]
    for f in feats:
        t, c = np.zeros(many, np.int64), np.zeros(many, np.int64)
        for (a, _), pairs in zip(blocks, held, strict=True):
            pairs = np.unique((pairs >> 32) * many + f[pairs & 0xFFFFFFFF])
            d, g = pairs // many + a, pairs % many
            t += np.bincount(g[keep[d] & (y[d] == 1)], minlength=many)
            c += np.bincount(g[keep[d] & (y[d] == 0)], minlength=many)
        odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
        bad |= ((t >= max(3, 0.012 * nt)) & (odds > np.log(12)))[f]
    del held
    w, step = np.zeros(many), np.full(many, 0.5)
    theta, tstep = np.array([-4.0, 0, 0, 0, 0]), np.full(5, 0.3)  # bias, transitions
    old, told = np.zeros(many), np.zeros(5)

    def field(a: int, b: int, by_type: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the tokens of texts a to b, forward ratios, and emissions times backward ratios."""
        s = by_type[kind[first[a] : first[b]]]
        r, back = ratios(s, first[a : b + 1] - first[a], theta[1:].reshape(2, 2))
        x = r * back
        return x / (1 + x), r, np.exp(np.clip(s, -30, 30)) * back

    for _ in range(rounds):
        grad, tgrad = -0.02 * w, -0.02 * theta
        by_type, sums = theta[0] + w[feats].sum(0), np.zeros(len(types))
        for d0, d1 in blocks:
            own = kind[first[d0] : first[d1]]
            doc = owners(first[d0 : d1 + 1]) + d0
            target, use, (p, r, eb) = bad[own] & (y[doc] == 1), keep[doc], field(d0, d1, by_type)
            miss = (target - p) * use
            sums += np.bincount(own, miss, len(types))
            # Transitions: pairs as labelled less their marginals.
            pair = np.flatnonzero((doc[1:] == doc[:-1]) & use[1:])
            state = 2 * target[pair] + target[pair + 1]
            tgrad += np.append(miss.sum(), np.bincount(state, minlength=4) - pair_marginals(r[pair], eb[pair + 1], theta[1:].reshape(2, 2)).sum(1))
        for f in feats:
            grad += np.bincount(f, sums, many)
        for g, o, st, x in ((grad, old, step, w), (tgrad, told, tstep, theta)):
            sign = g * o
            st *= np.where(sign > 0, 1.2, np.where(sign < 0, 0.5, 1.0))
            np.minimum(st, 2.0, out=st)
            g[sign < 0] = 0
            x += np.sign(g) * st
            o[:] = g
        theta[1:] = np.clip(theta[1:], -4, 4)
    model = table_of(names, w)
    by_type = theta[0] + weights(model, names)[feats].sum(0, dtype=np.float64)
    x, top = np.concatenate([doc_features(field(a, b, by_type)[0], first[a : b + 1] - first[a]) for a, b in blocks])[keep], np.zeros(3)
    t = y[keep]
    for _ in range(30):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-x @ top))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        top += np.clip(np.linalg.solve(h, x.T @ (t - q) - 0.1 * top), -2, 2)
    return {**model, "bias": float(theta[0]), "trans": theta[1:].reshape(2, 2).copy(), "top": top}


def score_batch(model: dict, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[dict]], np.ndarray]:
    starts, ends, first, feats = tokens(data, off)
    p = marginals(model["bias"] + weights(model, feats).sum(0, dtype=np.float64), first, model["trans"])
    score = 1 / (1 + np.exp(-np.clip(doc_features(p, first) @ model["top"], -500, 500)))
    bad = np.flatnonzero(p >= 0.5)
    found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    n_bad = np.zeros(len(off) - 1, np.int64)
    if len(bad):
        doc = np.searchsorted(first, bad, "right") - 1
        n_bad = np.bincount(doc, minlength=len(off) - 1)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for d, i, j in zip(doc.tolist(), chars[starts[bad]].tolist(), chars[ends[bad]].tolist(), strict=True):
            base = int(chars[off[d]])
            own = found[d]
            if own and i - base - own[-1]["end"] <= 1:
                own[-1]["end"] = j - base
            else:
                own.append({"start": i - base, "end": j - base})
    return score, n_bad, found, np.diff(first)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 2400, learn=None, max_bytes: int = 64 << 20) -> dict:
    """Train on at most ``max_toxic`` + ``max_clean`` labelled documents, those with the smallest hashes of their ids.

    Of these, texts that would bring the total in this order above ``max_bytes`` don't count.
    ``learn``: a condition on doc_id; other rows are never learnt from. A doc_id that is labelled more
    than once is toxic if one of its labels is; null labels and ids don't count.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = (own if learn is None else own.filter(learn)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [own.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    sample = F.broadcast(some[0].unionByName(some[1]))  # max_toxic + max_clean rows at most
    got = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    got = materialize(got.withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), "sample")
    chosen, room = [], max_bytes
    for r in got.select("doc_id", "toxic", "size").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").collect():
        if r["size"] <= room:
            room -= r["size"]
            chosen.append((r.doc_id, r.toxic))
    if not chosen:
        discard(got)
        return train([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        model = train_bytes(*text_bytes(table.column("text")), table.column("toxic").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    ids = docs.sparkSession.createDataFrame(chosen, got.select("doc_id", "toxic").schema)
    rows = got.join(F.broadcast(ids), ["doc_id", "toxic"]).repartition(1).sortWithinPartitions("doc_id", "toxic")
    model = pickle.loads(rows.select("toxic", "text").mapInArrow(run, "model binary").first().model)
    discard(got)
    return model


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of ``keep``, score, n_tokens, n_toxic_tokens, spans (character offsets).

    Null and empty texts have no tokens and get the score of no evidence. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for a, b, data, off in slices(batch, "text", NEAR):
                s, bad, found, n = score_batch(held.value, data, off)
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(found, kind)], [*keep, "score", "n_tokens", "n_toxic_tokens", "spans"])

    src = docs.select(*keep, "text")
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)]) + ", " + OUT)


def drop(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch, "text", NEAR):
                part = batch.slice(a, b - a).filter(pa.array(score_batch(held.value, data, off)[0] < threshold))
                if part.num_rows:
                    yield part

    return docs.select([F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
