"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``min_words`` consecutive words at least one
six-word gram is chosen by its content alone, so a passage that two documents share
has an anchor in both. Documents are joined on the anchors that two or more of them
have. Each occurrence brings the words around it, as far as a passage of
``min_words`` may reach; a match is extended word by word to both sides: occurrences
that agree so far stay together, others part. Words are compared as such, not by
hash. What reaches ``min_words`` in a smaller document is a repeat, and repeats that
overlap or touch make up the maximal ones. No pairs of documents are listed, so
a passage of n documents costs n steps.

An anchor of very many occurrences would meet in one task. Two things prevent it: each
task extends its own occurrences first and passes on only those with a window that no
smaller document of its own has; and where an anchor has more than ``HOT``
occurrences, its windows are dealt out one by one, by a 128-bit hash of their words.

What marks the shared anchors in the second pass is a Bloom filter of fixed size
(``log2_bits``): a full filter makes more seeds and changes no result. The same holds
for the filter of anchors with very many occurrences and that of documents with repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .store import discard, materialize, parts
from .words import U, blobs, distinct_words, gram_hashes, inside, mix, signed, slices, spans, word_hashes

GRAM = 6
FLUSH = 1_000_000  # anchors that a task aggregates at once
SEEDS = 1 << 17  # seeds that are extended at once, and bytes of the words around them
SEED_BYTES = 48 << 20
HOT = 4096  # occurrences beyond which an anchor's windows are dealt one by one
HOT_LESS, LEAST_BITS = 4, 16  # so many bits fewer has the filter of such anchors, but these at least
NEAR = 1 << 20  # bytes of text whose seeds are cut out at once
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept_text string"


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i:i+n] for each i that has them, by doubling."""
    got, width = x, 1
    while width < n:
        step = min(width, n - width)
        got = op(got[: len(got) - step], got[step:])
        width += step
    return got


def anchors(w: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen grams: (hashes, positions), and the least gram of each window, at the window's first word.

    A gram is chosen if it is the least of some min_words words of its text.
    """
    reach = min_words - GRAM + 1
    at, _ = inside(first, min_words)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(w), U)
    g = gram_hashes(w, GRAM) | U(1)
    least = np.zeros(len(w), U)
    least[at] = sliding(g, reach, np.minimum)[at]
    padded = np.concatenate([np.zeros(reach - 1, U), least])
    most = sliding(padded, reach, np.maximum)[: len(g)]
    pos = np.flatnonzero(most == g)
    return g[pos], pos, least


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the stretches."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.minimum(start, n), 1)
    np.add.at(d, np.minimum(end, n), -1)
    return np.cumsum(d[:-1]) > 0


def gathered(parts: Iterator[tuple[np.ndarray, ...]], limit: int) -> Iterator[list[np.ndarray]]:
    """Rows (as tuples of columns) put together to about ``limit`` at a time, however many batches they come in."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= limit:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _heads(h: np.ndarray) -> np.ndarray:
    """Where each value begins in a sorted array."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


def ends_of(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash its smallest document and its largest, if that is another; with the numbers of rows they stand for."""
    order = np.argsort(h)
    head = _heads(h[order])
    s, own = d[order], h[order[head]]
    low, high = np.minimum.reduceat(s, head), np.maximum.reduceat(s, head)
    two = high > low
    n = np.diff(np.append(head, len(h))) - two
    return np.concatenate([own, own[two]]), np.concatenate([low, high[two]]), np.concatenate([n, np.ones(int(two.sum()), np.int64)])


def later(h: np.ndarray, h2: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which rows have a smaller document with the same two hashes among these rows."""
    order = np.lexsort((h2, h))
    head = np.flatnonzero(np.append(True, (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)))
    s = d[order]
    out = np.empty(len(h), bool)
    out[order] = s > np.repeat(np.minimum.reduceat(s, head), np.diff(np.append(head, len(h))))
    return out


def runs_of(d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (document, position) as runs: document, first position, how many."""
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)))
    return d[cut], p[cut].astype(np.int32), (p[np.append(cut[1:], len(p)) - 1] - p[cut] + 1).astype(np.int32)


def extended(doc: np.ndarray, left: np.ndarray, data: np.ndarray, off: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of any anchors, each with its text: ``left`` words, the anchor's, and the words after it.

    Two tables of a row for each seed and a column for each number of words to its left, 0
    to ``reach``: whether the window that begins there is there, and whether a smaller
    document has it. Groups of seeds are refined word by word, outwards from the anchor.
    """
    n = len(doc)
    starts, ends, first = spans(data, off)
    _, ids = distinct_words(data, starts, ends)
    base, right = first[:-1] + left, np.diff(first) - left - GRAM

    def finer(groups: np.ndarray, at: np.ndarray, there: np.ndarray | bool) -> np.ndarray:
        word = np.where(there, ids[np.where(there, at, 0)] + 1, 0)
        return np.unique(groups * (len(ids) + 1) + word, return_inverse=True)[1]

    groups = np.zeros(n, np.int64)
    for j in range(GRAM):
        groups = finer(groups, base + j, True)
    lefts, rights = [groups], [groups]
    for j in range(reach):
        lefts.append(finer(lefts[-1], base - 1 - j, left > j))
        rights.append(finer(rights[-1], base + GRAM + j, right > j))
    there, again = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), bool)
    for k in range(reach + 1):
        own = np.flatnonzero((left >= k) & (right >= reach - k))
        if len(own):
            _, both = np.unique(lefts[k][own] * n + rights[reach - k][own], return_inverse=True)
            least = np.full(int(both.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, both, doc[own])
            there[own, k] = True
            again[own, k] = doc[own] > least[both]
    return there, again


def pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each a to b, one after the other, and their offsets."""
    off = np.concatenate([[0], np.cumsum(b - a)])
    return data[np.repeat(a - off[:-1], b - a) + np.arange(off[-1])], off


class _Seeds:
    """Seeds held until there are enough, as columns: anchor, document, position, words to the left, text."""

    def __init__(self, reach: int):
        self.reach, self.parts, self.n, self.size = reach, [], 0, 0

    def add(self, g, d, p, left, data, off) -> bool:
        """True once there are enough."""
        if len(g):
            self.parts.append((g, d, p, left, data, np.diff(off)))
            self.n, self.size = self.n + len(g), self.size + len(data)
        return self.n >= SEEDS or self.size >= SEED_BYTES

    def take(self, whole: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
        """What is held; with ``whole`` only anchors that are complete as rows come sorted, the last one stays."""
        if not self.n:
            return None
        cols = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.n, self.size = [], 0, 0
        *cols, data, size = cols
        off = np.concatenate([[0], np.cumsum(size)])
        if whole:
            end = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
            self.add(*(c[end:] for c in cols), data[off[end] :], off[end:] - off[end])
            cols, data, off = [c[:end] for c in cols], data[: off[end]], off[: end + 1]
        return cols, data, off

    def judge(self, cols, data, off) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents and positions of windows that repeat, seeds with a window that doesn't)."""
        g, d, p, left = cols
        order = np.argsort(g, kind="stable")
        head = _heads(g[order])
        size = np.diff(np.append(head, len(g)))
        two = np.minimum.reduceat(d[order], head) < np.maximum.reduceat(d[order], head) if len(g) else np.zeros(0, bool)
        some = np.sort(order[np.repeat(two, size)])  # the others' documents are alone here
        rest = np.ones(len(g), bool)
        if not len(some):
            return d[:0], p[:0], rest
        there, again = extended(d[some], left[some], *pieces(data, off[some], off[some + 1]), self.reach)
        rest[some] = (there & ~again).any(1)
        row, k = np.nonzero(again)
        return d[some[row]], (p[some[row]] - k).astype(np.int32), rest


def repeats(docs: DataFrame, min_words: int = 50, log2_bits: int = 26, hot: int = HOT) -> DataFrame:
    """Runs of repeated windows: doc_id, start (a word number), n windows from there on.

    A window of a document is a repeat if its words also start in a document with a smaller doc_id.
    """
    spark = docs.sparkSession
    src = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reach = min_words - GRAM

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, _, data, off in slices(batch, "text"):
                    starts, ends, first = spans(data, off)
                    g, pos, _ = anchors(word_hashes(data, starts, ends), first, min_words)
                    yield g, ids[a + np.searchsorted(first, pos, "right") - 1]

        for g, d in gathered(found(), FLUSH):
            g, d, n = ends_of(g, d)
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(d), pa.array(n)], ["h", "doc_id", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes with two documents or more, and whether they occur very often; rows come sorted by hash."""
        held = [np.zeros(0, np.int64)] * 3

        def told(h, low, high, n) -> Iterator[pa.RecordBatch]:
            two = high > low
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[two]), pa.array(n[two] > hot)], ["h", "hot"])

        def sums(h, d, n):
            head = _heads(h)
            return h[head], np.minimum.reduceat(d, head), np.maximum.reduceat(d, head), np.add.reduceat(n, head)

        for batch in batches:
            if batch.num_rows:
                got = sums(*(np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)))
                yield from told(*(x[:-1] for x in got))
                h, low, high, n = (x[-1] for x in got)  # may go on
                held = [np.array(x) for x in ((h, h), (low, high), (n, 0))]
        if len(held[0]):
            yield from told(*sums(*held))

    by_hash = src.mapInArrow(seed, "h long, doc_id long, n long").repartition(parts(spark), "h").sortWithinPartitions("h")
    both = materialize(by_hash.mapInArrow(shared, "h long, hot boolean"), "shared")
    filters = spark.sparkContext.broadcast((bloom.build(both, "h", log2_bits), bloom.build(both.filter("hot"), "h", max(log2_bits - HOT_LESS, LEAST_BITS))))
    discard(both)
    names, kind = ["h", "h2", "doc_id", "pos", "n", "left", "around"], "h long, h2 long, doc_id long, pos int, n int, left int, around binary"

    def rows(h, h2, d, p, n, left, around) -> pa.RecordBatch:
        """Seeds have n = 0 and words around them, windows to be judged n = 0 and none, runs of repeats n > 0."""
        whole = lambda x, t: pa.array(np.full(len(d), x, t) if np.isscalar(x) else x.astype(t))
        return pa.RecordBatch.from_arrays([whole(h, np.int64), whole(h2, np.int64), pa.array(d), whole(p, np.int32), whole(n, np.int32), whole(left, np.int32), pa.nulls(len(d), pa.binary()) if around is None else around], names)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, count = _Seeds(reach), [], 0

        def flush_windows() -> Iterator[pa.RecordBatch]:
            h, h2, d, p = (np.concatenate(x) for x in zip(*windows, strict=True))
            windows.clear()
            again = later(h, h2, d)
            if again.any():
                e, q, n = runs_of(d[again], p[again])
                yield rows(0, 0, e, q, n, -1, None)
            yield rows(signed(h[~again]), signed(h2[~again]), d[~again], p[~again], 0, -1, None)

        def flush() -> Iterator[pa.RecordBatch]:
            cols, data, off = held.take(False)
            d, p, rest = held.judge(cols, data, off)
            if len(d):
                d, p, n = runs_of(d, p)
                yield rows(0, 0, d, p, n, -1, None)
            for i in range(0, len(rest), 1 << 14):  # batches of a few MB
                own = i + np.flatnonzero(rest[i : i + (1 << 14)])
                if len(own):
                    g, d, p, left = (c[own] for c in cols)
                    text, cut = pieces(data, off[own], off[own + 1])
                    yield rows(signed(g), 0, d, p, 0, left, blobs(text, np.diff(cut)))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, data, off in slices(batch, "text", NEAR):
                starts, ends, first = spans(data, off)
                w = word_hashes(data, starts, ends)
                g, pos, least = anchors(w, first, min_words)
                if not len(g):
                    continue
                some = bloom.passes(filters.value[0], g)
                often = bloom.passes(filters.value[1], g)
                if (some & often).any():  # windows whose least anchor is one of them, one by one
                    at, doc = inside(first, min_words)
                    own = bloom.passes(filters.value[1], least[at]) & bloom.passes(filters.value[0], least[at])
                    at, doc = at[own], doc[own]
                    windows.append((gram_hashes(w, min_words)[at], gram_hashes(mix(w ^ U(0xC3C3C3C3)), min_words)[at], ids[a + doc], (at - first[doc]).astype(np.int32)))
                    count += len(at)
                    if count >= FLUSH:
                        yield from flush_windows()
                        count = 0
                pos, g = pos[some & ~often], g[some & ~often]
                if len(g):
                    doc = np.searchsorted(first, pos, "right") - 1
                    left = np.minimum(reach, pos - first[doc])
                    last = np.minimum(pos + GRAM + reach, first[doc + 1]) - 1
                    if held.add(g, ids[a + doc], pos - first[doc], left, *pieces(data, starts[pos - left], ends[last])):
                        yield from flush()
        if held.n:
            yield from flush()
        if count:
            yield from flush_windows()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seeds and windows come sorted by hash and document: of equal windows the first has the smallest document. Runs pass."""

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            held, last, least = _Seeds(reach), (0, 0), None
            for batch in batches:
                h, h2, d, p, n, left = (batch.column(i).to_numpy() for i in range(6))
                run, one = n > 0, (n == 0) & (left < 0)
                if run.any():
                    yield d[run], p[run], n[run]
                if one.any():
                    x, y, e = h[one], h2[one], d[one]
                    new = np.append(least is None or (x[0], y[0]) != last, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                    head = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
                    low = np.where(head >= 0, e[np.maximum(head, 0)], 0 if least is None else least)
                    last, least = (x[-1], y[-1]), low[-1]
                    yield e[e > low], p[one][e > low], np.ones(int((e > low).sum()), np.int32)
                own = ~run & ~one
                if own.any():
                    around = batch.column(6).filter(pa.array(own))
                    (_, _, data, off), *_ = slices(pa.RecordBatch.from_arrays([around], ["around"]), "around", 1 << 40)
                    if held.add(h[own], d[own], p[own], left[own], data, off):
                        d, p, _ = held.judge(*held.take(True))
                        yield d, p, np.ones(len(d), np.int32)
            if held.n:
                d, p, _ = held.judge(*held.take(False))
                yield d, p, np.ones(len(d), np.int32)

        for d, p, n in gathered(found(), FLUSH):
            one = n == 1
            cols = [np.concatenate(x) for x in zip(runs_of(d[one], p[one]), (d[~one], p[~one], n[~one]), strict=True)] if one.any() else [d, p, n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc_id", "start", "n"])

    dealt = F.when(F.col("n") > 0, F.xxhash64("doc_id")).otherwise(F.col("h"))
    met = src.mapInArrow(seeds, kind).repartition(parts(spark), dealt).sortWithinPartitions("h", "h2", "doc_id")
    return materialize(met.mapInArrow(judge, "doc_id long, start int, n int"), "starts")


def _finish(data: np.ndarray, off: np.ndarray, found: list | None, min_words: int, with_text: bool) -> list[list]:
    """Columns of OUT but the first, for texts with runs of windows that go (or none)."""
    s, e, first = spans(data, off)
    raw = data.tobytes()
    cols: list[list] = [[], [], [], [], []]
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        cut, runs = np.zeros(b - a, bool), []
        if found is not None and len(found[i][0]):
            start, many = found[i]
            cut = covered(start, start + many - 1 + min_words, b - a)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            runs = [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()]
        keep = np.flatnonzero(~cut) + a
        text = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
        for c, v in zip(cols, (b - a, b - a - len(keep), hashlib.sha256(text).hexdigest(), runs, text.decode("utf-8", "replace") if with_text else None), strict=True):
            c.append(v)
    return cols


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]


def remove_repeats(docs: DataFrame, min_words: int = 50, log2_bits: int = 26, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (and kept_text with ``with_text``).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word goes that lies in
    ``min_words`` (6 or more) consecutive words which also start in a document with a smaller
    doc_id, judged on the input. spans are the maximal repeats (first word, end).
    kept words are joined by one space. Null and empty texts have no words. A row
    without doc_id is never a repeat nor compared. Rows that repeat a doc_id are
    judged together. Other columns are ignored.
    """
    starts = repeats(docs, min_words, log2_bits, hot)
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(starts, "doc_id", log2_bits))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the documents that have no repeats for certain; the texts of the others go on."""
        for batch in batches:
            some = bloom.passes(held.value, batch.column(0).fill_null(0).to_numpy()) & np.asarray(batch.column(0).is_valid())
            for a, b, _, _ in slices(batch, "text"):
                for go_on in (True, False):
                    part = batch.slice(a, b - a).filter(pa.array(some[a:b] == go_on))
                    if go_on and part.num_rows:
                        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.nulls(part.num_rows, k) for k in KINDS[1:]), part.column(1)], [*NAMES, "text"])
                    elif part.num_rows:
                        (_, _, x, o), *_ = slices(part, "text", 1 << 40)
                        done = (pa.array(c, k) for c, k in zip(_finish(x, o, None, min_words, with_text), KINDS[1:], strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(0), *done, pa.nulls(part.num_rows, pa.string())], [*NAMES, "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = np.asarray(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(~todo)) for c in batch.columns[:6]], NAMES)
            rest = batch.filter(pa.array(todo))
            for a, b, data, off in slices(rest, "text"):
                runs = rest.column(7).slice(a, b - a).fill_null([])
                each = runs.flatten()
                start, n = each.field("start").to_numpy(), each.field("n").to_numpy()
                at = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())])
                cols = _finish(data, off, [(start[x:y], n[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], min_words, with_text)
                yield pa.RecordBatch.from_arrays([rest.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, KINDS[1:], strict=True))], NAMES)

    marks = starts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, OUT + ", text string")
    result = texts.join(marks, "doc_id", "left").select(*NAMES, "text", "starts").mapInArrow(apply, OUT)
    return result if with_text else result.drop("kept_text")
