"""Benchmark decontamination by spaced seeds.

Two fixed masks of nine words ignore three positions each; together they hit every
passage of 13 words with at most two substituted words. Three shorter masks of five
words hit every item of 9 to 12 words with as many as a fifth substituted. Masked
windows of the benchmark and of the documents are joined by hash; around each hit the aligned
words are compared, so a match may have substitutions. Benchmarks up to
``MAX_BYTES`` are sent to the tasks and the texts aren't shuffled; larger ones are
joined by hash with a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .joins import spread
from .store import materialize
from .words import LOWER, U, gram_hashes, inside, mix, signed, slices, spans, word_hashes

MASKS = ("100101111", "111011001")
SHORT_MASKS = ("111011", "1101011", "1110011")  # for items of SPAN to WINDOW - 1 words
SPAN = 9
WINDOW = 13  # words compared around a hit
SHARE = 0.8  # of them that must agree
SHORT = 5  # shorter items never match; items of 5 to 8 words match as a whole
#: Masks, and the least and the most words of the items that they are for.
SEEDS = (*((m, WINDOW, 1 << 62) for m in MASKS), *((m, SPAN, WINDOW - 1) for m in SHORT_MASKS), *(("1" * n, n, n) for n in range(SHORT, SPAN)))
MAX_BYTES = 32 << 20
_C = 0xD1342543DE82EF95
OVERLAPS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_equal", T.IntegerType())]))


def masked_hashes(w: np.ndarray, mask: str) -> np.ndarray:
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    total, c = np.zeros(n, U), 1
    for j, bit in enumerate(mask):
        if bit == "1":
            total += w[j : j + n] * U(c)
            c = c * _C % (1 << 64)
    return mix(total)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, first = spans(low, off)
    return word_hashes(low, starts, ends), first


def seeds(w: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under a mask, and their word positions."""
    at, _ = inside(first, len(mask))
    return masked_hashes(w, mask)[at] if len(at) else np.zeros(0, U), at


def item_seeds(w: np.ndarray, first: np.ndarray, seed: tuple[str, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for the texts whose length the mask is for."""
    mask, least, most = seed
    h, at = seeds(w, first, mask)
    n = np.diff(first)[np.searchsorted(first, at, "right") - 1]
    own = (n >= least) & (n <= most)
    return h[own], at[own]


def verify(dw: np.ndarray, iw: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """The aligned stretch in which WINDOW words (all of a shorter item) agree but for a fifth: doc word, item word, words, equal words."""
    lo, hi = max(0, -shift), min(len(iw), len(dw) - shift)
    size = min(len(iw), WINDOW)
    if hi - lo < size:
        return None
    same = np.concatenate([[0], np.cumsum(dw[lo + shift : hi + shift] == iw[lo:hi])])
    good = np.flatnonzero(same[size:] - same[:-size] >= SHARE * size)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + size
    return lo + a + shift, lo + a, b - a, int(same[b] - same[a])


class Benchmark:
    """Words and sorted seeds of all items."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.ids = ids
        self.words, self.first = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        self.seeds = []
        for seed in SEEDS:
            h, at = item_seeds(self.words, self.first, seed)
            if not len(h) or seed[1] < SPAN:  # items below SPAN words match as a whole
                continue
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> U(44)).astype(np.int64)] = True
            self.seeds.append((seed[0], h[order], at[order], bits))
        n = np.diff(self.first)
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((n >= SHORT) & (n < SPAN)).tolist():
            g = int(gram_hashes(self.words[self.first[i] : self.first[i + 1]], int(n[i]))[0])
            self.short.setdefault(int(n[i]), {}).setdefault(g, []).append(i)

    def overlaps(self, w: np.ndarray, first: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        diagonals: list[np.ndarray] = []
        for mask, known, where, bits in self.seeds:
            h, at = seeds(w, first, mask)
            some = np.flatnonzero(bits[(h >> U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(known, h[some], "left"), np.searchsorted(known, h[some], "right")
            n = hi - lo
            if n.sum():
                pos = np.repeat(at[some], n)
                item_pos = where[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                doc, item = np.searchsorted(first, pos, "right") - 1, np.searchsorted(self.first, item_pos, "right") - 1
                diagonals.append(np.stack([doc, item, (pos - first[doc]) - (item_pos - self.first[item])], 1))
        for d, i, shift in np.unique(np.concatenate(diagonals), axis=0).tolist() if diagonals else ():
            if got := verify(w[first[d] : first[d + 1]], self.words[self.first[i] : self.first[i + 1]], shift):
                out[d].append(dict(zip(("item_id", "doc_word", "item_word", "n_words", "n_equal"), (self.ids[i], *got), strict=True)))
        for n, items in self.short.items():
            at, doc = inside(first, n)
            if len(at):
                h = gram_hashes(w, n)[at]
                known = np.array(sorted(items), U)
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for j in np.flatnonzero(known[k] == h).tolist():
                    for i in items[int(h[j])]:
                        out[doc[j]].append({"item_id": self.ids[i], "doc_word": int(at[j] - first[doc[j]]), "item_word": 0, "n_words": n, "n_equal": n})
        return out


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, name: str = "overlaps", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns of ``keep`` (all by default) of every row of docs, with an array of its verified overlaps.

    An overlap aligns a document with an item of the benchmark (item_id, text) so that
    in 13 consecutive aligned words at least four fifths are equal, A-Z lower-cased
    (items of 9 to 12 words: of all their words; of 5 to 8: all words; fewer: never).
    Null or empty texts on either side have none; repeated rows are each judged.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], F.col("text").alias("__text"))
    bench = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    if (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > max_bytes:
        return _joined(bench, src, name)
    rows = bench.orderBy("item_id", "text").collect()  # at most max_bytes
    held = docs.sparkSession.sparkContext.broadcast(Benchmark([r.item_id for r in rows], [r.text for r in rows]))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(name, OVERLAPS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch, "__text"):
                found = held.value.overlaps(*words_of(data, off))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(found, kind)], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def _joined(bench: DataFrame, src: DataFrame, name: str) -> DataFrame:
    """For benchmarks too large to send around: seeds of both sides joined by hash, then each pair of texts verified once.

    Rows of both sides are known by numbers that are written with them, not by their ids.
    """
    src = materialize(src.withColumn("__row", F.monotonically_increasing_id()), "docs")
    bench = materialize(bench.withColumn("item", F.monotonically_increasing_id()), "items")

    def seeds_of(df: DataFrame, kinds: list[int], of, known=None) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, _, data, off in slices(batch, batch.schema.names[1]):
                    w, first = words_of(data, off)
                    for k in kinds:
                        h, at = of(w, first, SEEDS[k])
                        if known is not None:
                            some = bloom.passes(known.value, h)
                            h, at = h[some], at[some]
                        doc = np.searchsorted(first, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + doc]), pa.array(np.full(len(at), k), pa.int32()), pa.array(signed(h)), pa.array((at - first[doc]).astype(np.int32))], ["id", "mask", "h", "pos"])

        return df.mapInArrow(emit, "id long, mask int, h long, pos int")

    i = materialize(seeds_of(bench.select("item", "text"), list(range(len(SEEDS))), item_seeds), "seeds")
    kinds = [r.mask for r in i.select("mask").distinct().collect()]
    rows = src.select("__row", "__text").filter(F.col("__text").isNotNull())
    known = src.sparkSession.sparkContext.broadcast(bloom.build(i, "h"))  # few seeds of documents go beyond their task
    d = seeds_of(rows, kinds, lambda w, first, seed: seeds(w, first, seed[0]), known)
    # A seed, or an item, that very many documents have is spread over tasks.
    d = materialize(d.withColumnRenamed("id", "__row"), "hits")
    pairs = spread(d, i.select(F.col("id").alias("item"), "mask", "h", F.col("pos").alias("item_pos")), ["mask", "h"], ["__row"])
    pairs = materialize(pairs.select("__row", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "pairs")
    both = spread(pairs, bench, ["item"], ["__row"]).join(rows, "__row").select("__row", "item_id", "shift", "__text", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda r: words_of(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0]
        last, dw = None, None
        for batch in batches:
            out, items = [], {}
            for row, item_id, shift, text, item in zip(*batch.columns, strict=True):
                row, item_id, shift = row.as_py(), item_id.as_py(), shift.as_py()
                if row != last:  # rows come by document, whose words are cut once
                    last, dw = row, words(text.as_py().encode("utf-8", "replace"))
                if item_id not in items:
                    items[item_id] = {}
                own, item = items[item_id], item.as_py()
                if item not in own:
                    own[item] = words(item.encode("utf-8", "replace"))
                iw = own[item]
                got = verify(dw, iw, shift)
                if got and (len(iw) >= SPAN or got[3] == len(iw)):
                    out.append((row, item_id, *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["__id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])

    found = both.mapInArrow(check, "__id long, item_id long, doc_word long, item_word long, n_words long, n_equal long")
    row = F.struct("item_id", *(F.col(c).cast("int").alias(c) for c in ("doc_word", "item_word", "n_words", "n_equal")))
    lists = found.groupBy("__id").agg(F.array_sort(F.collect_list(row)).alias("__found"))
    keep = [F.col(f"`{c}`") for c in src.columns[:-2]]
    return src.join(lists, F.col("__row") == F.col("__id"), "left").select(*keep, F.coalesce("__found", F.array().cast(OVERLAPS)).alias(name))
