"""Filter interaction audit: what each filter removes in every order of a chain of filters.

A document is known by its failure mask (a bit for each filter). Spark counts the masks
of each part, for all documents and for each label; these histograms are stacked as rows
of a matrix and multiplied by integer matrices of 2^k masks by k! * k (order, step)
columns: 32 by 600 for five filters. One product gives the documents kept after each
step, one those removed, redundant or failing that filter alone.

The last filter needs no join back to the documents: of equal texts, all fail it but the
rows with the smallest id, so a text's first rows are taken off the histogram of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import distinct_words, owners, slices, spans

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
SALTS = 4096


@cache
def matrices(letters: str = LETTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders, and 0/1 matrices of masks by (order, step): kept, removed, redundant, unique_fails."""
    orders = ["".join(p) for p in permutations(letters)]
    bits = np.array([[1 << letters.index(f) for f in o] for o in orders])  # (order, step)
    before = np.cumsum(bits, axis=1) - bits  # bits of the filters that come earlier
    mask = np.arange(1 << len(letters))[:, None, None]
    fails, gone = (mask & bits) > 0, (mask & before) > 0
    cells = {"kept": ~(fails | gone), "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bits}
    return orders, {k: v.reshape(len(mask), -1).astype(np.int64) for k, v in cells.items()}


def failures(docs: DataFrame, min_words: int = 100, distinct_pct: int = 80, upper_pct: int = 10, marks: str = "#$%&*|") -> DataFrame:
    """(doc_id, part, mask, key) for each row: bits of filters A to D over the whole text, and the text's SHA-256.

    A: under ``min_words`` words. B: 100 * distinct words < ``distinct_pct`` * words.
    C: 100 * [A-Z] > ``upper_pct`` * code points. D: holds one of ``marks`` (ASCII).
    Words are ``[^\\x20\\x09-\\x0D]+``, with case. A null text is an empty one and fails
    A alone; a null lang is the part ''.
    """
    marked = np.zeros(256, bool)
    marked[list(marks.encode("ascii"))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                starts, ends, first = spans(data, off)
                words = np.diff(first)
                _, number = distinct_words(data, starts, ends)
                pairs = np.unique(owners(first) * (len(number) + 1) + number)
                distinct = np.bincount(pairs // (len(number) + 1), minlength=b - a)
                held = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])  # noqa: E731, B023
                points, upper = held((data & 0xC0) != 0x80), held((data >= 65) & (data <= 90))
                mask = (words < min_words) * 1 + (100 * distinct < distinct_pct * words) * 2 + (100 * upper > upper_pct * points) * 4 + (held(marked[data]) > 0) * 8
                raw = memoryview(data)
                keys = [hashlib.sha256(raw[s:e]).digest() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(mask.astype(np.int32)), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "key"])

    src = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, part string, mask int, key binary")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each failure mask. E: an equal text has a smaller doc_id.

    A row without doc_id isn't compared (it never fails E, nor makes another fail) and has
    no label. Rows that repeat the smallest id of a text don't fail E. If a doc_id is
    labelled more than once, one label of 1 is enough; null labels count as 0.
    """
    # Rows without an id meet no label: their salt keeps them from one task.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = failures(docs).withColumn("salt", salt)
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic")).withColumn("salt", F.lit(0))
    own = rows.join(marks, ["doc_id", "salt"], "left").groupBy("doc_id", "salt", "key", "mask", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    texts = own.groupBy("doc_id", "salt", "key", "mask").agg(F.collect_list(F.struct("part", "n", "good", "toxic")).alias("parts"))
    texts = materialize(texts.select("doc_id", "key", "mask", "parts"), "masks")
    firsts = texts.filter("doc_id IS NOT NULL").groupBy("key", "mask").agg(F.min_by("parts", "doc_id").alias("parts")).select("mask", "parts")
    firsts = firsts.unionByName(texts.filter("doc_id IS NULL").select("mask", "parts"))
    counts = [F.col(f"p.{c}").alias(c) for c in ("n", "good", "toxic")]
    less = [(-F.col(f"p.{c}")).alias(c) for c in ("n", "good", "toxic")]
    part, copy = F.col("p.part").alias("part"), F.col("mask").bitwiseOR(COPY).alias("mask")
    every = texts.select("mask", F.explode("parts").alias("p")).select(part, copy, *counts)
    first = firsts.select("mask", F.explode("parts").alias("p")).select(part, F.explode(F.array(F.struct("mask", *counts), F.struct(copy, *less))).alias("x")).select("part", "x.*")
    return every.unionByName(first).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def outcomes(hist: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of histograms (part, mask, n, good, toxic): one row per part, filter_order and step."""
    size = 1 << len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, m = matrices(letters)
        steps = len(letters)
        column = np.array([letters.index(f) for o in orders for f in o])
        for batch in batches:
            part, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h = np.zeros((len(part), 3, size), np.int64)
            for i, row in enumerate(cells):
                for c in row:
                    h[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            whole = h.reshape(-1, size)  # a row each for all, good and toxic documents of a part
            got = {k: (whole @ v).reshape(len(part), 3, -1) for k, v in m.items()}
            for i, p in enumerate(part):
                cols = {k: v[i, 0] for k, v in got.items()} | {"good_lost": got["removed"][i, 1], "toxic_lost": got["removed"][i, 2]}
                share = np.zeros(steps, np.int64)
                np.add.at(share, column, got["removed"][i, 0])
                cols["shapley"] = share[column]
                n = len(column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * n, pa.string()), pa.array([o for o in orders for _ in letters]), pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32()), *(pa.array(v, pa.int64()) for v in cols.values())],
                    ["part", "filter_order", "step", *cols],
                )

    rows = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a cell for each mask at most
    return rows.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang, '' if null), filter_order (all orders of ABCDE) and step (1 to 5), zeros included.

    kept: rows left after the step. removed: rows that it takes. redundant: rows that fail
    its filter but went earlier. unique_fails: rows that fail no other filter. good_lost and
    toxic_lost: labelled rows among the removed. shapley: rows that the filter removes,
    summed over all orders. An empty table has no parts, so no rows. Other columns are ignored.
    """
    return outcomes(histograms(docs, labels))
