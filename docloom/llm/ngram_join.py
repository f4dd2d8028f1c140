"""N-gram Jaccard join by T-occurrence search with DivideSkip, lossless, without listing all pairs.

1. Documents with the same shingle set are one class (told by two 64-bit hashes of the set).
2. Shingles get one global order: by a fixed-size table of counts over all documents
   (rare first), then by hash. Two sets similar enough share a shingle of their
   prefixes, so only prefixes are dealt out by shingle; a cell is a shingle with two
   classes or more.
3. First round: in each cell every class is paired with the cell's head (that whose
   prefix reaches the shingle first, so the plainest member), and the pairs verified.
4. Second round: within cells, all pairs of classes that are not yet connected and
   whose positions still allow the overlap. A group of near copies is connected to
   its head by then, so its pairs are never listed.
5. Verification: for a class, the inverted lists of its shingles over the sets of its
   candidates; DivideSkip merges the short lists with a heap, looks the long ones up
   by binary search, and keeps the candidates that reach the required overlap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .joins import BUCKETS, inner, largest
from .store import discard, materialize, parts
from .words import U, blobs, mix, shingle_sets, signed, slices

COUNT_BITS = 20
COUNT_CHUNKS = 64
BLOCK = 128  # candidates verified at once
RUN = 1 << 18  # rows of a cell in memory at once in the first round
PAIRS = 1 << 16
CELL_BLOCK = 4096  # classes of a cell that meet in a task, on either side
SENT = 1 << 20  # candidate pairs that are sent to the sets; more are joined by a shuffle of both
MOST_SHARED = 10_000  # hashes that different sets share
LEAST_BITS, MOST_BITS = 64, 1 << 24  # of a set's parities


def digest(h: np.ndarray, doc: np.ndarray, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: of sums of mixed members, so the order of members doesn't matter; 0 for an empty set.

    The first, of ``bits`` bits, names a class as long as no other set has it.
    """
    counts = np.bincount(doc, minlength=n)
    one, two = np.zeros(n, U), np.zeros(n, U)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        x, y = np.add.reduceat(mix(h ^ U(0xA5A5A5A5)), at), np.add.reduceat(mix(h ^ U(0x3C3C3C3C)), at)
        one[full] = mix(x ^ mix(y) * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
        two[full] = mix(y ^ mix(x ^ U(0x5A5A)) * U(0xD1342543DE82EF95))
    return one, two


def classes_of(h: np.ndarray, doc: np.ndarray, n: int, bits: int, shared: np.ndarray) -> np.ndarray:
    """The class of each set: its first hash, or its second if the first is one that different sets have."""
    one, two = digest(h, doc, n, bits)
    return np.where(np.isin(one, shared), two, one) if len(shared) else one


def needed(a, b, percent: int):
    """The least overlap of sets of a and b members with 100 * overlap >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def divide_skip(query: np.ndarray, sets: list[np.ndarray], t: np.ndarray, mu: float = 0.0085) -> np.ndarray:
    """Which sets share t[i] or more members with the query; all arrays sorted and distinct."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    member, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    at = np.minimum(np.searchsorted(query, member), len(query) - 1)
    hit = query[at] == member
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    lists = np.split(owner, cut[1:]) if len(cut) else []
    least = int(t.min())
    if len(lists) < least:
        return np.zeros(m, bool)
    lists.sort(key=len)
    long = min(least - 1, int(least / (mu * math.log2(max(2, len(lists[-1]))) + 1)))
    short, probe = lists[: len(lists) - long], lists[len(lists) - long :]
    count = np.zeros(m, np.int64)
    heap = [(int(x[0]), i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:  # the records in order, each counted over the short lists that have it
        top, i, k = heap[0]
        count[top] += 1
        if k + 1 < len(short[i]):
            heapq.heapreplace(heap, (int(short[i][k + 1]), i, k + 1))
        else:
            heapq.heappop(heap)
    left = np.flatnonzero(count >= np.maximum(t - long, 1))
    for k, x in enumerate(probe):
        if not len(left):
            break
        j = np.minimum(np.searchsorted(x, left), len(x) - 1)
        count[left] += x[j] == left
        left = left[count[left] >= t[left] - (len(probe) - k - 1)]
    return count >= t


def parities(h: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """For each set, whether the number of its members in each bucket is odd, in two to four buckets a member.

    Two sets differ in as many members at least as their parities do in bits.
    """
    size = np.bincount(doc, minlength=n)
    m = np.minimum(np.int64(1) << np.ceil(np.log2(np.maximum(2 * size, LEAST_BITS))).astype(np.int64), MOST_BITS)
    base = np.cumsum(m) - m
    odd = np.bincount(base[doc] + ((mix(h) >> U(40)).astype(np.int64) & (m[doc] - 1)), minlength=int(m.sum())) & 1
    return blobs(np.packbits(odd.astype(np.uint8)), m // 8)


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Parities of rows in fewer buckets: those that fall together are added."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _near_enough(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Without the pairs whose parities already differ too much; nothing that is similar goes."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    # Copies go in the tasks that read them, before a class is shuffled.
    own = rows.select("cls", F.col("n").alias("size"), "data").dropDuplicates(["cls"]).join(need.hint("merge"), "cls", "left_semi")
    side = lambda x: own.select(F.col("cls").alias(x), F.col("size").alias(f"n_{x}"), F.col("data").alias(f"data_{x}"))
    both = inner(pairs, side("a"), ["a"], ["b"], largest(pairs, ["a"])).join(side("b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "data_a", "data_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy() for i in (2, 3))
            wide = np.array([pc.binary_length(batch.column(i)).to_numpy() for i in (4, 5)]).T.reshape(-1, 2)
            ok = np.zeros(batch.num_rows, bool)
            for w in np.unique(wide, axis=0):
                at = np.flatnonzero((wide == w).all(1))
                x, y = (folded(np.frombuffer(b"".join(batch.column(i).take(pa.array(at)).to_pylist()), U).reshape(len(at), -1), int(w.min()) // 8) for i in (4, 5))
                ok[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (n1 + n2 - 2 * needed(n1, n2, percent))[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _first_scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """kind 0: a document's set size, hashes and parities. kind 1: parts of a task's table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        names = ["kind", "doc_id", "n", "one", "two", "data"]
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                h, doc = shingle_sets(data, off, k)
                counts += np.bincount((h >> U(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.int32)
                n = b - a
                one, two = digest(h, doc, n, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).slice(a, n), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(signed(one)), pa.array(signed(two)), parities(h, doc, n)], names)
        size = len(counts) // COUNT_CHUNKS
        for c in range(COUNT_CHUNKS):
            part = counts[c * size : (c + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, batch_type), pa.array([c], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([part.tobytes()], pa.binary())], names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batch_type = pa.int64()
    return src.mapInArrow(run, "kind int, doc_id long, n long, one long, two long, data binary")


def _prefixes(docs: DataFrame, counts, k: int, percent: int, bits: int, shared) -> DataFrame:
    """Prefix shingles of every class: h, cls, n, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                h, doc = shingle_sets(data, off, k)
                cls = classes_of(h, doc, b - a, bits, shared.value)
                _, one = np.unique(cls, return_index=True)  # copies next to each other once
                own = np.zeros(b - a, bool)
                own[one] = True
                keep = own[doc]
                h, doc = h[keep], doc[keep]
                n = np.bincount(doc, minlength=b - a)
                order = np.argsort(counts.value[(h >> U(64 - COUNT_BITS)).astype(np.int64)], kind="stable")  # members come sorted
                order = order[np.argsort(doc[order].astype(np.uint16 if b - a < 1 << 16 else np.int64), kind="stable")]
                pos = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                keep = pos < prefix_length(n, percent)[doc]
                doc, pos, h = doc[keep], pos[keep], h[order][keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(cls[doc])), pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], ["h", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(run, "h long, cls long, n int, pos int")


CELL = "h long, cls long, n int, pos int, head long, head_n int, head_pos int, m int"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h and cls: those of shingles with two classes or more, with the head of their cell and its number of classes (RUN for a huge one)."""
    names, huge = [x.split()[0] for x in CELL.split(", ")], None

    def emit(h, cls, n, pos) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, pos = h[new], cls[new], n[new], pos[new]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(cut, len(h)))
        cell = np.repeat(np.arange(len(cut)), size)
        order = np.lexsort((cls, pos / n, cell))
        head = order[cut][cell]
        keep = size[cell] > 1
        if keep.any():
            m = np.where(h == huge, RUN, np.minimum(size[cell], RUN)) if huge is not None else np.minimum(size[cell], RUN)
            cols = [x[keep] for x in (h, cls, n, pos, cls[head], n[head], pos[head], m.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        end = int(np.searchsorted(held[0], held[0][-1])) if held[0][0] != held[0][-1] else 0
        if end:
            yield from emit(*(x[:end] for x in held))
            held = [x[end:] for x in held]
        elif len(held[0]) > RUN:  # a huge cell goes in parts that share their plainest member
            huge = held[0][0]
            yield from emit(*held)
            best = np.lexsort((held[1], held[3] / held[2]))[:1]
            held = [x[best] for x in held]
    if held is not None:
        yield from emit(*held)


def _possible(n1, p1, n2, p2, percent: int):
    """Whether sets of n1 and n2 members can be similar if the first member that they share is at p1 and p2.

    Every similar pair has its first shared member in both prefixes, and so passes in that cell.
    """
    return np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2, percent)


def _dealt_cells(named: DataFrame, most: int) -> DataFrame:
    """Rows of large cells (h, cls, n, pos, comp) with the pair of blocks (i, j) in which they meet others; i = j is a block with itself.

    Cells of up to ``most`` classes are one block. In a larger one the classes of the cell's largest component
    are blocks of their own kind, which never meet each other: a similar pair among them is connected already.
    So a cell in which nearly all is connected costs its size times the few other blocks.
    """
    sizes = named.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("h").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top")).filter(F.col("all") > most)
    blocks = lambda n: F.ceil(n / most).cast("int")
    large = sizes.select("h", F.col("top.comp").alias("main"), blocks(F.col("top.m")).alias("n_main"), blocks(F.col("all") - F.col("top.m")).alias("n_rest"))
    dealt = named.withColumn("spread_bucket", F.pmod(F.xxhash64("cls"), F.lit(BUCKETS)).cast("int"))
    asked = dealt.select("h", "spread_bucket").distinct().join(large, "h")
    x = dealt.join(asked, ["h", "spread_bucket"], "left").drop("spread_bucket")
    rest = F.col("comp") != F.col("main")
    # Blocks of the rest are numbered from 0, those of the main component come behind them.
    own = F.when(F.col("main").isNull(), 0).when(rest, F.pmod(F.xxhash64("cls", "h"), F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(F.xxhash64("cls", "h"), F.col("n_main"))).cast("int")
    others = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(F.col("n_rest") == 0, F.array().cast("array<int>")).when(rest, F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") - 1))
    x = x.withColumn("own", own).withColumn("other", F.explode(others))
    return x.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "n", "pos", "comp", "own")


def _open_pairs(percent: int):
    """Rows come sorted by h, i and j: cls, n, pos, comp, own block. Pairs of different components whose positions allow the overlap.

    Within a block, the members of its largest component are only compared with the others; two blocks' members only with each other's.
    """

    def emit(i, j, cls, n, pos, comp, own, seen: set) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low = n.min()
        # No partner can be smaller than the cell's smallest set.
        able = (n - pos) * 100 >= percent * (np.maximum(low, n - pos) + pos)
        if i == j:
            names, where, size = np.unique(comp, return_inverse=True, return_counts=True)
            if len(names) < 2:
                return
            asks = np.flatnonzero((where != size.argmax()) & able)
            mates = slice(None)
        else:  # the smaller side asks
            sides = np.flatnonzero(own == i), np.flatnonzero(own == j)
            less, mates = sorted(sides, key=len)
            asks = less[able[less]]
        m_cls, m_n, m_pos, m_comp = cls[mates], n[mates], pos[mates], comp[mates]
        for k in asks.tolist():
            ok = np.flatnonzero((m_comp != comp[k]) & _possible(m_n, m_pos, n[k], pos[k], percent))
            if len(ok):
                a, b = np.minimum(m_cls[ok], cls[k]), np.maximum(m_cls[ok], cls[k])
                fresh = [x for x, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if key not in seen and not seen.add(key)]
                if len(seen) > PAIRS:
                    seen.clear()
                yield a[fresh], b[fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        seen: set = set()

        def flush(cols, cut) -> Iterator[pa.RecordBatch]:
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for a, b in emit(int(cols[1][x]), int(cols[2][x]), *(c[x:y] for c in cols[3:]), seen):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = _starts(held[:3])
            yield from flush(held, cut)
            held = [x[cut[-1] :] for x in held]
        if held is not None:
            yield from flush(held, np.append(_starts(held[:3]), len(held[0])))

    return run


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that are similar. sets: cls, members (sorted hashes as bytes)."""
    n_of = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    most, total = n_of.agg(F.max("n"), F.sum("n")).first()
    degree = n_of.select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = inner(pairs, degree, ["a"], ["b"], most or 0).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    cands = dealt.select("a", "block", F.col("b").alias("cls"))
    asks = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("cls"))
    rows = cands.select("a", "block", "cls", F.lit(1).alias("role")).unionByName(asks.select("a", "block", "cls", F.lit(0).alias("role")))
    rows = sets.join(F.broadcast(rows) if (total or 0) <= SENT else rows, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, ids, own = None, None, [], []

        def search() -> Iterator[pa.RecordBatch]:
            if query is not None and ids:
                t = np.array([needed(len(query), len(s), percent) for s in own])
                good = divide_skip(query, own, t)
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]] * int(good.sum()), pa.int64()), pa.array(np.array(ids)[good])], ["a", "b"])

        for batch in batches:
            for a, block, role, cls, raw in zip(*(batch.column(i) for i in range(5)), strict=True):
                key, s = (a.as_py(), block.as_py()), np.frombuffer(raw.as_buffer(), U)
                if key != now or len(ids) >= 4 * BLOCK:
                    yield from search()
                    query, ids, own = (query if key == now else None), [], []
                    now = key
                if role.as_py() == 0:
                    query = s.copy()
                else:
                    ids.append(cls.as_py())
                    own.append(s.copy())
        yield from search()

    n = parts(pairs.sparkSession)
    return rows.select("a", "block", "role", "cls", "members").repartition(n, "a", "block").sortWithinPartitions("a", "block", "role").mapInArrow(run, "a long, b long")


def _key(cls, doc_id):
    """Of a class and its document with the smallest id."""
    return cls ^ (doc_id << 17) ^ doc_id


def _sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, class_bits: int, shared) -> DataFrame:
    """cls, members of the classes in ``pairs``, from one document of each (hardly ever more).

    A Bloom filter over documents, and over (class, document), picks them in a scan, so
    other texts aren't cut into shingles or shuffled; the join that follows is exact.
    """
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(reps.hint("merge"), "cls")
    least = F.coalesce("least", F.lit(-1))
    key = F.col("cls").bitwiseXOR(F.shiftleft(least, 17)).bitwiseXOR(least)
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(named.select(F.explode(F.array(key, least)).alias("key")), "key", 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            asked = bloom.passes(bits.value, ids)
            batch, ids = batch.filter(pa.array(asked)), ids[asked]
            for a, b, data, off in slices(batch, "text"):
                h, doc = shingle_sets(data, off, k)
                cls = classes_of(h, doc, b - a, class_bits, shared.value)
                own = bloom.passes(bits.value, _key(signed(cls), ids[a:b]))
                keep = own[doc]
                if keep.any():
                    n = np.bincount(doc[keep], minlength=b - a)[own]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(cls[own])), blobs(h[keep], n)], ["cls", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "cls long, members binary")


def _logs(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit logarithms, in steps of less than a thousandth."""
    return np.minimum(np.log2(counts + 1.0) * 1000, 65_535).astype(np.uint16)


def _scale(got: dict[int, bytes], kind=np.int64) -> np.ndarray:
    """The table of logarithms of its parts: counts, or logarithms (16 bits) that tasks have taken."""
    size = (1 << COUNT_BITS) // COUNT_CHUNKS
    parts = (np.frombuffer(got[c], kind) if c in got else np.zeros(size, kind) for c in range(COUNT_CHUNKS))
    return np.concatenate([x if kind == np.uint16 else _logs(x) for x in parts])


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75, class_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, class_size.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set holds its
    distinct k-word shingles; with fewer words its whole sequence is the only one; null
    and empty texts have an empty set and link with nothing. Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable by links. Repeated rows are copies of each other; a row without doc_id
    can link others, and its component_id is null only if nothing with an id is
    reachable. Other columns are ignored. class_id joins documents with equal sets.
    Shingles are told by 64-bit hashes. Fewer ``class_bits`` only make more classes go by
    their second hash.
    """
    spark = docs.sparkSession
    scan = materialize(_first_scan(docs, k, class_bits), "scan")
    full = scan.filter("kind = 0")
    both = full.filter("n > 0").groupBy("one").agg(F.min("two").alias("a"), F.max("two").alias("b")).filter("a <> b")
    # Different sets with one hash: n sets have n * n / 2 ** 65 of them, a few hundred in 10 ** 11.
    found = [r.one for r in both.select("one").limit(MOST_SHARED + 1).collect()]
    if len(found) > MOST_SHARED:
        raise ValueError("more sets share a hash than chance can give")
    shared = spark.sparkContext.broadcast(np.array(sorted(found), np.int64).view(U))
    full = full.select("doc_id", "n", (F.when(F.col("one").isin(found), F.col("two")).otherwise(F.col("one")) if found else F.col("one")).alias("cls"), "data")
    rows = full.drop("data")
    got = bloom.add_up(scan.filter("kind = 1").select(F.col("n").cast("int").alias("chunk"), "data"), "int32", np.add, "int64", _logs)
    counts = spark.sparkContext.broadcast(_scale(got, np.uint16))
    n = parts(spark)
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"))
    cells = materialize(_prefixes(docs, counts, k, percent, class_bits, shared).repartition(n, "h").sortWithinPartitions("h", "cls").mapInArrow(_cells, CELL), "cells")
    possible = F.least(F.col("n") - F.col("pos"), F.col("head_n") - F.col("head_pos")) >= F.ceil(percent * (F.col("n") + F.col("head_n")) / (100.0 + percent) - 1e-9)
    stars = cells.filter(F.col("cls") != F.col("head")).filter(possible).select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    stars = materialize(_near_enough(stars, full, percent), "stars")
    links = materialize(_verified(stars, _sets(docs, stars, reps.select("cls", "least"), k, class_bits, shared), percent), "links")
    comp = components(links)
    named = cells.select("h", "cls", "n", "pos", "m").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("h", "cls", "n", "pos", F.coalesce("root", "cls").alias("comp"), "m")
    big, whole = [], F.lit(0)
    block = lambda x: x.select("h", whole.alias("i"), whole.alias("j"), "cls", "n", "pos", "comp", whole.alias("own"))
    if (cells.agg(F.max("m")).first()[0] or 0) <= CELL_BLOCK:
        dealt = block(named)
    else:
        big = [materialize(named.filter(F.col("m") > CELL_BLOCK).drop("m"), "big-cells")]
        dealt = block(named.filter(F.col("m") <= CELL_BLOCK)).unionByName(_dealt_cells(big[0], CELL_BLOCK))
    dealt = dealt.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j")
    opened = materialize(dealt.mapInArrow(_open_pairs(percent), "a long, b long").distinct(), "open")
    discard(cells, stars, *big)
    more = materialize(_near_enough(opened, full, percent), "pairs")
    discard(opened)
    if not more.isEmpty():
        extra = materialize(_verified(more, _sets(docs, more, reps.select("cls", "least"), k, class_bits, shared), percent), "links")
        if not extra.isEmpty():
            discard(comp)
            comp = components(links.unionByName(extra))
        discard(extra)
    discard(links, more)
    # Classes to documents: the least id of each class, then of each component, which goes down by way of its buckets,
    # so that a component of very many classes doesn't meet in one task.
    named = reps.join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
    linked = named.filter("root is not null").withColumn("bucket", F.pmod(F.xxhash64("cls"), F.lit(BUCKETS)))
    low = linked.groupBy("root", "bucket").agg(F.min("least").alias("least"))
    top = low.groupBy("root").agg(F.min("least").alias("component_id"))
    down = low.select("root", "bucket").join(top, "root")
    classes = linked.join(down, ["root", "bucket"]).select("cls", "component_id", "class_size").unionByName(named.filter("root is null").select("cls", F.col("least").alias("component_id"), "class_size"))
    copies = reps.agg(F.max("class_size")).first()[0] or 0
    out = inner(rows.filter("n > 0"), classes, ["cls"], ["doc_id"], copies).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"), "class_size")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)
