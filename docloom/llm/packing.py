"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised once, in the tasks that read them, and cut into pieces of at most
``capacity`` tokens. The driver sees only how many pieces have each length (``capacity``
rows) and packs these counts: longest first, each into the fullest sequence that still
takes it. Sequences with equal contents are one range of numbers, so a step places any
number of pieces at once, and the plan has at most 3 * capacity * log2(capacity) rows.
Pieces then take the planned slots by their rank within their length, which is their rank
within the task that made them plus the pieces of that length in earlier tasks.

Texts are tokenised by distinct segments: a segment starts at a space before a visible
character, and at an ASCII mark behind an ASCII letter or digit, where a byte-level
pre-tokeniser always starts a new token.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize
from .words import distinct_words, slices

CAPACITY = 1024
END_ID = 2
CACHE = 250_000  # segments of a generation; a task keeps two
BATCH = 1 << 14  # bytes of new segments encoded at once
CACHED = 64  # bytes of the longest segment kept
ALNUM, MARK = np.zeros(256, bool), np.zeros(256, bool)
MARK[0x21:0x7F] = True
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
MARK &= ~ALNUM
GROUP = 1 << 19  # segments told apart at once


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Segments:
    """Token ids of UTF-8 texts, each distinct segment encoded once.

    ``json`` is a byte-level BPE tokenizer without a prefix space, as text.
    """

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # White space beyond ASCII starts with C2, E1, E2 or E3; before an added token the text is cut otherwise.
        opens = np.zeros(256, bool)
        opens[0x21:0x7F] = opens[0xC3:0xE1] = opens[0xE4:0xF5] = True
        for t in self.tokenizer.get_added_tokens_decoder().values():
            opens[t.content.encode()[:1][0]] = False
        self.opens = opens
        # Bytes of each token: one a character of its name, but for added tokens.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.added = []
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            self.size[i] = len(t.content.encode())
            self.added.append(t.content.encode())

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The first byte of each segment; texts that aren't empty start one."""
        new = np.zeros(len(data) + 1, bool)
        new[:-2] = (data[:-1] == 32) & self.opens[data[1:]]
        if not any(t in memoryview(data).tobytes() for t in self.added):  # these may hold such a place
            new[1:-1] |= ALNUM[data[:-1]] & MARK[data[1:]]
        new[off[:-1]] = True
        return np.flatnonzero(new[:-1])

    def _run(self, keys: list[bytes]) -> list[bytes] | None:
        """Ids of segments that begin with a space, encoded as one text and cut where segments end; None if tokens don't end there."""
        try:
            text = b"".join(keys).decode()
        except UnicodeDecodeError:
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends, want = np.cumsum(self.size[ids]), np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
        at = np.searchsorted(ends, want)
        if not len(ids) or at[-1] >= len(ends) or not (ends[at] == want).all():
            return None
        raw, last = ids.tobytes(), (4 * (at + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def _one(self, key: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([key.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of segments as bytes of 32-bit numbers. What was met lately is kept: a full generation becomes the old one."""
        raw, out = memoryview(data), []
        young, old = self.young, self.old
        new: list[int] = []
        keys = [bytes(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i, key in enumerate(keys):
            got = young.get(key)
            if got is None and (got := old.get(key)) is not None:
                young[key] = got
            elif got is None:
                new.append(i)
            out.append(got)
        batch: list[int] = []
        size = 0
        for k, i in enumerate(new):
            if keys[i][:1] == b" ":
                batch.append(i)
                size += len(keys[i])
            else:
                out[i] = self._one(keys[i])
            if batch and (size >= BATCH or k + 1 == len(new)):
                for j, x in zip(batch, self._run([keys[j] for j in batch]) or [self._one(keys[j]) for j in batch], strict=True):
                    out[j] = x
                batch, size = [], 0
        young.update((keys[i], out[i]) for i in new if len(keys[i]) <= CACHED)
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their number by text)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        starts = self.starts(data, off)
        ends = np.append(starts[1:], len(data))
        flat, per = [np.zeros(0, np.uint32)], np.zeros(len(starts) + 1, np.int64)
        for a in range(0, len(starts), GROUP):
            s, e = starts[a : a + GROUP], ends[a : a + GROUP]
            index, number = distinct_words(data, s, e)
            ids = self._ids(data, s[index], e[index])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at, pool = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint32)
            n = size[number]
            per[a + 1 : a + 1 + len(n)] = n
            flat.append(pool[np.arange(int(n.sum())) + np.repeat(at[number] - (np.cumsum(n) - n), n)])
        sums = np.cumsum(per)
        return np.concatenate(flat), np.diff(sums[np.searchsorted(starts, off)])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of each document, written: doc_id, piece, start, length, ids_crc32, task, nth (and ids).

    A document is its text's ids and ``end_id``; null is an empty text, so its only piece is
    ``end_id``. Longer ones than ``capacity`` are cut into full pieces behind a first one that
    takes what is left over. ``nth`` counts pieces of a length within a task.
    """
    with open(tokenizer or vocabulary_path(), encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = Segments(held.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                ids, n = coder.encode(data, off)
                total = n + 1
                count = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                lead = (total - 1) % capacity + 1
                start = np.where(piece > 0, lead[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, lead[doc])
                whole = np.full(len(ids) + len(n), end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                at = (np.cumsum(total) - total)[doc] + start
                raw = whole.astype("<u4").tobytes()
                cut = [raw[4 * s : 4 * (s + k)] for s, k in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                new = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole, pa.uint32()).cast(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, NAMES[: len(cols)])

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return materialize(src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids), "pieces")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over the number of pieces of each length.

    Rows (length, first rank, number, pieces a sequence, first sequence, offset): the pieces
    with these ranks fill a range of sequences, so many in each, from the offset on.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by tokens left: (first sequence, number)
    rows, opened = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]

        def put(first: int, number: int, each: int, free: int) -> None:
            nonlocal rank, left
            n = number * each
            rows.append((length, rank, n, each, first, capacity - free))  # noqa: B023
            room[free - each * length].append((first, number))  # noqa: B023
            rank, left = rank + n, left - n

        for free in range(length, capacity + 1):
            while left and room[free]:
                first, number = room[free].pop()
                each = free // length
                full = min(number, left // each)
                if full:
                    put(first, full, each, free)
                if full < number:
                    if left:
                        put(first + full, 1, left, free)
                        full += 1
                    if full < number:
                        room[free].append((first + full, number - full))
        each = capacity // length
        if left >= each:
            put(opened, left // each, each, capacity)
            opened += rows[-1][2] // each
        if left:
            put(opened, 1, left, capacity)
            opened += 1
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row.

    Pieces of a sequence lie one behind the other from 0 on. Rows that repeat a doc_id or
    lack one are packed like others. An empty table gives none. Other columns are ignored.
    """
    made = pieces(docs, tokenizer, capacity, end_id, with_ids)
    tally = materialize(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "tally")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    held = docs.sparkSession.sparkContext.broadcast(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        begins = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            slot = rows[np.searchsorted(begins, length << 44 | rank, "right") - 1]
            place = rank - slot[:, 1]
            cols = {"sequence_id": pa.array(slot[:, 4] + place // slot[:, 3]), "offset": pa.array(slot[:, 5] + place % slot[:, 3] * length)}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    ranked = made.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "task")
    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ids, and the documents' starts within each. Needs ``with_ids``."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # ``capacity`` tokens at most
    rows = packed.groupBy("sequence_id").agg(inside.alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.offset").alias("starts"), F.col("x.doc_id").alias("doc_ids"))
