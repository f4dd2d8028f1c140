"""Vectorised word handling on the UTF-8 bytes of Arrow string columns.

A text is never decoded: the separators are ASCII, so words can be cut on the
bytes. Batches are worked off in slices of a few MB, so memory is bounded by
that or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 3 << 20  # bytes of text handled at once
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters and non-ASCII bytes.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit numbers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (nulls are empty) and the rows' offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose texts have about ``limit`` bytes: (first, last, bytes, offsets)."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index(name)))
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~sep[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    cut = off[:-1]
    before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    cut = off[1:]
    after[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, off)


#: Masks that keep the first 0 to 8 bytes of a block, and what a word's length adds to its hash.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG = 256  # longer words are hashed by BLAKE2
_C, _D = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number (zeros follow the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, block by block of eight bytes.

    Each block goes through a bijection before the next is added, so regular words don't
    meet by construction; words of one length up to eight bytes never do.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, U)
    blocks = _blocks(data)
    h = mix((blocks[starts] & KEEP[np.minimum(size, 8)]) ^ size.astype(U) * U(_D))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        h[at] = mix(h[at] * U(_C) + (blocks[starts[at] + k] & KEEP[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct word, number of its word for each). Equal hashes are compared byte by byte."""
    _, index, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not len(starts):
        return index, number
    size, one, blocks = ends - starts, index[number], _blocks(data)
    short = KEEP[np.minimum(size, 8)]
    same = (size == size[one]) & (blocks[starts] & short == blocks[starts[one]] & short)
    at, k = np.flatnonzero(same & (size > 8) & (size <= LONG)), 8
    while len(at):
        k = np.minimum(k, size[at] - 8)  # the last block ends with the word
        same[at] = blocks[starts[at] + k] == blocks[starts[one[at]] + k]
        more = same[at] & (size[at] > k + 8)
        at, k = at[more], k[more] + 8
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[one[i]] : ends[one[i]]])
    if not same.all():
        own: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            number[i] = own.setdefault(data[starts[i] : ends[i]].tobytes(), len(index) + len(own))
        extra = {n: i for i, n in zip(np.flatnonzero(~same).tolist(), number[~same].tolist(), strict=True)}
        index = np.append(index, [extra[n] for n in sorted(extra)])
    return index, number


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, at its first word; empty if there are fewer words.

    Runs are joined two by two (the last two may overlap), each time through a bijection.
    """
    if len(words) < k:
        return np.zeros(0, U)
    got, width = words.astype(U, copy=True), 1
    while width < k:
        step = min(width, k - width)
        new = got[: len(got) - step] * U(_C)
        new += got[step:]
        new ^= new >> U(32)
        new *= U(_D)
        got, width = new, width + step
    got ^= got >> U(29)
    return mix(got)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one text start, and their texts."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc], doc


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, A-Z lower-cased: (hashes, texts), sorted by text and hash.

    A text of 1 to k-1 words has its whole sequence as its only shingle.
    """
    data = LOWER[data]
    starts, ends, first = spans(data, off)
    w = word_hashes(data, starts, ends)
    at, doc = inside(first, k)
    h = gram_hashes(w, k)[at] if len(at) else np.zeros(0, U)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([int(gram_hashes(w[first[d] : first[d + 1]], int(n[d]))[0]) for d in short], U)
        h, doc = np.concatenate([h, mix(own ^ U(0x1234567))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each row's run of values as bytes."""
    raw = np.ascontiguousarray(values)
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * raw.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
