"""Token counts by a longest-match automaton.

Greedy longest-match segmentation of a word in one pass over its characters: a
trie of the vocabulary with failure links. When no edge goes on, the failure link
leads to the state of what is left after the tokens that are certain by then, and
their precomputed number is added. No piece is ever built.

A character that begins no token counts as its UTF-8 bytes (byte fallback).
Words are ``[^\\x20\\x09-\\x0D]+``; each gets the vocabulary's word-start mark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import distinct_words, slices, spans

MARK = "▁"
CACHE = 300_000  # word counts kept in a task at most
CACHED = 64  # bytes of the longest word kept
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Automaton:
    """edges: (state << 21 | code point) -> state; fail and cost by state; state 0 is the root."""

    def __init__(self, vocabulary: list[str]):
        edges: dict[int, int] = {}
        final = {0: 0}
        parent, by = [0], [0]

        def add(token: str, cost: int) -> None:
            v = 0
            for c in map(ord, token):
                k = v << 21 | c
                if k not in edges:
                    edges[k] = len(parent)
                    parent.append(v)
                    by.append(c)
                v = edges[k]
            final.setdefault(v, cost)

        for token in vocabulary:
            if token:
                add(token, 1)
        for c in sorted({c for t in vocabulary for c in t}):
            add(c, len(c.encode("utf-8", "surrogatepass")))
        n = len(parent)
        fail, cost = [0] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[parent[v]].append(v)
        todo = deque(children[0])
        while todo:
            v = todo.popleft()
            todo.extend(children[v])
            if v in final:
                fail[v], cost[v] = 0, final[v]
                continue
            z, spent = fail[parent[v]], cost[parent[v]]
            while (k := z << 21 | by[v]) not in edges:  # ends at the root: every character of a token is one itself
                spent, z = spent + cost[z], fail[z]
            fail[v], cost[v] = edges[k], spent
        self.edges, self.fail, self.cost = edges, fail, cost

    def count(self, word: str) -> int:
        edges, fail, cost = self.edges, self.fail, self.cost
        v = total = 0
        for ch in word:
            c = ord(ch)
            while (w := edges.get(v << 21 | c)) is None:
                if not v:
                    total += len(ch.encode("utf-8", "surrogatepass"))
                    break
                total += cost[v]
                v = fail[v]
            else:
                v = w
        while v:
            total += cost[v]
            v = fail[v]
        return total


def count_tokens(docs: DataFrame, vocabulary: str | list[str] = DEFAULT_VOCABULARY, mark: str = MARK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, n_words, n_tokens for each document; null and empty texts have 0.

    The vocabulary (a file path or pieces) is read on the driver; its automaton, of a
    size fixed by the vocabulary, goes to the tasks. No shuffle.
    """
    auto = Automaton(read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    held = docs.sparkSession.sparkContext.broadcast(auto)
    keep = tuple(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, cache = held.value, {}
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                starts, ends, first = spans(data, off)
                index, number = distinct_words(data, starts, ends)
                raw = data.tobytes()
                if len(cache) > CACHE:
                    cache.clear()
                counts = np.empty(len(index), np.int64)
                for i, (s, e) in enumerate(zip(starts[index].tolist(), ends[index].tolist(), strict=True)):
                    word = raw[s:e]
                    n = cache.get(word)
                    if n is None:
                        n = auto.count(mark + word.decode("utf-8", "replace"))
                        if e - s <= CACHED:
                            cache[word] = n
                    counts[i] = n
                sums = np.concatenate([[0], np.cumsum(counts[number])])
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first), pa.int64()), pa.array(np.diff(sums[first]), pa.int64())], [*keep, "n_words", "n_tokens"])

    src = docs.select(*keep, "text")
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)]) + ", n_words long, n_tokens long")
