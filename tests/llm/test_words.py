"""Words are told apart: regular ones by their hashes, all by comparison where a count or a removal hangs on it."""

import hashlib

import numpy as np
import pytest

from docloom.llm import ngram_join, substring_dedup, token_count, words


def regular(n):
    """The two words of 2**n letters that any polynomial modulo a power of two takes for one."""
    a = "a"
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


WORDS = ["a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 24 + "b", "a" * 25, "x" * 300, "x" * 300 + "y", "é", "漢字漢字", "x" * 16 + "\0", "x" * 16, *regular(10), *regular(7)]


def arrays(ws):
    data = np.frombuffer(" ".join(ws).encode(), np.uint8)
    return (data, *words.spans(data, np.array([0, len(data)]))[:2])


def test_hashes_of_words():
    h = words.word_hashes(*arrays(WORDS + WORDS))
    assert len(set(h.tolist())) == len(WORDS) and (h[: len(WORDS)] == h[len(WORDS) :]).all()


@pytest.mark.parametrize("weak", [False, True])
def test_distinct_words(monkeypatch, weak):
    if weak:  # all that differs by a hash alone is one word then
        monkeypatch.setattr(words, "word_hashes", lambda d, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    ws = WORDS + WORDS[::-1]
    index, number = words.distinct_words(*arrays(ws))
    assert [ws[k] for k in index[number].tolist()] == ws and len(index) == len(WORDS)
    none = np.zeros(0, np.int64)
    assert [len(x) for x in words.distinct_words(np.zeros(0, np.uint8), none, none)] == [0, 0]


def test_hashes_of_runs():
    """Runs of two words in every order, 14 at a time: no two different ones meet."""
    w = words.word_hashes(*arrays(["yes", "no"]))
    runs = [[w[i >> k & 1] for k in range(14)] for i in range(1 << 14)]
    h = [int(words.gram_hashes(np.array(r), 14)[0]) for r in runs[:4096]]
    assert len(set(h)) == len(h)
    assert not len(words.gram_hashes(w, 3)) and len(words.gram_hashes(w, 2)) == 1 and len(words.gram_hashes(w, 1)) == 2


def test_regular_words_in_operators(spark):
    a, b = regular(10)
    rest = " ".join(f"r{i}" for i in range(12))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {rest}"), (4, f"{b} {rest}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 13).collect()}
    assert got[4] == (0, hashlib.sha256(f"{b} {rest}".encode()).hexdigest())
    vocab = ["▁", "a", "b", "ab", "ba", "▁abba"]
    auto = token_count.Automaton(vocab)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs.filter("doc_id < 3"), vocab).collect()}
    assert got == {1: auto.count("▁" + a), 2: auto.count("▁" + b)} and got[1] != got[2]
