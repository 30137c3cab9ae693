"""Counts and base score against plain Python; the model's probabilities add up."""

import math
from collections import Counter

import numpy as np
import pytest

from merchgrid.llm import lm_score as lm

TRAIN = ["the cat sat on the mat", "The dog sat\ton  the log", "a b a b a b a b", None, "Äpfel the", "the cat sat on the mat"]


def plain(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return [*out, ""]


def rows(spark, docs, train):
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    return {r.doc_id: r for r in lm.score(df, spark.createDataFrame([(t,) for t in train], "text string")).collect()}


def test_base_is_add_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)  # the join is needed
    docs = [(1, "the CAT sat"), (2, None), (3, "zebra Äpfel äpfel"), (4, "log " * 5000), (5, "\x85  ")]
    got = rows(spark, [(*d, "x") for d in docs], TRAIN)
    c = Counter(t for x in TRAIN for t in plain(x))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in plain(t))
        assert got[i].base_score == pytest.approx(want, abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(plain(t)), sum(c[x] > 0 for x in plain(t)), n)
        assert got[i].score < 0


def test_no_training_and_no_rows(spark):
    assert [(r.base_score, r.score, r.train_tokens) for r in rows(spark, [(1, "a", "x")], []).values()] == [(0.0, 0.0, 0)]
    assert rows(spark, [], TRAIN) == {}


def test_probabilities_add_up_and_learn():
    lex = lm.Lexicon(10, 3, {b"": 4, b"a": 3, b"b": 3}, {b"": 0, b"a": 1, b"b": 2}, np.zeros(256), np.zeros(256))
    w = lm.start_weights(lex)
    leaf = np.arange(lm.LEAVES)
    for prev, skip in ((0, 0), (1, 2), (4000, 17)):
        assert np.exp(lm.log_leaf(w, leaf, np.full(lm.LEAVES, prev), np.full(lm.LEAVES, skip))).sum() == pytest.approx(1, abs=1e-4)
    text = np.array([1, 2] * 2000 + [0])
    h = (np.concatenate([[0], text[:-1]]), np.concatenate([[0, 0], text[:-2]]))
    before = lm.log_leaf(w, text, *h).sum()
    used = np.zeros(len(w))
    for _ in range(10):
        lm.gradient_step(w, used, text, *h)
    assert lm.log_leaf(w, text, *h).sum() > before / 2
    assert np.exp(lm.log_leaf(w, leaf, np.full(lm.LEAVES, 1), np.full(lm.LEAVES, 2))).sum() == pytest.approx(1, abs=1e-4)


def test_texts_in_a_row_keep_their_own_histories():
    lex = lm.Lexicon(10, 3, {b"": 4, b"a": 3, b"b": 3}, {b"": 0, b"a": 1, b"b": 2}, np.zeros(256), np.zeros(256))
    both = lm.encoded(lex, ["a b zz", "", "b"])
    apart = [lm.encoded(lex, [t]) for t in ("a b zz", "", "b")]
    for name in ("leaf", "prev", "skip", "place", "size"):
        assert np.array_equal(getattr(both, name), np.concatenate([getattr(x, name) for x in apart])), name
    assert both.leaf[2] == lm.leaf_of(b"zz") >= lm.OWN


def test_every_level_learns_from_both_words_before_and_trains_its_bias():
    # the words differ in the third choice only, and only both words before together tell which comes
    pairs = [(16, 16, 17), (16, 17, 18), (17, 16, 18), (17, 17, 17)] * 500
    skip, prev, leaf = map(np.array, zip(*pairs, strict=True))
    lex = lm.Lexicon(10, 3, {b"": 4, b"a": 3, b"b": 3}, {b"": 0, b"a": 17, b"b": 18}, np.zeros(256), np.zeros(256))
    w = lm.start_weights(lex)
    biases, used = w[: 1 + 16 + 256].copy(), np.zeros(len(w))
    for _ in range(20):
        lm.gradient_step(w, used, leaf, prev, skip)
    assert np.exp(lm.log_leaf(w, leaf, prev, skip)).min() > 0.8
    assert (w[: len(biases)] != biases).any()


def test_weight_rows_are_hashed_as_in_long_integers():
    rng = np.random.default_rng(3)
    leaf, prev, skip = rng.integers(0, lm.LEAVES, (3, 1000))
    c1, c2 = leaf >> 8, leaf >> 4
    for level, node in enumerate((0, c1 + 1, c2 + 17)):
        for k, x in enumerate((prev * 40503, skip * 52711 + 7, prev * 92821 + skip * 68917 + 3)):
            h = [int(v) & 0xFFFFFFFF for v in x + node * 7919]
            h = [(v ^ (v >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF for v in h]
            h = [(v ^ (v >> 12)) * 0x297A2D39 & 0xFFFFFFFF for v in h]
            want = [lm.offsets()[level][k] + ((v ^ (v >> 15)) & (lm.ROWS - 1)) for v in h]
            assert lm._rows(leaf, prev, skip)[level][1][1 + k].tolist() == want
