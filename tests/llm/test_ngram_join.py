"""Classes and link counts against all pairs."""

import random

import numpy as np
import pytest

from merchgrid.llm import ngram_join as nj


def grams(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links = [[i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        if label[i] < i:
            continue
        while todo:
            k = todo.pop()
            for j, y in enumerate(links[k]):
                if y and label[j] != label[i]:
                    label[j] = label[i]
                    todo.append(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids[label[i]] = min(ids.get(label[i], d), d)
    return {d: (ids[label[i]], sum(links[i])) for i, (d, _) in enumerate(rows)}


def sample(seed):
    r = random.Random(seed)

    def text(n):
        return [f"w{r.randint(0, 400)}" for _ in range(n)]

    def edit(t, k):
        t = list(t)
        for _ in range(k):
            t[r.randrange(len(t))] = f"x{r.randint(0, 10**6)}"
        return t

    rows = []
    for _ in range(6):
        base = text(r.randint(40, 160))
        for _ in range(r.randint(2, 25)):
            rows.append(edit(base, r.choice([0, 0, 1, 1, 2, 3, 5, 8])))
    rows += [text(r.randint(0, 8)) for _ in range(30)] + [text(60) for _ in range(30)] + [[], ["a"], ["a"], ["a", "b", "c", "d", "e"]]
    r.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 4)])
def test_equals_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_NODES", block)
    rows = sample(seed)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_bands_meet_the_recall():
    bands, rows = nj.choose_bands(0.8)
    assert bands * rows <= nj.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= nj.RECALL
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 50, np.uint64))
    assert not nj.linked([a, a[:35]], (4, 5))[0, 1] and nj.linked([a, a[:40]], (4, 5))[0, 1]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "a b c d e f", "y"), (3, "a b c d e f", "z"), (3, "a b c d e f", "z"), (5, " \n", "x"), (6, "long " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in nj.jaccard_classes(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0, True), (None, 3, 2, False), (3, 3, 2, True), (3, 3, 2, False), (5, 5, 0, True), (6, 6, 0, True)], key=repr)
    assert nj.keep_one(df).count() == 4 and nj.keep_one(df).columns == df.columns
    assert nj.jaccard_classes(df.limit(0)).count() == 0
