"""The q-gram filter and the banded alignment against full dynamic programming."""

import random

import numpy as np

from merchgrid.llm import decontaminate as dc


def distance(a, b):
    """Fewest edits that turn all of a into some part of b."""
    row = np.zeros(len(b) + 1, int)
    for i, c in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, d in enumerate(b):
            new[j + 1] = min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1)
        row = new
    return row.min()


def word(r):
    return "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))


def test_leaks_equal_full_alignment():
    r = random.Random(11)
    items = [(i, " ".join(word(r) for _ in range(r.randint(8, 30)))) for i in range(12)]
    p = dc.index(items)
    found = 0
    for _ in range(150):
        i, t = r.choice(items)
        t = list(t)
        for _ in range(r.randint(0, max(1, int(len(t) * 0.14)))):
            k = r.randrange(len(t))
            kind = r.random()
            if kind < 0.4:
                t[k] = r.choice("abcdexyz")
            elif kind < 0.7:
                t.insert(k, r.choice("abcdexyz"))
            else:
                del t[k]
        doc = " ".join(word(r) for _ in range(r.randint(0, 40))) + " " + "".join(t) + " " + " ".join(word(r) for _ in range(r.randint(0, 40)))
        x, _ = dc.folded(doc)
        got = {i for i, *_ in dc.find(doc, p)}
        want = {p.ids[k] for k in range(len(p.ids)) if distance(p.texts[k], x) <= p.budget[k]}
        assert got == want
        found += bool(want)
    assert 30 < found < 150


def test_spans_fold_case_and_marks():
    p = dc.index([(7, "The quick brown fox jumps over the lazy dog"), (8, "too short")])  # the second one stands nowhere
    doc = "x " * 50 + "THE  quick, brown fox -- jumps over the lazy dog!" + " y" * 50
    assert dc.find(doc, p) == [(7, 100, 148, 0)]
    assert dc.find("", p) == [] and dc.find("the quick brown", p) == []
    assert [f[0] for f in dc.find("The quick brown fox jumps over the lazy dog", p)] == [7]


def test_rows(spark):
    text = "The quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"a {text} b", "k"), (2, None, None), (3, "clean", "k"), (3, "clean", "k")], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, text, 7)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, tuple(x.item_id for x in r.leaks)) for r in dc.with_leaks(docs, bench).collect()}
    assert got == {(1, (1, 3)), (2, ()), (3, ())}
    assert dc.clean(docs, bench).count() == 3 and dc.clean(docs, bench).columns == docs.columns
    assert dc.clean(docs, bench.limit(0)).count() == 4 and dc.clean(docs.limit(0), bench).count() == 0


def test_short_items_match_at_word_edges():
    p = dc.index([(1, "Paris"), (2, "to be"), (3, "To be!"), (4, ""), (None, "x y"), (5, "!?")])
    assert dc.find("in PARIS to-be or", p) == [(1, 3, 8, 0), (2, 9, 14, 0), (3, 9, 14, 0)]
    assert dc.find("parisian into be toobe", p) == [] and dc.find("X y", p) == [(None, 0, 3, 0)] and dc.find("", p) == []


def test_windows_own_the_places_that_start_in_them(monkeypatch):
    r = random.Random(4)
    items = [(i, " ".join(word(r) for _ in range(25))) for i in range(3)]
    p = dc.index(items)
    texts = [" ".join(word(r) for _ in range(r.randint(0, 60))) + " " + items[k % 3][1] + " " + " ".join(word(r) for _ in range(60)) for k in range(40)]
    whole = [dc.find(t, p) for t in texts]
    assert all(whole)
    for width in (64, 101, 333):
        monkeypatch.setattr(dc, "WINDOW", width)
        for t, want in zip(texts, whole, strict=True):
            assert [x for x in dc.find(t, p) if x[3] == 0] == [x for x in want if x[3] == 0], width
            assert {x[0] for x in dc.find(t, p)} == {x[0] for x in want}


def test_item_across_the_window_edge():
    item = "seven brave foxes carried nine golden apples over the frozen river at dawn"
    for shift in (0, 4, 40):
        t = "z " * ((dc.WINDOW - shift) // 2) + item + " z" * 50
        assert dc.find(t, dc.index([(1, item)])) == [(1, (dc.WINDOW - shift) // 2 * 2, (dc.WINDOW - shift) // 2 * 2 + len(item), 0)]
