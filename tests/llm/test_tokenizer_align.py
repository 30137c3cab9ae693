"""Groups, links and counts against plain Python over whole encodings."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from merchgrid.llm import tokenizer_align
from merchgrid.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {c: i for i, c in enumerate(byte_letters())}


def plain(sides, text):
    """Groups as lists of ids, by the ends of tokens over the whole text."""
    a, b, back = sides
    if not text:
        return []
    ea, eb = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    ids = ea.ids  # a new list on each call
    ba = [bytes(back[c] for c in t) for t in ea.tokens]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return []
    at = [list(accumulate(map(len, x))) for x in (ba, bb)]
    out, i, j = [], 0, 0
    for end in sorted(set(at[0]) & set(at[1])):
        k, n = bisect_right(at[0], end), bisect_right(at[1], end)
        out.append((tuple(ids[i:k]), tuple(eb[j:n])))
        i, j = k, n
    return out


def written(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def results(sides, texts):
    groups = [plain(sides, t) for t in texts]
    count = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for g in groups:
        links = [count[x[-1], y[-1]] for x, y in g]
        best = sum(count[x[-1], y[-1]] == top[y[-1]] for x, y in g)
        digest = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), best, sum(links), digest))
    return out


ODD = ["", " ", "  ", "a", " a ", "a  b", "tab\t x", "\n\nline \n next", "don't we'll", "A▁b plain", "▁", "<|endoftext|> x <s></s><unk>", "<0x41>", "ﬁne ｆｕｌｌ", "é é", "　x  y", "a\x00b \x1c c \x85 d", "日本語 テキスト", "😀 👍🏽", "x" * 500, "١٢٣ 456 7", "foo\r\n bar", "end ", "word\n"]


def test_units_equal_whole_texts(sides):
    al = tokenizer_align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "ing", "über", "é", "日本", "1234", "'s", "'", ".", "▁", "\t", "Xq", "😀", "\r"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    for t, got in zip(texts, al.texts(texts), strict=True):
        want = plain(sides, t)
        assert (got.groups if got else "") == written(want), repr(t)
        assert got == (al.align(t) if t else None), repr(t)
        if got:
            assert (got.n_a, got.n_b) == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want))


def test_forgotten_units_change_nothing(monkeypatch):
    texts = [d or "" for d in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()][:40]
    al = tokenizer_align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    want = al.texts(texts)
    monkeypatch.setattr(tokenizer_align, "MEMO", 50)
    monkeypatch.setattr(tokenizer_align, "SLICE", 7)
    monkeypatch.setattr(tokenizer_align, "MEMO_CHARS", 5)
    assert al.texts(texts) == want and al.texts(texts) == want


def test_query_equals_plain_counts(spark, sides):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op12_tokenizer_align"](spark, SF).collect()}
    assert got == dict(zip((d["doc_id"] for d in docs), results(sides, [d["text"] for d in docs]), strict=True))


def test_defined_rows(spark, sides):
    texts = [None, *ODD, "the end of the text", "the end of the text", "the end " * 20_000]
    rows = [(k if k % 5 else None, t, "x", 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links string, row int")
    out = tokenizer_align.align(df, A, B, keep_groups=True)
    assert out.columns == ["doc_id", "text", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum"]
    key = lambda r: (r[0] or -1, r[1] or "")
    got = sorted(((r.doc_id, r.text, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups, r.row) for r in out.collect()), key=key)
    want = sorted(((i, t, *r, written(plain(sides, t)), 7) for (i, t, _, _), r in zip(rows, results(sides, texts), strict=True)), key=key)
    assert got == want
    assert tokenizer_align.align(df.limit(0), A, B).count() == 0
