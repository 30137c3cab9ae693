"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from merchgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe._loaded(open(PATH, "rb").read())


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == want, text
    assert OURS.decode(np.asarray(want, np.int64)) == LIBRARY.decode(want, skip_special_tokens=False)


def test_random_texts():
    r = random.Random(3)
    parts = ["a", "b", "e", " ", "  ", "\n", "th", "ing", "1", "23", "'s", "!", "é", "ß", "你", "\U0001f600", "\r\n", "\t", "<|endoftext|>", "aaaa", "    ", "\x1c", "\x85", " ", "--", "****"]
    for _ in range(4000):
        check("".join(r.choice(parts) for _ in range(r.randint(0, 25))))
    for _ in range(2000):
        check("".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(97, 122)])) for _ in range(r.randint(1, 30))))


def test_every_token_and_long_runs():
    for t in list(LIBRARY.get_vocab())[::7]:
        check(t)
    for n in (1, 2, 3, 10, 100, 5001, 100_000):
        for c in "a- =0é\n":
            check(c * n)


def test_broken_ids_decode_like_the_library():
    r = random.Random(4)
    for _ in range(500):
        ids = [r.randint(0, 50256) for _ in range(r.randint(0, 12))]
        assert OURS.decode(np.asarray(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    texts = [(1, "Hello  world<|endoftext|>"), (2, None), (3, ""), (1, "Hello  world<|endoftext|>")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, token_ids string")
    rows = bpe.round_trip(df, PATH, keep_ids=True).collect()
    assert len(rows) == 4
    for r in rows:
        text = dict(texts)[r.doc_id] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, list(r.token_ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decoded(bpe.with_tokens(df, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
