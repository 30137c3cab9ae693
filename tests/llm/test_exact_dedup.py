"""Block naming against grouping by the normalised text."""

import hashlib
import random
import re

import pytest

from merchgrid.llm import exact_dedup as ed


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, x in norm.items():
        groups.setdefault(x, []).append(i)
    return {i: (min(groups[x]), len(groups[x]), i == min(groups[x]), hashlib.sha256(x.encode()).hexdigest()) for i, x in norm.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_equals_grouping(spark, block):
    r = random.Random(block)
    pool = ["", " ", "\n", "a", "ab", "abc", "abcd", "abcabc", "abc abc", "abc\n\tabc", "é\U0001f600x" * 5] + ["".join(r.choice("ab \n") for _ in range(r.randint(1, 40))) for _ in range(60)]
    rows = [(i, r.choice(pool)) for i in range(400)] + [(1000, None), (1001, "x" * 20000), (1002, "x" * 20000), (1003, "x" * 20001)]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block).collect()}
    assert got == brute(rows)


def test_colliding_block_keys_are_told_apart(spark, monkeypatch):
    real = ed.F.xxhash64
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: real(*c) % 3)
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, "a", 1), (5, "a", 2), (None, "a", 3), (6, None, 4), (7, "", 5)], "doc_id long, text string, name int")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.keep_id, x.group_size, x.kept) for x in ed.exact_dedup(df).collect())
    assert got == [(False, 5, 5, 3, False), (False, 5, 5, 3, True), (False, 6, 6, 2, True), (False, 7, 6, 2, False), (True, 0, 5, 3, False)]
    kept = ed.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == 2
    assert ed.exact_dedup(df.limit(0)).count() == 0
