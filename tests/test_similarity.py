"""The batch ratio against the standard library's matcher."""

import random
from difflib import SequenceMatcher

from merchgrid.functions import similarity as S


def test_batch_ratio_equals_the_matcher(monkeypatch):
    rng = random.Random(12)
    for alphabet in ("ab", "abcde ", "abcdefghijklmnopqrstuvwxyz é\U0001f600"):
        pairs = [tuple("".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 2, 5, 13, 40, 90)))) for _ in range(2)) for _ in range(300)]
        pairs += [("trail jacket mens", "mens trail jacket 2024"), ("x" * 250, "x" * 250), ("a b" * 90, "b a" * 90), ("same", "same"), ("", "")]
        want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
        assert S.ratios(pairs) == want
        monkeypatch.setattr(S, "CELLS", 500)
        assert S.ratios(pairs) == want
        monkeypatch.setattr(S, "CELLS", 1 << 20)


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "ab", "abc"), (2, None, "x"), (3, "ab", "abc"), (4, "", "")], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", S.sequence_ratio(df.a, df.b).alias("s")).collect()}
    assert got == {1: 0.8, 2: None, 3: 0.8, 4: 1.0}
