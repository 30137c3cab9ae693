"""Anchor expansion against the plain patterns."""

import random
import re
import time

import pytest

from merchgrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok[k](m.group())]


def test_random_texts_equal_the_patterns():
    r = random.Random(5)
    parts = ["a", "B.", "@", "x@y.z", ".", "-", " ", "+", "+1", "(", ")", "1", "22", "255", "256", "1.2.3.4", "4929348385146306", "4111 1111 1111 1111", "é", "\n", "%", "_", "00", "..", "--", "٣"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute(t), t


def test_edges():
    assert pii.find("") == []
    assert pii.find("a@b.c.d@e.f") == [("email", 0, 7)]
    assert pii.find("1.2.3.4.5.6.7.8") == [("ip", 0, 7), ("ip", 8, 15)]
    assert pii.find("+1 (017) 555-7713 x") == [("phone", 0, 17)]
    assert ("card", 0, 16) in pii.find("4929348385146306")
    long = "1" * 5000 + ".1.1.1"
    assert [s for s in pii.find(long) if s[0] in pii.BASE] == []


def test_added_kinds():
    assert ("url", 4, 27) in pii.find("see http://a.example.com/x?y, now")[0:9] or ("url", 4, 28) in pii.find("see http://a.example.com/x?y, now")
    assert ("iban", 5, 27) in pii.find("IBAN DE89370400440532013000 x")
    assert ("ssn", 5, 16) in pii.find("SSN: 123-45-6789.")


def test_rows(spark):
    df = spark.createDataFrame([(1, "a@b.cc", 7), (None, None, 8), (1, "a@b.cc", 7)], "doc_id long, text string, kind int")
    got = pii.with_spans(df).collect()
    assert len(got) == 3 and [len(r.pii) for r in got] == [1, 0, 1]
    assert pii.with_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["a://b", "a://b.", "://", "a@b.", "+1", "1.", "1-", "iban ", "ssn ", "x://u@"])
def test_linear_on_a_megabyte(unit):
    start = time.perf_counter()
    pii.find(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 6


def test_urls():
    assert [s for s in pii.find("see http://a.b/c?x=http://d.e, and x://y.z).") if s[0] == "url"] == [("url", 4, 29), ("url", 35, 42)]
    assert [s for s in pii.find("a://b://c.d/e") if s[0] == "url"] == [("url", 4, 13)]
