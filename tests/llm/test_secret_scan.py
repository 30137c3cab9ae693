"""Secret spans against the plain patterns, and checksums against literal secrets."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from merchgrid.llm import secret_scan
from merchgrid.llm.secret_scan import find

SF = "/root/testdata/sf0.001"
PLAIN = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain(t):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PLAIN) for m in p.finditer(t) if ok(m)]
    return [(name, lo, hi) for lo, _, hi, name in sorted(spans)]


def base(t):
    return [s for s in find(t) if s[0] in secret_scan.BASE]


def digits(n, alphabet, width):
    out = ""
    while n:
        n, d = divmod(n, len(alphabet))
        out = alphabet[d] + out
    return out.rjust(width, alphabet[0])


def service(body, prefix="ghp_"):
    return prefix + body + digits(zlib.crc32(body.encode()), secret_scan._BASE62, 6)


def test_base_kinds_on_random_texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "api__key", "'", '"', " ", "  ", ":", "=", "==", "abcdef", "abc", "AKIA", "AKIAAKIA", "A" * 16, "7" * 20, "0123456789abcdef", "deadbeef", "é", "ſ", "K", "\n", "-", ".", "/", "z"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(t) == plain(t), t


def test_literal_cases():
    assert base("password=token: abcdef") == []
    assert base("password=ab token=abcdef") == [("assign", 12, 24)]
    assert base("secretoken = 'a.b-c_d'") == [("assign", 5, 21)]
    assert base("\U0001f600 PASSWORD: \"hunter22\"") == [("assign", 2, 21)]
    assert base("pa\u017f\u017fword=abcdefg to\u212aen=abcdefg") == []
    assert base("AKIA" + "A" * 15) == [] and base("AKIAAKIA" + "B" * 12) == [("access", 0, 20)]
    assert base("a" * 23) == [] and base("g" + "a" * 24 + "G") == [("hex", 1, 25)]
    assert find("") == []


def test_checksums_decide():
    good = service("a1B2" * 7 + "xy")
    assert find(f"x {good} y") == [("service", 2, 42)]
    assert find(good[:-1] + ("0" if good[-1] != "0" else "1")) == [] and find(good + "z") == []
    assert [s[0] for s in find(service("Q" * 30, "npm_"))] == ["npm"]
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    whole = raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    key = digits(int.from_bytes(whole, "big"), secret_scan._BASE58, 111)
    assert key.startswith("xprv") and find(f"({key})") == [("xprv", 1, 112)]
    assert find(key[:50] + ("2" if key[50] != "2" else "3") + key[51:]) == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    web = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    assert [s[0] for s in find(web)] == ["jwt"] and find(f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln") == []
    body = base64.b64encode(b"\x30\x20" + bytes(32)).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body[:20]}\n{body[20:]}\n-----END RSA PRIVATE KEY-----"
    assert [s[0] for s in find(pem)] == ["pem"]
    assert find(pem.replace(body[:20], base64.b64encode(b"\x30\x21" + bytes(32)).decode()[:20])) == []


@pytest.mark.parametrize("unit", ["password ", "password=", "token:a", "eyJ", "eyJ.", "eyJa.eyJb ", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----\n", "AKIA", "ab", "xprv", "ghp_", "secret  =", "api_key'"])
def test_linear_on_a_megabyte(unit):
    t = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    find(t)
    assert time.perf_counter() - start < 3


def test_query_equals_plain_patterns(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in entry.queries()["op13_secret_scan"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d["doc_id"]], plain(d["text"] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secret_scan.BASE] == [sum(s[0] == k for s in want) for k in secret_scan.BASE]
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))


def test_rows_of_every_kind(spark):
    t = "token=abcdef0123"
    rows = [(1, t, "own"), (1, t, "own"), (None, t, None), (2, None, "x"), (3, "", "y"), (4, "x" * 3_000_000 + t, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = secret_scan.with_spans(df).collect()
    assert sorted((r.doc_id or 0, r.kind or "") for r in out) == [(0, ""), (1, "own"), (1, "own"), (2, "x"), (3, "y"), (4, "z")]
    spans = {r.doc_id: [tuple(s) for s in r.secrets] for r in out}
    assert spans == {1: [("assign", 0, 16)], None: [("assign", 0, 16)], 2: [], 3: [], 4: [("assign", 3_000_000, 3_000_016)]}
    assert secret_scan.with_spans(df.limit(0)).count() == 0
