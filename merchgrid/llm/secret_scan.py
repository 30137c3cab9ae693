"""Secrets: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits, embedded checksums.

One automaton passes each text once and finds the keywords of every kind.  Only there is the
kind's regular expression tried, anchored at the keyword, so a text without keywords costs one pass in C.  Then the checks that a match carries in itself decide:
lengths, the CRC-32 at the end of a service token, the JSON head of a signed web token, the
base58 double-SHA-256 sum of an extended key, the DER length of a private key.

Base kinds are exactly the leftmost non-overlapping matches of their patterns, failing ones
dropped without a retry (ASCII letters only, whatever the case rules of other scripts say):

* ``assign``: a name such as ``password`` or ``api_key`` with a value of six characters or more,
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more,
* ``hex``: a run of ``0-9a-f`` of 24 characters or more.

Added kinds: ``service`` (prefix, 30 letters or digits, their CRC-32 in base 62), ``npm`` (the same
form under its own prefix), ``jwt``, ``xprv`` and ``pem``.

Work is linear in the text: a keyword inside an earlier match of its kind is passed over, and a hexadecimal run
is walked once.

Defined results: null text counts as empty and has no spans; offsets count code points, ends
exclusive; spans are ordered by start, then kind as listed; repeated rows give repeated results;
extra columns are kept; rows of very long texts are treated whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import chunks, texts, widened, with_columns

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "service", "npm", "jwt", "xprv", "pem"]
SPAN = "array<struct<kind:string,start:int,end:int>>"

#: Names that a secret is assigned to, in either case.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Prefixes of service tokens with a CRC-32, and other keywords that start a secret.
SERVICES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
STARTS = {"AKIA": "access", "npm_": "npm", "eyJ": "jwt", "xprv": "xprv", "-----BEGIN ": "pem"}
HEX = "0123456789abcdef"
#: Neighbouring hexadecimal digits that make a keyword; every run of 24 has such neighbours.
HEX_KEY = 4

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "service": re.compile(r"gh[pousr]_([0-9A-Za-z]+)"),
    "npm": re.compile(r"npm_([0-9A-Za-z]+)"),
    "jwt": re.compile(r"(eyJ[0-9A-Za-z_-]*)\.(eyJ[0-9A-Za-z_-]*)\.[0-9A-Za-z_-]+"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]+"),
    "pem": re.compile(r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]*)-----END (?:[A-Z]+ )?PRIVATE KEY-----", re.ASCII),
}


def _crc62(m: re.Match) -> bool:
    """30 letters or digits and the CRC-32 of them as six digits of base 62."""
    body = m[1]
    if len(body) != 36:
        return False
    n = 0
    for c in body[30:]:
        n = n * 62 + _BASE62.index(c)
    return n == zlib.crc32(body[:30].encode())


def _unpadded(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _jwt(m: re.Match) -> bool:
    """Head and claims are JSON objects and the head names an algorithm."""
    try:
        head, claims = json.loads(_unpadded(m[1])), json.loads(_unpadded(m[2]))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def _base58(m: re.Match) -> bool:
    """111 digits of base 58 whose last four bytes are the double SHA-256 of the 78 before."""
    if len(m[0]) != 111:
        return False
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(83, "big")[-82:]
    return n < 1 << 656 and hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def _pem(m: re.Match) -> bool:
    """The body is base64 of one DER sequence whose length is the rest of it."""
    try:
        raw = base64.b64decode("".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if len(raw) < 16 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    size = raw[1] & 0x7F
    return 0 < size <= 4 and len(raw) == 2 + size + int.from_bytes(raw[2 : 2 + size], "big")


#: The first run of a web token.
_RUN = re.compile(r"[0-9A-Za-z_-]*")

CHECKS: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "hex": lambda m: len(m[0]) >= 24,
    "service": _crc62,
    "npm": _crc62,
    "jwt": _jwt,
    "xprv": _base58,
    "pem": _pem,
}


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    """Every spelling of the names, the starts of the other kinds, and all runs of ``HEX_KEY`` hexadecimal digits."""
    a = ahocorasick.Automaton()
    for name in NAMES:
        for spelling in itertools.product(*({c, c.upper()} for c in name)):
            a.add_word("".join(spelling), ("assign", len(name)))
    for word, kind in [*STARTS.items(), *((s, "service") for s in SERVICES)]:
        a.add_word(word, (kind, len(word)))
    for digits in itertools.product(HEX, repeat=HEX_KEY):
        a.add_word("".join(digits), ("hex", HEX_KEY))
    a.make_automaton()
    return a


def find(t: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    got: list[tuple[int, int, int]] = []
    order = {k: i for i, k in enumerate(KINDS)}
    floor = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _keywords().iter(t):
        at = last + 1 - size
        if at < floor[kind]:
            continue
        m = PATTERNS[kind].match(t, at)
        if m is None:
            if kind == "jwt":  # a later start within the same run of letters has the same rest behind it
                floor[kind] = _RUN.match(t, at).end()
            continue
        floor[kind] = m.end()
        if CHECKS[kind](m):
            got.append((at, order[kind], m.end()))
    return [(KINDS[k], lo, hi) for lo, k, hi in sorted(got)]


def with_spans(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with all spans of ``text`` as column ``out`` (a column of that name is replaced)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4 << 20):
            found = [[{"kind": k, "start": lo, "end": hi} for k, lo, hi in find(t)] for t in texts(b, text)]
            yield with_columns(b, {out: pa.array(found, kind)})

    return docs.mapInArrow(run, widened(docs.schema, **{out: SPAN}))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
