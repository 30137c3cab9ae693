"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs,
digits, scheme marks and identifier cues.  Deterministic local parsers expand each anchor to
the left and right as far as its kind allows and validate it: labels of a domain, parts of
an address, the Luhn sum of a card, the mod-97 sum of an account number.  Work is linear in
the text.  Base kinds (email, ip, card, phone) give exactly the leftmost non-overlapping
matches of their patterns, failing ones dropped without a retry; url, iban and ssn are added.

Defined results: null text counts as empty and has no spans; offsets count code points, ends
exclusive; repeated rows give repeated results; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import chunks, texts, widened, with_columns

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "ssn"]
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _ALNUM | frozenset("+.-")
_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
SPAN = "array<struct<kind:string,start:int,end:int>>"


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for anchor, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *((d, "digit") for d in "0123456789")]:
        a.add_word(anchor, (kind, len(anchor)))
    for cue, kind in (("iban", "iban"), ("ssn", "ssn"), ("social security", "ssn")):
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(t: str, i: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from ``i``."""
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    lo = at
    while lo > floor and t[lo - 1] in _LOCAL:
        lo -= 1
    hi = _run(t, at + 1, _LABEL)
    if lo == at or hi == at + 1:
        return None
    end = hi
    while end < len(t) and t[end] == ".":
        nxt = _run(t, end + 1, _LABEL)
        if nxt == end + 1:
            break
        end = nxt
    return (lo, end) if end > hi else None


def _phone(t: str, at: int) -> tuple[int, int] | None:
    """From the plus sign to the last digit of the run behind it; None where the pattern doesn't match."""
    if at + 1 >= len(t) or t[at + 1] not in _DIGITS:
        return None
    end = _run(t, at + 2, _PHONE)
    while end > at + 2 and t[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def _card(t: str, at: int) -> int:
    """End of the chain of digits with at most one space or hyphen between two."""
    n, j = len(t), at + 1
    while j < n:
        if t[j] in _DIGITS:
            j += 1
        elif t[j] in " -" and j + 1 < n and t[j + 1] in _DIGITS:
            j += 2
        else:
            break
    return j


def _dotted(t: str, at: int) -> list[tuple[int, int]]:
    """The numbers of a dotted chain."""
    out = []
    while True:
        end = _run(t, at, _DIGITS)
        out.append((at, end))
        if end + 1 < len(t) and t[end] == "." and t[end + 1] in _DIGITS:
            at = end + 1
        else:
            return out


def _at_most_255(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _url(t: str, colon: int, floor: int, run: list[int]) -> tuple[int, int] | None:
    """``run`` remembers the end of the characters that a URL may hold, and that without closing punctuation."""
    if colon < floor:
        return None
    lo = colon
    while lo > floor and t[lo - 1] in _SCHEME:
        lo -= 1
    while lo < colon and not t[lo].isalpha():
        lo += 1
    if colon + 3 > run[0]:
        end = colon + 3
        while end < len(t) and t[end] not in _URL_END:
            end += 1
        run[0] = end
        while end > colon + 3 and t[end - 1] in ".,;:!?)]":
            end -= 1
        run[1] = end
    hi = max(run[1], colon + 3)
    slash = t.find("/", colon + 3, hi)
    host = t[colon + 3 : slash if slash >= 0 else hi].rpartition("@")[2].split(":", 1)[0]
    return (lo, hi) if lo < colon and "." in host.strip(".") and _run(host, 0, _LABEL | {"."}) == len(host) else None


def _iban(t: str, i: int) -> tuple[int, int] | None:
    while i < len(t) and t[i] in " :#=.":
        i += 1
    lo, got, end = i, "", i
    while i < len(t) and len(got) < 34 and (t[i] in _ALNUM or t[i] == " " and i > end - 1 and got):
        if t[i] != " ":
            got += t[i].upper()
            end = i + 1
            if len(got) == 4 and not (got[:2].isalpha() and got[2:].isdigit()):
                return None
            if len(got) >= 15 and got[:2].isalpha() and got[2:4].isdigit() and int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1:
                if i + 1 >= len(t) or t[i + 1] not in _ALNUM:
                    return lo, end
        i += 1
    return None


def _ssn(t: str, i: int) -> tuple[int, int] | None:
    while i < len(t) and t[i] in " :#=.":
        i += 1
    s = t[i : i + 11]
    fits = len(s) == 11 and s[3] == s[6] == "-" and all(c in _DIGITS for c in s[:3] + s[4:6] + s[7:])
    return (i, i + 11) if fits and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" and (i + 11 == len(t) or t[i + 11] not in _DIGITS) else None


def find(t: str) -> list[tuple[str, int, int]]:
    """All spans by kind, then start."""
    got: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = {k: 0 for k in KINDS}
    run = [0, 0]
    for last, (kind, size) in _automaton().iter(t):
        at = last + 1 - size
        if kind == "digit":
            if at >= floor["card"]:
                end = _card(t, at)
                floor["card"] = end
                digits = t[at:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    got["card"].append((at, end))
            if at >= floor["ip"]:
                parts = _dotted(t, at)
                floor["ip"] = parts[-1][1]
                for k in range(0, len(parts) - 3, 4):
                    if all(_at_most_255(t[lo:hi]) for lo, hi in parts[k : k + 4]):
                        got["ip"].append((parts[k][0], parts[k + 3][1]))
        elif kind == "email":
            m = _email(t, at, floor["email"])
            if m:
                floor["email"] = m[1]
                got["email"].append(m)
        elif kind == "phone":
            if at >= floor["phone"]:
                m = _phone(t, at)
                if m:
                    floor["phone"] = m[1]
                    if 8 <= sum(c in _DIGITS for c in t[m[0] : m[1]]) <= 15:
                        got["phone"].append(m)
        else:
            m = _url(t, at, floor["url"], run) if kind == "url" else _iban(t, last + 1) if kind == "iban" else _ssn(t, last + 1)
            if m and m[0] >= floor[kind]:
                floor[kind] = m[1]
                got[kind].append(m)
    return [(k, lo, hi) for k in KINDS for lo, hi in got[k]]


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with all spans of ``text`` as column ``out``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4 << 20):
            found = [[{"kind": k, "start": lo, "end": hi} for k, lo, hi in find(t)] for t in texts(b, text)]
            yield with_columns(b, {out: pa.array(found, kind)})

    return docs.mapInArrow(run, widened(docs.schema, **{out: SPAN}))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
