"""Repairs against an exhaustive search, SQL and rows of every kind."""

import hashlib
import itertools
import random
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from merchgrid.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"


def search(symbols, roles):
    """Cheapest (cost, audit) by trying edits in a plain state search, audits as strings."""
    best = {cr.START: (0, "")}
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    for s, role in [*zip(symbols, roles, strict=True), (None, None)]:
        for _ in range(2):
            for i, (c, a) in list(best.items()):
                if (c + 3, a + "I") < best.get(nxt[i], (1 << 60, "")):
                    best[nxt[i]] = c + 3, a + "I"
        if s is None:
            return min(best[i] for i in (0, 3) if i in best)
        new = {}
        for i, (c, a) in best.items():
            moves = [(i, 4, "D")]
            if s:
                cut = 3 * ((s - 1) % 2)
                moves.append((nxt[i], 3 + cut, "R"))
                if role == "s" and i == 0:
                    moves.append((1, cut, "K"))
                if role in ("u", "a") and nxt[i] == {"u": 2, "a": 3}[role]:
                    moves.append((nxt[i], cut, "K"))
            for j, x, letter in moves:
                new[j] = min(new.get(j, (1 << 60, "")), (c + x, a + letter))
        best = new
    return None


def coded(rows):
    """Symbols of rows ``(role initial, fault)``."""
    return [0 if f == "gone" else 1 + 2 * "suax".index(r) + (f == "cut") for r, f in rows]


def test_every_short_sequence_equals_the_search():
    g = cr.Grammar(((3, 5), (5, 3), (9, 9), (11, 1), (0, 0)))
    kinds = list(itertools.product("suax", ("fine", "cut")))
    kinds = [*kinds, ("u", "gone")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            symbols = coded(rows)
            assert g.whole(bytes(symbols)) == search(symbols, [r for r, _ in rows]), rows


def test_long_sequences_rules_and_blocks_change_nothing():
    rng = random.Random(11)
    for _ in range(60):
        rows = [(rng.choice("suuaaux"), rng.choice(("fine", "fine", "cut", "gone"))) for _ in range(rng.randint(20, 300))]
        symbols = coded(rows)
        want = search(symbols, [r for r, _ in rows])
        rules = tuple((rng.randint(0, 8 + k), rng.randint(0, 8 + k)) for k in range(80))
        assert cr.Grammar(()).whole(bytes(symbols)) == cr.Grammar(rules).whole(bytes(symbols)) == want
        at = rng.randint(0, len(symbols))
        v = [(0, cr.Rope("")), None, None, None]
        for part in (symbols[:at], symbols[at:]):
            v = cr.vector(v, cr.Grammar(rules).block(bytes(part)))
        assert cr.finish(v) == want


def test_ropes_compare_as_texts():
    rng = random.Random(2)
    for _ in range(300):
        texts, ropes = [], []
        for _ in range(2):
            parts = [rng.choice(("D", "DK", "K", "R" * 50, "I")) for _ in range(rng.randint(0, 12))]
            texts.append("".join(parts))
            rope = cr.Rope("")
            for p in parts:
                rope = rope + cr.Rope(p)
            ropes.append(rope)
        assert (ropes[0] < ropes[1]) == (texts[0] < texts[1]) and str(ropes[0]) == texts[0]


def brute(rows):
    """Results of undamaged rows by the contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            act = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = role if role is not None else " ", text if text is not None else " "
            if c == conv and act:
                text = "" if act == 1 else text.translate({ord(x): None for x in ".!?"}) if act == 2 else text
                mine += [(turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            clean = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not clean else "duplicate" if (role, text) in seen else "truncated" if clean[-1] not in ".!?" else "")
            seen.add((role, text))
        symbols = [0 if f in ("blank", "duplicate") else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(r[1][:1], 3) + (f == "truncated") for r, f in zip(mine, faults, strict=True)]
        cost, audit = search(symbols, [r[1][:1] for r in mine])
        lines, rest, last = [], iter(mine), None
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(mine, mine[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    return {r.conv_id: tuple(r)[1:] for r in cr.repair(cr.damage(df)).collect()}


@pytest.mark.parametrize("rows_a_block", [3, 1024])
def test_rows_of_every_kind(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(cr, "ROWS", rows_a_block)
    rng = random.Random(rows_a_block)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "cut off", "", None, " \n", "a?", "Long " * 50 + ".", "été…", "\U0001f600."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(77, t, "user", "same.") for t in range(700)] + [(78, 5, "user", "tie."), (78, 5, "user", "tie."), (78, 5, "assistant", "tie.")] * 20 + [(79, 1, "user", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, blk int")
    assert repaired(df.repartition(7)) == brute(rows)
    assert repaired(df.limit(0)) == {}


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = entry.oracle_sql()["op11_conversation_repair"]
    df = entry.queries()["op11_conversation_repair"](spark, SF)
    cols = sorted(df.columns)
    assert sorted(c.sql(sql).columns) == cols
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
