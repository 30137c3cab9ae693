"""Colour name expressions: comparison form, family, search term, fuzzy option match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchgrid.functions.common import lookup, squeeze, strip, text
from merchgrid.rules import colors as rules


def normalize(c: Column) -> Column:
    """Comparison form: separators ``/ | - w/`` become blanks, lower case (F16)."""
    steps = [(r"\s*[/|]\s*", " "), (r"\s+-\s+", " "), (r"\bw/", "w ")]
    return F.lower(squeeze(reduce(lambda x, p: F.regexp_replace(x, *p), steps, c)))


def loosely_contains(a: Column, b: Column) -> Column:
    """One normalised name inside the other and longer than half of it."""
    la, lb = F.length(a), F.length(b)
    inside = lambda s, l, n, m: l.contains(s) & (n > 0) & (n * 2 > m)
    return F.when(la <= lb, inside(a, b, la, lb)).otherwise(inside(b, a, lb, la))


def family(color: Column) -> Column:
    """Colour family of a vendor's colour name; null when nothing fits."""
    name = strip(text(color))
    low = F.lower(name)
    creative = rules.CREATIVE_NAMES
    parts = F.split(name, "/")
    slash_pair = (F.size(parts) >= 2) & F.forall(parts, lambda p: strip(p) != "")
    exact = lookup(low, {f.lower(): f for f in rules.FAMILIES})
    inside = F.coalesce(*[F.when(low.contains(f.lower()), F.lit(f)) for f in rules.FAMILY_PRIORITY])
    words = F.split(F.replace(low, F.lit("-"), F.lit(" ")), r"\s+")
    by_word = F.get(F.filter(F.transform(words, lambda w: lookup(w, creative)), lambda f: f.isNotNull()), F.lit(0))
    known = F.when(slash_pair, F.lit("Multi")).otherwise(F.coalesce(exact, lookup(low, creative), inside, by_word))
    return F.when((text(color) != "") & (color != "Default Title"), known)


def query_term(color: Column) -> Column:
    """Search-friendly colour term."""
    base = F.regexp_replace(strip(color), r"(?i)\s+w/\s.*$|\s+with\s.*$", "")
    base = F.regexp_replace(base, r"(?i)\s+\S*\s*lens$", "")
    words = F.filter(F.split(F.lower(F.replace(base, F.lit("/"), F.lit(" "))), r"\s+"), lambda w: (w != "") & ~w.isin(rules.MODIFIERS))
    lone = F.element_at(words, 1)
    plain = F.when(F.size(words) == 1, F.split(F.coalesce(lookup(lone, rules.PLAIN_NAMES), lone), " ")).otherwise(words)
    kept = F.filter(plain, lambda w, i: (i == 0) | (w != F.get(plain, i - 1)))
    return F.when(F.size(words) == 0, strip(F.lower(color))).otherwise(F.array_join(kept, " "))


def description_words(c: Column) -> Column:
    words = F.transform(F.split(F.lower(strip(c)), r"\s+"), lambda w: F.regexp_replace(w, "^[,.]+|[,.]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(rules.DESCRIPTION_NOISE)))


def option_words(c: Column) -> Column:
    """Meaningful words of an option in order; the first one is its dominant colour word."""
    words = F.split(F.lower(strip(F.regexp_replace(c, "[/-]", " "))), r"\s+")
    return F.filter(words, lambda w: ~w.isin(rules.DESCRIPTION_NOISE))


def best_option(desc: Column, options: Column) -> Column:
    """Option a free description points at, null when the overlap is too weak.

    ``desc`` holds the description's words, ``options`` an ordered array of
    structs (option, words).  The first option with the largest overlap is taken;
    one shared word suffices only for a one-word description or when it is the
    option's dominant word.
    """
    scored = F.transform(
        options,
        lambda o, i: F.struct(
            F.size(F.array_intersect(desc, o["words"])).alias("n"), (-i).alias("rank"), o["option"].alias("option"),
            F.coalesce(F.array_contains(desc, F.get(o["words"], F.lit(0))), F.lit(False)).alias("dominant"),
        ),
    )
    best = F.array_max(scored)
    need = F.when(F.size(desc) >= 2, 2).otherwise(1)
    return F.when((best["n"] >= 1) & ((best["n"] >= need) | best["dominant"]), best["option"])
