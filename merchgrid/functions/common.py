"""Small column helpers shared by every job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(rows: DataFrame) -> DataFrame:
    """One side of a join of two sides that both grow with the tables: it is sorted and merged, never broadcast.

    Spark takes a side's size from its compressed files, before names are built and arrays exploded, so a table of a few
    MB may stand for hundreds in the driver and in every task.
    """
    return rows.hint("merge")


def half_up(c: Column, digits: int) -> Column:
    """Round with ``floor(x * 10^n + 0.5) / 10^n`` - plain double arithmetic in any engine."""
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with 0 for an empty denominator (ANSI mode raises otherwise)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim all leading/trailing whitespace; SQL ``trim`` removes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def labels(*pairs: tuple[Column, object]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    items = [F.when(cond, lab if isinstance(lab, Column) else F.lit(lab)) for cond, lab in pairs]
    return F.array_compact(F.array(*items))


def add_all(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def flag(cond: Column, value: float = 1.0) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def contains_any(c: Column, needles) -> Column:
    return any_of(*[c.contains(n) for n in needles])


def lookup(key: Column, table: dict) -> Column:
    """Literal-map lookup for a rule table of fixed size; null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def first_rule(subject: Column, rules) -> Column:
    """Value of the first regex (in order) found in ``subject``; null when none is."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(list(rules)):
        out = F.when(subject.rlike(pattern), F.lit(value)).otherwise(out)
    return out
