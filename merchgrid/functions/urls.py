"""URL expressions (F7) and URL predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchgrid.functions.common import text
from merchgrid.rules import matching as rules

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host(url: Column) -> Column:
    """Host without ``www.``; the first path part of a URL without a scheme."""
    found = F.regexp_extract(url, AUTHORITY, 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(F.element_at(F.split(url, "[/?#]"), 1)), r"^www\.", "")


def drop_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def normalize(url: Column) -> Column:
    """Fragment and trailing slashes removed; a bare root keeps its slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    return F.when(path(plain) == "/", plain).otherwise(F.regexp_replace(plain, "/+$", ""))


def drop_resize_params(url: Column) -> Column:
    """Query parameters that only select a thumbnail are removed."""
    has_query = F.instr(url, "?") > 0
    base, rest = F.substring_index(url, "?", 1), F.regexp_replace(F.regexp_extract(url, r"\?(.*)$", 1), "#.*$", "")
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    kept = F.filter(F.split(rest, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(rules.RESIZE_PARAMS))
    joined = F.array_join(kept, "&")
    return F.when(has_query, F.concat(base, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)), fragment)).otherwise(url)


def widest_source(srcset: Column) -> Column:
    """URL with the largest width of a ``srcset``; the first of equals wins."""
    entries = F.transform(F.split(text(srcset), r"\s*,\s+|,(?=https?:)"), F.trim)
    parsed = F.transform(
        F.filter(entries, lambda e: e != ""),
        lambda e, i: F.struct(
            F.coalesce(F.regexp_extract(e, r"\s(\d+)w$", 1).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("rank"),
            F.element_at(F.split(e, r"\s+"), 1).alias("url"),
        ),
    )
    return F.array_max(parsed)["url"]


def is_product_url(url: Column, blocked_paths: Column) -> Column:
    """False only below a blocked path; product patterns never reject."""
    p = F.lower(path(url))
    return ~F.exists(blocked_paths, lambda b: p.startswith(F.lower(b)))


def same_domain(url: Column, domain: Column) -> Column:
    """Either host contains the other."""
    a, b = F.lower(host(url)), F.lower(F.regexp_replace(domain, r"^www\.", ""))
    return a.contains(b) | b.contains(a)


def image_reject_reason(url: Column) -> Column:
    """Why an image is not importable; null when it is."""
    low = F.lower(text(url))
    bare = F.substring_index(low, "?", 1)
    return (
        F.when(bare.endswith(".svg") | bare.endswith(".ico"), "unsupported format")
        .when(low.rlike("icon|logo|badge|pixel"), "likely icon/badge").when(url.startswith("data:"), "data URI")
    )
