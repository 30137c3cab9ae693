"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element ends a line.  Parts that are marked as no
text of the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments;
by element or by the words of class, id and role) leave empty lines behind, as do the edges of
``article`` and ``main``.  Text lengths are then summed over windows of ``WINDOW`` lines: the sum
surges where text begins and dives to zero where it ends.  What lies between a dive and
the next is one stretch; a stretch surges if its sum passes ``SURGE`` somewhere, link texts not
counted.  Inside an ``article`` or ``main`` the threshold is zero, outside it is ``SURGE`` whether the page has
such elements or not.  All is kept from the first surge to the last dive, which is where the last text outside
links ends: marked parts inside the text cut it up, and its short pieces belong to it.  Before the first surge, what
begins with a heading is kept too, unless nothing but links stands between.  If no stretch
surges, the threshold is zero everywhere; a page of nothing but links is kept whole.

Work is linear in the page; pages are independent of each other.  Defined results: null html
counts as empty; a page without text gives the empty string; a tag cut off by the end of the page is
dropped; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from merchgrid.llm.common import chunks, texts, widened, with_columns

#: Lines of a window, and the characters outside links that a window needs for a surge.
WINDOW, SURGE = 3, 86

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile("[>\"']")
#: Elements whose content is no markup and no text of the page, and their ends.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style title textarea noscript iframe template".split()}
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no text of an article.
APART = frozenset("aside button dialog footer form head header menu nav search select svg".split())
#: Words of class, id and role that mark such parts.
APART_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert alertdialog banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommendations recommended "
    "related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that may stand beside one of these in a class, id or role, as in ``site-footer``; others, as in ``long-form``, unmark it.
PLACE_WORDS = frozenset(
    "app area bar block body bottom box btn button buttons card center col column container content desktop entry fixed global group icon icons inline inner item items label left link links list main mini mobile new outer page panel post posts primary reader right row secondary "
    "section site slot small sticky story text title top unit user web wrap wrapper".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KEEP = frozenset("html body article main".split())
_NEGATED = frozenset("no has have with without not".split())
#: Elements that end where their next sibling begins, and what begins after them.
_IMPLIED = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}


def _apart(name: str, attributes: str, articles: int) -> bool:
    if name in _KEEP or name in _VOID:
        return False
    if name in APART:
        return not (name == "header" and articles)
    for value in _MARKS.findall(attributes):
        for token in value.strip("\"'").split():
            found = [w.lower() for w in _WORD.findall(token)]
            marks = [k for k, w in enumerate(found) if w in APART_WORDS and not (k and found[k - 1] in _NEGATED) and not (w in ("header", "byline") and articles)]
            if marks and all(w in APART_WORDS or w in PLACE_WORDS or w.isdigit() for w in found):
                return True
    return False


def tags(html: str) -> Iterator[tuple[int, int, bool, bool, str, str]]:
    """``(start, end, raw, closing, name, attributes)`` of tags, comments and elements without markup inside, in one pass.

    A ``>`` inside quotes ends no tag; once quotes don't pair up, they count as other characters.  What can't end is left as text, but
    for an unfinished tag at the end of the page.
    """
    at, quotes = 0, True
    while m := _OPEN.search(html, at):
        lo, name = m.start(), (m[3] or "").lower()
        if m[1]:
            end = html.find("-->", m.end()) + 3
            at = end if end > 2 else len(html)
            yield lo, at, False, False, "", ""
            continue
        end = -1
        if name and name not in _RAW and quotes:
            i = m.end()
            while q := _STOP.search(html, i):
                if q[0] == ">":
                    end = q.start()
                    break
                i = html.find(q[0], q.end()) + 1
                if not i:
                    break
            quotes = end >= 0
        if end < 0:
            end = html.find(">", m.end())
        if end < 0:
            cut = html.rfind("<")
            if _OPEN.match(html, cut):
                yield cut, len(html), False, False, "", ""
            return
        at = end + 1
        raw = name in _RAW and not m[2]
        if raw:
            close = _RAW[name].search(html, at)
            at = close.end() if close else len(html)
        yield lo, at, raw, bool(m[2]), name, html[m.end() : end]


def lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, characters outside links, inside an article, heading)`` per line; gaps are empty lines."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    plain = 0
    inside = articles = depth = link = 0
    skip = ""
    heading = False

    def flush() -> None:
        nonlocal plain
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, plain, inside > 0, heading))
        parts.clear()
        plain = 0

    def gap() -> None:
        flush()
        out.extend([("", 0, inside > 0, False)] * WINDOW)

    def say(raw: str) -> None:
        nonlocal plain
        if raw and not skip:
            text = unescape(raw)
            parts.append(text)
            if not link:
                plain += len(text.strip())

    end = 0
    for start, stop, raw, closing, name, attributes in tags(html):
        say(html[end:start])
        end = stop
        if raw or not name:
            if raw and not skip:
                parts.append(" ")
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if attributes.rstrip().endswith("/") else 1
                if not closing and name in _IMPLIED and name in _IMPLIED[name]:
                    depth = 0  # the next sibling
            elif not closing and (name in ("article", "main") or name in _IMPLIED.get(skip, ())):
                depth = 0
            elif closing and name in ("article", "main", "body", "html"):
                depth = 0
            if depth > 0:
                continue
            ended_by_close = closing and name == skip
            skip = ""
            if ended_by_close:
                continue
        if closing:
            if name == "a":
                link = 0
            elif name in ("article", "main"):
                gap()
                inside = max(0, inside - 1)
                articles = max(0, articles - (name == "article"))
            elif name in BLOCKS:
                flush()
                heading = heading and name not in HEADINGS
            continue
        if _apart(name, attributes, articles):
            gap()
            if not attributes.rstrip().endswith("/"):
                skip, depth, link = name, 1, 0
            continue
        if name in ("article", "main"):
            gap()
            inside += 1
            articles += name == "article"
        elif name in ("br", "td", "th"):
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            heading = heading or name in HEADINGS
        elif name == "a":
            link = 1
    say(html[end:])
    flush()
    return out


def extract(html: str) -> str:
    """The main text of a page, one line for each block."""
    found = lines(html)
    stretches: list[list[tuple[str, int, bool, bool]]] = [[]]
    empty = 0
    for x in found:
        empty = 0 if x[0] else empty + 1
        if x[0]:
            stretches[-1].append(x)
        elif empty == WINDOW and stretches[-1]:  # the sum over a window dives to zero
            stretches.append([])
    stretches = [s for s in stretches if s]
    plain = [k for k, s in enumerate(stretches) if any(x[1] for x in s)]
    plain_set = set(plain)
    surges = [k for k, s in enumerate(stretches) if any(sum(x[1] for x in s[i : i + WINDOW]) > (0 if s[0][2] else SURGE) for i in range(len(s)))] or plain
    if not surges:
        return "\n".join(x[0] for s in stretches for x in s)
    # the dive: an article that surges ends at its edge; elsewhere the last text outside links ends the page's text
    first, last = surges[0], surges[-1] if stretches[surges[-1]][0][2] else plain[-1]
    begin, skipped = first, 0
    for k in range(first - 1, -1, -1):
        heads = [i for i, x in enumerate(stretches[k]) if x[3]]
        if heads:
            begin, skipped = k, heads[0]
        elif k not in plain_set:
            break
    kept = [stretches[begin][skipped:], *stretches[begin + 1 : last + 1]]
    return "\n".join(x[0] for s in kept for x in s)


def with_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4 << 20):
            yield with_columns(b, {out: pa.array([extract(t) for t in texts(b, html)], pa.string())})

    return pages.mapInArrow(run, widened(pages.schema, **{out: "string"}))
