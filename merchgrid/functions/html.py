"""Arrow helper that turns one page into its flat list of elements, texts and blocks.

Elements are numbered in document order and know their last descendant, so "inside" is an
interval test, and a page's text is stored once, each element naming its place in it: output and time grow with
the page, not with its depth.  Which text belongs to which block needs a stack and is found in the same pass;
the words and patterns of the rules, and all facts, are those of operators/pages.py.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of html whose pages are parsed and handed on together: the elements of a page take many times its size.
PARSED_AT_ONCE = 1 << 20

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
KEPT = {
    "p", "div", "span", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "th", "td", "dl", "dt", "dd", "script", "meta",
    "title", "link", "img", "main", "article", "body",
}
# An opening tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {"div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "article", "main", "section", "dl"}

#: An element: its number in document order, that of its last descendant, its place in the page's text (``said``),
#: whether it lies in page furniture, and the raw text of scripts and styles.  ``a`` lies inside ``b`` if ``b.ord < a.ord <= b.last``.
ELEMENT = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("skip", T.BooleanType()), T.StructField("raw", T.StringType()),
])
SPEC = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
STRINGS = T.ArrayType(T.StringType())
#: What parsing adds to a page, in order.
PARSED = T.StructType([
    T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("said", T.StringType()), T.StructField("blocks", STRINGS),
    T.StructField("lists", T.ArrayType(STRINGS)), T.StructField("specs", T.ArrayType(SPEC)), T.StructField("parse_error", T.StringType()),
])


class Rules(NamedTuple):
    """What is page furniture, what is the main area, and which elements are blocks (patterns with ASCII classes)."""

    skip_tags: frozenset[str]
    skip_marks: str
    furniture: str
    area_class: str
    block_tags: frozenset[str]
    least_block: int
    least_item: int
    longest_block: int | None = None
    longest_item: int | None = None


class _Elements(HTMLParser):
    """One pass with the open elements as a stack; everything an element inherits comes from its parent."""

    def __init__(self, rules: Rules) -> None:
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.marked = re.compile(rules.skip_marks, re.ASCII)
        self.open: list[dict] = []
        self.names: Counter[str] = Counter()
        self.done: list[dict] = []
        self.said: list[str] = []
        self.size = 0
        #: Per text outside scripts: whether it lies in furniture.
        self.hidden: list[bool] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        while self.open and self.open[-1]["tag"] in closes:
            self._close()
        a = {k: v or "" for k, v in attrs}
        mark = f"{a.get('class', '')} {a.get('id', '')}".strip() if tag not in ("body", "html") else ""
        above = self.open[-1] if self.open else None
        self.count += 1
        skip = bool(above and above["skip"]) or tag in self.rules.skip_tags or bool(mark and self.marked.search(mark))
        self.open.append({"ord": self.count, "parent": above["ord"] if above else 0, "tag": tag, "attrs": a, "begin": self.size, "from": len(self.said), "skip": skip, "raw": [] if tag in ("script", "style") else None})
        self.names[tag] += 1
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and self.open:
            top = self.open[-1]
            if top["raw"] is not None:
                top["raw"].append(text)
            else:
                self.said.append(text)
                self.hidden.append(top["skip"])
                self.size += len(text)

    def _close(self) -> None:
        e = self.open.pop()
        self.names[e["tag"]] -= 1
        if e["tag"] in KEPT or any(k.startswith("data-") for k in e["attrs"]) or "color-swatch" in e["attrs"].get("class", ""):
            self.done.append(e | {"last": self.count, "end": self.size, "to": len(self.said), "raw": None if e["raw"] is None else "".join(e["raw"])})

    def result(self) -> list[dict]:
        while self.open:
            self._close()
        return sorted(self.done, key=lambda e: e["ord"])


def own_texts(elements: list[dict], outer: list[dict], said: list[str], hidden: list[bool]) -> dict[int, str]:
    """Text of each element outside the other elements, by number; what is in none goes to the outermost of ``outer`` around it.

    One sweep over the texts with the elements around them as a stack; ``hidden`` texts are nobody's.
    """
    got: dict[int, list[str]] = {e["ord"]: [] for e in [*elements, *outer]}
    stacks: tuple[list[dict], list[dict]] = [], []
    at = [0, 0]
    for k, text in enumerate(said):
        for n, (found, stack) in enumerate(zip((elements, outer), stacks, strict=True)):
            while at[n] < len(found) and found[at[n]]["from"] <= k:
                e = found[at[n]]
                at[n] += 1
                if e["to"] > k:
                    while stack and stack[-1]["to"] <= k:
                        stack.pop()
                    stack.append(e)
            while stack and stack[-1]["to"] <= k:
                stack.pop()
        owner = stacks[0][-1] if stacks[0] else stacks[1][0] if stacks[1] else None
        if owner and not hidden[k]:
            got[owner["ord"]].append(text)
    return {o: "".join(t) for o, t in got.items()}


def folded_blocks(texts: list[str]) -> list[str]:
    """Blocks in order without repeats; a block under 200 characters that holds another one or lies in one is dropped.

    Blocks kept so far are one long text for the one test, and are found by their first four characters for the other.
    """
    kept: list[str] = []
    seen: set[str] = set()
    joined: list[str] = []
    starts: dict[str, list[str]] = {}
    for t in texts:
        if t in seen:
            continue
        if len(t) < 200:
            heads = {t[i : i + n] for i in range(len(t)) for n in range(1, 5)}
            if any(t in j for j in joined) or any(b in t for h in heads if h in starts for b in starts[h]):
                continue
        seen.add(t)
        kept.append(t)
        starts.setdefault(t[:4], []).append(t)
        # a few long texts, doubling in size, so that one is searched for rarely more than a dozen
        joined.append(t)
        while len(joined) > 1 and len(joined[-2]) <= len(joined[-1]):
            joined[-2:] = ["\x00".join(joined[-2:])]
    return kept


def page_facts(elements: list[dict], said: list[str], hidden: list[bool], rules: Rules) -> tuple[list[str], list[list[str]], list[dict]]:
    """Visible blocks, bullet lists and specs of one page."""
    whole = "".join(said)
    furniture = re.compile(rules.furniture, re.ASCII)
    text = lambda e: whole[e["begin"] : e["end"]]
    size = lambda e: e["end"] - e["begin"]
    short = lambda e, n: n is None or size(e) < n
    in_class = re.compile(rules.area_class, re.ASCII)
    wanted = (lambda e: e["tag"] == "main", lambda e: e["tag"] == "article", lambda e: e["tag"] == "div" and bool(in_class.search(e["attrs"].get("class", ""))))
    area = next((found for test in wanted if (found := next(filter(test, elements), None))), None)
    visible = [e for e in elements if not e["skip"] and size(e) > rules.least_block and short(e, rules.longest_block) and (area is None or area["ord"] < e["ord"] <= area["last"])]
    own = own_texts([e for e in visible if e["tag"] in rules.block_tags], [e for e in visible if e["tag"] == "span"], said, hidden)
    blocks = folded_blocks([t for _, t in sorted(own.items()) if t and not furniture.search(t)])
    items: dict[int, list[dict]] = {}
    for e in elements:
        if e["tag"] == "li" and size(e) > rules.least_item and short(e, rules.longest_item):
            items.setdefault(e["parent"], []).append(e)
    told_of = [items[u["ord"]] for u in elements if u["tag"] in ("ul", "ol") and not u["skip"] and len(items.get(u["ord"], ())) >= 2]
    lists = [x for found in told_of if len(x := [i for i in found if not furniture.search(text(i))]) >= 2]
    lists = [x for x in lists if not (len(x) > 8 and all(size(i) < 30 for i in x))]
    told = own_texts(sorted((i for x in lists for i in x), key=lambda e: e["ord"]), [], said, [False] * len(said))
    cells = [e for e in elements if e["tag"] in ("th", "td")]
    at = [e["ord"] for e in cells]
    pairs = []
    for r in elements:
        if r["tag"] == "tr" and not r["skip"]:
            k = bisect_right(at, r["ord"])
            if k + 1 < len(cells) and at[k + 1] <= r["last"]:
                pairs.append((cells[k], cells[k + 1]))
    terms, values = ([e for e in elements if e["tag"] == tag and not e["skip"]] for tag in ("dt", "dd"))
    pairs += zip(terms, values, strict=False)
    specs: dict[str, str] = {}  # the first value of a repeated key stays
    for k, v in pairs:
        if size(k) and size(v):
            specs.setdefault(text(k), text(v))
    return blocks, [[told[i["ord"]] for i in x if told[i["ord"]]] for x in lists], [{"key": k, "value": v} for k, v in specs.items()]


def store_product(script: str) -> str | None:
    """Text of the first product object with a list of variants inside a script.

    Objects are decoded where they begin: behind ``meta =`` (its ``product``), or at the
    brace that opens just before a ``variants`` list.
    """
    if "variants" not in script:
        return None
    starts = [(m.end() - 1, True) for m in re.finditer(r"\bmeta\s*=\s*\{", script)]
    starts += [(m.start(), False) for m in re.finditer(r'\{[^{}]*"variants"\s*:\s*\[', script)]
    for at, wrapped in starts:
        try:
            found = json.JSONDecoder().raw_decode(script, at)[0]
        except ValueError:
            continue
        product = found.get("product") if wrapped else found
        if isinstance(product, dict) and isinstance(product.get("variants"), list):
            return json.dumps(product)
    return None


def parsed(html: str | None, rules: Rules) -> tuple:
    """One page laid out as ``PARSED``; what stopped the parser, if anything did, is named, and the page ends there."""
    parser, error = _Elements(rules), None
    try:
        parser.feed(html or "")
        parser.close()
    except Exception as e:  # noqa: BLE001 - a malformed page must not fail the job; the row tells of it
        error = f"{type(e).__name__}: {e}"
    elements = parser.result()
    for e in elements:
        if e["tag"] == "script" and (product := store_product(e["raw"])):
            e["attrs"]["store_product"] = product
    names = ELEMENT.fieldNames()
    return [{k: e[k] for k in names} for e in elements], "".join(parser.said), *page_facts(elements, parser.said, parser.hidden, rules), error


def parse_pages(rules: Rules):
    """mapInPandas body: the page columns with ``html`` replaced by those of ``PARSED``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pages in stretches(pdf, PARSED_AT_ONCE):
                found = [parsed(h, rules) for h in pages["html"]]
                yield pages.drop(columns="html").assign(**{name: [f[k] for f in found] for k, name in enumerate(PARSED.fieldNames())})

    return run


def stretches(pdf: pd.DataFrame, chars: int) -> Iterator[pd.DataFrame]:
    """The rows in order, cut before the page with which a stretch would hold more than ``chars`` characters of html."""
    begin = held = 0
    for i, h in enumerate(pdf["html"]):
        n = len(h or "")
        if i > begin and held + n > chars:
            yield pdf.iloc[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(pdf):
        yield pdf.iloc[begin:]
