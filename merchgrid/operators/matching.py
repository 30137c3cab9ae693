"""Record matching: candidate scores, gates, confidence, selection and decisions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions import urls as U
from merchgrid.functions.colors import normalize as normalize_color
from merchgrid.functions.common import add_all, any_of, clamp, contains_any, flag, labels, merged, ratio, strip, text
from merchgrid.functions.ranking import top_k
from merchgrid.functions.setsim import blocked, prefixes, set_id, token_frequency
from merchgrid.functions.similarity import any_homonym, sequence_ratio
from merchgrid.operators.images import catalog_by_barcode
from merchgrid.rules import matching as rules
from merchgrid.session import durable, held, written


def lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(c: Column) -> Column:
    """Distinct ``[a-z0-9]+`` words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), 1))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\d+)"), 1))


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(20[23]\d)"), 1))


def has(a: Column) -> Column:
    return F.size(a) > 0


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


# -- structure of the candidate URL and title (M12) ---------------------------


def url_score(url: Column, title: Column, product_title: Column) -> Column:
    """Score 0..100 from path, segments, title shape, query and slug overlap."""
    path = F.lower(U.path(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.size(segments)
    product_page = any_of(*[path.rlike(f"{p}/*[^/]") for p in rules.PRODUCT_PATHS])
    shop = ~product_page & path.contains("/shop/")
    category_hits = F.size(F.filter(segments, lambda s: s.isin(rules.CATEGORY_SEGMENTS)))
    low = F.lower(text(title))
    words = F.size(F.filter(F.split(text(title), r"\s+"), lambda w: w != ""))
    last = F.coalesce(F.element_at(segments, -1), F.lit(""))
    split_words = lambda c: F.filter(F.split(F.lower(c), r"[\s\-/]+"), lambda w: F.length(w) > 2)
    wanted = F.array_distinct(F.filter(split_words(text(product_title)), lambda w: ~w.isin(rules.SLUG_STOP)))
    share = ratio(F.size(F.array_intersect(wanted, split_words(path))), F.size(wanted))
    points = [
        (product_page, 20), (shop & (depth >= 4), -10), (shop & (depth < 4), 5), (contains_any(path, rules.CATEGORY_PATHS), -20),
        (category_hits >= 2, -15), (depth.between(1, 3), 10), (depth > 5, -10), (contains_any(low, rules.GENERIC_TITLE_PARTS), -15),
        (strip(low).isin(rules.GENERIC_TITLES), -25), (words.between(2, 10), 5), (text(title).rlike(r"\d"), 5),
        (url.contains("?") & contains_any(F.lower(url), rules.QUERY_MARKERS), -15), (last.contains("-") & (F.length(last) > 10), 5),
        (share >= 0.5, 10), ((share >= 0.3) & (share < 0.5), 5),
    ]
    return clamp(F.lit(50) + add_all(*[F.when(c, n).otherwise(0) for c, n in points]), 0, 100)


# -- title comparison (M13) and price (M14) -----------------------------------


def clean_title(title: Column, vendor: Column) -> Column:
    """Catalog title without a leading vendor name."""
    t, v = strip(text(title)), text(vendor)
    led = (v != "") & F.lower(t).startswith(F.lower(v))
    return F.when(led, F.regexp_replace(F.substring(t, F.length(v) + 1, F.length(t)), "^[ -]+|[ -]+$", "")).otherwise(t)


def found_price(*texts: Column) -> Column:
    """First dollar amount of the first text that has one; commas are dropped."""
    amount = lambda c: F.nullif(F.replace(F.regexp_extract(text(c), r"\$(\d+(?:[.,]\d{2})?)", 1), F.lit(","), F.lit("")), F.lit(""))
    return F.coalesce(*[amount(c) for c in texts]).try_cast("double")


def percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def title_steps(df: DataFrame, live: bool) -> DataFrame:
    """Adds the word sets and conditions the title adjustments need.

    Expects ``wanted`` (clean lower title), ``cand`` (lower candidate title), ``vendor``.
    """
    t, c = F.col("t_words"), F.col("c_words")
    generic = lits(sorted(set(rules.TYPE_WORDS + rules.HEIGHT_WORDS + rules.EDITION_WORDS + rules.DEMOGRAPHICS + rules.OTHER_GENERIC)))
    both = lambda words: has(F.array_intersect(F.col("missing"), lits(words))) & has(F.array_intersect(F.col("extra"), lits(words)))
    clash = lambda a, b: has(a) & has(b) & ~overlaps(a, b)
    heights, demos = lits(rules.HEIGHT_WORDS), lits(rules.DEMOGRAPHICS)
    named = df.withColumns({
        "t_words": F.array_except(tokens(F.col("wanted")), lits(rules.FILLER)), "c_words": F.array_except(tokens(F.col("cand")), lits(rules.FILLER)),
    }).withColumns({
        "comparable": has(t) & has(c), "missing": F.array_except(t, c), "extra": F.array_except(c, t),
        "overlap": ratio(F.size(F.array_intersect(t, c)), F.size(t)),
        "t_years": years(F.col("wanted")), "c_years": years(F.col("cand")),
    })
    quiet = F.concat(generic, tokens(F.col("vendor")))
    staged = named.withColumns({
        "foreign": F.array_except(F.array_except(F.col("extra"), quiet), numbers(F.col("cand"))),
        "absent": F.array_except(F.array_except(F.col("missing"), quiet), numbers(F.col("wanted"))),
        "extra_height": has(F.array_intersect(F.col("extra"), heights)),
        "collab": has(F.array_intersect(F.col("extra"), lits(rules.COLLAB_WORDS)))
        | (F.col("cand").rlike(rules.CROSSOVER) & ~F.col("wanted").rlike(rules.CROSSOVER)),
        "demo_clash": clash(F.array_intersect(t, demos), F.array_intersect(c, demos)),
        "year_clash": clash(F.col("t_years"), F.col("c_years")),
        "critical": both(rules.TYPE_WORDS) | both(rules.HEIGHT_WORDS) | both(rules.EDITION_WORDS)
        | clash(F.array_except(numbers(F.col("wanted")), F.col("t_years")), F.array_except(numbers(F.col("cand")), F.col("c_years"))),
    }).withColumns({
        "asym_height": F.col("extra_height") & ~overlaps(t, heights),
        "is_foreign": has(F.col("foreign")) & has(F.col("absent")),
    })
    need = F.col("comparable") & ~F.col("critical") & (F.col("overlap") < 0.6)
    if live:
        need = need & ~F.col("is_foreign")
    return staged.withColumn("needs_ratio", need)


def rescore(candidates: DataFrame, live: bool = False, similarity=sequence_ratio) -> DataFrame:
    """Score of every candidate with its reasoning trail.

    Expects ``url, title, snippet, product_title, vendor, price``.  The adjustments are
    an ordered fold that clamps to 0..100 after each step, so penalties do not commute.
    ``live`` selects the stricter treatment of foreign product names.
    """
    staged = title_steps(
        candidates.withColumns({
            "base": url_score(F.col("url"), F.col("title"), F.col("product_title")),
            "wanted": F.lower(clean_title(F.col("product_title"), F.col("vendor"))), "cand": F.lower(text(F.col("title"))),
        }), live,
    ).withColumn("seq", similarity(F.col("wanted"), F.col("cand"), F.col("needs_ratio")))
    homonym = any_homonym(F.col("foreign"), F.col("absent"), F.col("is_foreign")) if live else F.lit(False)
    staged = staged.withColumn("homonym", F.coalesce(homonym, F.lit(False)))

    t, ov, seq = F.col("t_words"), F.col("overlap"), F.coalesce("seq", F.lit(0.0))
    ok, crit, foreign = F.col("comparable"), F.col("critical"), F.col("is_foreign")
    open_ = ok & ~crit & ~foreign if live else ok & ~crit
    strong = open_ & ((ov >= 0.6) | (seq >= 0.5))
    weak = open_ & ~strong & (ov < 0.2) & (seq < 0.3)
    meek = open_ & ~strong & ~weak & (ov < 0.3)
    in_url = ratio(F.size(F.array_intersect(t, tokens(F.col("url")))), F.size(t))
    boost = F.floor(20 * ov).cast("int") + F.when(in_url > 0.5, 5).otherwise(0)
    first_two = lambda a: F.array_join(F.slice(F.array_sort(a), 1, 2), ",")
    names = F.concat(F.lit(" -foreign_product("), first_two(F.col("foreign")), F.lit(")"))
    price = found_price(F.col("snippet"), F.col("title"))
    known = (F.col("price") > 0) & price.isNotNull() & (price > 0)
    gap = F.when(known, F.abs(price - F.col("price")) / F.col("price"))
    dollars = lambda sep: F.format_string(f"$%.0f{sep}$%.0f)", price, F.col("price"))

    steps: list[tuple[Column, object, object]] = [
        (ok & F.col("asym_height"), -15, " -asymmetric_height"),
        (ok & F.col("collab"), -25, " -collab_mismatch"),
        (ok & F.col("demo_clash"), -15, " -demographic_mismatch"),
        (ok & F.col("year_clash"), -5, " -year_mismatch"),
    ]
    if live:
        pair = F.concat(F.lit(" -near_homonym("), first_two(F.col("foreign")), F.lit("vs"), first_two(F.col("absent")), F.lit(")"))
        steps += [(ok & foreign & F.col("homonym"), -40, pair), (ok & foreign & ~F.col("homonym"), -35, names)]
    else:
        steps += [(ok & foreign, -20, names)]
    steps += [
        (ok & crit, -30, " -critical_mismatch(type/model)"),
        (strong, boost, F.concat(F.lit(" +title_match("), percent(ov), F.lit(")"))),
        (weak, -25, F.concat(F.lit(" -title_mismatch("), percent(seq), F.lit(")"))),
        (meek, -10, F.concat(F.lit(" -title_weak("), percent(seq), F.lit(")"))),
        (F.coalesce(gap <= 0.20, F.lit(False)), 10, F.concat(F.lit(" +price_match("), dollars("≈"))),
        (F.coalesce(gap > 0.50, F.lit(False)), -15, F.concat(F.lit(" -price_mismatch("), dollars("vs"))),
    ]
    deltas = F.array(*[F.when(c, d if isinstance(d, Column) else F.lit(d)).otherwise(F.lit(0)) for c, d, _ in steps])
    total = F.aggregate(deltas, F.col("base").cast("int"), lambda acc, d: F.greatest(F.lit(0), F.least(F.lit(100), acc + d)))
    trail = F.concat(F.lit("base="), F.col("base").cast("string"), F.array_join(labels(*[(c, lab) for c, _, lab in steps]), ""))
    return staged.select(*candidates.columns, F.col("base").alias("url_score"), F.col("overlap"), total.alias("confidence"), trail.alias("reasoning"))


def search_hits(candidates: DataFrame) -> DataFrame:
    """Confidence after the search-strategy adjustments.

    Expects ``product_id, ord, strategy, confidence, url, title, snippet, barcode, sku,
    broad_count``.  Handle hits count only for products without any other hit.
    """
    with_other = candidates.where("strategy <> 'handle'").select("product_id").distinct()
    kept = candidates.where("strategy <> 'handle'").unionByName(
        candidates.where("strategy = 'handle'").join(merged(with_other), "product_id", "left_anti")
    )
    inside = lambda needle, *cols: (needle != "") & any_of(*[text(F.col(c)).contains(needle) for c in cols])
    sku = strip(text(F.col("sku")))
    prefix = F.when(sku.contains("-"), F.substring_index(sku, "-", 1)).otherwise(F.left(sku, F.lit(8)))
    by_barcode, by_sku, kind = inside(strip(text(F.col("barcode"))), "snippet", "url", "title"), inside(sku, "snippet", "url") | inside(prefix, "url"), F.col("strategy")
    delta = (
        F.when(kind == "barcode", F.when(by_barcode, 15).otherwise(-5)).when(kind == "sku", F.when(by_sku, 12).otherwise(-5))
        .when(kind == "title", 10).otherwise(0)
    )
    first = kept.groupBy("product_id").agg(F.min("ord").alias("_first"))
    broad = F.col("broad_count")
    extra = F.when((broad >= 3) & (F.col("ord") == F.col("_first")), 5).when(broad == 0, -10).otherwise(0)
    step = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(100), c + d))
    return kept.join(merged(first), "product_id").withColumn("confidence", step(step(F.col("confidence"), delta), extra)).drop("_first")


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def best_per_url(candidates: DataFrame, key: str = "product_id") -> DataFrame:
    """Highest confidence per URL, the earlier candidate on a tie."""
    best = candidates.groupBy(key, url_key(F.col("url")).alias("url_key")).agg(
        F.min_by(F.struct(*[c for c in candidates.columns if c != key]), F.struct(-F.col("confidence"), F.col("ord"))).alias("r")
    )
    return best.select(key, "url_key", "r.*")


def top_candidates(candidates: DataFrame, k: int = 5, key: str = "product_id") -> DataFrame:
    return top_k(best_per_url(candidates, key), [key], [F.desc("confidence"), F.col("ord")], k)


def select_candidate(candidates: DataFrame, key: str = "product_id") -> DataFrame:
    """First live candidate by confidence with its warning (M17); ``live`` is landed."""
    at = F.struct(-F.col("confidence"), F.col("ord"))
    picked = candidates.groupBy(key).agg(
        F.min_by(F.struct("url", "confidence"), F.when(F.col("live"), at)).alias("s"), F.min(F.when(F.col("live"), at)).alias("_at")
    )
    dead = candidates.join(merged(picked.select(key, "_at")), key).where(~F.col("live") & (F.col("_at").isNull() | (at < F.col("_at")))).groupBy(key).agg(
        F.count(F.lit(1)).alias("dead_before")
    )
    conf = F.col("s.confidence")
    return picked.join(merged(dead), key, "left").select(
        key, F.col("s.url").alias("selected_url"), conf.alias("selected_confidence"), F.coalesce("dead_before", F.lit(0)).alias("dead_before"),
        F.when(conf < 70, "LOW_MATCH_CONFIDENCE").when(conf < 85, "MODERATE_MATCH_CONFIDENCE").otherwise("").alias("warning"),
    )


# -- gates ----------------------------------------------------------------------


def bot_blocked(page: Column, head: int | None = None, short: int = 500) -> Column:
    """Anti-bot page (P13): all markers on a page under ``short`` characters, the main ones on any other.

    ``head`` looks for the main ones in the first characters only; by default in the whole page.
    """
    low = F.lower(text(page))
    main = contains_any(low if head is None else F.left(low, F.lit(head)), rules.BOT_MARKERS)
    return main | ((F.length(text(page)) < short) & contains_any(low, rules.BOT_MARKERS_SHORT))


def meaning_words(c: Column) -> Column:
    return F.array_except(tokens(c), lits(sorted(set(rules.GATE_FILLER + rules.DEMOGRAPHICS))))


def headings(markdown: Column) -> Column:
    """Headings of a page in order."""
    return F.filter(F.transform(F.regexp_extract_all(text(markdown), F.lit(r"(?m)^#{1,3}\s+(.+)$"), 1), strip), lambda h: h != "")


def best_heading(markdown: Column, catalog_title: Column) -> Column:
    """Heading with the largest share of the catalog words, at least 0.3; the first of equals."""
    return best_of(headings(markdown), catalog_title)


def best_of(found: Column, catalog_title: Column) -> Column:
    wanted = meaning_words(catalog_title)
    scored = F.transform(found, lambda h, i: F.struct(
        ratio(F.size(F.array_intersect(wanted, meaning_words(h))), F.size(wanted)).alias("s"), (-i).alias("rank"), h.alias("h")))
    best = F.array_max(scored)
    first = F.get(found, F.lit(0))
    return F.when(F.size(wanted) == 0, first).otherwise(F.when(best["s"] >= 0.3, best["h"]))


def gate_words(page: Column, catalog: Column) -> tuple[Column, Column]:
    """(demographic match or null, word overlap) of two titles."""
    demo = lambda c: F.array_distinct(F.transform(
        F.array_intersect(tokens(c), lits(rules.DEMOGRAPHICS)),
        lambda w: F.when(w == "men", "mens").when(w == "women", "womens").otherwise(w)))
    dp, dc = demo(page), demo(catalog)
    match = F.when(has(dp) & has(dc), overlaps(dp, dc))
    wc = meaning_words(catalog)
    return match, F.size(F.array_intersect(wc, meaning_words(page))) / F.greatest(F.size(wc), F.lit(1)).cast("double")


def title_gate(pairs: DataFrame, min_similarity: float = 0.4, min_overlap: float = 0.3, similarity=sequence_ratio, needed: Column | None = None) -> DataFrame:
    """Cheap title check (M18). Expects ``page_title, catalog_title``; where ``needed`` is false the similarity stays null."""
    only = (lambda c: c) if needed is None else (lambda c: F.when(needed, c))
    match, overlap = gate_words(F.col("page_title"), F.col("catalog_title"))
    staged = pairs.withColumns({"demographic_match": match, "word_overlap": overlap}).withColumn(
        "title_similarity", similarity(only(F.lower("page_title")), only(F.lower("catalog_title")))
    )
    clash = F.coalesce(~F.col("demographic_match"), F.lit(False))
    low = (F.col("title_similarity") < min_similarity) & (F.col("word_overlap") < min_overlap)
    reason = F.when(clash, "demographic_mismatch").when(
        low, F.format_string("title_similarity_too_low: %.2f, word_overlap: %.2f", F.col("title_similarity"), F.col("word_overlap"))
    ).otherwise("ok")
    return staged.withColumns({"passed": ~(clash | low), "reason": reason})


def facts_price(specs: Column, offers_price: Column) -> Column:
    """Price of the facts: a price-like spec with an amount, else the structured offer."""
    amounts = F.transform(
        F.filter(F.map_entries(specs), lambda e: F.lower(strip(e["key"])).isin(rules.PRICE_KEYS)),
        lambda e: F.nullif(F.replace(F.regexp_extract(e["value"], r"[\$€£]([\d,]+\.?\d*)", 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double"),
    )
    return F.coalesce(F.get(F.filter(amounts, lambda a: a.isNotNull()), F.lit(0)), offers_price.try_cast("double"))


def offers_price(json_ld: Column) -> Column:
    """``offers.price`` of structured data, offers being an object or an array."""
    v = F.try_parse_json(json_ld)
    return F.coalesce(F.try_variant_get(v, "$.offers.price", "string"), F.try_variant_get(v, "$.offers[0].price", "string"))


def color_overlap(catalog: Column, vendor: Column) -> Column:
    """Jaccard of the non-neutral colours, 1.0 when both sides are empty."""
    active = lambda cs: F.array_distinct(F.filter(
        F.transform(F.filter(cs, lambda c: strip(c) != ""), normalize_color),
        lambda n: ~overlaps(F.split(n, " "), lits(rules.NEUTRALS))))
    a, b = active(catalog), active(vendor)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.floor(F.size(F.array_intersect(a, b)) / union.cast("double") * 1000 + 0.5) / 1000.0)


def spec_colors(specs: Column) -> Column:
    """Colours of a colour-like spec, split at ``/ , |``."""
    hit = F.get(F.filter(F.map_entries(specs), lambda e: F.lower(strip(e["key"])).isin(rules.COLOR_KEYS)), F.lit(0))["value"]
    return F.coalesce(F.filter(F.transform(F.split(hit, "[/,|]"), strip), lambda c: c != ""), F.array().cast("array<string>"))


def extraction_score(f: dict[str, Column]) -> Column:
    """0..100 content score of extracted facts (P17); usable from 30."""
    body = F.lower(text(f["description"]))
    described = body != ""
    base = flag(text(f["product_name"]) != "", 30) + flag(f["has_json_ld"], 25) + flag(f["n_images"] > 0, 20) + flag(f["n_bullets"] > 0, 10) + flag(described, 10)
    spoiled = described & contains_any(body, rules.BAD_CONTENT)
    return F.when(spoiled, F.greatest(base - 40.0, F.lit(0.0))).otherwise(base) + flag(f["n_specs"] > 0, 5)


def price_score(scraped: Column, known: Column) -> Column:
    """1.0 up to 20 % off, falling to 0 at 60 %; 0.5 without data."""
    gap = F.abs(scraped - known) / known
    decay = clamp(1.0 - (gap - 0.2) / 0.4, 0.0, 1.0)
    return F.when(scraped.isNotNull() & (known > 0), F.when(gap > 0.2, decay).otherwise(1.0)).otherwise(F.lit(0.5))


def post_extraction(rows: DataFrame, similarity=sequence_ratio, threshold: float = 50.0, needed: Column | None = None) -> DataFrame:
    """Confidence from title, price, colours and content.

    Expects ``product_name, catalog_title, scraped_price, catalog_price, catalog_colors,
    vendor_colors, content_score``; where ``needed`` is false the confidence stays null.
    """
    only = (lambda c: c) if needed is None else (lambda c: F.when(needed, c))
    named = text(F.col("product_name")) != ""
    staged = rows.withColumn("_sim", similarity(only(F.lower(text(F.col("product_name")))), only(F.lower("catalog_title"))))
    colors = F.when(has(F.col("vendor_colors")) & has(F.col("catalog_colors")), color_overlap(F.col("catalog_colors"), F.col("vendor_colors"))).otherwise(0.5)
    staged = staged.withColumns({
        "sig_title": only(F.when(named, F.col("_sim")).otherwise(0.0)), "sig_price": price_score(F.col("scraped_price"), F.col("catalog_price")),
        "sig_color": colors, "sig_quality": flag(F.col("content_score") >= 30),
    }).drop("_sim")
    total = F.col("sig_title") * 40 + F.col("sig_price") * 25 + F.col("sig_color") * 25 + F.col("sig_quality") * 10
    return staged.withColumn("match_confidence", total).withColumn("match_passed", F.col("match_confidence") >= threshold)


def decide(candidates: DataFrame, pages: DataFrame, similarity=sequence_ratio, k: int | None = 3) -> DataFrame:
    """Decision row per tried candidate.

    ``candidates(product_id, url, ord, confidence, catalog_title, catalog_price,
    catalog_colors)``, ``pages(url, markdown, product_name, scraped_price, vendor_colors,
    content_score)``.  The best k candidates, or all, are tried in order up to the first accepted.
    Of several pages with one url the one with the highest content score is read (then the greatest markdown, name, price, colours).
    """
    columns = ["content_score", "markdown", "product_name", "scraped_price", "vendor_colors"]
    # the text of a page is read once, below the join, and goes no further
    unread = (text(F.col("markdown")) == "") | bot_blocked(F.col("markdown"))
    pages = pages.groupBy("url").agg(F.max(F.struct(*columns)).alias("_p")).select("url", "_p.*").select(
        "url", "content_score", "product_name", "scraped_price", "vendor_colors", headings(F.col("markdown")).alias("_headings"), unread.alias("_unread"))
    tried = top_k(candidates, ["product_id"], [F.desc("confidence"), F.col("ord")], k, out="attempt").join(merged(pages), "url", "left")
    staged = tried.withColumns({"page_title": best_of(F.col("_headings"), F.col("catalog_title")), "_unread": F.coalesce("_unread", F.lit(True))}).drop("_headings")
    # the ratios run only on rows that nothing cheaper has decided
    open_ = (F.col("confidence") >= 50) & ~F.col("_unread")
    staged = staged.withColumn("_open", F.coalesce(open_, F.lit(False)))
    gated = title_gate(staged, similarity=similarity, needed=F.col("_open") & F.col("page_title").isNotNull())
    named = F.col("_open") & (F.col("page_title").isNull() | F.col("passed")) & (text(F.col("product_name")) != "")
    gated = gated.withColumn("_open", F.coalesce(named, F.lit(False))).withColumn("content_score", F.coalesce("content_score", F.lit(0.0)))
    scored = post_extraction(gated, similarity=similarity, needed=F.col("_open")).drop("_open")
    outcome = (
        F.when(F.col("confidence") < 50, "skip_low_confidence")
        .when(F.col("_unread"), "reject_bot_blocked")
        .when(F.col("page_title").isNotNull() & ~F.col("passed"), "reject_title_gate")
        .when(text(F.col("product_name")) == "", "reject_extraction_failed")
        .when(~F.col("match_passed"), "reject_post_extraction")
        .otherwise("accept")
    )
    # over the tried rows themselves, so the gates and ratios run once
    first_ok = F.min(F.when(F.col("outcome") == "accept", F.col("attempt"))).over(Window.partitionBy("product_id"))
    return scored.withColumn("outcome", outcome).withColumn("_ok", first_ok).where(F.col("_ok").isNull() | (F.col("attempt") <= F.col("_ok"))).select(
        "product_id", "attempt", "url", F.col("confidence").alias("resolver_confidence"), "outcome",
        text(F.col("page_title")).alias("title_extracted"), "title_similarity", "word_overlap", "match_confidence",
        "sig_title", "sig_price", "sig_color", "sig_quality",
    )


# -- season flags (M33) -----------------------------------------------------------


def url_years(url: Column) -> Column:
    """Four-digit years in a URL, season codes such as fw24 included."""
    # Look-arounds let one separator close a year and open the next.
    full = F.regexp_extract_all(url, F.lit(r"(?:^|[/_-])(20[23]\d)(?=$|[/_-])"), 1)
    short = F.regexp_extract_all(url, F.lit(r"(?i)(?:^|[/_-])(?:fw|ss|sp|su|fa|aw)(\d{2})(?=$|[/_-])"), 1)
    return F.array_distinct(F.concat(full, F.transform(short, lambda y: F.concat(F.lit("20"), y))))


def tag_years(tags: Column) -> Column:
    parts = F.flatten(F.transform(tags, lambda t: F.split(F.lower(strip(t)), r"[:\-_/\s]")))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^20[23]\d$")))


def season_flags(rows: DataFrame) -> DataFrame:
    """Season signals of a matched page. Expects ``catalog_colors, vendor_colors, tags, url``."""
    active = lambda c: F.array_distinct(F.filter(F.transform(F.filter(F.col(c), lambda x: strip(x) != ""), normalize_color),
                                                 lambda n: ~overlaps(F.split(n, " "), lits(rules.NEUTRALS))))
    staged = rows.withColumns({
        "color_overlap": color_overlap(F.col("catalog_colors"), F.col("vendor_colors")), "year_hints": url_years(F.col("url")),
        "_cat_years": tag_years(F.col("tags")), "_n": F.size(F.array_union(active("catalog_colors"), active("vendor_colors"))),
    })
    y, c = F.col("year_hints"), F.col("_cat_years")
    dated = has(y) & has(c)
    flags = labels(
        ((F.col("_n") >= 2) & (F.col("color_overlap") < 0.3), "LOW_COLOR_OVERLAP"),
        (dated & ~overlaps(y, c), "URL_YEAR_MISMATCH"),
        (dated & (F.array_max(y) > F.array_max(c)), "POSSIBLE_NEWER_MODEL"),
    )
    f = F.col("flags")
    low, mis, newer = (F.array_contains(f, n) for n in ("LOW_COLOR_OVERLAP", "URL_YEAR_MISMATCH", "POSSIBLE_NEWER_MODEL"))
    note = (
        F.when(F.size(f) == 0, "No season mismatch signals detected.")
        .when(low & mis, "Low color overlap AND URL year mismatch: likely a different season. Review before using vendor data.")
        .when(low, "Low non-neutral color overlap with vendor page. May indicate a different season or colorway refresh.")
        .when(newer, "Vendor page appears to show a newer model year than catalog.")
        .otherwise("URL contains a year that doesn't match catalog tags.")
    )
    return staged.withColumn("flags", flags).withColumn("note", note).drop("_cat_years", "_n")


# -- catalog cross-checks -----------------------------------------------------------


def cross_reference(rows: DataFrame, similarity=sequence_ratio) -> DataFrame:
    """Name and price warnings against the catalog.

    Expects ``barcode_known, product_name, catalog_title, scraped_price, known_price``.
    """
    r = rows.withColumn("_r", similarity(F.lower(text(F.col("product_name"))), F.lower(text(F.col("catalog_title")))))
    both = F.col("barcode_known") & (text(F.col("product_name")) != "") & (text(F.col("catalog_title")) != "")
    far = F.abs(F.col("scraped_price") - F.col("known_price")) > 0.5 * F.col("known_price")
    return r.withColumn("warnings", labels(
        (both & (F.col("_r") < 0.3), "PRODUCT_NAME_MISMATCH"), (both & (F.col("_r") >= 0.3) & (F.col("_r") < 0.6), "PRODUCT_NAME_LOW_SIMILARITY"),
        (F.col("barcode_known") & (F.col("known_price") > 0) & F.coalesce(far, F.lit(False)), "PRICE_MISMATCH"),
    )).drop("_r")


#: Slices in which many rows meet a table of keys, so the disk holds the shuffle files of one at a time.
SLICES = 4


def _slices(rows: DataFrame, side: DataFrame, *keys: str) -> list[DataFrame]:
    """``rows`` left-joined with ``side``, cut by the first key's hash; together they are the whole join."""
    nth = lambda df, k: df.where(F.pmod(F.xxhash64(keys[0]), F.lit(SLICES)) == k)
    return [nth(rows, k).join(merged(nth(side, k)), list(keys), "left") for k in range(SLICES)]


@contextmanager
def _priced(rows: DataFrame, variants: DataFrame, items: DataFrame) -> Iterator[DataFrame]:
    """``rows`` with the price and image of their barcode, and the number of its variants (``_coded``, null if none has it)."""
    coded = variants.where("barcode <> ''")
    price = coded.groupBy("barcode").agg(F.min_by("price", "variant_id").alias("known_price"), F.count(F.lit(1)).alias("_coded"))
    with ExitStack() as tables:
        with held(rows) as given, held(price.join(merged(catalog_by_barcode(items)), "barcode", "left")) as known:
            none = {c: F.lit(None).cast(known.schema[c].dataType) for c in ("known_price", "_coded", "catalog_image")}
            blank = given.where("barcode is null or barcode = ''").withColumns(none)
            found = tables.enter_context(held(*_slices(given.where("barcode <> ''"), known, "barcode"), blank))
        if "variant_id" in rows.columns:
            # where one variant only has the barcode, the barcode's price is that variant's
            shared = F.coalesce((F.col("_coded") > 1) & F.col("variant_id").isNotNull(), F.lit(False))
            if not found.where(shared).isEmpty():
                own = coded.select("barcode", "variant_id", F.col("price").alias("_own"))
                settled = [m.withColumn("known_price", F.coalesce("_own", "known_price")).drop("_own") for m in _slices(found.where(shared), own, "barcode", "variant_id")]
                found = found.where(~shared).unionByName(tables.enter_context(held(*settled)))
        yield found


def catalog_cross_check(rows: DataFrame, variants: DataFrame, products: DataFrame, items: DataFrame, descriptions: DataFrame, similarity=sequence_ratio) -> DataFrame:
    """Scraped rows against the catalog (J12): warnings with their values, and what the catalog itself offers.

    ``rows(row_id, handle, barcode, product_name, scraped_price)``, ``descriptions(product_id, description)``.  Rows whose
    barcode no variant has come back without warnings; those without a barcode stay out of every join on it.
    Where several variants have one barcode, the row's own (``variant_id``, if ``rows`` has it) gives the price, else the one
    with the smallest id.  The rows meet their barcodes, handles and descriptions in steps, each written before the next,
    so the disk holds the shuffle files of one step.
    """
    store = products.select("handle", "product_id", F.col("title").alias("catalog_title"))
    with _priced(rows, variants, items) as found, held(store) as store:
        known = found.where("_coded is not null").select("row_id", "handle", "product_name", "scraped_price", "known_price", "catalog_image")
        met = [m.drop("handle") for m in _slices(known, store, "handle")]
        rest = found.where("_coded is null").select("row_id", *[F.lit(None).cast(met[0].schema[c].dataType).alias(c) for c in met[0].columns if c != "row_id"])
        met = written(*met, rest)
    text_ = descriptions.where("description <> ''").groupBy("product_id").agg(F.min("description").alias("catalog_description"))
    # rows of no product, as those without a known barcode, stay out of the join with the descriptions
    checked = met.where("product_id is not null").join(merged(text_), "product_id", "left").unionByName(met.where("product_id is null").withColumn("catalog_description", F.lit(None).cast("string")))
    name, title = text(F.col("product_name")), text(F.col("catalog_title"))
    both = (name != "") & (title != "")
    checked = checked.withColumn("_r", similarity(F.when(both, F.lower(name)), F.when(both, F.lower(title))))
    share = F.concat(F.bround(F.col("_r") * 100).cast("int").cast("string"), F.lit("%"))
    said = lambda kind: F.concat(F.lit(f"{kind}: scraped='"), name, F.lit("' vs catalog='"), title, F.lit("' (similarity="), share, F.lit(")"))
    far = (F.col("known_price") > 0) & (F.abs(F.col("scraped_price") - F.col("known_price")) / F.col("known_price") > 0.5)
    dollars = lambda c: F.format_string("$%.2f", F.col(c))
    warnings = labels(
        (F.col("_r") < 0.3, said("PRODUCT_NAME_MISMATCH")), ((F.col("_r") >= 0.3) & (F.col("_r") < 0.6), said("PRODUCT_NAME_LOW_SIMILARITY")),
        (far, F.concat(F.lit("PRICE_MISMATCH: scraped="), dollars("scraped_price"), F.lit(" vs catalog="), dollars("known_price"))))
    return checked.select("row_id", warnings.alias("warnings"), "catalog_image", "catalog_description")


#: Titles a side that a word's block holds.
BLOCK = 4096


def title_join(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Best word-Jaccard match of every left title in another catalog of its domain.

    ``left(domain, product_id, title)``, ``right(domain, other_id, other_title)``.  Equal
    word sets are joined once and fanned out at the end; a pair above the threshold must
    share one of the rarest words of the left set (prefix filter), and enough words can follow the first
    one they share (positional filter), so frequent words pair short titles only.  A word
    of many titles is joined in blocks of ``BLOCK`` titles a side.  Every surviving pair is verified on the whole sets.
    """
    words = lambda c: F.array_sort(F.array_except(tokens(F.col(c)), lits(rules.CATALOG_FILLER)))
    lset = durable(left.withColumn("words", words("title")).where(F.size("words") > 0).withColumn("sid", set_id(F.col("words"))))
    lsets = lset.groupBy("domain", "sid").agg(F.any_value("words").alias("words"))
    rsets = durable(
        right.withColumn("rwords", words("other_title")).where(F.size("rwords") > 0)
        .groupBy("domain", set_id(F.col("rwords")).alias("rid")).agg(F.any_value("rwords").alias("rwords"), F.min("other_id").alias("other_id"))
    )
    freq = token_frequency(rsets, ["domain"], "rwords")
    mine = prefixes(lsets, ["domain"], "sid", "words", threshold, freq)
    theirs = prefixes(rsets, ["domain"], "rid", "rwords", threshold, freq).withColumnsRenamed({"size": "rsize", "pos": "rpos"})
    size_ok = (F.col("rsize") * threshold < F.col("size")) & (F.col("size") * threshold < F.col("rsize"))
    # of the first word that a pair shares: it and what follows it on the shorter side are all that they can share
    rest_ok = F.least(F.col("size") - F.col("pos"), F.col("rsize") - F.col("rpos")) * (1 + threshold) > threshold * (F.col("size") + F.col("rsize")) - 1e-9
    mine, theirs = blocked(mine, theirs, ["domain", "w"], "sid", "rid", BLOCK)
    met = mine.join(theirs, ["domain", "w", "bl", "br"]).where(size_ok & rest_ok).select("domain", "sid", "rid").distinct()
    pairs = met.join(merged(lsets), ["domain", "sid"]).join(merged(rsets), ["domain", "rid"])
    t, c = F.col("words"), F.col("rwords")
    jac = F.size(F.array_intersect(t, c)) / F.size(F.array_union(t, c)).cast("double")
    alien = has(F.array_except(F.array_except(c, t), lits(rules.CATALOG_GENERIC))) & has(F.array_except(F.array_except(t, c), lits(rules.CATALOG_GENERIC)))
    score = jac * F.when(alien, 0.5).otherwise(1.0)
    best = pairs.withColumn("score", score).where(F.col("score") > threshold).groupBy("domain", "sid").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "other_id")).alias("b")
    )
    return lset.join(merged(best), ["domain", "sid"]).select("domain", "product_id", F.col("b.other_id").alias("other_id"), (-F.col("b.neg")).alias("score"))


def with_context(candidates: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Candidates with product title and price and the vendor's domain; off-domain rows are marked."""
    c = candidates.join(merged(products.select("product_id", F.col("title").alias("product_title"), "vendor", "price")), "product_id")
    return c.join(vendors.select("vendor", "domain"), "vendor", "left").withColumn("on_domain", F.coalesce(U.same_domain(F.col("url"), F.col("domain")), F.lit(False)))
