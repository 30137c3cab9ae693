"""Text quality: output score (M22), fact score (M23), duplicate and overlap jobs (J19, J20), drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions.common import any_of, clamp, contains_any, flag, merged, ratio, strip, text
from merchgrid.functions.ranking import top_k
from merchgrid.functions.urls import image_reject_reason
from merchgrid.rules import quality as rules

BOILERPLATE_RE = "(?i)(?:" + ")|(?:".join(rules.BOILERPLATE) + ")"


def words(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text(c), r"\s+"), lambda w: w != "")


def long_words(c: Column) -> Column:
    return F.filter(words(F.lower(c)), lambda w: F.length(w) > 4)


def tag_free(html: Column) -> Column:
    return F.regexp_replace(text(html), "<[^>]+>", " ")


def is_boilerplate(line: Column) -> Column:
    """Known page furniture, or a short line without digit and without an acronym."""
    s = strip(line)
    return line.rlike(BOILERPLATE_RE) | ((F.length(s) < 15) & ~s.rlike(r"\d") & ~s.rlike("[A-Z]{2,}"))


def real_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_boilerplate(x))


# -- output score (M22) --------------------------------------------------------


def _used(phrases: Column, body: Column, limit: int, need: int) -> Column:
    """Phrases of which enough of the first long words occur in the body.

    The words are split once per phrase; the lambda below only sees the short list.
    """
    keys = F.transform(phrases, lambda x: F.slice(long_words(x), 1, limit))
    return F.size(F.filter(keys, lambda k: (F.size(k) > 0) & (F.size(F.filter(k, lambda w: body.contains(w))) >= F.least(F.lit(need), F.size(k)))))


def output_quality(outputs: DataFrame) -> DataFrame:
    """Five axis scores of generated descriptions.

    Expects ``body_html, blocks, bullets, specs, materials, care`` and the verification
    counts ``verdict, n_supported, n_unsupported, n_embellished`` (null: not verified).
    """
    html = text(F.col("body_html"))
    low = F.lower(html)
    tag = lambda name: low.rlike(rf"<{name}[\s>/]")
    body = F.lower(strip(tag_free(html)))
    has_bullets, has_specs = F.size("bullets") > 0, F.size("specs") > 0
    staged = outputs.withColumns({
        "_li": F.transform(F.regexp_extract_all(html, F.lit(r"(?i)(?:^|>)([^<>]*)</li\s*>"), 1), strip), "_body": body,
        "_p": tag("p"), "_ul": tag("ul"), "_table": tag("table"), "_h3": tag("h3"), "_words": F.size(words(tag_free(html))),
    })
    n_li, b = F.size("_li"), F.col("_body")
    semantic = sum((x.cast("int") for x in (F.col("_p"), F.col("_h3"), F.col("_ul") | ~has_bullets, F.col("_table") | ~has_specs)), F.lit(0))
    structure = (
        flag(F.col("_p"), 8) + F.when(~has_bullets, 7).when(~F.col("_ul"), 0).when(n_li <= 6, 7).otherwise(3)
        + flag(~has_specs | F.col("_table"), 5) + F.least(F.lit(5), F.floor(semantic * 5 / F.lit(4.0)))
    )
    n = F.col("_words")
    long_li = F.size(F.filter("_li", lambda x: F.size(words(x)) > 12))
    length = (
        F.when(n.between(100, 400), 10).when(n.between(50, 99) | n.between(401, 600), 5).otherwise(0)
        + F.when((n_li == 0) | (long_li == 0), 5).otherwise(F.floor(5 * (1 - ratio(long_li, n_li))))
    )
    banned = sum((b.rlike(rf"(?U)\b{w}\b").cast("int") for w in rules.BANNED_WORDS), F.lit(0))
    hype = F.greatest(F.lit(0), 15 - F.least(F.lit(15), banned * 5))
    blocks_ok = (F.size("blocks") == 0) | (_used(F.col("blocks"), b, 10, 3) > 0)
    bullets_used = ratio(_used(F.col("bullets"), b, 5, 2), F.size("bullets"))
    mentioned = lambda c: _used(F.array(text(F.col(c))), b, 10, 2) > 0
    rich = [
        (has_specs, F.exists(F.map_values("specs"), lambda v: b.contains(F.lower(v)))),
        (text(F.col("materials")) != "", mentioned("materials")), (text(F.col("care")) != "", mentioned("care")),
    ]
    n_rich = sum((c.cast("int") for c, _ in rich), F.lit(0))
    n_used = sum(((c & u).cast("int") for c, u in rich), F.lit(0))
    coverage = (
        flag(blocks_ok, 5) + F.when(has_bullets, F.floor(5 * bullets_used)).otherwise(5)
        + F.when(n_rich > 0, F.floor(5 * ratio(n_used, n_rich))).otherwise(5)
    )
    claims = F.col("n_supported") + F.col("n_unsupported") + F.col("n_embellished")
    fidelity = (
        F.when(F.coalesce("verdict", F.lit("ERROR")) == "ERROR", 0).when(claims == 0, 30)
        .otherwise(F.floor(30 * ratio(F.col("n_supported"), claims)))
    )
    axes = {"structure": structure, "length": length, "anti_hype": hype, "coverage": coverage, "fidelity": fidelity}
    scored = staged.withColumns({k: v.cast("int") for k, v in axes.items()}).drop("_li", "_body", "_p", "_ul", "_table", "_h3", "_words")
    return scored.withColumn("total", sum((F.col(a) for a in axes), F.lit(0)))


def quality_rollup(scored: DataFrame) -> DataFrame:
    """Mean total, percent and axes."""
    return scored.agg(
        F.count(F.lit(1)).alias("outputs"), F.avg("total").alias("avg_total"), F.avg(F.col("total") / F.lit(100.0) * 100.0).alias("avg_pct"),
        *[F.avg(a).alias(f"avg_{a}") for a in ("structure", "length", "anti_hype", "coverage", "fidelity")],
    )


# -- duplicates and overlap -------------------------------------------------------


def near_duplicate_counts(lines: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """Number of line pairs per document with word Jaccard above the threshold.

    ``lines(key, line)`` holds one row per line.  Equal word sets are counted once, so a
    block of n copies adds n(n-1)/2 without listing a pair; different sets meet in their document's
    rarest words only (the prefix filter of ``setsim.prefixes``), and every surviving pair is verified on the whole sets.
    All steps group or join by the key alone, or by more than the key on rows that lie by it: the lines are
    shuffled once, or not at all if they come dealt by it, and neither sets nor words are written.
    """
    ranked = F.dense_rank().over(Window.partitionBy(key).orderBy("s"))  # equal sets of a document have one number
    sets = (
        lines.select(key, F.array_sort(F.array_distinct(words(F.lower("line")))).alias("s")).where(F.size("s") > 0)
        .withColumn("sid", ranked).groupBy(key, "sid").agg(F.count(F.lit(1)).alias("n"), F.any_value("s").alias("s"))
    )
    inside = sets.where("n > 1").select(key, (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    toks = sets.select(key, "sid", F.explode("s").alias("w")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(key, "w")))
    ordered = toks.groupBy(key, "sid").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    size = F.size("o")
    keep = size - F.floor(F.lit(threshold) * size).cast("int")
    blocks = ordered.select(key, "sid", size.alias("size"), F.explode(F.slice("o", F.lit(1), keep)).alias("p")).where("p.df > 1")
    holders = blocks.groupBy(key, F.col("p.w").alias("w")).agg(F.array_sort(F.collect_list(F.struct("sid", "size"))).alias("m")).where(F.size("m") > 1)
    first = holders.select(key, "m", F.posexplode("m").alias("at", "a"))
    size_ok = lambda b: (F.col("a.size") * threshold < b["size"]) & (b["size"] * threshold < F.col("a.size"))
    others = F.filter(F.slice("m", F.col("at") + 2, F.size("m")), size_ok)
    met = first.select(key, F.col("a.sid").alias("sida"), F.explode(others).alias("b")).select(key, "sida", F.col("b.sid").alias("sidb")).distinct()
    # a document's sets by number, as its text was one row before
    whole = sets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sid", "n", "s"))).alias("_sets"))
    a, b = (F.get("_sets", F.col(f"sid{x}") - 1) for x in "ab")
    shared = F.size(F.array_intersect(a["s"], b["s"]))
    across = met.join(merged(whole), key).where(
        shared / (F.size(a["s"]) + F.size(b["s"]) - shared).cast("double") > threshold
    ).select(key, (a["n"] * b["n"]).alias("pairs"))
    return inside.unionByName(across).groupBy(key).agg(F.sum("pairs").alias("pairs"))


def ngrams(lines: Column, n: int = 6) -> Column:
    """64-bit hash of every run of ``n`` words of the lines of an array."""
    none = F.array().cast("array<bigint>")
    # a line's words are a bound variable: a column would be split again for every run
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(none)
    return F.flatten(F.transform(F.transform(lines, lambda x: words(F.lower(x))), runs))


def shared_ngrams(facts: DataFrame, key: str, blocks: str = "blocks", bullets: str = "bullets", n: int = 6) -> DataFrame:
    """``(key, shared)``: number of distinct n-grams that occur in a block and in a bullet (J20), for keys that have any.

    A row holds 8 bytes for each word of its texts, no n-gram in writing, and nothing is shuffled.  N-grams with
    one 64-bit hash count as one: among ten million n-grams two such are met once in 300,000 texts.
    """
    both = facts.where((F.size(blocks) > 0) & (F.size(bullets) > 0))
    return both.select(key, F.size(F.array_intersect(ngrams(F.col(blocks), n), ngrams(F.col(bullets), n))).cast("bigint").alias("shared")).where("shared > 0")


# -- fact score (M23) -----------------------------------------------------------


def fact_quality(facts: DataFrame, key: str = "handle") -> DataFrame:
    """Four axis scores of extracted facts.

    Expects ``product_name, brand, blocks, bullets, specs, materials, care, ld_description``.
    """
    staged = facts.withColumns({"_blocks": real_lines(F.col("blocks")), "_bullets": real_lines(F.col("bullets"))})
    lines = staged.select(key, F.explode("_bullets").alias("line"))
    pairs = near_duplicate_counts(lines, key).withColumnRenamed("pairs", "_near")
    nb, nf = F.size("_blocks"), F.size("_bullets")
    share = ratio(nb + nf, F.size("blocks") + F.size("bullets"))
    base = F.when(share >= 0.8, 28).when(share >= 0.6, 22).when(share >= 0.4, 15).when(share >= 0.2, 8).when(share >= 0.01, 3).otherwise(0)
    rescue = F.length(strip(text(F.col("ld_description")))) > 50
    signal = F.when(rescue, F.least(F.lit(30), base + 5)).otherwise(base)
    n_specs = F.size("specs")
    materials = text(F.col("materials"))
    complete = (
        flag(text(F.col("product_name")) != "", 4) + flag(text(F.col("brand")) != "", 3) + flag(nb >= 1, 5)
        + F.when(nf >= 3, 5).when(nf == 2, 3).when(nf == 1, 1).otherwise(0) + F.when(n_specs >= 2, 4).when(n_specs == 1, 2).otherwise(0)
        + flag(materials != "", 2) + flag(text(F.col("care")) != "", 2)
    )
    content = F.array_join(F.concat("_blocks", "_bullets"), " ")
    name_words = F.filter(words(F.lower("product_name")), lambda w: F.length(w) > 2)
    lowered = F.lower(content)
    named = (content != "") & F.exists(name_words, lambda w: lowered.contains(w))
    tech = (
        F.regexp_count(content, F.lit(rf"(?iU)\b\d+[\s-]*({rules.UNITS})\b")) + F.regexp_count(content, F.lit(rf"(?i)({rules.MATERIALS})"))
        + F.regexp_count(content, F.lit(r"(?U)\b[A-Z]{2,}\b"))
    )
    solid = F.size(F.filter(F.map_values("specs"), lambda v: v.rlike(r"\d") | (F.length(strip(v)) > 3)))
    pct, fiber = materials.rlike(r"\d+\s*%"), materials.rlike(f"(?i)({rules.MATERIALS})")
    specific = (
        flag(named, 7) + F.when(tech >= 3, 6).when(tech >= 1, 4).otherwise(0) + F.least(F.lit(6), solid * 2)
        + F.when(materials == "", 0).when(pct & fiber, 6).otherwise(3)
    )
    norm = F.transform("_blocks", lambda x: F.lower(strip(x)))
    dupes = F.size(norm) - F.size(F.array_distinct(norm))
    both = (F.size("_blocks") > 0) & (F.size("_bullets") > 0)
    collisions = F.when(both, F.size(F.array_intersect(ngrams(F.col("_blocks")), ngrams(F.col("_bullets"))))).otherwise(0)
    near = F.coalesce("_near", F.lit(0))
    zero = F.lit(0)
    unique = F.greatest(zero, 8 - dupes * 2) + F.greatest(zero, 6 - near * 2) + F.greatest(zero, 6 - collisions * 3)
    axes = {"signal": signal, "completeness": complete, "specificity": specific, "uniqueness": unique}
    scored = staged.join(merged(pairs), key, "left").withColumns({k: v.cast("int") for k, v in axes.items()} | {
        "duplicate_blocks": dupes, "near_pairs": near, "collisions": collisions})
    return scored.withColumn("total", sum((F.col(a) for a in axes), F.lit(0))).drop("_blocks", "_bullets", "_near")


# -- drafts and confidence ----------------------------------------------------------


def refusal(html: Column) -> Column:
    """First refusal phrase found; null for real content."""
    low = F.lower(html)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in rules.REFUSALS])


def draft_cleanup(html: Column) -> Column:
    """Code fences and trailing commentary removed (F2)."""
    out = F.regexp_replace(strip(html), r"^```(?:html|HTML)?\s*\n?", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n?\s*```\s*$", ""), r"(?m)^```\s*$", "")
    return strip(F.element_at(F.split(out, r"\n---\n|\n\*\*[A-Z]"), 1))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def truncated(c: Column, limit: int | None) -> Column:
    return c if limit is None else F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def fallback_html(blocks: Column, bullets: Column, specs: Column, chars: int | None = None, items_: int | None = None, item_chars: int | None = None, rows_: int | None = None) -> Column:
    """Plain description from facts; null without any.

    The first block, all features and specifications; the numbers bound its characters, the features and theirs, and the specifications.
    """
    first = lambda c, n: c if n is None else F.slice(c, 1, n)
    intro = F.when(F.size(blocks) > 0, F.concat(F.lit("<p>"), escape_html(truncated(F.get(blocks, F.lit(0)), chars)), F.lit("</p>")))
    items = F.transform(first(bullets, items_), lambda b: F.concat(F.lit("<li>"), escape_html(truncated(b, item_chars)), F.lit("</li>")))
    features = F.when(F.size(bullets) > 0, F.concat(F.lit("<h3>Features</h3>\n<ul>\n"), F.array_join(items, "\n"), F.lit("\n</ul>")))
    rows = F.transform(
        first(F.map_entries(specs), rows_),
        lambda e: F.concat(F.lit("<tr><td>"), escape_html(e["key"]), F.lit("</td><td>"), escape_html(e["value"]), F.lit("</td></tr>")))
    table = F.when(F.size(specs) > 0, F.concat(F.lit("<h3>Specifications</h3>\n<table>\n"), F.array_join(rows, "\n"), F.lit("\n</table>")))
    return F.nullif(F.concat_ws("\n", intro, features, table), F.lit(""))


def scoring_inputs(outputs: DataFrame, facts: DataFrame, verifications: DataFrame) -> DataFrame:
    """What ``output_quality`` reads, joined from artifacts (J16): outputs with a body and facts, verified or not."""
    body = outputs.where(text(F.col("body_html")) != "").select("handle", "body_html")
    return body.join(merged(facts), "handle").join(merged(verifications.select("handle", "verdict", "n_supported", "n_unsupported", "n_embellished")), "handle", "left")


def prompt_facts(facts: DataFrame, blocks: int | None = None, bullets: int | None = None, specs: int | None = None) -> DataFrame:
    """Facts without rating noise and body measures (P23); the numbers bound what a prompt holds, by default nothing."""
    few = lambda c, n: c if n is None else F.slice(c, 1, n)
    clean = lambda c: strip(F.regexp_replace(F.regexp_replace(c, r"\d+\.?\d*\(\d+\)\d+\s*total reviews?", ""), r"\d+\.?\d*\s*out of \d+\s*stars?", ""))
    first_specs = F.map_from_entries(few(F.map_entries("specs"), specs))
    return facts.withColumns({
        "product_name": clean(text(F.col("product_name"))),
        "blocks": F.filter(F.transform(few(F.col("blocks"), blocks), clean), lambda b: b != ""),
        "bullets": few(F.col("bullets"), bullets),
        "specs": F.map_filter(first_specs, lambda k, v: ~contains_any(F.lower(k), rules.MEASURE_KEYS)),
    })


def output_confidence(html: Column, n_images: Column, n_colors: Column, warnings: Column, sources: Column) -> Column:
    """Confidence of a generated output (P18); ``sources`` counts JSON-LD, bullets and specs present."""
    size = F.length(text(html))
    body = F.when(size > 200, 15).when(size > 100, 10).when(size > 0, 5).otherwise(0)
    cost = F.aggregate(
        F.transform(warnings, lambda w: F.when(any_of(*[w.contains(c) for c in rules.CRITICAL_WARNINGS]), 10).otherwise(2)), F.lit(0), lambda a, x: a + x)
    return clamp(F.lit(50) + body + F.least(n_images * 3, F.lit(15)) + F.least(n_colors * 2, F.lit(10)) - cost + sources * 5, 0, 100).cast("int")


def ranked_images(images: DataFrame, key: str = "handle", limit: int | None = None) -> DataFrame:
    """Output images in order, all or at most ``limit`` per product.

    ``images(key, ord, url, source_hint, alt, product_name)``: first per URL without
    query, importable only, non-badges first, then more name words in the URL, then source.
    """
    bare = F.substring_index("url", "?", 1)
    row = F.struct("ord", "url", "source_hint", "alt", "product_name")
    unique = images.groupBy(key, bare.alias("_bare")).agg(F.min_by(row, "ord").alias("r")).select(key, "r.*")
    name = F.array_distinct(F.filter(words(F.lower("product_name")), lambda w: F.length(w) > 2))
    low = F.lower("url")
    file = F.substring_index(F.lower(F.substring_index("url", "?", 1)), "/", -1)
    source = F.when(F.col("source_hint") == "json_ld", 0).when(F.col("source_hint") == "gallery", 1).otherwise(2)
    ok = unique.where(image_reject_reason(F.col("url")).isNull()).withColumns({
        "_badge": contains_any(file, rules.BADGE_FILES).cast("int"), "_hits": F.size(F.filter(name, lambda w: low.contains(w))), "_src": source})
    top = top_k(ok, [key], [F.col("_badge"), F.desc("_hits"), F.col("_src"), F.col("ord")], limit, out="position")
    auto = F.when(F.col("position") == 1, F.col("product_name")).otherwise(F.concat("product_name", F.lit(" - Image "), F.col("position").cast("string")))
    return top.select(key, "position", F.col("url").alias("src"), F.coalesce(F.nullif(F.col("alt"), F.lit("")), auto).alias("alt"))

