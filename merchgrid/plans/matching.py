"""Queries over record matching, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions.common import half_up
from merchgrid.functions.similarity import edit_ratio, sequence_ratio
from merchgrid.operators import matching as M
from merchgrid.plans.sql import r, with_tables
from merchgrid.rules import matching as rules


def _edit(a, b, needed=None):
    return edit_ratio(a, b) if needed is None else F.when(needed, edit_ratio(a, b))


def url_structure_score(spark, sf):
    c = Tables(spark, sf).search_results()
    return c.select("product_id", "ord", "url", M.url_score(F.col("url"), F.col("title"), F.col("product_title")).cast("bigint").alias("score"))


def _scored_columns(df):
    return df.select("product_id", "ord", F.col("url_score").cast("bigint").alias("url_score"), half_up(F.col("overlap"), 6).alias("overlap"),
                     F.col("confidence").cast("bigint").alias("confidence"))


def rescore(spark, sf):
    return M.rescore(Tables(spark, sf).search_results()).select("product_id", "ord", "url", "confidence", "reasoning")


def rescore_live(spark, sf):
    return M.rescore(Tables(spark, sf).search_results(), live=True).select("product_id", "ord", "url", "confidence", "reasoning")


def rescore_edit(spark, sf):
    return _scored_columns(M.rescore(Tables(spark, sf).search_results(), similarity=_edit))


def _hits(spark, sf):
    c = Tables(spark, sf).search_results()
    base = c.withColumn("confidence", M.url_score(F.col("url"), F.col("title"), F.col("product_title")).cast("int"))
    return M.search_hits(base)


def search_hit_scores(spark, sf):
    return _hits(spark, sf).select("product_id", "ord", F.col("confidence").cast("bigint").alias("confidence"))


def candidate_top(spark, sf):
    return M.top_candidates(_hits(spark, sf), 3).select("product_id", "url", F.col("confidence").cast("bigint").alias("confidence"), F.col("pos").cast("bigint").alias("pos"))


def candidate_select(spark, sf):
    return M.select_candidate(M.best_per_url(_hits(spark, sf))).select(
        "product_id", F.coalesce("selected_url", F.lit("")).alias("selected_url"), F.coalesce("selected_confidence", F.lit(-1)).cast("bigint").alias("selected_confidence"), "dead_before", "warning")


def title_gate(spark, sf):
    g = M.title_gate(Tables(spark, sf).title_pairs())
    return g.select("conv_id", "turn", "title_similarity", "word_overlap", "passed", "reason")


def title_gate_edit(spark, sf):
    # ASCII letters only: the oracle's edit distance counts bytes.
    ascii_edit = lambda a, b: _edit(F.regexp_replace(a, r"[^\x00-\x7F]", ""), F.regexp_replace(b, r"[^\x00-\x7F]", ""))
    g = M.title_gate(Tables(spark, sf).title_pairs(), similarity=ascii_edit)
    demo = F.coalesce(F.col("demographic_match").cast("int"), F.lit(-1)).cast("bigint")
    return g.select("conv_id", "turn", half_up(F.col("title_similarity"), 6).alias("title_similarity"), half_up(F.col("word_overlap"), 6).alias("word_overlap"),
                    demo.alias("demographic"), "passed")


def _decision_input(t):
    c = t.search_results().withColumn("confidence", M.url_score(F.col("url"), F.col("title"), F.col("product_title")).cast("int"))
    colors = F.when(F.col("product_id") % 3 == 0, F.array(F.lit("Red"), F.lit("Teal"))).otherwise(F.array(F.lit("Forest Green")))
    return c.select("product_id", "url", "ord", "confidence", F.col("product_title").alias("catalog_title"), F.col("price").alias("catalog_price"), colors.alias("catalog_colors"))


def candidate_decisions(spark, sf):
    t = Tables(spark, sf)
    return M.decide(_decision_input(t), t.candidate_pages())


def _decision_columns(d):
    return d.select("product_id", F.col("attempt").cast("bigint").alias("attempt"), "url", "outcome", "title_extracted",
                    half_up(F.col("word_overlap"), 6).alias("word_overlap"), half_up(F.col("sig_price"), 6).alias("sig_price"), half_up(F.col("sig_color"), 6).alias("sig_color"),
                    half_up(F.col("match_confidence"), 4).alias("match_confidence"))


def candidate_decisions_edit(spark, sf):
    t = Tables(spark, sf)
    return _decision_columns(M.decide(_decision_input(t), t.candidate_pages(), similarity=_edit))


def candidate_decisions_ratio(spark, sf):
    """The decisions' compared columns with the ratio itself."""
    t = Tables(spark, sf)
    return _decision_columns(M.decide(_decision_input(t), t.candidate_pages()))


def candidate_decisions_all(spark, sf):
    """Every candidate may be tried."""
    t = Tables(spark, sf)
    return _decision_columns(M.decide(_decision_input(t), t.candidate_pages(), k=None))


def season_flags(spark, sf):
    s = M.season_flags(Tables(spark, sf).season_rows())
    return s.select("product_id", half_up(F.col("color_overlap"), 3).alias("color_overlap"), F.array_join("year_hints", ",").alias("year_hints"),
                    F.array_join("flags", ",").alias("flags"), "note")


def catalog_title_match(spark, sf):
    t = Tables(spark, sf)
    m = M.title_join(t.match_titles(), t.vendor_catalog())
    return m.withColumn("score", half_up(F.col("score"), 6))


QUERIES = {f.__name__: f for f in (
    url_structure_score, rescore, rescore_live, rescore_edit, search_hit_scores, candidate_top, candidate_select, title_gate, title_gate_edit,
    candidate_decisions, candidate_decisions_edit, candidate_decisions_ratio, candidate_decisions_all, season_flags, catalog_title_match,
)}

# ---------------------------------------------------------------- oracles


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _set(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_V = "lower(replace(p_brand, '#', ''))"
_SITE = f"'https://www.' || {_V} || '.example.com'"
_NOUN = "split_part(p_name, ' ', 2)"
_H = "replace(p_name, ' ', '-') || '-' || p_partkey"
_CODE = "lpad((p_partkey * 1000)::VARCHAR, 12, '0')"
_PRICE = "floor(p_retailprice)::BIGINT"
_SHAPES = [
    ("barcode", f"{_SITE} || '/products/' || {_H}", "p_name",
     f"'Code ' || CASE WHEN p_partkey % 2 = 0 THEN {_CODE} ELSE 'none' END || ' now $' || ({_PRICE} + p_partkey % 3 * 300) || '.50'"),
    ("sku", f"{_SITE} || '/shop/mens/jackets/all/' || {_NOUN}", "p_name || ' Mid ' || (2020 + p_partkey % 6)", "''"),
    ("title", f"'https://' || {_V} || '.example.com/collections/all?page=2&sort=x'", f"'Shop all ' || {_NOUN} || 's | Official'", "''"),
    ("title", f"{_SITE} || '/p/' || p_partkey || '/'", f"p_brand || ' ' || {_NOUN} || ' ' || (p_partkey % 100) || ' limited'", f"'from $' || {_PRICE}"),
    ("title", f"{_SITE} || '/blog/about-' || {_NOUN} || '-story-' || p_partkey", f"{_NOUN} || ' boots for women'", "''"),
    ("title", f"{_SITE} || '/products/' || {_H} || '/'", "p_name || ' - ' || p_brand", "''"),
]
_SEARCH = " UNION ALL ".join(
    f"""SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN p_name || ' Low ' || (p_partkey % 50) ELSE p_name END AS product_title,
      p_brand AS vendor, {_PRICE}::DOUBLE AS price, {_CODE} AS barcode, 'SKU-' || p_partkey AS sku, p_partkey % 5 AS broad_count, {i}::BIGINT AS ord, '{k}' AS strategy,
      {u} AS url, {t} AS title, {s} AS snippet, (p_partkey + {i}) % 4 <> 0 AS live FROM part""" for i, (k, u, t, s) in enumerate(_SHAPES)
)
_any = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_PP = " OR ".join(f"regexp_matches(path, '{p}/*[^/]')" for p in rules.PRODUCT_PATHS)
_TOK = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
_NUM = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[0-9]+'))"
_MINUS = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
_BOTH = lambda ws: f"(list_has_any(missing, {_list(ws)}) AND list_has_any(extra, {_list(ws)}))"
_CLASH = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"
_LEV = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"
_GENERIC = sorted(set(rules.TYPE_WORDS + rules.HEIGHT_WORDS + rules.EDITION_WORDS + rules.DEMOGRAPHICS + rules.OTHER_GENERIC))
_STEP = lambda prev, new, d: f"greatest(0, least(100, {prev} + CASE WHEN {new} THEN {d} ELSE 0 END))"

_URL = {
    "search_": _SEARCH,
    "u1": "SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM search_",
    "u2": """SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs,
        list_distinct(list_filter(regexp_split_to_array(lower(product_title), '[\\s\\-/]+'), lambda w: length(w) > 2 AND w NOT IN """ + _set(rules.SLUG_STOP) + """)) AS wanted_,
        list_filter(regexp_split_to_array(path, '[\\s\\-/]+'), lambda w: length(w) > 2) AS pwords FROM u1""",
    "u3": f"""SELECT *, ({_PP}) AS pp, len(segs) AS depth, len(list_filter(segs, lambda s: s IN {_set(rules.CATEGORY_SEGMENTS)})) AS cat,
        len(list_filter(string_split(trim(title), ' '), lambda w: w <> '')) AS tw,
        CASE WHEN len(wanted_) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(wanted_, lambda w: list_contains(pwords, w)))::DOUBLE / len(wanted_) END AS share FROM u2""",
    "u4": f"""SELECT *, greatest(0, least(100, 50 + CASE WHEN pp THEN 20 ELSE 0 END + CASE WHEN NOT pp AND contains(path, '/shop/') THEN CASE WHEN depth >= 4 THEN -10 ELSE 5 END ELSE 0 END
        - CASE WHEN {_any('path', rules.CATEGORY_PATHS)} THEN 20 ELSE 0 END - CASE WHEN cat >= 2 THEN 15 ELSE 0 END
        + CASE WHEN depth BETWEEN 1 AND 3 THEN 10 WHEN depth > 5 THEN -10 ELSE 0 END - CASE WHEN {_any('lower(title)', rules.GENERIC_TITLE_PARTS)} THEN 15 ELSE 0 END
        - CASE WHEN trim(lower(title)) IN {_set(rules.GENERIC_TITLES)} THEN 25 ELSE 0 END + CASE WHEN tw BETWEEN 2 AND 10 THEN 5 ELSE 0 END
        + CASE WHEN regexp_matches(title, '[0-9]') THEN 5 ELSE 0 END - CASE WHEN contains(url, '?') AND {_any('lower(url)', rules.QUERY_MARKERS)} THEN 15 ELSE 0 END
        + CASE WHEN depth > 0 AND contains(segs[-1], '-') AND length(segs[-1]) > 10 THEN 5 ELSE 0 END
        + CASE WHEN share >= 0.5 THEN 10 WHEN share >= 0.3 THEN 5 ELSE 0 END))::BIGINT AS score FROM u3""",
}
_RESCORE = _URL | {
    "r1": f"""SELECT *, lower(title) AS cand, lower(CASE WHEN starts_with(lower(product_title), lower(vendor)) THEN regexp_replace(product_title[length(vendor) + 1:], '^[ -]+|[ -]+$', '', 'g') ELSE trim(product_title) END) AS wanted FROM u4""",
    "r2": f"""SELECT *, {_MINUS(_TOK('wanted'), _list(rules.FILLER))} AS tws, {_MINUS(_TOK('cand'), _list(rules.FILLER))} AS cws,
        list_distinct(regexp_extract_all(wanted, '20[23][0-9]')) AS ty, list_distinct(regexp_extract_all(cand, '20[23][0-9]')) AS cy FROM r1""",
    "r3": f"""SELECT *, {_MINUS('tws', 'cws')} AS missing, {_MINUS('cws', 'tws')} AS extra, len(tws) > 0 AND len(cws) > 0 AS ok,
        CASE WHEN len(tws) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(tws, cws))::DOUBLE / len(tws) END AS ov FROM r2""",
    "r4": f"""SELECT *, list_has_any(extra, {_list(rules.HEIGHT_WORDS)}) AND NOT list_has_any(tws, {_list(rules.HEIGHT_WORDS)}) AS asym,
        list_has_any(extra, {_list(rules.COLLAB_WORDS)}) OR (regexp_matches(cand, '\\s[x×]\\s|×') AND NOT regexp_matches(wanted, '\\s[x×]\\s|×')) AS collab,
        {_CLASH(f"list_intersect(tws, {_list(rules.DEMOGRAPHICS)})", f"list_intersect(cws, {_list(rules.DEMOGRAPHICS)})")} AS demo, {_CLASH('ty', 'cy')} AS yc,
        {_BOTH(rules.TYPE_WORDS)} OR {_BOTH(rules.HEIGHT_WORDS)} OR {_BOTH(rules.EDITION_WORDS)} OR {_CLASH(_MINUS(_NUM('wanted'), 'ty'), _MINUS(_NUM('cand'), 'cy'))} AS crit,
        len({_MINUS('extra', f"list_concat(list_concat({_list(_GENERIC)}, {_TOK('vendor')}), {_NUM('cand')})")}) > 0
          AND len({_MINUS('missing', f"list_concat(list_concat({_list(_GENERIC)}, {_TOK('vendor')}), {_NUM('wanted')})")}) > 0 AS alien,
        CASE WHEN ok AND ov < 0.6 THEN {_LEV.format(a='wanted', b='cand')} ELSE 0.0::DOUBLE END AS seq,
        CASE WHEN len(tws) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(tws, {_TOK('url')}))::DOUBLE / len(tws) END AS inurl,
        try_cast(replace(coalesce(nullif(regexp_extract(snippet, '\\$([0-9]+(?:[.,][0-9]{{2}})?)', 1), ''), nullif(regexp_extract(title, '\\$([0-9]+(?:[.,][0-9]{{2}})?)', 1), '')), ',', '') AS DOUBLE) AS cp FROM r3""",
    "r5": f"SELECT *, {_STEP('score', 'ok AND asym', '-15')} AS c1 FROM r4",
    "r6": f"SELECT *, {_STEP('c1', 'ok AND collab', '-25')} AS c2 FROM r5",
    "r7": f"SELECT *, {_STEP('c2', 'ok AND demo', '-15')} AS c3 FROM r6",
    "r8": f"SELECT *, {_STEP('c3', 'ok AND yc', '-5')} AS c4 FROM r7",
    "r9": f"SELECT *, {_STEP('c4', 'ok AND alien', '-20')} AS c5 FROM r8",
    "r10": """SELECT *, greatest(0, least(100, c5 + CASE WHEN NOT ok THEN 0 WHEN crit THEN -30 WHEN ov >= 0.6 OR seq >= 0.5 THEN floor(20 * ov)::INT + CASE WHEN inurl > 0.5 THEN 5 ELSE 0 END
        WHEN ov < 0.2 AND seq < 0.3 THEN -25 WHEN ov < 0.3 THEN -10 ELSE 0 END)) AS c6 FROM r9""",
    "r11": """SELECT *, greatest(0, least(100, c6 + CASE WHEN cp IS NULL OR cp <= 0 THEN 0 WHEN abs(cp - price) / price <= 0.2::DOUBLE THEN 10
        WHEN abs(cp - price) / price > 0.5::DOUBLE THEN -15 ELSE 0 END)) AS c7 FROM r10""",
}
_HITS = _URL | {
    "h1": """SELECT *, greatest(0, least(100, score + CASE strategy
          WHEN 'barcode' THEN CASE WHEN contains(snippet, barcode) OR contains(url, barcode) OR contains(title, barcode) THEN 15 ELSE -5 END
          WHEN 'sku' THEN CASE WHEN contains(snippet, sku) OR contains(url, sku) OR contains(url, split_part(sku, '-', 1)) THEN 12 ELSE -5 END
          WHEN 'title' THEN 10 ELSE 0 END)) AS s1 FROM u4""",
    "hits": "SELECT *, greatest(0, least(100, s1 + CASE WHEN broad_count >= 3 AND ord = 0 THEN 5 WHEN broad_count = 0 THEN -10 ELSE 0 END))::BIGINT AS confidence FROM h1",
    "uniq_url": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, regexp_replace(lower(url), '/+$', '') ORDER BY confidence DESC, ord) AS dup FROM hits) WHERE dup = 1""",
}

_GF, _GD = rules.GATE_FILLER, rules.DEMOGRAPHICS
_MEAN = lambda c: _MINUS(_TOK(c), _list(sorted(set(_GF + _GD))))
_DEMO = lambda c: f"list_distinct(list_transform(list_intersect({_TOK(c)}, {_list(_GD)}), lambda w: CASE w WHEN 'men' THEN 'mens' WHEN 'women' THEN 'womens' ELSE w END))"


def gate_sql(src: str, clean: str = "{}") -> str:
    return f"""SELECT *, {_DEMO('page_title')} AS dp, {_DEMO('catalog_title')} AS dc, len(list_intersect({_MEAN('catalog_title')}, {_MEAN('page_title')}))::DOUBLE
        / greatest(len({_MEAN('catalog_title')}), 1) AS word_overlap, {_LEV.format(a=clean.format('lower(page_title)'), b=clean.format('lower(catalog_title)'))} AS title_similarity FROM {src}"""


_GATE = {
    "pairs_": """SELECT conv_id, q.turn AS turn, q.text AS catalog_title, text AS page_title FROM (SELECT conv_id, role, text, last_value(CASE WHEN role = 'user' THEN {'turn': turn, 'text': text} END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) WHERE role = 'assistant' AND q IS NOT NULL""",
    "gated": gate_sql("pairs_", "regexp_replace({}, '[^\\x00-\\x7F]', '', 'g')"),
}
_ACTIVE = lambda c: f"list_distinct(list_filter(list_transform({c}, lambda x: lower(trim(regexp_replace(regexp_replace(x, '\\s*[/|]\\s*', ' ', 'g'), '\\s+', ' ', 'g')))), lambda n: NOT list_has_any(string_split(n, ' '), {_list(rules.NEUTRALS)})))"
_OVER = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0::DOUBLE ELSE floor(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) * 1000 + 0.5::DOUBLE) / 1000 END"
_DECIDE = _URL | {
    "dc_": """SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, ord) AS attempt, product_title AS catalog_title,
        (product_id + ord) % 9 = 0 AS blocked, CASE WHEN (product_id + ord) % 7 = 0 THEN '' ELSE title END AS product_name,
        CASE WHEN ord % 2 = 0 THEN price * (1.0::DOUBLE + (product_id % 8) / 10.0::DOUBLE) END AS scraped,
        CASE WHEN product_id % 4 = 0 THEN []::VARCHAR[] ELSE ['red', 'forest green'] END AS vcol,
        CASE WHEN product_id % 3 = 0 THEN ['red', 'teal'] ELSE ['forest green'] END AS ccol, (product_id + ord * 3) % 10 * 10.0::DOUBLE AS content FROM u4""",
    "pg_": """SELECT * FROM (SELECT url, blocked, product_name, scraped, vcol, content, title, row_number() OVER (PARTITION BY url ORDER BY content DESC,
        CASE WHEN blocked THEN 'Just a moment, checking your browser' ELSE '# Menu' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || 'A long' END DESC, product_name DESC, scraped DESC NULLS LAST, vcol DESC) AS nth FROM dc_) WHERE nth = 1""",
    "dp_": """SELECT dc_.* REPLACE (pg_.blocked AS blocked, pg_.product_name AS product_name, pg_.scraped AS scraped, pg_.vcol AS vcol, pg_.content AS content, pg_.title AS title) FROM dc_ JOIN pg_ ON pg_.url = dc_.url""",
    "d2": f"""SELECT *, CASE WHEN blocked THEN NULL WHEN len({_MEAN('catalog_title')}) = 0 THEN 'Menu'
        WHEN len(list_intersect({_MEAN('catalog_title')}, {_MEAN('title')}))::DOUBLE / len({_MEAN('catalog_title')}) >= 0.3 THEN trim(title) END AS page_title FROM dp_ WHERE attempt <= 3""",
    "d3": gate_sql("d2"),
    "d4": f"""SELECT *, CASE WHEN len(dp) > 0 AND len(dc) > 0 AND NOT list_has_any(dp, dc) THEN false ELSE NOT (title_similarity < 0.4 AND word_overlap < 0.3) END AS passed,
        CASE WHEN product_name = '' THEN 0.0::DOUBLE ELSE {_LEV.format(a='lower(product_name)', b='lower(catalog_title)')} END AS st,
        CASE WHEN scraped IS NULL THEN 0.5::DOUBLE WHEN abs(scraped - price) / price > 0.2 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (abs(scraped - price) / price - 0.2::DOUBLE) / 0.4::DOUBLE)) ELSE 1.0::DOUBLE END AS sp,
        CASE WHEN len(vcol) = 0 THEN 0.5::DOUBLE ELSE {_OVER('ccol', 'vcol')} END AS sc, CASE WHEN content >= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sq FROM d3""",
    "d5": """SELECT *, st * 40 + sp * 25 + sc * 25 + sq * 10 AS conf FROM d4""",
    "d6": """SELECT *, CASE WHEN score < 50 THEN 'skip_low_confidence' WHEN blocked THEN 'reject_bot_blocked' WHEN page_title IS NOT NULL AND NOT passed THEN 'reject_title_gate'
        WHEN product_name = '' THEN 'reject_extraction_failed' WHEN conf < 50 THEN 'reject_post_extraction' ELSE 'accept' END AS outcome FROM d5""",
    "d7": "SELECT *, min(CASE WHEN outcome = 'accept' THEN attempt END) OVER (PARTITION BY product_id) AS okat FROM d6",
    "d8": "SELECT * REPLACE (CASE WHEN outcome IN ('accept', 'reject_post_extraction') THEN conf END AS conf) FROM d7",
}
_SEASON = {
    "sr": """SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN ['Red', 'Black', 'Forest Green'] WHEN 1 THEN ['Navy Blue', 'Sand / Oat'] ELSE ['Red'] END AS cc,
        CASE p_partkey % 5 WHEN 0 THEN ['red', 'Sand | Oat'] WHEN 1 THEN ['teal', 'Matte Black', 'plum'] ELSE ['forest green', 'red'] END AS vc, 2022 + p_partkey % 4 AS ty,
        CASE WHEN p_partkey % 2 = 0 THEN 2021 + p_partkey % 7 ELSE 2022 + p_partkey % 5 END AS uy FROM part""",
    "sa": f"SELECT *, {_ACTIVE('cc')} AS a, {_ACTIVE('vc')} AS b FROM sr",
    "sb": f"""SELECT *, {_OVER('a', 'b')} AS co, len(list_distinct(list_concat(a, b))) AS n FROM sa""",
    "sf_": """SELECT *, n >= 2 AND co < 0.3 AS low, uy <> ty AS mis, uy > ty AS newer FROM sb""",
}
_JT = lambda c: f"list_sort({_MINUS(_TOK(c), _list(rules.CATALOG_FILLER))})"
_JOIN = {
    "jl": f"SELECT p_partkey % 4 AS domain, p_partkey AS product_id, {_JT('p_name || chr(32) || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN chr(32) || chr(98) || chr(111) || chr(111) || chr(116) || chr(115) ELSE chr(32) END')} AS a FROM part",
    "jr": f"""SELECT p_partkey % 4 AS domain, p_partkey AS other_id, {_JT("split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ['', ' deluxe', ' boots', ' 2025', ' verbier edition'][(p_partkey % 5)::INT + 1]")} AS b FROM part""",
    "js": "SELECT DISTINCT domain, a FROM jl",
    "jt": "SELECT domain, b, min(other_id) AS other_id FROM jr GROUP BY 1, 2",
    "jp": f"""SELECT js.domain, a, other_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * CASE WHEN
        len({_MINUS(_MINUS('b', 'a'), _list(rules.CATALOG_GENERIC))}) > 0 AND len({_MINUS(_MINUS('a', 'b'), _list(rules.CATALOG_GENERIC))}) > 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score
      FROM js JOIN jt ON js.domain = jt.domain""",
    "jb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, a ORDER BY score DESC, other_id) AS rn FROM jp WHERE score > 0.3) WHERE rn = 1",
}
_JOIN["jl"] = f"SELECT p_partkey % 4 AS domain, p_partkey AS product_id, {_JT('full_title')} AS a FROM (SELECT *, p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' boots' ELSE '' END AS full_title FROM part)"


def ratio_ctes(pairs: str) -> dict[str, str]:
    """Ratio ``q`` of the pairs ``(a, b)``: the longest common block (earliest in a, then in b) splits both sides, again and again."""
    return {
        "rp_": f"SELECT DISTINCT a, b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL",
        "rt_": """SELECT a, b, a AS x, b AS y, 0::BIGINT AS m FROM rp_
          UNION ALL SELECT a, b, unnest([left(x, i - 1), substr(x, i + k)]), unnest([left(y, j - 1), substr(y, j + k)]), unnest([k, 0]) FROM (
            SELECT *, strpos(y, substr(x, i, k)) AS j FROM (SELECT a, b, x, y, best.k AS k, -best.ni AS i FROM (
              SELECT a, b, x, y, list_max(list_transform(range(1, length(x) + 1), lambda i: {
                'k': coalesce(list_max(list_filter(range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))), 0), 'ni': -i})) AS best
              FROM rt_ WHERE x <> '' AND y <> '')) WHERE k > 0)""",
        "rr_": "SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(m) / (length(a) + length(b)) END AS q FROM rt_ GROUP BY a, b",
    }


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_SEQ = f"CASE WHEN ok AND ov < 0.6 THEN {_LEV.format(a='wanted', b='cand')} ELSE 0.0::DOUBLE END AS seq"
_QUIET = f"list_concat({_list(_GENERIC)}, {_TOK('vendor')})"


def rescore_sql(live: bool) -> str:
    """Score and trail with the ratio itself."""
    foreign, absent = (_MINUS(_MINUS(x, _QUIET), _NUM(of)) for x, of in (("extra", "cand"), ("missing", "wanted")))
    q4 = _RESCORE["r4"]
    assert _SEQ in q4
    two = lambda c: f"array_to_string(list_sort({c})[1:2], ',')"
    pct = lambda c: f"floor({c} * 100 + 0.5::DOUBLE)::BIGINT || '%)'"
    usd = lambda sep: f"'$' || floor(cp + 0.5::DOUBLE)::BIGINT || '{sep}$' || floor(price + 0.5::DOUBLE)::BIGINT || ')'"
    names = f"' -foreign_product(' || {two('fw')} || ')'"
    steps = [("ok AND asym", "-15", "' -asymmetric_height'"), ("ok AND collab", "-25", "' -collab_mismatch'"), ("ok AND demo", "-15", "' -demographic_mismatch'"), ("ok AND yc", "-5", "' -year_mismatch'")]
    if live:
        steps += [("ok AND alien AND near", "-40", f"' -near_homonym(' || {two('fw')} || 'vs' || {two('aw')} || ')'"), ("ok AND alien AND NOT near", "-35", names)]
    else:
        steps += [("ok AND alien", "-20", names)]
    steps += [
        ("ok AND crit", "-30", "' -critical_mismatch(type/model)'"), ("strong", "floor(20 * ov)::INT + CASE WHEN inurl > 0.5 THEN 5 ELSE 0 END", f"' +title_match(' || {pct('ov')}"),
        ("weak", "-25", f"' -title_mismatch(' || {pct('seq')}"), ("meek", "-10", f"' -title_weak(' || {pct('seq')}"),
        ("gap <= 0.2::DOUBLE", "10", f"' +price_match(' || {usd('≈')}"), ("gap > 0.5::DOUBLE", "-15", f"' -price_mismatch(' || {usd('vs')}"),
    ]
    score = "score"
    for when, delta, _ in steps:
        score = f"greatest(0, least(100, {score} + CASE WHEN {when} THEN {delta} ELSE 0 END))"
    trail = " || ".join(f"CASE WHEN {when} THEN {label} ELSE '' END" for when, _, label in steps)
    words = " UNION ALL SELECT f, unnest(aw) FROM (SELECT unnest(fw) AS f, aw FROM q4 WHERE ok AND alien)" if live else ""
    ctes = {k: v for k, v in _RESCORE.items() if k in _URL or k in ("r1", "r2", "r3")} | {
        "q4": q4.replace(_SEQ, f"{foreign} AS fw, {absent} AS aw"),
        **ratio_ctes(f"SELECT wanted AS a, cand AS b FROM q4 WHERE ok AND NOT crit AND ov < 0.6{' AND NOT alien' if live else ''}{words}"),
        "near_": "SELECT product_id, ord, bool_or(f <> m AND q >= 0.55) AS near FROM (SELECT product_id, ord, f, unnest(aw) AS m FROM (SELECT product_id, ord, unnest(fw) AS f, aw FROM q4 WHERE ok AND alien)) JOIN rr_ ON a = f AND b = m GROUP BY 1, 2",
        "q5": f"""SELECT q4.*, coalesce(q, 0.0::DOUBLE) AS seq, {'coalesce(near, false)' if live else 'false'} AS near, CASE WHEN cp > 0 AND price > 0 THEN abs(cp - price) / price END AS gap,
            ok AND NOT crit {'AND NOT alien' if live else ''} AS open FROM q4 LEFT JOIN rr_ ON a = wanted AND b = cand {'LEFT JOIN near_ ON near_.product_id = q4.product_id AND near_.ord = q4.ord' if live else ''}""",
        "q6": "SELECT *, open AND (ov >= 0.6 OR seq >= 0.5) AS strong FROM q5",
        "q7": "SELECT *, open AND NOT strong AND ov < 0.2 AND seq < 0.3 AS weak FROM q6",
        "q8": "SELECT *, open AND NOT strong AND NOT weak AND ov < 0.3 AS meek FROM q7",
    }
    return recursive(with_tables(f"SELECT product_id, ord, url, {score} AS confidence, 'base=' || score || {trail} AS reasoning FROM q8", ctes))


_DECISIONS = f"""SELECT product_id, attempt, url, outcome, coalesce(page_title, '') AS title_extracted, {r('CASE WHEN page_title IS NULL THEN 0 ELSE word_overlap END', 6)} AS word_overlap,
        {r('sp', 6)} AS sig_price, {r('sc', 6)} AS sig_color, {r('conf', 4)} AS match_confidence FROM d8 WHERE okat IS NULL OR attempt <= okat"""


def decisions_sql(k: int | None) -> str:
    """Decisions with the ratio itself."""
    sim, named = _LEV.format(a="lower(page_title)", b="lower(catalog_title)"), _LEV.format(a="lower(product_name)", b="lower(catalog_title)")
    gate, signals = gate_sql("(SELECT d2.*, q FROM d2 LEFT JOIN rr_ ON a = lower(page_title) AND b = lower(catalog_title))"), _DECIDE["d4"]
    assert sim in gate and named in signals
    ctes = _DECIDE | {
        "d2": _DECIDE["d2"] if k else _DECIDE["d2"].replace(" WHERE attempt <= 3", ""),
        **ratio_ctes("SELECT lower(page_title) AS a, lower(catalog_title) AS b FROM d2 UNION ALL SELECT lower(product_name), lower(catalog_title) FROM d2 WHERE product_name <> ''"),
        "d3": gate.replace(sim, "q"),
        "d4": signals.replace(named, "q2").replace(" FROM d3", " FROM (SELECT d3.*, r2.q AS q2 FROM d3 LEFT JOIN rr_ r2 ON r2.a = lower(product_name) AND r2.b = lower(catalog_title))"),
    }
    return recursive(with_tables(_DECISIONS, ctes))


ORACLES = {
    "rescore": rescore_sql(False),
    "rescore_live": rescore_sql(True),
    "url_structure_score": with_tables("SELECT product_id, ord, url, score FROM u4", _URL),
    "rescore_edit": with_tables(f"SELECT product_id, ord, score AS url_score, {r('ov', 6)} AS overlap, c7::BIGINT AS confidence FROM r11", _RESCORE),
    "search_hit_scores": with_tables("SELECT product_id, ord, confidence FROM hits", _HITS),
    "candidate_top": with_tables("""SELECT product_id, url, confidence, pos FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, ord) AS pos FROM uniq_url) WHERE pos <= 3""", _HITS),
    "candidate_select": with_tables("""SELECT product_id, coalesce(url, '') AS selected_url, coalesce(confidence, -1) AS selected_confidence, dead_before,
          CASE WHEN confidence < 70 THEN 'LOW_MATCH_CONFIDENCE' WHEN confidence < 85 THEN 'MODERATE_MATCH_CONFIDENCE' ELSE '' END AS warning
        FROM (SELECT product_id, min(pos) FILTER (live) AS at_, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, ord) AS pos FROM uniq_url) GROUP BY 1) g
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, ord) AS pos FROM uniq_url) p USING (product_id)
        CROSS JOIN LATERAL (SELECT coalesce(g.at_ - 1, g.n) AS dead_before) WHERE p.pos = g.at_ OR (g.at_ IS NULL AND p.pos = 1)""", _HITS),
    "title_gate_edit": with_tables(f"""SELECT conv_id, turn, {r('title_similarity', 6)} AS title_similarity, {r('word_overlap', 6)} AS word_overlap,
        CASE WHEN len(dp) > 0 AND len(dc) > 0 THEN list_has_any(dp, dc)::BIGINT ELSE -1 END AS demographic,
        NOT (len(dp) > 0 AND len(dc) > 0 AND NOT list_has_any(dp, dc)) AND NOT (gated.title_similarity < 0.4 AND gated.word_overlap < 0.3) AS passed FROM gated""", _GATE),
    "candidate_decisions_edit": with_tables(_DECISIONS, _DECIDE),
    "candidate_decisions_ratio": decisions_sql(3),
    "candidate_decisions_all": decisions_sql(None),
    "season_flags": with_tables(f"""SELECT product_id, {r('co', 3)} AS color_overlap, uy::VARCHAR AS year_hints,
        concat_ws(',', CASE WHEN low THEN 'LOW_COLOR_OVERLAP' END, CASE WHEN mis THEN 'URL_YEAR_MISMATCH' END, CASE WHEN newer THEN 'POSSIBLE_NEWER_MODEL' END) AS flags,
        CASE WHEN NOT low AND NOT mis AND NOT newer THEN 'No season mismatch signals detected.'
          WHEN low AND mis THEN 'Low color overlap AND URL year mismatch: likely a different season. Review before using vendor data.'
          WHEN low THEN 'Low non-neutral color overlap with vendor page. May indicate a different season or colorway refresh.'
          WHEN newer THEN 'Vendor page appears to show a newer model year than catalog.' ELSE 'URL contains a year that doesn''t match catalog tags.' END AS note FROM sf_""", _SEASON),
    "catalog_title_match": with_tables(f"SELECT jl.domain, product_id, other_id, {r('score', 6)} AS score FROM jl JOIN jb ON jl.domain = jb.domain AND jl.a = jb.a", _JOIN),
}
