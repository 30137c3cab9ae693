"""Queries over taxonomy, feed, images, colours and policy, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchgrid.bind import PAGE_COLORS, Tables
from merchgrid.functions import colors as FC
from merchgrid.functions.common import half_up
from merchgrid.operators import audit as A
from merchgrid.operators import colors as C
from merchgrid.operators import feed as D
from merchgrid.operators import images as M
from merchgrid.operators import policy as P
from merchgrid.operators import taxonomy as T
from merchgrid.operators import variant_order as V
from merchgrid.plans.sql import r, with_tables
from merchgrid.rules import catalog as rules
from merchgrid.rules import colors as crules


def taxonomy_assign(spark, sf):
    return T.assign_taxonomy(Tables(spark, sf).products())


def update_queue_diff(spark, sf):
    return T.update_queue(T.assign_taxonomy(Tables(spark, sf).products()))


def tagger_infer(spark, sf):
    out = T.infer_tags(Tables(spark, sf).products())
    return out.withColumn("new_tags", F.array_join("new_tags", ", "))


def _feed(spark, sf):
    t = Tables(spark, sf)
    return D.shopping_feed(t.products(), t.variants())


def shopping_feed(spark, sf):
    return _feed(spark, sf)


def feed_coverage(spark, sf):
    return D.feed_coverage(_feed(spark, sf))


def category_buckets(spark, sf):
    return D.category_buckets(_feed(spark, sf))


def price_tier_hist(spark, sf):
    return _feed(spark, sf).groupBy("price_tier", "season").agg(F.count(F.lit(1)).alias("variants"))


def weight_sheet(spark, sf):
    t = Tables(spark, sf)
    return D.weight_sheet(t.products(), t.variants()).select("variant_id", "product_type", F.col("grams").cast("bigint").alias("grams"))


def weight_counts(spark, sf):
    t = Tables(spark, sf)
    return D.weight_counts(D.weight_sheet(t.products(), t.variants()))


def bulky_audit(spark, sf):
    t = Tables(spark, sf)
    return D.bulky_audit(t.products(), t.variants()).select(
        "handle", "title", "vendor", "product_type", "sku", F.col("suggested_g").cast("bigint").alias("suggested_g"), half_up(F.col("price"), 2).alias("price"))


def alt_text(spark, sf):
    t = Tables(spark, sf)
    return D.alt_text_rows(t.products(), t.variants())


def feed_exclusions(spark, sf):
    return D.feed_exclusions(Tables(spark, sf).products(), rules.HOUSE_VENDORS, ["ring", "used"], "brand#1%").select("product_id", "handle", "vendor")


def metafield_batches(spark, sf):
    fields = {"category": "google_product_category", "gender": "gender", "age_group": "age_group"}
    return D.metafield_rows(_feed(spark, sf), fields)


def image_propagation(spark, sf):
    t = Tables(spark, sf)
    return M.propagate_images(t.products(), t.variants(), t.catalog_items()).withColumn("source_id", F.coalesce("source_id", F.lit(0)))


def image_sources(spark, sf):
    t = Tables(spark, sf)
    return M.source_counts(M.propagate_images(t.products(), t.variants(), t.catalog_items()))


def variant_order_check(spark, sf):
    return V.order_check(Tables(spark, sf).variants())


def variant_order_rows(spark, sf):
    return V.order_rows(Tables(spark, sf).variants())


def color_family(spark, sf):
    t = Tables(spark, sf)
    names = t.variants().select("product_id", F.col("option1_value").alias("color")).distinct()
    first = t.handles().select("product_id", F.element_at(F.split("title", " "), 1).alias("color"))
    both = names.unionByName(first).distinct()
    return both.select("product_id", "color", F.coalesce(FC.family(F.col("color")), F.lit("")).alias("family"))


def color_terms(spark, sf):
    v = Tables(spark, sf).variants().groupBy("option1_value").agg(F.count(F.lit(1)).alias("variants"))
    return v.select(F.col("option1_value").alias("color"), FC.normalize(F.col("option1_value")).alias("normalized"),
                    FC.query_term(F.col("option1_value")).alias("term"), "variants")


def color_match(spark, sf):
    t = Tables(spark, sf)
    return C.match_colors(t.variants().select("product_id", F.col("option1_value").alias("color")), t.page_colors())


def color_family_vote(spark, sf):
    t = Tables(spark, sf)
    return C.family_votes(C.color_groups(t.variants()), t.color_labels())


def image_assign(spark, sf):
    t = Tables(spark, sf)
    return C.assign_images(t.image_queue(), t.color_options())


def gtin_quality(spark, sf):
    t = Tables(spark, sf)
    return P.gtin_quality(t.variants(), t.products())


def policy_terms(spark, sf):
    d = Tables(spark, sf).raw("documents")
    hits = d.select("doc_id", F.explode(P.prohibited_terms(F.col("text"))).alias("term"))
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def title_policy(spark, sf):
    t = Tables(spark, sf)
    heads = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    return heads.select("doc_id", F.col("line").cast("bigint").alias("line"), F.array_join(P.title_violations(F.col("title")), "; ").alias("violations")).where("violations <> ''")


def required_attributes(spark, sf):
    t = Tables(spark, sf)
    first = A.variant_stats(t.variants()).select("product_id", "price", F.when(F.col("any_image"), "x").otherwise("").alias("image"))
    p = t.products().select("product_id", "title", "body_html").join(first, "product_id", "left")
    return p.select("product_id", F.array_join(P.missing_attributes(p), "; ").alias("missing")).where("missing <> ''")


QUERIES = {f.__name__: f for f in (
    taxonomy_assign, update_queue_diff, tagger_infer, shopping_feed, feed_coverage, category_buckets, price_tier_hist, weight_sheet, weight_counts,
    bulky_audit, alt_text, feed_exclusions, metafield_batches, image_propagation, image_sources, variant_order_check, variant_order_rows,
    color_family, color_terms, color_match, color_family_vote, image_assign, gtin_quality, policy_terms, title_policy, required_attributes,
)}

# ---------------------------------------------------------------- oracles


def values(table: dict, *cols: str) -> str:
    rows = ", ".join("('" + str(k).replace("'", "''") + "', " + (f"'{v}'" if isinstance(v, str) else repr(v)) + ")" for k, v in table.items())
    return f"SELECT * FROM (VALUES {rows}) t({', '.join(cols)})"


_TITLE_RULES = "CASE " + " ".join(f"WHEN regexp_matches(lower(vendor || ' ' || title), '{p}') THEN '{t}'" for p, t in rules.TITLE_TYPE_RULES) + " END"
_ACT = "CASE new_type " + " ".join(f"WHEN '{t}' THEN '{', '.join(tags)}'" for t, tags in rules.ACTIVITY_FROM_TYPE.items()) + " END"
_FEAT = ", ".join(
    f"CASE WHEN regexp_matches(lower(title), '{p}')" + (f" AND new_type IN {tuple(rules.CONTEXT_TYPES)}" if t in rules.CONTEXT_TAGS else "") + f" THEN '{t}' END"
    for p, t in rules.FEATURE_RULES
)
_TAX = {
    "old_types": values(rules.OLD_TYPE_TO_TYPE, "k", "v"), "leaf_types": values(rules.CATEGORY_LEAF_TO_TYPE, "k", "v"),
    "vendor_types": values(rules.VENDOR_TO_TYPE, "k", "v"), "groups_": values(rules.TYPE_TO_GROUP, "k", "v"),
    "typed": f"""SELECT p.*, coalesce(CASE WHEN product_type <> '' THEN coalesce(o.v, product_type) END, l.v, w.v, {_TITLE_RULES}, '') AS new_type
      FROM products p LEFT JOIN old_types o ON o.k = product_type LEFT JOIN leaf_types l ON l.k = lower(string_split(category, ' > ')[-1])
        LEFT JOIN vendor_types w ON w.k = vendor WHERE vendor NOT IN ('Brand#25', 'Brand#24')""",
    "tagged": f"""SELECT handle, title, vendor, product_type AS current_type, tags AS current_tags, category, new_type,
        concat_ws(', ', CASE WHEN contains(lower(category), 'forge') THEN 'activity:forging' WHEN contains(lower(category), 'bars') THEN 'activity:machining'
            WHEN contains(lower(category), 'fasteners') THEN 'activity:assembly' ELSE {_ACT} END,
          CASE WHEN new_type IN ('Widget', 'Gizmo') THEN CASE gender WHEN 'female' THEN 'gender:womens' ELSE 'gender:mens' END END,
          CASE WHEN new_type IN ('Heated Part', 'Anvil') THEN 'season:winter' WHEN new_type = 'Ring' THEN 'season:summer' END, {_FEAT}, g.v) AS new_tags
      FROM typed LEFT JOIN groups_ g ON g.k = new_type""",
    "merged": """SELECT *, array_to_string(list_concat(cur, [x FOR x IN new IF NOT list_contains(cur, x)]), ', ') AS all_tags
      FROM (SELECT *, CASE WHEN current_tags = '' THEN []::VARCHAR[] ELSE string_split(current_tags, ', ') END AS cur, string_split(new_tags, ', ') AS new FROM tagged)""",
}

_UNITS = D.UNITS
_FEED = {
    "cats": values(rules.TYPE_TO_CATEGORY, "product_type", "category"),
    "phrases": values(rules.TYPE_PHRASES, "product_type", "phrase"),
    "firsts": "SELECT product_id, arg_min(variant_id, position) AS first_id FROM variants GROUP BY 1",
    "kept_feed": "SELECT * FROM products WHERE status = 'active' AND vendor NOT IN ('Brand#25', 'Brand#24')",
    "ptext": f"""SELECT k.product_id, handle, vendor, k.product_type, tags, title, coalesce(c.category, '') AS category,
        CASE WHEN contains(tags, 'gender:womens') THEN 'female' WHEN contains(tags, 'gender:mens') THEN 'male' ELSE '' END AS gender,
        CASE WHEN contains(tags, 'season:winter') THEN 'fall-winter' ELSE 'year-round' END AS season, phrase,
        trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body_html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'),
          '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS body,
        vendor || ' ' || title AS head FROM kept_feed k LEFT JOIN cats c USING (product_type) LEFT JOIN phrases USING (product_type)""",
    "pseo": f"""SELECT *, CASE WHEN length(head) + {len(rules.STORE_NAME) + 3} <= 60 THEN head ELSE rtrim(left(head, {60 - len(rules.STORE_NAME) - 3})) END || ' | {rules.STORE_NAME}' AS st,
        CASE WHEN body <> '' THEN CASE WHEN length(body) > 155 THEN rtrim(left(body, 155)) || '...' ELSE body END
          ELSE 'Shop the ' || vendor || ' ' || title || ' at {rules.STORE_NAME} in {rules.STORE_PLACE}.' || coalesce(' ' || phrase || '.', '') || ' Free in-store pickup available.' END AS sd
      FROM ptext""",
    "vsize": f"""SELECT product_id, variant_id, price, CASE WHEN lower(option1_name) IN ('color', 'style') THEN option1_value ELSE '' END AS color,
        CASE WHEN lower(option1_name) IN ('color', 'style') AND NOT regexp_matches(option2_value, '^\\d+(\\.\\d+)?\\s*({_UNITS})\\b|^\\d+\\s*/\\s*\\d+\\s*(oz|g)') THEN option2_value ELSE '' END AS size FROM variants""",
    "feed": """SELECT p.product_id, variant_id, handle, 'MERGE' AS command, category, gender, 'adult' AS age_group, 'new' AS condition, color, size,
        CASE WHEN size = '' THEN '' WHEN vendor IN ('Brand#9', 'Brand#12') THEN 'EU' WHEN product_type = 'Ring' AND try_cast(size AS DOUBLE) BETWEEN 20 AND 33 THEN '' ELSE 'US' END AS size_system,
        season, CASE WHEN price < 50 THEN 'under-50' WHEN price < 100 THEN '50-100' WHEN price < 200 THEN '100-200' ELSE 'over-200' END AS price_tier, 'general' AS activity,
        CASE WHEN variant_id = first_id THEN st ELSE '' END AS seo_title, CASE WHEN variant_id = first_id THEN sd ELSE '' END AS seo_description
      FROM vsize JOIN pseo p USING (product_id) JOIN firsts USING (product_id)""",
    "type_g": "SELECT * FROM (VALUES ('Bolt', 113), ('Ring', 227), ('Gear', 907), ('Rod', 1588), ('Plate', 1814), ('Widget', 454), ('Anvil', 2268)) e(product_type, grams)",
}

_IMG = {
    "barcodes": "SELECT barcode, min(image_url) AS catalog_image FROM catalog_items WHERE barcode <> '' AND image_url NOT LIKE '%swatch.example%' GROUP BY 1",
    "styles": "SELECT vendor, style, color, min(image_url) AS style_image FROM catalog_items WHERE style <> '' GROUP BY 1, 2, 3",
    "vv": """SELECT v.*, bool_or(option1_name = 'Color') OVER (PARTITION BY v.product_id) AS has_color, catalog_image FROM variants v LEFT JOIN barcodes USING (barcode)""",
    "gg": """SELECT product_id, option1_value AS color, arg_min(image_src, position) FILTER (image_src <> '') AS own, arg_min(variant_id, position) FILTER (image_src <> '') AS own_id,
        arg_min(catalog_image, position) FILTER (catalog_image IS NOT NULL) AS group_catalog FROM vv WHERE has_color GROUP BY 1, 2""",
    "assigned": """SELECT variant_id, product_id, handle,
        coalesce(CASE WHEN has_color THEN coalesce(own, group_catalog, style_image) ELSE catalog_image END, '') AS image_url,
        CASE WHEN has_color AND own IS NOT NULL THEN 'propagation' WHEN has_color AND group_catalog IS NOT NULL THEN 'catalog_barcode'
             WHEN has_color AND style_image IS NOT NULL THEN 'catalog_style_color' WHEN NOT has_color AND catalog_image IS NOT NULL THEN 'catalog_barcode' ELSE 'missing' END AS source,
        CASE WHEN has_color AND own IS NOT NULL THEN own_id ELSE 0 END AS source_id
      FROM vv JOIN products p USING (product_id) LEFT JOIN gg ON gg.product_id = vv.product_id AND gg.color = option1_value
        LEFT JOIN styles s ON s.vendor = p.vendor AND s.style = p.style AND s.color = option1_value
      WHERE image_src = '' AND status = 'active'""",
}

_RANKS = values(V.SIZE_RANK, "k", "v")
_ORDER = {
    "size_rank": _RANKS,
    "vo": """SELECT *, count(*) OVER (PARTITION BY product_id) AS n, bool_or(option1_name = 'Color') OVER (PARTITION BY product_id) AS has_color,
        option1_value || ' / ' || option2_value AS label FROM variants""",
    "vk": """SELECT vo.*, CASE WHEN has_color THEN option1_value ELSE '' END AS block, lower(CASE WHEN has_color THEN option2_value ELSE label END) AS sz
      FROM vo WHERE n > 1""",
    "vs": """SELECT vk.*, CASE WHEN v IS NOT NULL THEN 0 WHEN try_cast(sz AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END AS cls,
        coalesce(v, try_cast(sz AS DOUBLE), 0.0::DOUBLE) AS num, CASE WHEN v IS NULL AND try_cast(sz AS DOUBLE) IS NULL THEN sz ELSE '' END AS txt,
        min(position) OVER (PARTITION BY product_id, block) AS start FROM vk LEFT JOIN size_rank ON k = sz""",
    "placed_": """SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY position) AS actual_place,
        row_number() OVER (PARTITION BY product_id ORDER BY start, cls, num, txt, position) AS expected_place FROM vs""",
    "verdicts": "SELECT product_id, CASE WHEN bool_or(actual_place <> expected_place) THEN 'violation' ELSE 'sorted' END AS verdict FROM placed_ GROUP BY 1",
}

_CREATIVE = values(crules.CREATIVE_NAMES, "k", "v")
_FAMILY = "CASE " + " ".join(f"WHEN low = '{f.lower()}' THEN '{f}'" for f in crules.FAMILIES) + " END"
_INSIDE = "CASE " + " ".join(f"WHEN contains(low, '{f.lower()}') THEN '{f}'" for f in crules.FAMILY_PRIORITY) + " END"
_FAM = {
    "creative": _CREATIVE,
    "names_": "SELECT product_id, option1_value AS color FROM variants UNION SELECT product_id, split_part(title, ' ', 1) FROM handles",
    "uniq": "SELECT DISTINCT color, lower(color) AS low FROM names_",
    "words_": """SELECT color, arg_min(v, i) AS word_family FROM (SELECT color, unnest(string_split(replace(low, '-', ' '), ' ')) AS w,
        generate_subscripts(string_split(replace(low, '-', ' '), ' '), 1) AS i FROM uniq) JOIN creative ON k = w GROUP BY 1""",
    "families_": f"""SELECT u.color, coalesce(CASE WHEN regexp_matches(u.color, '[^/ ] */ *[^/ ]') THEN 'Multi' END, {_FAMILY}, c.v, {_INSIDE}, word_family, '') AS family
      FROM uniq u LEFT JOIN creative c ON c.k = low LEFT JOIN words_ w ON w.color = u.color""",
}

_NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\s*[/|]\\s*', ' ', 'g'), '\\s+-\\s+', ' ', 'g'), '\\bw/', 'w ', 'g'), '\\s+', ' ', 'g')))"
_MATCH = {
    "page_colors": f"""SELECT p_partkey AS product_id, i AS ord, {PAGE_COLORS!r}[i + 1] AS candidate FROM part, range({len(PAGE_COLORS)}) t(i) WHERE (p_partkey + i) % 3 <> 0""",
    "tc": f"SELECT DISTINCT product_id, option1_value AS color, {_NORM.format(c='option1_value')} AS norm FROM variants",
    "cc": f"SELECT product_id, candidate, ord, {_NORM.format(c='candidate')} AS cnorm FROM page_colors",
    "pairs": """SELECT tc.product_id, color, candidate, ord, CASE WHEN color = candidate THEN 1 WHEN norm = cnorm THEN 2
        WHEN length(norm) <= length(cnorm) AND contains(cnorm, norm) AND length(norm) * 2 > length(cnorm) THEN 3
        WHEN length(norm) > length(cnorm) AND contains(norm, cnorm) AND length(cnorm) * 2 > length(norm) THEN 3 END AS tier
      FROM tc JOIN cc ON tc.product_id = cc.product_id""",
}

_VOTE = {
    "imgs": "SELECT DISTINCT product_id, option1_value AS color, split_part(image_src, '?', 1) AS image_url FROM variants WHERE image_src <> '' AND option1_value <> ''",
    "labs": """SELECT DISTINCT product_id, option1_value AS color, split_part(image_src, '?', 1) AS image_url, ['Red', 'Navy', 'Black'][(position % 3)::INT + 1] AS label
        FROM variants WHERE image_src <> '' AND product_id % 3 = 0""",
    "votes_": """SELECT product_id, color, label, row_number() OVER (PARTITION BY product_id, color ORDER BY count(*) DESC, label) AS rn
        FROM imgs JOIN labs USING (product_id, color, image_url) GROUP BY 1, 2, 3""",
}

_DIGITS = " + ".join(f"substr(pad, {i}, 1)::INT * {3 if i % 2 else 1}" for i in range(1, 14))


def _unicode_words(p: str) -> str:
    """RE2's word boundary is ASCII; spell the Unicode one out."""
    p = p.replace("\\b#", "[\\p{L}\\p{N}_]#")
    p = "(^|[^\\p{L}\\p{N}_])" + p[2:] if p.startswith("\\b") else p
    return p[:-2] + "($|[^\\p{L}\\p{N}_])" if p.endswith("\\b") else p


_PROHIB = " UNION ALL ".join(
    f"SELECT doc_id, '{m.replace(chr(39), chr(39) * 2)}' AS term FROM documents WHERE regexp_matches(text, '(?i){_unicode_words(p)}')" for p, m in P.PROHIBITED
)

# Sequential rule: labels first, then each free description in image order takes the best open colour.
_NOISE = "['and', 'with', 'the', 'a', 'an', 'dark', 'light', 'bright', 'deep', 'pale', 'matte', 'product', 'is', 'color', 'colored']"
_ASSIGN = {
    "queue_": """SELECT product_id, position::BIGINT AS ord, image_src AS url, CASE WHEN (product_id + position) % 3 = 0 THEN option1_value END AS label,
        ['deep red', 'blue and navy', 'black polarized', 'bright green forest', 'grey', 'a product'][((product_id + position * 5) % 6)::INT + 1] AS description FROM variants WHERE image_src <> ''""",
    "choices_": "SELECT product_id, option1_value AS option, min(position)::BIGINT AS ord FROM variants GROUP BY 1, 2",
    "labelled_": "SELECT q.product_id, option, arg_min(url, q.ord) AS url FROM queue_ q JOIN choices_ c ON q.product_id = c.product_id AND label = option GROUP BY 1, 2",
    "pool_": f"""SELECT product_id, list({{'option': option, 'words': list_filter(regexp_split_to_array(lower(trim(regexp_replace(option, '[/-]', ' ', 'g'))), '\\s+'), lambda w: NOT list_contains({_NOISE}, w))}}
        ORDER BY ord, option) AS pool FROM choices_ c WHERE NOT EXISTS (FROM labelled_ l WHERE l.product_id = c.product_id AND l.option = c.option) GROUP BY 1""",
    "free_": f"""SELECT product_id, url, row_number() OVER (PARTITION BY product_id ORDER BY ord, url) AS nth,
        list_distinct(list_filter(list_transform(regexp_split_to_array(lower(trim(description)), '\\s+'), lambda w: trim(w, ',.')), lambda w: NOT list_contains({_NOISE}, w))) AS words
        FROM queue_ WHERE label IS NULL AND description IS NOT NULL""",
    "walk_": """SELECT product_id, 0::BIGINT AS nth, pool, NULL::VARCHAR AS option, NULL::VARCHAR AS url FROM pool_
      UNION ALL SELECT product_id, nth, list_filter(pool, lambda o: best IS NULL OR o.option <> best), best, url FROM (
        SELECT product_id, nth, pool, url, CASE WHEN b.n >= 1 AND (b.n >= CASE WHEN len(words) >= 2 THEN 2 ELSE 1 END OR b.dominant) THEN b.option END AS best FROM (
          SELECT w.product_id, f.nth, w.pool, f.url, f.words, list_max(list_transform(w.pool, lambda o, i: {'n': len(list_intersect(f.words, o.words)), 'rank': -i, 'option': o.option,
            'dominant': coalesce(list_contains(f.words, o.words[1]), false)})) AS b
          FROM walk_ w JOIN free_ f ON f.product_id = w.product_id AND f.nth = w.nth + 1))""",
}

ORACLES = {
    "image_assign": with_tables("""SELECT product_id, option, url, 'label' AS via FROM labelled_
        UNION ALL SELECT product_id, option, url, 'description' FROM walk_ WHERE option IS NOT NULL""", _ASSIGN).replace("WITH ", "WITH RECURSIVE ", 1),
    "taxonomy_assign": with_tables("SELECT * FROM tagged", _TAX),
    "update_queue_diff": with_tables("""SELECT handle, 'product_type' AS field, current_type AS old_value, new_type AS new_value, 'taxonomy_map' AS source, 'pending' AS status
        FROM merged WHERE new_type <> '' AND new_type <> current_type
        UNION ALL SELECT handle, 'tags', current_tags, all_tags, 'taxonomy_map', 'pending' FROM merged WHERE new_tags <> '' AND all_tags <> current_tags""", _TAX),
    "tagger_infer": with_tables("""SELECT product_id, CASE WHEN regexp_matches(b, '\\bring\\b') AND NOT regexp_matches(b, '\\bring\\s+binder') THEN 'Ring'
          WHEN regexp_matches(b, '\\bhot\\s+rod\\b') THEN 'Heated Part' WHEN regexp_matches(b, '\\brod\\b') THEN 'Bar Stock' WHEN regexp_matches(b, '\\bbolts?\\b') THEN 'Fastener'
          WHEN regexp_matches(b, '\\bplate\\b') THEN 'Sheet Stock' WHEN regexp_matches(b, '\\bgear\\b') THEN 'Gear' WHEN regexp_matches(b, '\\banvil\\b') THEN 'Anvil'
          WHEN regexp_matches(b, '\\bwidget\\b') THEN 'Widget' ELSE '' END AS inferred_type,
        concat_ws(', ', CASE WHEN regexp_matches(b, '\\bwomen''?s\\b|\\bladies\\b') AND NOT contains(tags, 'gender:womens') THEN 'gender:womens' END,
          CASE WHEN regexp_matches(b, '\\bmen''?s\\b') AND NOT contains(tags, 'gender:mens') THEN 'gender:mens' END,
          CASE WHEN regexp_matches(b, '\\bkids?\\b|\\byouth\\b') THEN 'gender:kids' END, CASE WHEN regexp_matches(b, '\\banvil\\b|\\bhot\\b') THEN 'activity:forging' END,
          CASE WHEN regexp_matches(b, '\\bcold\\b') THEN 'activity:cooling' END, CASE WHEN regexp_matches(b, '\\bbolts?\\b|\\bring\\b') THEN 'activity:assembly' END) AS new_tags
        FROM (SELECT *, lower(title || ' ' || body_html) AS b FROM products)"""),
    "shopping_feed": with_tables("SELECT * FROM feed", _FEED),
    "feed_coverage": with_tables("""SELECT count(*) AS total_variants, count(DISTINCT handle) AS total_products, count(*) FILTER (category <> '') AS has_category,
        count(*) FILTER (gender <> '') AS has_gender, count(*) FILTER (age_group <> '') AS has_age_group, count(*) FILTER (color <> '') AS has_color,
        count(*) FILTER (size <> '') AS has_size, count(*) FILTER (seo_title <> '') AS has_seo_title, count(*) FILTER (seo_description <> '') AS has_seo_description FROM feed""", _FEED),
    "category_buckets": with_tables("SELECT string_split(category, ' > ')[1] AS bucket, count(*) AS variants FROM feed WHERE category <> '' GROUP BY 1", _FEED),
    "price_tier_hist": with_tables("SELECT price_tier, season, count(*) AS variants FROM feed GROUP BY 1, 2", _FEED),
    "weight_sheet": with_tables("SELECT variant_id, product_type, grams::BIGINT AS grams FROM variants v JOIN kept_feed USING (product_id) JOIN type_g USING (product_type)".replace("grams::BIGINT", "type_g.grams::BIGINT"), _FEED),
    "weight_counts": with_tables("SELECT product_type, count(*) AS variants FROM variants JOIN kept_feed USING (product_id) JOIN type_g USING (product_type) GROUP BY 1", _FEED),
    "bulky_audit": with_tables(f"SELECT handle, title, vendor, product_type, sku, type_g.grams::BIGINT AS suggested_g, {r('price', 2)} AS price FROM variants JOIN kept_feed USING (product_id) JOIN type_g USING (product_type) WHERE product_type IN ('Anvil', 'Plate', 'Rod')", _FEED),
    "alt_text": with_tables("""SELECT product_id, handle, image_src, vendor || ' ' || title || CASE WHEN n IN ('Color') THEN ' - ' || o ELSE '' END AS alt FROM
        (SELECT product_id, image_src, arg_min(option1_name, (option1_value, position)) AS n, min(option1_value) AS o FROM variants WHERE image_src <> '' GROUP BY 1, 2)
        JOIN kept_feed USING (product_id)""", _FEED),
    "feed_exclusions": with_tables("""SELECT product_id, handle, vendor FROM products WHERE status = 'active' AND (vendor IN ('Brand#25', 'Brand#24')
        OR (contains(lower(title), 'rental') AND NOT contains(lower(title), 'sale') AND lower(vendor) NOT LIKE 'brand#1%') OR lower(product_type) IN ('ring', 'used'))"""),
    "metafield_batches": with_tables("""SELECT product_id, namespace, key, value, ceil(row_number() OVER (ORDER BY product_id, namespace, key, value) / 25.0)::BIGINT AS batch_id
        FROM (SELECT DISTINCT product_id, namespace, key, CASE key WHEN 'google_product_category' THEN category WHEN 'gender' THEN gender ELSE age_group END AS value
              FROM feed, (VALUES ('google_shopping'), ('mm-google-shopping')) a(namespace), (VALUES ('google_product_category'), ('gender'), ('age_group')) b(key)) WHERE value <> ''""", _FEED),
    "image_propagation": with_tables("SELECT * FROM assigned", _IMG),
    "image_sources": with_tables("SELECT source, count(*) AS variants FROM assigned GROUP BY 1", _IMG),
    "variant_order_check": with_tables("SELECT * FROM verdicts", _ORDER),
    "variant_order_rows": with_tables("SELECT product_id, variant_id, label, actual_place, expected_place FROM placed_ JOIN verdicts USING (product_id) WHERE verdict = 'violation'", _ORDER),
    "color_family": with_tables("SELECT product_id, n.color, family FROM names_ n JOIN families_ f ON f.color = n.color", _FAM),
    "color_terms": with_tables(f"""SELECT color, {_NORM.format(c='color')} AS normalized, coalesce(CASE WHEN nw = 1 THEN plain END, array_to_string(ws, ' ')) AS term, variants
        FROM (SELECT *, len(ws) AS nw FROM (SELECT option1_value AS color, count(*) AS variants, list_filter(regexp_split_to_array(lower(replace(option1_value, '/', ' ')), '\\s+'),
          lambda w: w <> '' AND w NOT IN ({", ".join(f"'{m}'" for m in crules.MODIFIERS)})) AS ws FROM variants GROUP BY 1))
        LEFT JOIN ({values(crules.PLAIN_NAMES, "k", "plain")}) ON k = ws[1]"""),
    "color_match": with_tables("""SELECT product_id, color, candidate AS matched, tier FROM (SELECT *, row_number() OVER (PARTITION BY product_id, color ORDER BY tier, ord) AS rn
        FROM pairs WHERE tier IS NOT NULL) WHERE rn = 1""", _MATCH),
    "color_family_vote": with_tables("""SELECT product_id, color, images, coalesce(label, family) AS family,
        CASE WHEN label IS NOT NULL THEN 'vision' WHEN family <> '' THEN 'text' ELSE 'unknown' END AS source, images > 1 AS anomaly
        FROM (SELECT product_id, color, count(*) AS images FROM imgs GROUP BY 1, 2) JOIN families_ USING (color)
        LEFT JOIN (SELECT * FROM votes_ WHERE rn = 1) USING (product_id, color)""", _FAM | _VOTE),
    "gtin_quality": with_tables(f"""SELECT vendor, count(*) AS coded, count(*) FILTER (NOT ok) AS invalid FROM (SELECT product_id,
        regexp_matches(barcode, '^(\\d{{8}}|\\d{{12,14}})$') AND NOT regexp_matches(barcode, '^0+$') AND (10 - ({_DIGITS}) % 10) % 10 = substr(pad, 14, 1)::INT AS ok
        FROM (SELECT product_id, barcode, lpad(barcode, 14, '0') AS pad FROM variants WHERE barcode <> '')) JOIN products USING (product_id) GROUP BY 1"""),
    "policy_terms": f"SELECT term, count(*) AS documents FROM ({_PROHIB}) GROUP BY 1",
    "title_policy": """SELECT doc_id, line, CASE WHEN trim(t) = '' THEN 'Title is empty' ELSE concat_ws('; ', CASE WHEN length(t) > 150 THEN 'Title exceeds 150 characters (' || length(t) || ')' END,
        CASE WHEN t = upper(t) AND length(t) > 10 THEN 'Title is all caps (GMC may flag as spammy)' END,
        CASE WHEN regexp_matches(t, '[!]{2,}|[?]{2,}') THEN 'Title contains excessive punctuation' END) END AS violations
        FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE violations <> ''""",
    "required_attributes": with_tables("""SELECT product_id, concat_ws('; ', CASE WHEN trim(body_html) = '' THEN 'Missing required attribute: Product description' END,
        CASE WHEN NOT coalesce(any_image, false) THEN 'Missing required attribute: Product image' END,
        CASE WHEN coalesce(price, 0) = 0 THEN 'Missing required attribute: Product price' END) AS missing FROM products LEFT JOIN vstats USING (product_id) WHERE missing <> ''"""),
}
