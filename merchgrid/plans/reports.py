"""Queries over store reads, sheets, checks and artifact joins, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions import urls as U
from merchgrid.functions.common import half_up, merged
from merchgrid.functions.similarity import edit_ratio
from merchgrid.operators import audit as A
from merchgrid.operators import feedback as B
from merchgrid.operators import health as H
from merchgrid.operators import images as M
from merchgrid.operators import intake as N
from merchgrid.operators import matching as X
from merchgrid.operators import quality as Q
from merchgrid.operators import review as V
from merchgrid.operators import shipping as S
from merchgrid.operators import weights as W
from merchgrid.plans.catalog import _IMG
from merchgrid.plans.core import _HEALTH, _SHIP, scores
from merchgrid.plans.matching import _URL
from merchgrid.plans.review import _CHANGES, _OPT, _VENDORS
from merchgrid.plans.sql import r, with_tables
from merchgrid.sources import readers, sinks


def store_values(spark, sf):
    p = Tables(spark, sf).products()
    return readers.list_values(p, "vendor").select(F.lit("vendor").alias("kind"), F.col("vendor").alias("value")).unionByName(
        readers.list_values(p, "product_type").select(F.lit("product_type").alias("kind"), F.col("product_type").alias("value")))


def store_lookup(spark, sf):
    """Point lookups by handle: the product that each collection override names."""
    t = Tables(spark, sf)
    wanted = "red-bolt-"
    p = t.products()
    return readers.get_product(p.withColumn("handle", F.regexp_replace("handle", r"\d+$", "")), wanted).select("product_id", "title", "vendor")


def _image_rows(t):
    v = t.variants().where("image_src <> ''")
    return v.select("product_id", F.when(F.col("position") % 2 == 1, F.col("variant_id")).alias("variant_id"), F.col("position").cast("int").alias("position"), F.col("image_src").alias("src"), F.lit(None).cast("string").alias("alt"))


def shaped_products(spark, sf):
    t = Tables(spark, sf)
    bare = t.products().withColumn("vendor", F.when(F.col("product_id") % 5 != 0, F.col("vendor"))).withColumn("tags", F.nullif("tags", F.lit("")))
    s = readers.shape_products(bare, _image_rows(t))
    n = F.coalesce(F.size("images"), F.lit(0))
    return s.select("product_id", "vendor", "tags", F.when(F.col("images").isNull(), 0).otherwise(n).cast("bigint").alias("images"), F.coalesce(F.get("images", F.lit(0))["src"], F.lit("")).alias("first_src"))


def shaped_variants(spark, sf):
    gone = lambda c: F.when(F.col("position") % 4 != 0, F.col(c)).alias(c)
    v = Tables(spark, sf).variants().select("variant_id", "position", gone("sku"), gone("grams"), gone("price"), gone("requires_shipping"), F.when(F.col("position") % 3 == 0, "g").alias("weight_unit"))
    return readers.shape_variants(v).drop("position")


def hero_images(spark, sf):
    return H.hero_images(_image_rows(Tables(spark, sf)))


def health_images(spark, sf):
    """Health verdicts from image labels."""
    t = Tables(spark, sf)
    p, i = t.products(), F.col("product_id")
    v = p.select("product_id", H.image_verdict(
        F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 5 == 0, "no").otherwise("yes"), F.when(i % 3 == 0, "lifestyle").when(i % 4 == 0, "placeholder").otherwise("product"), i % 11 != 0).alias("image_verdict"))
    return H.health_report(p, v).select("product_id", "image_verdict", F.element_at(F.split("notes", "; "), 1).alias("first_note"), (F.col("severity") == "FAIL").alias("fails"))


def ranked_handles(spark, sf):
    w = W.ranked_handles(scores(Tables(spark, sf)))
    return w.select("handle", "product_id", half_up(F.col("priority"), 3).alias("priority"))


def shipping_sheet(spark, sf):
    t = Tables(spark, sf)
    issues = S.shipping_issues(A.active_products(t.products()), t.variants())
    rows = sinks.shipping_rows(S.ordered_issues(issues))
    return rows.select(F.col("Handle").alias("handle"), F.col("Issue Type").alias("issue_type"), F.col("Severity").alias("severity"), F.col("Price").alias("price"))


def bulk_images(spark, sf):
    t = Tables(spark, sf)
    a = M.propagate_images(t.products(), t.variants(), t.catalog_items()).where("image_url <> ''").withColumn("ord", F.col("variant_id"))
    b = sinks.bulk_image_rows(M.merge_marker(a))
    return b.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in b.columns])


def backfill_rows(spark, sf):
    t = Tables(spark, sf)
    d = t.raw("documents").select((F.col("doc_id") * 2).alias("product_id"), F.col("text").alias("description"))
    b = sinks.bulk_description_rows(M.description_backfill(t.products(), d))
    return b.select(F.col("ID").alias("product_id"), F.col("Handle").alias("handle"), F.col("Command").alias("command"), F.length("Body HTML").cast("bigint").alias("chars"))


def url_checks(spark, sf):
    p = Tables(spark, sf).raw("pages")
    return p.select("page_id", U.is_product_url(F.col("url"), F.array(F.lit("/EN/1"), F.lit("/de"))).alias("product"), U.same_domain(F.col("url"), F.lit("www.example.com")).alias("same"))


def extraction_scores(spark, sf):
    f = Tables(spark, sf).facts()
    body = F.concat_ws("\n", "blocks")
    s = X.extraction_score({
        "product_name": F.col("product_name"), "has_json_ld": F.col("ld_description") != "", "n_images": F.col("doc_id") % 3, "n_bullets": F.size("bullets"), "description": F.when(F.col("doc_id") % 8 == 0, F.concat(body, F.lit(" Just sit tight"))).otherwise(body), "n_specs": F.size("specs")})
    return f.select("doc_id", s.alias("score"))


def brand_colors(spark, sf):
    p = N.skip_types(Tables(spark, sf).products(), ["bolt", "gear"])
    c = N.brand_color(p, ["Brand#11", "Brand#12"], ["Brand#13", "Brand#14", "Brand#21"], ["red", "blue", "green"])
    return c.select("product_id", "color")


def prompt_facts(spark, sf):
    p = Q.prompt_facts(Tables(spark, sf).facts().withColumn("specs", F.map_concat("specs", F.create_map(F.lit("Waist size"), F.lit("3")))))
    return p.select("handle", "product_name", F.size("blocks").cast("bigint").alias("blocks"), F.size("bullets").cast("bigint").alias("bullets"), F.size("specs").cast("bigint").alias("specs"))


def clean_descriptions(spark, sf):
    d = Tables(spark, sf).raw("documents")
    rated = F.concat(F.lit("4.5(12)12 total reviews "), F.col("text"), F.lit(" 3.0 out of 5 stars"))
    return d.select("doc_id", F.length(V.clean_description(rated)).cast("bigint").alias("chars"))


def hero_assign(spark, sf):
    t = Tables(spark, sf)
    d = F.col("product_id")
    none = F.array().cast("array<string>")
    o = t.products().select(
        "handle", (d % 3 == 0).alias("has_color"), F.when(d % 4 == 0, none).otherwise(F.array(F.concat(F.lit("h"), d.cast("string")))).alias("images"),
        F.when(d % 5 == 0, F.create_map(F.lit("Red"), F.array(F.col("title"), F.lit("x")))).otherwise(F.create_map().cast("map<string,array<string>>")).alias("image_map"))
    a = M.assign_hero(o)
    return a.select("handle", F.array_join(F.transform(F.map_entries("assignment"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("assignment"), F.coalesce("warning", F.lit("")).alias("warning"))


def cross_check_edit(spark, sf):
    """Catalog warnings, with the edit-distance ratio."""
    t = Tables(spark, sf)
    i = F.col("product_id")
    rows = t.products().select(
        "product_id", (i % 4 != 0).alias("barcode_known"), F.when(i % 3 == 0, F.lit("zzzz qqqq")).when(i % 3 == 1, F.substring("title", 1, 5)).otherwise(F.col("title")).alias("product_name"), F.col("title").alias("catalog_title"),
        (i % 90 + 10).cast("double").alias("scraped_price"), F.lit(40.0).alias("known_price"))
    return X.cross_reference(rows, similarity=edit_ratio).select("product_id", F.array_join("warnings", ",").alias("warnings"))


def _catalog_check(spark, sf, description):
    t = Tables(spark, sf)
    i = F.col("position")
    shop = t.products().select("product_id", "handle", "title")
    rows = t.variants().join(merged(shop), "product_id").select(
        "variant_id", F.col("variant_id").alias("row_id"), F.when(i % 12 == 5, F.concat(F.lit("gone-"), "handle")).otherwise(F.col("handle")).alias("handle"), F.when(i % 10 == 7, F.concat(F.lit("x"), "barcode")).otherwise(F.col("barcode")).alias("barcode"),
        F.when(i % 3 == 0, F.lit("zzzz qqqq")).when(i % 3 == 1, F.substring("title", 1, 5)).otherwise(F.col("title")).alias("product_name"), F.when(i % 5 != 2, F.col("price") * (1 + i % 4)).alias("scraped_price"))
    # dealt out by product at once, so whole texts are not shuffled again to find a product's own
    d = t.scan("documents").select((F.col("doc_id") * 2).alias("product_id"), description.alias("description")).repartition("product_id")
    out = X.catalog_cross_check(rows, t.variants(), t.products(), t.catalog_items(), d, similarity=edit_ratio)
    return out.select("row_id", F.array_join("warnings", "; ").alias("warnings"), F.coalesce("catalog_image", F.lit("")).alias("image"), F.coalesce("catalog_description", F.lit("")).alias("description"))


def catalog_check_text_edit(spark, sf):
    """The whole catalog check over every variant, with the edit-distance ratio."""
    return _catalog_check(spark, sf, F.col("text"))


def export_images(spark, sf):
    t = Tables(spark, sf)
    none = F.lit("")
    rows = t.variants().select("product_id", F.col("variant_id").alias("row_id"), "option1_name", "option1_value", "option2_name", "option2_value", none.alias("option3_name"), none.alias("option3_value"))
    return N.export_variant_images(rows, t.color_map()).select("product_id", "row_id", "option_value", "image")


def candidate_context(spark, sf):
    t = Tables(spark, sf)
    v = t.vendors().select("vendor", F.concat(F.lower(F.regexp_replace("vendor", "#", "")), F.lit(".example.com")).alias("domain"))
    p = t.products().withColumn("price", F.col("product_id").cast("double"))
    c = X.with_context(t.search_results().select("product_id", "ord", "url"), p, v)
    return c.select("product_id", "ord", F.col("price").alias("price"), F.coalesce("domain", F.lit("")).alias("domain"), "on_domain")


def run_reports(spark, sf):
    c = Tables(spark, sf).changes()
    rows = c.select("handle", F.col("product_type").alias("vendor"), "status", "confidence", F.array(F.lit("A"), F.col("reason")).alias("warnings"), F.concat(F.lit(" "), F.col("run_id")).alias("source_url"))
    rep = sinks.run_report(rows)
    return rep.select(*[F.col(n).alias(n.lower().replace(" ", "_")) for n in rep.columns]).withColumn("confidence", F.col("confidence").cast("bigint"))


def artifact_changes(spark, sf):
    """Run artifacts joined with the store: unknown handles go, missing sources come from the selected URL."""
    t = Tables(spark, sf)
    i = F.col("product_id")
    made = t.products().select(F.when(i % 6 == 0, F.concat(F.lit("gone-"), "handle")).otherwise(F.col("handle")).alias("handle"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("body_html"),
                               F.when(i % 2 == 0, F.concat(F.lit("https://s/"), i.cast("string"))).otherwise("").alias("source_url"), F.array("title").alias("images"))
    picked = t.products().where(i % 3 != 0).select("handle", F.concat(F.lit("https://r/"), i.cast("string")).alias("selected_url"))
    return V.artifact_changes(made, picked, t.products()).select("handle", "vendor", F.coalesce("source_url", F.lit("")).alias("source_url"), F.length("new_body_html").cast("bigint").alias("chars"))


def scoring_inputs(spark, sf):
    """Outputs, facts and verifications stored apart, joined and scored."""
    o = Tables(spark, sf).outputs()
    d = F.col("doc_id")
    made = o.select("handle", F.when(d % 10 != 0, F.col("body_html")).otherwise("").alias("body_html"))
    facts = o.where(d % 7 != 0).select("handle", "blocks", "bullets", "specs", "materials", "care")
    ver = o.where(F.col("verdict").isNotNull()).select("handle", "verdict", "n_supported", "n_unsupported", "n_embellished")
    return Q.output_quality(Q.scoring_inputs(made, facts, ver)).select("handle", F.col("total").cast("bigint").alias("total"))


def feedback_weighted(spark, sf):
    """Iteration results weighted by the handles that reviewers rejected or edited."""
    t = Tables(spark, sf)
    f = B.collect_feedback(t.changes())
    res = B.iteration_results(B.mark_feedback(t.iteration_scores(), f))
    return res.select(F.col("iteration").cast("bigint").alias("iteration"), half_up(F.col("avg_score"), 6).alias("avg_score"), F.col("max_score").cast("bigint").alias("max_score"))


QUERIES = {f.__name__: f for f in (
    store_values, store_lookup, shaped_products, shaped_variants, hero_images, health_images, ranked_handles, shipping_sheet, bulk_images, backfill_rows, url_checks, extraction_scores, brand_colors,
    prompt_facts, clean_descriptions, hero_assign, cross_check_edit, catalog_check_text_edit, export_images, candidate_context, run_reports, artifact_changes, scoring_inputs, feedback_weighted,
)}

# ---------------------------------------------------------------- oracles
_IMAGES = {"img_rows": "SELECT product_id, position, image_src AS src, position % 2 = 1 AS own FROM variants WHERE image_src <> ''"}
_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace({c}, '\\d+\\.?\\d*\\(\\d+\\)\\d+\\s*total reviews?', '', 'g'), '\\d+\\.?\\d*\\s*out of \\d+\\s*stars?', '', 'g'), ' ' || chr(10))"
_DISTANCE = "(1.0::DOUBLE - levenshtein(lower(pn), lower(title))::DOUBLE / greatest(length(pn), length(title)))"


def _outputs_apart() -> dict[str, str]:
    from merchgrid.plans.content import _OUT

    return _OUT


ORACLES = {
    "store_values": with_tables("SELECT 'vendor' AS kind, vendor AS value FROM products GROUP BY 2 UNION ALL SELECT 'product_type', product_type FROM products WHERE product_type <> '' GROUP BY 2"),
    "store_lookup": with_tables("SELECT product_id, title, vendor FROM products WHERE regexp_replace(handle, '[0-9]+$', '') = 'red-bolt-'"),
    "shaped_products": with_tables("""SELECT p.product_id, CASE WHEN p.product_id % 5 <> 0 THEN vendor ELSE '' END AS vendor, tags, coalesce(n, 0) AS images, coalesce(src, '') AS first_src
        FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, arg_min(src, position) AS src FROM img_rows GROUP BY 1) USING (product_id)""", _IMAGES),
    "shaped_variants": with_tables("""SELECT variant_id, CASE WHEN position % 4 <> 0 THEN sku ELSE '' END AS sku, CASE WHEN position % 4 <> 0 THEN grams ELSE 0.0::DOUBLE END AS grams,
        CASE WHEN position % 4 <> 0 THEN price ELSE 0.0::DOUBLE END AS price, CASE WHEN position % 4 <> 0 THEN requires_shipping ELSE true END AS requires_shipping, CASE WHEN position % 3 = 0 THEN 'g' ELSE 'lb' END AS weight_unit FROM variants"""),
    "hero_images": with_tables("SELECT product_id, arg_min(src, position) AS hero_image_url FROM img_rows WHERE NOT own GROUP BY 1", _IMAGES),
    "health_images": with_tables("""SELECT product_id, verdict AS image_verdict, string_split(concat_ws('; ', CASE verdict WHEN 'mismatch' THEN 'Hero image doesn''t match product' WHEN 'lifestyle' THEN 'Hero image is a lifestyle shot'
          WHEN 'placeholder' THEN 'Hero image is a placeholder' END, nullif(reason, ''), CASE WHEN coherence = 'mismatch' THEN 'No title/type words found in description. Expected one of: ' || array_to_string(list_sort(words), ', ') END), '; ')[1] AS first_note,
        verdict = 'mismatch' OR coherence = 'mismatch' AS fails
        FROM (SELECT *, CASE WHEN product_id % 11 = 0 THEN 'no_image' WHEN product_id % 7 = 0 THEN 'error' WHEN product_id % 5 = 0 THEN 'mismatch' WHEN product_id % 3 = 0 THEN 'lifestyle' WHEN product_id % 4 = 0 THEN 'placeholder' ELSE 'product' END AS verdict FROM coherence_)""", _HEALTH),
    "ranked_handles": with_tables(f"SELECT handle, product_id, {r('priority_score', 3)} AS priority FROM audited WHERE priority_score > 0"),
    "shipping_sheet": with_tables("""SELECT handle, kind AS issue_type, CASE kind WHEN 'zero_weight' THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN bad_price = 0 THEN '' ELSE printf('$%.2f', bad_price) END AS price
        FROM per_product WHERE kind IS NOT NULL UNION ALL
        SELECT handle, 'high_shipping_ratio', CASE WHEN est / rep_price * 100 > 40 THEN 'warning' ELSE 'info' END, printf('$%.2f', rep_price) FROM costed WHERE est / rep_price * 100 > 25""", _SHIP),
    "bulk_images": with_tables("""SELECT product_id AS id, handle, CASE WHEN variant_id = min(variant_id) OVER (PARTITION BY product_id) THEN 'MERGE' ELSE '' END AS command, variant_id, 'MERGE' AS variant_command, image_url AS variant_image
        FROM assigned WHERE image_url <> ''""", _IMG),
    "backfill_rows": with_tables("SELECT product_id, handle, 'MERGE' AS command, length(text) AS chars FROM products JOIN documents d ON d.doc_id * 2 = product_id WHERE status = 'active' AND trim(body_html) = '' AND text <> ''"),
    "url_checks": """SELECT page_id, NOT (starts_with(p, '/en/1') OR starts_with(p, '/de')) AS product, contains(h, 'example.com') OR contains('example.com', h) AS same
        FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages)""",
    "extraction_scores": with_tables("""SELECT doc_id, greatest(0.0::DOUBLE, 30.0::DOUBLE * (product_name <> '')::INT + 25 * (ld <> '')::INT + 20 * (doc_id % 3 > 0)::INT + 10 * (len(bullets) > 0)::INT + 10 * (len(blocks) > 0 OR doc_id % 8 = 0)::INT
        - CASE WHEN doc_id % 8 = 0 THEN 40 ELSE 0 END) + 5 * (len(specs) > 0)::INT AS score FROM facts"""),
    "brand_colors": with_tables("""SELECT product_id, CASE WHEN vendor IN ('Brand#11', 'Brand#12') THEN title WHEN vendor IN ('Brand#13', 'Brand#14', 'Brand#21')
        THEN CASE WHEN regexp_matches(title, '^(red|blue|green)\\b') THEN upper(title[1]) || regexp_extract(title, '^.(\\w+)', 1) ELSE '' END ELSE '' END AS color FROM products WHERE lower(product_type) NOT IN ('bolt', 'gear')"""),
    "prompt_facts": with_tables(f"SELECT handle, {_CLEAN('product_name')} AS product_name, len(list_filter(blocks, lambda b: {_CLEAN('b')} <> ''))::BIGINT AS blocks, len(bullets)::BIGINT AS bullets, len(specs)::BIGINT AS specs FROM facts"),
    "clean_descriptions": "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace('4.5(12)12 total reviews ' || text || ' 3.0 out of 5 stars', '\\d+\\.\\d+\\(\\d+\\)\\d+\\s*total reviews?', '', 'g'), '\\b\\d+\\.\\d+\\s*out of \\d+\\s*stars?\\b', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS chars FROM documents",
    "hero_assign": with_tables("""SELECT handle, CASE WHEN product_id % 5 = 0 THEN 'Red=' || title WHEN product_id % 3 <> 0 AND product_id % 4 <> 0 THEN '__all__=h' || product_id ELSE '' END AS assignment,
        CASE WHEN product_id % 5 = 0 THEN '' WHEN product_id % 3 = 0 THEN 'COLOR_MATCHING_FAILED_NO_IMAGES_ASSIGNED' WHEN product_id % 4 = 0 THEN 'NO_IMAGES_FOR_VARIANT_ASSIGNMENT' ELSE '' END AS warning FROM products"""),
    "cross_check_edit": with_tables(f"""SELECT product_id, concat_ws(',', CASE WHEN k AND {_DISTANCE} < 0.3 THEN 'PRODUCT_NAME_MISMATCH' END, CASE WHEN k AND {_DISTANCE} >= 0.3 AND {_DISTANCE} < 0.6 THEN 'PRODUCT_NAME_LOW_SIMILARITY' END,
        CASE WHEN k AND abs(product_id % 90 + 10 - 40) > 20 THEN 'PRICE_MISMATCH' END) AS warnings
        FROM (SELECT product_id, title, product_id % 4 <> 0 AS k, CASE product_id % 3 WHEN 0 THEN 'zzzz qqqq' WHEN 1 THEN left(title, 5) ELSE title END AS pn FROM products)"""),
    "catalog_check_text_edit": with_tables(f"""SELECT variant_id AS row_id, coalesce(concat_ws('; ', CASE WHEN rr < 0.3 THEN 'PRODUCT_NAME_MISMATCH: ' || said WHEN rr < 0.6 THEN 'PRODUCT_NAME_LOW_SIMILARITY: ' || said END,
        CASE WHEN known AND abs(scraped - kp) / kp > 0.5 THEN 'PRICE_MISMATCH: scraped=' || printf('$%.2f', scraped) || ' vs catalog=' || printf('$%.2f', kp) END), '') AS warnings,
        CASE WHEN known THEN coalesce(catalog_image, '') ELSE '' END AS image, CASE WHEN known AND in_store THEN coalesce(dd, '') ELSE '' END AS description
        FROM (SELECT *, CASE WHEN known AND in_store THEN {_DISTANCE} END AS rr, 'scraped=' || chr(39) || pn || chr(39) || ' vs catalog=' || chr(39) || title || chr(39) || ' (similarity=' || round_even({_DISTANCE} * 100, 0)::INT || '%)' AS said
          FROM (SELECT v.variant_id, v.price AS kp, title, catalog_image, v.barcode <> '' AND position % 10 <> 7 AS known, position % 12 <> 5 AS in_store, d.text AS dd,
            CASE position % 3 WHEN 0 THEN 'zzzz qqqq' WHEN 1 THEN left(title, 5) ELSE title END AS pn, CASE WHEN position % 5 <> 2 THEN v.price * (1 + position % 4) END AS scraped
            FROM variants v JOIN products p USING (product_id) LEFT JOIN barcodes USING (barcode) LEFT JOIN documents d ON d.doc_id * 2 = product_id AND d.text <> ''))""", _IMG),
    "export_images": with_tables("""SELECT v.product_id, variant_id AS row_id, option1_value AS option_value, url AS image FROM variants v
        JOIN (SELECT product_id, color, arg_min(url, ord) AS url FROM cmap GROUP BY 1, 2) m ON m.product_id = v.product_id AND m.color = option1_value WHERE lower(option1_name) = 'color'""", _OPT),
    "candidate_context": with_tables("""SELECT product_id, ord, product_id::DOUBLE AS price, coalesce(domain, '') AS domain, coalesce(contains(h, domain) OR contains(domain, h), false) AS on_domain
        FROM (SELECT u.product_id, u.ord, CASE WHEN vv_.vendor IS NULL THEN NULL ELSE lower(replace(vv_.vendor, '#', '')) || '.example.com' END AS domain, regexp_replace(lower(regexp_extract(u.url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS h
          FROM u4 u JOIN products p ON p.product_id = u.product_id LEFT JOIN vendors_ vv_ ON vv_.vendor = p.vendor)""", _URL | _VENDORS),
    "run_reports": with_tables("SELECT handle AS product_handle, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Bolt' END AS vendor, status, confidence, 'A; ' || reason AS warnings, run_id AS source_url FROM ch", _CHANGES),
    "artifact_changes": with_tables("""SELECT handle, vendor, CASE WHEN product_id % 2 = 0 THEN 'https://s/' || product_id WHEN product_id % 3 <> 0 THEN 'https://r/' || product_id ELSE '' END AS source_url, length(title) + 7 AS chars
        FROM products WHERE product_id % 6 <> 0"""),
    "scoring_inputs": with_tables("SELECT handle, total FROM o4 WHERE substr(handle, 5)::BIGINT % 10 <> 0 AND substr(handle, 5)::BIGINT % 7 <> 0 AND handle IN (SELECT handle FROM outputs WHERE body_html <> '')", _outputs_apart()),
    "feedback_weighted": with_tables(f"""SELECT i AS iteration, {r('sum(total * w) / sum(w)', 6)} AS avg_score, max(total) AS max_score FROM (SELECT i, (d + i * 3) % 26 + (d * 3 + i) % 16 + (d + i) % 16 + (d * 5 + i * 2) % 16 AS total,
        CASE WHEN 'doc-' || d IN (SELECT handle FROM fb WHERE disposition IN ('rejected', 'edited')) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM (SELECT doc_id AS d, unnest(range(0, 5)) AS i FROM documents)) GROUP BY 1""", _CHANGES),
}
