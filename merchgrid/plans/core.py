"""Queries over audit, signals, weights, ranking, shipping and health, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions.common import half_up
from merchgrid.operators import audit as A
from merchgrid.operators import health as H
from merchgrid.operators import inventory as I
from merchgrid.operators import ranking as R
from merchgrid.operators import shipping as S
from merchgrid.operators import signals as G
from merchgrid.operators import weights as W
from merchgrid.plans.sql import priority_sql, r, with_tables

GRID = W.weight_grid(seed=7, per_transform=8)


def scores(t: Tables) -> DataFrame:
    online = G.merge_online_signals(t.sessions_by_path(), t.online_sales(), t.handles())
    listing = G.listing_by_product(G.merge_listing(G.listing_performance(t.listing_perf()), G.listing_status(t.listing_status())), t.variants())
    return A.audit(t.products(), t.variants(), None, online, listing)


def audit_priority(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(Tables(spark, sf)).where("gap_count > 0")
    return s.select(
        "product_id", "handle", "vendor", "title", "barcode", "sku", F.array_join("gaps", ", ").alias("gaps"),
        F.array_join("suggestions", "; ").alias("suggestions"), half_up(F.col("gap_count"), 4).alias("gap_count"),
        "online_sessions", "listing_impressions", half_up(F.col("opportunity_gap"), 6).alias("opportunity_gap"),
        half_up(F.col("discovery_gap"), 6).alias("discovery_gap"), half_up(F.col("priority_score"), 3).alias("priority_score"),
    )


def priority_top(spark, sf):
    s = scores(Tables(spark, sf))
    return A.priority_items(s, 50).select("product_id", "handle", half_up(F.col("priority_score"), 3).alias("priority_score"))


def audit_summary(spark, sf):
    out = A.audit_summary(scores(Tables(spark, sf)))
    return out.withColumn("completion_pct", half_up(F.col("completion_pct"), 4)).withColumn("value_at_risk", half_up(F.col("value_at_risk"), 1))


def audit_full(spark, sf):
    s = scores(Tables(spark, sf))
    return s.select(
        "product_id", "variant_count", "variants_missing_images", "description_length", "has_product_image", "has_all_variant_images",
        "has_description", "has_product_type", "has_tags", half_up(F.col("completeness_pct"), 2).alias("completeness_pct"),
        half_up(F.col("price"), 6).alias("price"), half_up(F.col("cost"), 6).alias("cost"), "total_inventory",
        half_up(F.col("inventory_value"), 2).alias("inventory_value"),
    )


def vendor_completion(spark, sf):
    return A.vendor_completion(scores(Tables(spark, sf)))


def online_signals_merge(spark, sf):
    t = Tables(spark, sf)
    o = G.merge_online_signals(t.sessions_by_path(), t.online_sales(), t.products())
    return o.select("title", "sessions", half_up(F.col("conversion_rate"), 6).alias("conversion_rate"), half_up(F.col("online_revenue"), 2).alias("online_revenue"),
                    "orders", "quantity_ordered", half_up(F.col("opportunity_gap"), 6).alias("opportunity_gap"))


def _listing(t: Tables) -> DataFrame:
    return G.merge_listing(G.listing_performance(t.listing_perf()), G.listing_status(t.listing_status()))


def listing_merge(spark, sf):
    return _listing(Tables(spark, sf)).select("offer_id", "clicks", "impressions", "disapproved", F.size("issues").cast("bigint").alias("n_issues"))


def listing_rollup(spark, sf):
    t = Tables(spark, sf)
    g = G.listing_by_product(_listing(t), t.variants())
    n = lambda name: F.coalesce(F.get(F.transform(F.filter("issues", lambda i: i["issue"] == name), lambda i: i["n"]), F.lit(0)), F.lit(0))
    return g.select("product_id", "clicks", "impressions", "disapproved", n("fix_image").alias("n_image"), n("fix_price").alias("n_price"),
                    half_up(F.col("ctr"), 6).alias("ctr"), half_up(F.col("discovery_gap"), 6).alias("discovery_gap"))


def inventory_rollup(spark, sf):
    inv = I.inventory_rollup(Tables(spark, sf).inventory_levels())
    return inv.select("product_id", "total", half_up(F.col("value"), 2).alias("value"), half_up(F.col("full_price_value"), 2).alias("full_price_value"),
                      *[F.coalesce(F.element_at("by_location", F.lit(f"loc{i}")), F.lit(0)).alias(f"loc{i}") for i in range(3)])


def sales_velocity(spark, sf):
    t = Tables(spark, sf)
    return I.sales_velocity(t.order_lines(), t.last_sale())


def _members(t: Tables) -> DataFrame:
    p = t.products().select("product_id", "handle", "title", "vendor", "created_at")
    return t.collection_members().join(p, "product_id")


def _ranked(t: Tables, limit) -> DataFrame:
    inv = I.inventory_totals(t.inventory_levels())
    vel = I.sales_velocity(t.order_lines(), t.last_sale())
    return R.rank_collections(_members(t), t.variants(), vel, inv, t.rank_overrides(), t.reference_date(), limit=limit)


def _rank_columns(df):
    return df.select("collection", "product_id", half_up(F.col("total_score"), 6).alias("total_score"), "rank", R.notes().alias("notes"))


def collection_rank(spark, sf):
    return _rank_columns(_ranked(Tables(spark, sf), None))


def rank_with_pins(spark, sf):
    return _rank_columns(_ranked(Tables(spark, sf), None))


def margin(spark, sf):
    return R.margin_stats(Tables(spark, sf).variants()).select("product_id", half_up(F.col("margin_pct"), 3).alias("margin_pct"))


def _sweep_columns(df, *ids):
    keep = ["variant_leverage", "vendor_concentration", "inventory_coverage", "traffic_alignment", "composite"]
    return df.select(*ids, "top_count", *[half_up(F.col(c), 6).alias(c) for c in keep])


def coverage_topn(spark, sf):
    return _sweep_columns(W.coverage(scores(Tables(spark, sf)), top_n=50))


def weight_sweep(spark, sf):
    return _sweep_columns(W.sweep(scores(Tables(spark, sf)), GRID, top_n=50), "weight_id")


def weight_best(spark, sf):
    b = W.best_vector(W.sweep(scores(Tables(spark, sf)), GRID, top_n=50))
    return b.select("best_id", *[half_up(F.col(c), 6).alias(c) for c in ("best_efficiency", "baseline_efficiency", "improvement")])


def coverage_vendors(spark, sf):
    return W.top_vendors(scores(Tables(spark, sf)))


def shipping_audit(spark, sf):
    t = Tables(spark, sf)
    out = S.shipping_issues(A.active_products(t.products()), t.variants())
    return out.select("product_id", "handle", "issue_type", "severity", "variant_count", "weight_g", "expected_g", half_up(F.col("price"), 2).alias("price"),
                      half_up(F.col("est_shipping"), 3).alias("est_shipping"), half_up(F.col("shipping_pct"), 4).alias("shipping_pct"))


def health_text(spark, sf):
    return H.health_report(Tables(spark, sf).products())


QUERIES = {f.__name__: f for f in (
    audit_priority, priority_top, audit_summary, audit_full, vendor_completion, online_signals_merge, listing_merge, listing_rollup,
    inventory_rollup, sales_velocity, collection_rank, rank_with_pins, margin, coverage_topn, weight_sweep, weight_best, coverage_vendors,
    shipping_audit, health_text,
)}

# ---------------------------------------------------------------- oracles
_GAPS = """concat_ws(', ', CASE WHEN NOT has_product_image THEN 'Missing product image' END,
  CASE WHEN NOT has_all_variant_images THEN 'Missing variant images (' || variants_missing_images || '/' || variant_count || ')' END,
  CASE WHEN NOT has_description THEN CASE WHEN description_length = 0 THEN 'Missing description' ELSE 'Short description (' || description_length || ' chars)' END END,
  CASE WHEN NOT has_product_type THEN 'Missing product type' END, CASE WHEN NOT has_tags THEN 'No tags' END)"""
_SUGG = """concat_ws('; ', CASE WHEN NOT has_product_image THEN 'Add at least one product-level image' END,
  CASE WHEN NOT has_all_variant_images THEN 'Add images for each color variant' END,
  CASE WHEN NOT has_description THEN 'Add description (minimum 100 characters)' END,
  CASE WHEN NOT has_product_type THEN 'Set product type for better categorization' END,
  CASE WHEN NOT has_tags THEN 'Add relevant tags for search and filtering' END)"""

_RANK = {
    "members": "SELECT lower(p_type) AS collection, p.* FROM part JOIN products p ON p_partkey = product_id",
    "overrides": """SELECT handle, CASE WHEN product_id % 41 = 3 THEN product_id % 23 + 1 END AS pin,
        CASE WHEN product_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS boost, product_id % 37 = 5 AS bury
      FROM handles WHERE product_id % 41 = 3 OR product_id % 37 = 5""",
    "margins": """SELECT product_id, CASE WHEN n = 0 OR p = 0 THEN 0.0::DOUBLE ELSE (p / n - c / n) / (p / n) * 100 END AS margin_pct
      FROM (SELECT product_id, sum(CASE WHEN cost > 0 THEN cost ELSE 0.0::DOUBLE END) AS c,
                   sum(CASE WHEN price > 0 THEN price ELSE 0.0::DOUBLE END) AS p, count(*) FILTER (cost > 0) AS n FROM variants GROUP BY 1)""",
    "metrics": f"""SELECT collection, m.product_id, handle, {r('coalesce(weekly_avg, 0)', 2)} AS weekly_units, {r('coalesce(margin_pct, 0)', 1)} AS margin_pct,
        coalesce(total, 0) AS total_inventory,
        CASE WHEN coalesce(weekly_avg, 0) > 0 THEN {r('coalesce(total, 0)::DOUBLE / weekly_avg', 1)} ELSE 999.0::DOUBLE END AS wos,
        coalesce(floor((epoch(ref_date) - created_s) / 86400.0::DOUBLE), 999) AS days_old, pin, coalesce(boost, 0.0::DOUBLE) AS boost, coalesce(bury, false) AS bury
      FROM pool m LEFT JOIN margins USING (product_id) LEFT JOIN velocity USING (product_id) LEFT JOIN inventory USING (product_id)
        LEFT JOIN overrides USING (handle) CROSS JOIN ref""",
    "scored": """SELECT *, CASE WHEN bury THEN -999.0::DOUBLE ELSE
          weekly_units / max_v * 0.35::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, margin_pct / max_m)) * 0.2::DOUBLE
          + (CASE WHEN wos BETWEEN 3 AND 12 THEN 1.0::DOUBLE WHEN wos < 3 THEN 0.3::DOUBLE WHEN wos <= 20 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) * 0.2::DOUBLE
          + (CASE WHEN days_old <= 30 THEN 1.0::DOUBLE - days_old / 30.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.15::DOUBLE
          + (CASE WHEN total_inventory < 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.1::DOUBLE + boost END AS total_score
      FROM metrics JOIN (SELECT collection, CASE WHEN max(weekly_units) = 0 THEN 1.0::DOUBLE ELSE max(weekly_units) END AS max_v,
        CASE WHEN max(margin_pct) = 0 THEN 1.0::DOUBLE ELSE max(margin_pct) END AS max_m FROM metrics GROUP BY 1) USING (collection)""",
    "sizes": "SELECT collection, count(*) AS n FROM scored GROUP BY 1",
    "pinned": """SELECT collection, pin, max(product_id) AS product_id FROM scored JOIN sizes USING (collection)
        WHERE pin BETWEEN 1 AND n GROUP BY 1, 2""",
    "slots": """SELECT collection, slot, row_number() OVER (PARTITION BY collection ORDER BY slot) AS k
        FROM (SELECT collection, unnest(range(1, n + 1)) AS slot FROM sizes) s
        WHERE NOT EXISTS (SELECT 1 FROM pinned p WHERE p.collection = s.collection AND p.pin = s.slot)""",
    "placed": """SELECT u.collection, product_id, slot AS rank FROM (SELECT collection, product_id,
          row_number() OVER (PARTITION BY collection ORDER BY total_score DESC, product_id) AS k FROM scored WHERE pin IS NULL) u
        JOIN slots s ON s.collection = u.collection AND s.k = u.k
      UNION ALL SELECT collection, product_id, pin FROM pinned""",
}
_RANK_OUT = f"""SELECT s.collection, s.product_id, {r('total_score', 6)} AS total_score, coalesce(rank, 0)::BIGINT AS rank,
  concat_ws(', ', CASE WHEN pin IS NOT NULL THEN 'pinned #' || pin END, CASE WHEN boost > 0 THEN 'boosted' END, CASE WHEN bury THEN 'buried' END,
   CASE WHEN days_old <= 30 THEN 'new' END, CASE WHEN total_inventory < 3 THEN 'low stock' END) AS notes
  FROM scored s LEFT JOIN placed p ON p.collection = s.collection AND p.product_id = s.product_id"""

_VECTORS = ", ".join(
    "(" + ", ".join([str(i)] + [f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in w.__dict__.values()]) + ")" for i, w in GRID
)
_WCOLS = list(GRID[0][1].__dict__)


def _sweep_ctes(vectors: str) -> dict[str, str]:
    return {
        "grid": f"SELECT * FROM (VALUES {vectors}) g(weight_id, {', '.join(_WCOLS)})",
        "wide": f"SELECT * FROM (SELECT weight_id, s.*, {priority_sql({c: c for c in _WCOLS})} AS p FROM audited s CROSS JOIN grid) WHERE p > 0",
        "totals": """SELECT weight_id, sum(variants_missing_images) AS am, sum(inventory_value) AS ai, sum(online_sessions + listing_impressions) AS at_
            FROM wide GROUP BY 1""",
        "tops": """SELECT weight_id, sum(variants_missing_images) AS tm, sum(inventory_value) AS ti, sum(online_sessions + listing_impressions) AS tt,
            count(DISTINCT vendor) AS tv, count(*) AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY weight_id ORDER BY p DESC, product_id) AS rn FROM wide)
            WHERE rn <= 50 GROUP BY 1""",
        "covered": """SELECT weight_id, top_count, CASE WHEN am = 0 THEN 0.0::DOUBLE ELSE tm::DOUBLE / am::DOUBLE END AS variant_leverage,
            1 - tv::DOUBLE / top_count AS vendor_concentration, CASE WHEN ai = 0 THEN 0.0::DOUBLE ELSE ti / ai END AS inventory_coverage,
            CASE WHEN at_ = 0 THEN 0.0::DOUBLE ELSE tt::DOUBLE / at_::DOUBLE END AS traffic_alignment FROM totals JOIN tops USING (weight_id)""",
        "composed": """SELECT *, 0.3::DOUBLE * variant_leverage + 0.2::DOUBLE * vendor_concentration + 0.25::DOUBLE * inventory_coverage
            + 0.25::DOUBLE * traffic_alignment AS composite FROM covered""",
    }


_COMP = ", ".join(f"{r(c, 6)} AS {c}" for c in ("variant_leverage", "vendor_concentration", "inventory_coverage", "traffic_alignment", "composite"))
_ONE = ", ".join(["0"] + [f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in W.Weights().__dict__.values()])

_SHIP = {
    "expected": "SELECT * FROM (VALUES ('Bolt', 113), ('Ring', 227), ('Gear', 907), ('Rod', 1588), ('Plate', 1814), ('Widget', 454), ('Anvil', 2268)) e(product_type, expected_g)",
    "issue_base": """SELECT k.product_id, handle, position, grams, v.price, expected_g, CASE WHEN requires_shipping THEN CASE WHEN grams = 0 THEN 'zero_weight'
        WHEN expected_g IS NOT NULL AND (grams / expected_g < 0.5 OR grams / expected_g > 2) THEN 'weight_mismatch' END END AS kind
      FROM kept k JOIN variants v USING (product_id) LEFT JOIN expected USING (product_type)""",
    "per_product": """SELECT product_id, any_value(handle) AS handle, count(*) AS variant_count, max(expected_g) AS expected_g,
        arg_min(kind, position) FILTER (kind IS NOT NULL) AS kind, arg_min(grams, position) FILTER (kind IS NOT NULL) AS bad_g,
        arg_min(price, position) FILTER (kind IS NOT NULL) AS bad_price, arg_min(grams, position) AS rep_g, arg_min(price, position) AS rep_price
      FROM issue_base GROUP BY 1""",
    "costed": """SELECT *, 1.2::DOUBLE * CASE WHEN lb <= 1 THEN 9.5::DOUBLE WHEN lb <= 2 THEN 10.5::DOUBLE WHEN lb <= 3 THEN 11.5::DOUBLE WHEN lb <= 5 THEN 13.5::DOUBLE
        WHEN lb <= 10 THEN 18.0::DOUBLE WHEN lb <= 20 THEN 25.0::DOUBLE WHEN lb <= 30 THEN 33.0::DOUBLE WHEN lb <= 50 THEN 50.0::DOUBLE WHEN lb <= 70 THEN 70.0::DOUBLE ELSE 120.0::DOUBLE END AS est
      FROM (SELECT *, rep_g / 453.592::DOUBLE AS lb FROM per_product WHERE rep_g > 0 AND rep_price > 0)""",
}

_WORDS = "'the','a','an','and','or','of','for','in','on','to','with','men''s','mens','women''s','womens','unisex','kid''s','kids','youth','junior','adult'"
_HEALTH = {
    "plain": """SELECT product_id, vendor, handle, title, product_type, body_html,
        trim(regexp_replace(regexp_replace(regexp_replace(body_html, '<[^>]+>', ' ', 'g'), '&\\w+;', ' ', 'g'), '\\s+', ' ', 'g')) AS body,
        list_distinct([w FOR w IN string_split(lower(title || ' ' || product_type), ' ') IF length(w) > 3 AND w NOT IN (""" + _WORDS + """)]) AS words
      FROM products WHERE status = 'active'""",
    "judged": """SELECT *, CASE WHEN trim(body_html) = '' THEN 'No description' WHEN lower(body) = lower(title) THEN 'Title repeated as description'
        WHEN length(body) < 50 THEN 'Too short (' || length(body) || ' chars)'
        WHEN regexp_matches(body, '(?i)(buy\\s+locally|visit\\s+us|contact\\s+(your\\s+)?(local\\s+)?dealer|description\\s+coming\\s+soon|check\\s+with\\s+your\\s+local|available\\s+at\\s+your\\s+(local|nearest)|see\\s+in\\s+store|call\\s+for\\s+(pricing|availability))')
          THEN 'Boilerplate: ''' || regexp_extract(body, '(?i)(buy\\s+locally|visit\\s+us|contact\\s+(your\\s+)?(local\\s+)?dealer|description\\s+coming\\s+soon|check\\s+with\\s+your\\s+local|available\\s+at\\s+your\\s+(local|nearest)|see\\s+in\\s+store|call\\s+for\\s+(pricing|availability))') || ''''
        ELSE '' END AS reason,
        [d FOR d IN list_distinct(regexp_extract_all(lower(body), '[a-z'']+')) IF length(d) > 3] AS tokens FROM plain""",
    "coherence_": """SELECT *, CASE WHEN trim(body_html) = '' OR len(words) = 0 OR
        len([w FOR w IN words IF contains(lower(body), w) OR len([d FOR d IN tokens IF starts_with(d, left(w, greatest(4, length(w) - 1)::INT)) OR starts_with(w, left(d, greatest(4, length(d) - 1)::INT))]) > 0]) > 0
        THEN 'ok' ELSE 'mismatch' END AS coherence FROM judged""",
}

ORACLES = {
    "audit_priority": with_tables(f"""SELECT product_id, handle, vendor, title, barcode, sku, {_GAPS} AS gaps, {_SUGG} AS suggestions, {r('gap_count')} AS gap_count,
        online_sessions, listing_impressions, {r('opportunity_gap', 6)} AS opportunity_gap, {r('discovery_gap', 6)} AS discovery_gap, {r('priority_score', 3)} AS priority_score
        FROM audited WHERE gap_count > 0"""),
    "priority_top": with_tables(f"SELECT product_id, handle, {r('priority_score', 3)} AS priority_score FROM audited WHERE gap_count > 0 ORDER BY audited.priority_score DESC, product_id LIMIT 50"),
    "audit_summary": with_tables(f"""SELECT count(*) AS total_products, count(*) FILTER (gap_count > 0) AS products_with_gaps, count(*) FILTER (gap_count = 0) AS products_complete,
        {r('count(*) FILTER (gap_count = 0)::DOUBLE / count(*) * 100')} AS completion_pct, count(*) FILTER (NOT has_product_image) AS missing_images,
        count(*) FILTER (NOT has_all_variant_images) AS missing_variant_images, count(*) FILTER (NOT has_description) AS missing_description,
        count(*) FILTER (NOT has_product_type) AS missing_product_type, count(*) FILTER (NOT has_tags) AS missing_tags,
        {r('sum(inventory_value) FILTER (gap_count > 0)', 1)} AS value_at_risk FROM audited"""),
    "audit_full": with_tables(f"""SELECT product_id, variant_count, variants_missing_images, description_length, has_product_image, has_all_variant_images, has_description,
        has_product_type, has_tags, {r('(has_product_image::INT + has_all_variant_images::INT + has_description::INT + has_product_type::INT + has_tags::INT) * 20.0', 2)} AS completeness_pct,
        {r('price', 6)} AS price, {r('cost', 6)} AS cost, total_inventory, {r('inventory_value', 2)} AS inventory_value FROM audited"""),
    "vendor_completion": with_tables("SELECT vendor, count(*) AS products, count(*) FILTER (gap_count = 0) AS complete FROM audited GROUP BY 1"),
    "online_signals_merge": with_tables(f"""SELECT title, sessions, {r('conversion_rate', 6)} AS conversion_rate, {r('online_revenue', 2)} AS online_revenue, orders,
        quantity_ordered, {r('opportunity_gap', 6)} AS opportunity_gap FROM online"""),
    "listing_merge": with_tables("SELECT offer_id, clicks, impressions, disapproved, (n_image + n_price)::BIGINT AS n_issues FROM listing"),
    "listing_rollup": with_tables(f"SELECT product_id, clicks, impressions, disapproved, n_image, n_price, {r('ctr', 6)} AS ctr, {r('discovery_gap', 6)} AS discovery_gap FROM listing_product"),
    "inventory_rollup": with_tables(f"""SELECT product_id, sum(qty)::BIGINT AS total, {r('sum(qty * cost)', 2)} AS value,
        {r('sum(CASE WHEN on_sale THEN 0.0::DOUBLE ELSE qty * cost END)', 2)} AS full_price_value,
        {', '.join(f"coalesce(sum(qty) FILTER (location = 'loc{i}'), 0)::BIGINT AS loc{i}" for i in range(3))} FROM levels GROUP BY 1"""),
    "sales_velocity": with_tables("SELECT product_id, units, weekly_avg FROM velocity"),
    "collection_rank": with_tables(_RANK_OUT, _RANK | {"pool": "SELECT * FROM members"}),
    "rank_with_pins": with_tables(_RANK_OUT, _RANK | {"pool": "SELECT * FROM members"}),
    "margin": with_tables(f"SELECT product_id, {r('margin_pct', 3)} AS margin_pct FROM margins", _RANK),
    "coverage_topn": with_tables(f"SELECT top_count, {_COMP} FROM composed", _sweep_ctes(f"({_ONE})")),
    "weight_sweep": with_tables(f"SELECT weight_id, top_count, {_COMP} FROM composed", _sweep_ctes(_VECTORS)),
    "weight_best": with_tables(f"""SELECT (SELECT weight_id FROM composed ORDER BY composite DESC, weight_id LIMIT 1) AS best_id, {r('max(composite)', 6)} AS best_efficiency,
        {r('max(composite) FILTER (weight_id = 0)', 6)} AS baseline_efficiency, {r('max(composite) - max(composite) FILTER (weight_id = 0)', 6)} AS improvement FROM composed""", _sweep_ctes(_VECTORS)),
    "coverage_vendors": with_tables("""SELECT vendor, count(*) AS products FROM (SELECT * FROM audited WHERE priority_score > 0 ORDER BY priority_score DESC, product_id LIMIT 50)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "shipping_audit": with_tables(f"""SELECT product_id, handle, kind AS issue_type, CASE kind WHEN 'zero_weight' THEN 'critical' ELSE 'warning' END AS severity, variant_count,
        bad_g AS weight_g, coalesce(expected_g, 0)::DOUBLE AS expected_g, {r('bad_price', 2)} AS price, 0.0::DOUBLE AS est_shipping, 0.0::DOUBLE AS shipping_pct
        FROM per_product WHERE kind IS NOT NULL UNION ALL
        SELECT product_id, handle, 'high_shipping_ratio', CASE WHEN est / rep_price * 100 > 40 THEN 'warning' ELSE 'info' END, variant_count, rep_g, 0.0::DOUBLE, {r('rep_price', 2)},
        {r('est', 3)}, {r('est / rep_price * 100', 4)} FROM costed WHERE est / rep_price * 100 > 25""", _SHIP),
    "health_text": with_tables("""SELECT product_id, vendor, handle, title, product_type, 'skipped' AS image_verdict,
        CASE WHEN reason = 'No description' THEN 'empty' WHEN reason <> '' THEN 'weak' ELSE 'ok' END AS description_quality, coherence,
        CASE WHEN coherence = 'mismatch' THEN 'FAIL' WHEN reason <> '' THEN 'WARN' ELSE 'OK' END AS severity,
        concat_ws('; ', nullif(reason, ''), CASE WHEN coherence = 'mismatch' THEN 'No title/type words found in description. Expected one of: ' || array_to_string(list_sort(words), ', ') END) AS notes
        FROM coherence_""", _HEALTH),
}
