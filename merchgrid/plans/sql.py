"""DuckDB text of the bound logical tables, for the oracle queries."""

from __future__ import annotations

import re

from merchgrid import bind

_COLORS = "[" + ", ".join(f"'{c}'" for c in bind.COLORS) + "]"
_SIZES = "[" + ", ".join(f"'{c}'" for c in bind.SIZES) + "]"

_HANDLE = "replace(p_name, ' ', '-') || '-' || p_partkey"
_OFFER = (
    "CASE WHEN event_id % 11 = 0 THEN 'bare' || event_id "
    "WHEN event_id % 4 = 0 THEN 'shopify_US_' || pid || '_' || (pid * 100000 + event_id % 100) "
    "ELSE 'shopify_US_' || (pid * 100000 + event_id % 100) END"
)

CTES: dict[str, str] = {
    "ref": "SELECT max(o_orderdate) AS ref_date FROM orders",
    "handles": f"SELECT p_partkey AS product_id, {_HANDLE} AS handle, p_name AS title FROM part",
    "products": f"""SELECT p_partkey AS product_id, {_HANDLE} AS handle, p_name AS title, p_brand AS vendor,
        CASE WHEN p_partkey % 17 = 0 THEN '' ELSE upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] END AS product_type,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat_ws(', ', lower(p_type),
            CASE p_partkey % 4 WHEN 0 THEN 'gender:womens' WHEN 1 THEN 'gender:mens' END,
            CASE WHEN p_partkey % 3 = 0 THEN 'season:winter' END) END AS tags,
        coalesce('<p>' || text || '</p>', '') AS body_html,
        CASE WHEN p_partkey % 50 = 49 THEN 'draft' ELSE 'active' END AS status, split_part(p_name, ' ', 2) AS style,
        CASE WHEN p_partkey % 34 = 0 THEN 'Supply > Forge > Gears' WHEN p_partkey % 51 = 0 THEN 'Supply > Bars' ELSE '' END AS category,
        CASE WHEN p_partkey % 2 = 0 THEN 'female' ELSE '' END AS gender,
        CASE WHEN p_partkey % 97 <> 0 THEN epoch(ref_date)::BIGINT - (p_partkey % 90) * 86400 - p_partkey % 5000 END AS created_s
      FROM part LEFT JOIN documents ON doc_id = p_partkey CROSS JOIN ref""",
    "variants": f"""SELECT p * 100000 + s AS variant_id, p AS product_id, s AS position, 'SKU-' || p || '-' || s AS sku,
        CASE WHEN s % 9 = 0 THEN '' ELSE lpad((p * 1000 + s)::VARCHAR, 12, '0') END AS barcode, price,
        CASE WHEN disc_pts > 5 * n THEN floor(price * 1.25::DOUBLE * 4 + 0.5::DOUBLE) / 4 END AS compare_at_price,
        floor(price * (1 - disc_pts::DOUBLE / n / 100) * 0.6::DOUBLE * 4 + 0.5::DOUBLE) / 4 AS cost,
        CASE WHEN p % 10 = 9 THEN 'Material' ELSE 'Color' END AS option1_name, {_COLORS}[((p + s) % 6)::INT + 1] AS option1_value,
        'Size' AS option2_name, {_SIZES}[(s % 8)::INT + 1] AS option2_value,
        CASE WHEN p % 6 = 0 OR s % 5 = 0 THEN '' ELSE 'https://img.example.com/' || p || '/' || ((p + s) % 6) || '.jpg?v=' || s END AS image_src,
        CASE WHEN (p * 3 + s) % 31 = 0 THEN 0.0::DOUBLE ELSE ((p * 37 + s * 11) % 2500 + 40)::DOUBLE END AS grams,
        s % 13 <> 0 AS requires_shipping, (p * 7 + s * 13) % 40 AS qty, disc_pts > 5 * n AS on_sale
      FROM (SELECT *, floor(cents / units / 100 * 4 + 0.5::DOUBLE) / 4 AS price
        FROM (SELECT l_partkey AS p, l_suppkey AS s, sum(floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT)::DOUBLE AS cents,
              sum(l_quantity::BIGINT)::DOUBLE AS units, sum(floor(l_discount * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS disc_pts, count(*) AS n FROM lineitem GROUP BY 1, 2))""",
    "levels": """SELECT variant_id, product_id, cost, on_sale, 'loc' || (position % 3) AS location, qty FROM variants""",
    "inventory": """SELECT product_id, sum(qty)::BIGINT AS total, sum(qty * cost) AS value,
        sum(CASE WHEN on_sale THEN 0.0::DOUBLE ELSE qty * cost END) AS full_price_value FROM levels GROUP BY 1""",
    "order_lines": "SELECT l_partkey AS product_id, l_quantity AS units, o_orderdate AS sold_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "velocity": """SELECT product_id, sum(units) AS units, sum(units) / 4.0::DOUBLE AS weekly_avg FROM order_lines, ref
        WHERE epoch(sold_at) > epoch(ref_date) - 28 * 86400 GROUP BY 1""",
    "ev": "SELECT *, event_id % (SELECT count(*) FROM part) AS pid FROM events",
    "paths": """SELECT '/products/' || handle || CASE WHEN event_id % 3 = 0 THEN '?src=x' ELSE '' END AS path,
        count(*) FILTER (event_type IN ('view', 'click')) AS sessions,
        CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) = 0 THEN 0.0::DOUBLE
             ELSE least(1.0::DOUBLE, (count(*) FILTER (event_type = 'purchase'))::DOUBLE / (count(*) FILTER (event_type IN ('view', 'click')))) END AS conversion_rate
      FROM ev JOIN handles ON pid = product_id GROUP BY 1""",
    "online_sales": """SELECT title, sum(value) AS total_sales, count(*) AS orders, count(*) AS quantity_ordered
        FROM ev JOIN handles ON pid = product_id WHERE event_type = 'purchase' GROUP BY 1""",
    "sess": """SELECT regexp_extract(path, '^/products/([^?#]*)', 1) AS handle, arg_max(sessions, path) AS sessions,
        arg_max(conversion_rate, path) AS conversion_rate FROM paths GROUP BY 1""",
    "online": """SELECT title, coalesce(sessions, 0) AS sessions, coalesce(conversion_rate, 0.0::DOUBLE) AS conversion_rate,
        coalesce(total_sales, 0.0::DOUBLE) AS online_revenue, coalesce(orders, 0) AS orders, coalesce(quantity_ordered, 0) AS quantity_ordered,
        CASE WHEN coalesce(sessions, 0) = 0 THEN 0.0::DOUBLE
             ELSE (1 - coalesce(conversion_rate, 0.0::DOUBLE)) * least(sessions / 100.0::DOUBLE, 1.0::DOUBLE) END AS opportunity_gap
      FROM online_sales FULL JOIN (SELECT title, sessions, conversion_rate FROM sess
        JOIN (SELECT title, arg_max(handle, product_id) AS handle FROM products GROUP BY 1) USING (handle)) USING (title)""",
    "listing_daily": f"""SELECT {_OFFER} AS offer_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (event_type = 'view') * 40 AS impressions FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    "landed_status": f"""SELECT {_OFFER} AS offer_id, event_id AS ord, CASE WHEN value > 10 THEN 'DISAPPROVED' ELSE 'ELIGIBLE' END AS status,
        event_id % 2 = 0 AS ads_us, value > 30 AS price_us FROM ev WHERE event_type = 'error'""",
    "listing": """SELECT offer_id, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions,
        coalesce(status = 'DISAPPROVED', false) AS disapproved,
        CASE WHEN status IS NULL THEN 0 ELSE 1 + ads_us::INT END AS n_image, CASE WHEN status IS NULL THEN 0 ELSE price_us::INT END AS n_price
      FROM (SELECT offer_id, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM listing_daily GROUP BY 1)
      FULL JOIN (SELECT offer_id, arg_max(status, ord) AS status, arg_max(ads_us, ord) AS ads_us, arg_max(price_us, ord) AS price_us
                 FROM landed_status GROUP BY 1) USING (offer_id)""",
    "listing_resolved": """SELECT product_id, l.* FROM listing l JOIN variants ON len(string_split(offer_id, '_')) = 3
        AND lower(string_split(offer_id, '_')[1]) = 'shopify' AND variant_id = try_cast(string_split(offer_id, '_')[3] AS BIGINT)
      UNION ALL SELECT try_cast(string_split(offer_id, '_')[3] AS BIGINT), l.* FROM listing l
        WHERE len(string_split(offer_id, '_')) >= 4 AND lower(string_split(offer_id, '_')[1]) = 'shopify'""",
    "listing_product": """SELECT *, CASE WHEN impressions = 0 THEN 0.0::DOUBLE ELSE (1 - ctr) * least(impressions / 1000.0::DOUBLE, 1.0::DOUBLE) END AS discovery_gap
      FROM (SELECT product_id, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, bool_or(disapproved) AS disapproved,
              sum(n_image)::BIGINT AS n_image, sum(n_price)::BIGINT AS n_price,
              CASE WHEN sum(impressions) = 0 THEN 0.0::DOUBLE ELSE sum(clicks)::DOUBLE / sum(impressions)::DOUBLE END AS ctr
            FROM listing_resolved GROUP BY 1)""",
    "catalog_items": f"""SELECT barcode, CASE WHEN position % 2 = 0 OR product_id % 10 = 3 THEN 'https://cdn.example.org/' ELSE 'https://swatch.example.net/' END || barcode || '.jpg' AS image_url,
        '' AS vendor, '' AS style, '' AS color FROM variants WHERE (position % 7 = 1 OR product_id % 10 = 3) AND barcode <> ''
      UNION ALL SELECT '', 'https://cdn.example.org/style/' || p_partkey || '.jpg', p_brand, split_part(p_name, ' ', 2), {_COLORS}[(p_partkey % 6)::INT + 1]
        FROM part WHERE p_partkey % 13 = 0""",
    "facts": """SELECT doc_id, 'doc-' || doc_id AS handle, regexp_extract(text, '^(\\S+\\s+\\S+)', 1) AS product_name, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS brand,
        list_filter(string_split(text, chr(10)), lambda x: length(x) >= 120) AS blocks, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0 AND length(x) < 120) AS bullets,
        CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [n_chars || ' g'] ELSE [n_chars || ' g', lang] END AS specs,
        CASE doc_id % 3 WHEN 0 THEN '80% cotton, 20% nylon' WHEN 1 THEN 'soft shell fabric' ELSE '' END AS materials,
        CASE WHEN doc_id % 5 = 0 THEN 'machine wash cold inside' ELSE '' END AS care, CASE WHEN doc_id % 10 = 0 THEN text ELSE '' END AS ld, text, lang FROM documents""",
    "outputs": """SELECT f.*, CASE WHEN f.doc_id % 9 <> 8 THEN '<p>' || regexp_replace(CASE WHEN len(blocks) > 0 THEN array_to_string(blocks, chr(10)) ELSE 'A stunning perfect part.' END, '[<>]', ' ', 'g') || '</p>' ELSE '' END
        || CASE WHEN f.doc_id % 2 = 0 THEN '<ul>' || array_to_string(list_transform(bullets, lambda b: '<li>' || regexp_replace(b, '[<>]', ' ', 'g') || '</li>'), '') || '</ul>' ELSE '' END
        || CASE WHEN f.doc_id % 3 = 0 THEN '<h3>Specs</h3><table><tr><td>80% cotton, 20% nylon</td></tr></table>' ELSE '' END AS body_html,
        quality, quality * 3 + f.doc_id % 3 AS ns, coalesce(toxic, 0) AS nu, f.doc_id % 2 AS ne FROM facts f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
    "kept": "SELECT * FROM products WHERE status = 'active' AND vendor NOT IN ('Brand#25', 'Brand#24')",
    "vstats": """SELECT product_id, count(*) AS variant_count, bool_or(trim(image_src) <> '') AS any_image, avg(price) AS price, avg(cost) AS cost,
        arg_min(barcode, position) AS barcode, arg_min(sku, position) AS sku FROM variants GROUP BY 1""",
    "flags": """SELECT p.product_id, handle, title, vendor, product_type,
        length(regexp_replace(regexp_replace(body_html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS description_length,
        coalesce(any_image, false) AS has_product_image, coalesce(any_image, false) OR coalesce(variant_count, 0) = 0 AS has_all_variant_images,
        length(regexp_replace(regexp_replace(body_html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) >= 100 AS has_description,
        trim(product_type) <> '' AS has_product_type, trim(tags) <> '' AS has_tags, coalesce(variant_count, 0) AS variant_count,
        CASE WHEN coalesce(any_image, false) THEN 0 ELSE coalesce(variant_count, 0) END AS variants_missing_images,
        coalesce(barcode, '') AS barcode, coalesce(sku, '') AS sku, coalesce(v.price, 0.0::DOUBLE) AS price, coalesce(v.cost, 0.0::DOUBLE) AS cost,
        coalesce(total, 0) AS total_inventory, coalesce(value, 0.0::DOUBLE) AS inventory_value, coalesce(full_price_value, 0.0::DOUBLE) AS full_price_inventory_value
      FROM kept p LEFT JOIN vstats v USING (product_id) LEFT JOIN inventory USING (product_id)""",
    "scores": """SELECT f.*, coalesce(o.sessions, 0) AS online_sessions, coalesce(o.conversion_rate, 0.0::DOUBLE) AS online_conversion_rate,
        coalesce(o.online_revenue, 0.0::DOUBLE) AS online_revenue, coalesce(o.orders, 0) AS online_orders, coalesce(o.opportunity_gap, 0.0::DOUBLE) AS opportunity_gap,
        coalesce(g.clicks, 0) AS listing_clicks, coalesce(g.impressions, 0) AS listing_impressions, coalesce(g.ctr, 0.0::DOUBLE) AS listing_ctr,
        coalesce(g.disapproved, false) AS listing_disapproved, coalesce(g.discovery_gap, 0.0::DOUBLE) AS discovery_gap
      FROM flags f LEFT JOIN online o USING (title) LEFT JOIN listing_product g USING (product_id)""",
    "audited": "SELECT *, {gap_default} AS gap_count, {priority_default} AS priority_score FROM scores",
}


def gap_sql(w: dict[str, str]) -> str:
    return (
        f"(CASE WHEN has_product_image THEN 0.0::DOUBLE ELSE {w['gap_image']} END"
        f" + CASE WHEN has_all_variant_images THEN 0.0::DOUBLE ELSE {w['gap_variant_images']} * (variants_missing_images::DOUBLE / greatest(variant_count, 1)) END"
        f" + CASE WHEN has_description THEN 0.0::DOUBLE ELSE {w['gap_description']} END"
        f" + CASE WHEN has_product_type THEN 0.0::DOUBLE ELSE {w['gap_type']} END"
        f" + CASE WHEN has_tags THEN 0.0::DOUBLE ELSE {w['gap_tags']} END)"
    )


def priority_sql(w: dict[str, str]) -> str:
    return (
        f"(CASE {w['inventory_transform']} WHEN 'log' THEN ln(1 + inventory_value) WHEN 'sqrt' THEN sqrt(inventory_value) ELSE inventory_value END"
        f" * {gap_sql(w)}"
        " * (CASE WHEN full_price_inventory_value > 0 AND inventory_value > 0 THEN 1 + full_price_inventory_value / inventory_value ELSE 1.0::DOUBLE END)"
        f" * (1.0::DOUBLE + CASE WHEN online_sessions > 0 THEN opportunity_gap * ln(1 + online_sessions) / ln(1 + {w['session_scale']}) ELSE 0.0::DOUBLE END"
        f" + CASE WHEN listing_impressions > 0 THEN discovery_gap * ln(1 + listing_impressions) / ln(1 + {w['impression_scale']}) ELSE 0.0::DOUBLE END"
        f" + CASE WHEN listing_disapproved THEN {w['disapproval_boost']} ELSE 0.0::DOUBLE END))"
    )


DEFAULT = {
    "gap_image": "1.0::DOUBLE", "gap_variant_images": "1.0::DOUBLE", "gap_description": "1.0::DOUBLE", "gap_type": "0.5::DOUBLE",
    "gap_tags": "0.5::DOUBLE", "session_scale": "100.0::DOUBLE", "impression_scale": "1000.0::DOUBLE", "disapproval_boost": "0.5::DOUBLE",
    "inventory_transform": "'linear'",
}
CTES["audited"] = CTES["audited"].format(gap_default=gap_sql(DEFAULT), priority_default=priority_sql(DEFAULT))


def with_tables(query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the CTEs it needs, in dependency order."""
    table = CTES | (extra or {})
    used: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z_]+[a-z0-9_]*\b", sql):
            if name in table and name not in used and not (name in busy):
                busy.add(name)
                visit(table[name])
                used.append(name)

    busy: set[str] = set()
    visit(query)
    if not used:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({table[n]})" for n in used) + "\n" + query


def r(expr: str, digits: int = 4) -> str:
    """The oracle's half-up rounding, the same double arithmetic as ``half_up``."""
    k = f"{10**digits}.0::DOUBLE"
    return f"floor(({expr})::DOUBLE * {k} + 0.5::DOUBLE) / {k}"
