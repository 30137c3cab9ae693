"""Queries over intake, pages, review and feedback, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions.common import half_up
from merchgrid.functions.similarity import edit_ratio
from merchgrid.operators import colors as C
from merchgrid.operators import feedback as B
from merchgrid.operators import intake as N
from merchgrid.operators import matching as M
from merchgrid.operators import pages as P
from merchgrid.operators import policy as Y
from merchgrid.operators import review as R
from merchgrid.plans import core
from merchgrid.plans.catalog import _IMG, _MATCH, _NORM, _unicode_words
from merchgrid.plans.matching import _HITS, _LEV, _MEAN
from merchgrid.plans.sql import r, with_tables
from merchgrid.sources import readers as S
from merchgrid.streaming import jobs as J

PROPOSALS = [
    B.Proposal("title_gate.word_overlap", 0.225), B.Proposal("title_gate.title_similarity", 0.6), B.Proposal("pipeline.candidate_skip", 40.0),
    B.Proposal("resolver.foreign_product_penalty", -10.0), B.Proposal("post_extraction.pass_threshold", 40.0), B.Proposal("post_extraction.title_weight", 30.0),
]


# -- intake -----------------------------------------------------------------------
def known_colors(spark, sf):
    k = N.known_colors(Tables(spark, sf).variants_with_options())
    return k.select("product_id", "color", F.col("first_at.variant_id").alias("first_variant"), F.coalesce("catalog_image", F.lit("")).alias("catalog_image"))


def _needs(t):
    s = core.scores(t).select("product_id", "handle", "vendor", F.col("has_product_image").alias("has_image"), F.col("has_all_variant_images").alias("has_variant_images"), "has_description")
    return N.needs(s)


def route_status(spark, sf):
    t = Tables(spark, sf)
    cached = t.handles().where("product_id % 5 = 2").select("handle")
    return N.route(_needs(t), t.vendors(), cached).select("product_id", "needs_description", "needs_images", "needs_variant_images", "status")


def catalog_direct(spark, sf):
    t = Tables(spark, sf)
    k = N.known_colors(t.variants_with_options())
    return N.catalog_direct(_needs(t), k).select("product_id", "colors", "confidence")


def color_image_merge(spark, sf):
    t = Tables(spark, sf)
    k = N.known_colors(t.variants_with_options()).where("catalog_image is not null")
    cat = k.select("product_id", "color", F.col("first_at.position").cast("bigint").alias("ord"), F.col("catalog_image").alias("url"))
    return N.merge_color_images(t.color_map().where("color <> '__all__'"), cat).select("product_id", "color", "url")


def store_colors(spark, sf):
    t = Tables(spark, sf)
    return N.keep_store_colors(t.color_map(), t.variants_with_options()).select("product_id", "color", "ord")


def variant_image_rows(spark, sf):
    t = Tables(spark, sf)
    out = N.expand_variant_images(t.color_map(), t.variants_with_options(), t.handles())
    return out.withColumn("confidence", F.col("confidence").cast("bigint"))


def color_variants(spark, sf):
    t = Tables(spark, sf)
    wanted = t.page_colors().select("product_id", F.col("candidate").alias("color")).unionByName(t.handles().select("product_id", F.lit("XL").alias("color")))
    return N.color_variants(t.variants(), wanted)


def image_pairs(spark, sf):
    return C.image_pairs(Tables(spark, sf).variants())


def selected_images(spark, sf):
    t = Tables(spark, sf)
    m = t.color_map().where("color <> '__all__'")
    proposed = m.where("ord % 2 = 0").select("product_id", (F.col("ord") + 1).alias("position"), "url")
    return C.selected_images(t.variants_with_options(), m, proposed)


def output_policy(spark, sf):
    o = Tables(spark, sf).outputs().withColumn("title", F.element_at(F.split("text", "\n"), 1))
    flags = F.array_join("policy_flags", "; ")
    # exploded and not filtered: a filter would go below the dealing of the rows, and test every pattern a second time there
    return Y.output_flags(o).select("handle", F.explode(F.filter(F.array(flags), lambda f: f != "")).alias("flags"))


def mismatch_vendors(spark, sf):
    t = Tables(spark, sf)
    v = t.raw("part").select(F.col("p_brand").alias("vendor"), F.when(F.col("p_partkey") % 7 < 2, "mismatch").otherwise("match").alias("verdict"))
    return R.mismatch_vendors(v)


def collection_lookup(spark, sf):
    t = Tables(spark, sf)
    p = S.collection_products(S.list_products(t.products(), vendor="Brand#2"), t.collection_members(), "promo")
    return S.variants_by(t.variants(), p, "product_id").select("variant_id", "product_id", "sku")


# -- pages ------------------------------------------------------------------------
def page_extract(spark, sf):
    e = P.extract(Tables(spark, sf).raw("pages"))
    return e.select("page_id", "product_name", "page_title", F.size("description_blocks").cast("bigint").alias("blocks"), F.array_join("feature_bullets", "\n").alias("bullets"),
                    F.array_join("description_blocks", "\n").alias("text"), F.array_join(F.transform("images", lambda i: i["url"]), "\n").alias("images"),
                    F.coalesce("offers_price", F.lit("")).alias("price"), "canonical_url")


def page_titles(spark, sf):
    e = P.source_text(P.elements(Tables(spark, sf).raw("pages")))
    return e.select("page_id", "page_title", P.first_text(P.of_tags("h1")).alias("h1"), F.size(P.of_tags("li")).cast("bigint").alias("items"),
                    F.size(P.of_tags("p")).cast("bigint").alias("paragraphs"))


# -- review -------------------------------------------------------------------------
def apply_summary(spark, sf):
    s = B.apply_summary(Tables(spark, sf).changes())
    return s.withColumn("approval_rate", half_up(F.col("approval_rate"), 6))


def disposition_join(spark, sf):
    t = Tables(spark, sf)
    lab = t.raw("labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("handle"), F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "rejected").otherwise("skip").alias("status"),
        F.when(F.col("toxic") == 1, "toxic").alias("reason"), F.lit(None).cast("string").alias("edited_body_html"))
    return B.apply_dispositions(t.changes(), lab).select("handle", "status", "reason")


def feedback_rows(spark, sf):
    f = B.collect_feedback(Tables(spark, sf).changes())
    return f.select("handle", "run_id", "disposition", "reason", F.length("final_html").cast("bigint").alias("final_chars"), F.col("confidence").cast("bigint").alias("confidence"))


def feedback_summary(spark, sf):
    s = B.feedback_summary(B.collect_feedback(Tables(spark, sf).changes()))
    return s.withColumn("approval_rate", half_up(F.col("approval_rate"), 6))


def rejection_reasons(spark, sf):
    return B.rejection_reasons(B.collect_feedback(Tables(spark, sf).changes()))


def change_plan(spark, sf):
    c = R.change_plan(Tables(spark, sf).changes())
    return c.select("handle", "body_changed", *[F.col(n).cast("bigint").alias(n) for n in ("kept", "added", "removed")])


def review_rows(spark, sf):
    c = R.review_rows(Tables(spark, sf).changes())
    return c.select("handle", "confidence_class", "missing_fields", F.col("kept").cast("bigint").alias("kept"))


def undo_plan(spark, sf):
    return R.undo_plan(Tables(spark, sf).manifest())


def undo_totals(spark, sf):
    return R.undo_totals(R.undo_plan(Tables(spark, sf).manifest()))


def vendor_capped_batch(spark, sf):
    t = Tables(spark, sf)
    tested = t.handles().where("product_id % 3 = 0").select("handle")
    b = R.next_batch(core.scores(t), tested, t.vendors(), ["Brand#2", "Brand#7"], 30)
    return b.select("product_id", "vendor", half_up(F.col("priority_score"), 3).alias("priority_score"))


def resume_antijoin(spark, sf):
    t = Tables(spark, sf)
    done = t.handles().where("product_id % 2 = 0").select("handle")
    return R.resume(t.products().select("product_id", "handle", "vendor"), done, ["handle"])


def run_status(spark, sf):
    t = Tables(spark, sf)
    return R.run_summary(N.route(_needs(t), t.vendors(), t.handles().where("product_id % 5 = 2").select("handle")))


def regression_check(spark, sf):
    t = Tables(spark, sf)
    c = t.search_results()
    scored = c.withColumn("confidence", M.url_score(F.col("url"), F.col("title"), F.col("product_title")).cast("int"))
    recorded = c.where("ord = product_id % 3").select("product_id", F.when(F.col("product_id") % 10 == 0, "").otherwise(F.col("url")).alias("final_url"))
    return R.regression_check(scored, recorded).groupBy("verdict").agg(F.count(F.lit(1)).alias("products"))


# -- feedback loop --------------------------------------------------------------------
def _decisions(spark, sf):
    return B.normalize_decisions(Tables(spark, sf).decisions())


def failure_clusters(spark, sf):
    c = B.failure_clusters(_decisions(spark, sf))
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    num = lambda n: F.coalesce(F.col(n), F.lit(-1.0)).alias(n)
    return c.select("outcome", "failures", blank("common_vendor"), blank("common_type"), "actionable", "penalty_stacking", blank("param"), num("current_value"), num("proposed_value"),
                    F.coalesce("hits", F.lit(0)).alias("hits"))


def cluster_handles(spark, sf):
    return B.cluster_handles(_decisions(spark, sf))


def _edit(a, b, needed=None):
    return edit_ratio(a, b)


def replay_diff(spark, sf):
    c = B.replay(_decisions(spark, sf), PROPOSALS)
    return c.select("parameter", "decision_id", "ord", "change", "new_confidence")


def replay_diff_edit(spark, sf):
    c = B.replay(_decisions(spark, sf), PROPOSALS, similarity=_edit)
    return c.select("parameter", "decision_id", F.col("ord").cast("bigint").alias("ord"), "change", F.coalesce("new_confidence", F.lit(-1.0)).alias("new_confidence"))


def replay_summary(spark, sf):
    d = _decisions(spark, sf)
    return B.replay_summary(d, B.replay(d, PROPOSALS, similarity=_edit), PROPOSALS)


def outcome_histogram(spark, sf):
    return B.outcome_histogram(Tables(spark, sf).decisions())


def iteration_results(spark, sf):
    i = B.iteration_results(Tables(spark, sf).iteration_scores())
    return i.select(F.col("iteration").cast("bigint").alias("iteration"), F.col("max_score").cast("bigint").alias("max_score"),
                    *[half_up(F.col(c), 6).alias(c) for c in ("avg_structure", "avg_length", "avg_anti_hype", "avg_coverage", "avg_score")])


def iteration_compare(spark, sf):
    c = B.iteration_compare(B.iteration_results(Tables(spark, sf).iteration_scores()))
    return c.select("iterations", F.col("best_iteration").cast("bigint").alias("best_iteration"), *[half_up(F.col(x), 6).alias(x) for x in ("baseline_avg", "best_avg", "improvement")])


def campaign_metrics(spark, sf):
    p = Tables(spark, sf).raw("part").select(F.col("p_brand").alias("vendor"), (F.col("p_partkey") % 16 / F.lit(1024.0)).alias("cost"), (F.col("p_partkey") % 101).alias("confidence"))
    return B.campaign_metrics(p).select("vendor", "products", *[half_up(F.col(c), 6).alias(c) for c in ("cost_per_product", "avg_confidence", "efficiency")])


# -- traffic windows (the batch form of the streaming jobs) ------------------------------
def rolling_signals(spark, sf):
    t = Tables(spark, sf)
    ev = t.raw("events").withColumn("product_id", F.col("event_id") % t.part_count())
    s = J.rolling_signals(ev)
    return s.select(F.datediff(F.to_date("window_start"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("start_day"), "product_id", "sessions", "orders", half_up(F.col("revenue"), 2).alias("revenue"),
                    half_up(F.col("opportunity_gap"), 6).alias("opportunity_gap"))


def daily_outcomes(spark, sf):
    d = Tables(spark, sf).decisions().select(F.timestamp_seconds(F.col("ts") * 60).alias("timestamp"), "vendor", "outcome")
    o = J.outcome_counts(d)
    return o.select((F.unix_seconds("window_start") / 86400).cast("bigint").alias("start_day"), "vendor", "outcome", "decisions")


QUERIES = {f.__name__: f for f in (
    known_colors, route_status, catalog_direct, color_image_merge, store_colors, variant_image_rows, color_variants, image_pairs, selected_images, output_policy, mismatch_vendors, collection_lookup, page_extract, page_titles, apply_summary,
    disposition_join, feedback_rows, feedback_summary, rejection_reasons, change_plan, review_rows, undo_plan, undo_totals, vendor_capped_batch, resume_antijoin,
    run_status, regression_check, failure_clusters, cluster_handles, replay_diff, replay_diff_edit, replay_summary, outcome_histogram, iteration_results,
    iteration_compare, campaign_metrics, rolling_signals, daily_outcomes,
)}

# ---------------------------------------------------------------- oracles
_VENDORS = {
    "vend": "SELECT DISTINCT p_brand AS vendor, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part",
    "vendors_": "SELECT vendor, n % 4 = 1 AS blocked, n % 8 = 1 AS house FROM vend WHERE n % 6 <> 5",
    "needs_": """SELECT product_id, handle, vendor, NOT has_description AS nd, NOT has_product_image AS ni, NOT has_all_variant_images AS nv FROM audited""",
    "routed": """SELECT product_id, nd AS needs_description, ni AS needs_images, nv AS needs_variant_images,
        CASE WHEN NOT nd AND NOT ni AND NOT nv THEN 'SKIPPED_NO_GAPS' WHEN v.vendor IS NULL THEN 'SKIPPED_VENDOR_NOT_CONFIGURED'
             WHEN blocked AND NOT house THEN 'IMAGE_SEARCH_ONLY' WHEN blocked THEN 'SKIPPED_VENDOR_NOT_CONFIGURED' WHEN product_id % 5 = 2 THEN 'CACHED' ELSE 'PROCESS' END AS status
      FROM needs_ LEFT JOIN vendors_ v USING (vendor)""",
}
_OPT = _IMG | _MATCH | {
    "vopt": """SELECT v.*, CASE WHEN option1_name = 'Color' THEN option1_value ELSE '' END AS color, option2_value AS size, catalog_image FROM variants v LEFT JOIN barcodes USING (barcode)""",
    "kc": """SELECT product_id, color, min(position) AS first_pos, arg_min(variant_id, position) AS first_variant, arg_max(catalog_image, position) FILTER (catalog_image IS NOT NULL) AS catalog_image
      FROM vopt WHERE color <> '' GROUP BY 1, 2""",
    "cmap": """SELECT product_id, CASE WHEN product_id % 8 = 3 AND ord <= 1 THEN '__all__' ELSE candidate END AS color, ord,
        'https://scraped.example.com/' || product_id || '/' || ord || '.jpg' AS url, product_id % 50 + 50 AS confidence FROM page_colors WHERE product_id % 8 <> 7""",
}


def _tier(a: str, an: str, b: str, bn: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 1 WHEN {an} = {bn} THEN 2 WHEN length({an}) <= length({bn}) AND length({an}) > 0 AND contains({bn}, {an}) AND length({an}) * 2 > length({bn}) THEN 3 "
            f"WHEN length({an}) > length({bn}) AND length({bn}) > 0 AND contains({an}, {bn}) AND length({bn}) * 2 > length({an}) THEN 3 END")


_N = lambda c: _NORM.format(c=c)
_EXPAND = _OPT | {
    "vcols": f"SELECT DISTINCT product_id, color, {_N('color')} AS n FROM vopt WHERE color <> ''",
    "mcols": f"SELECT product_id, color AS mc, min(ord) AS ord, arg_min(url, ord) AS url, arg_min(confidence, ord) AS confidence, {_N('color')} AS mn FROM cmap WHERE color <> '__all__' GROUP BY product_id, color",
    "mm": f"""SELECT * FROM (SELECT v.product_id, v.color, url, confidence, row_number() OVER (PARTITION BY v.product_id, v.color ORDER BY {_tier('v.color', 'n', 'mc', 'mn')}, ord) AS rn
      FROM vcols v JOIN mcols m ON v.product_id = m.product_id WHERE {_tier('v.color', 'n', 'mc', 'mn')} IS NOT NULL) WHERE rn = 1""",
    "heroes": "SELECT product_id, arg_min(url, ord) AS url, any_value(confidence) AS confidence FROM cmap WHERE color = '__all__' GROUP BY 1",
}
_MERGE = _OPT | {
    "sc": f"SELECT product_id, color AS mc, ord, url, {_N('color')} AS mn FROM cmap WHERE color <> '__all__'",
    "ct": f"SELECT product_id, color, first_pos AS ord, catalog_image AS url, {_N('color')} AS n FROM kc WHERE catalog_image IS NOT NULL",
    "cm": f"""SELECT * FROM (SELECT c.product_id, c.color, mc, row_number() OVER (PARTITION BY c.product_id, c.color ORDER BY {_tier('c.color', 'n', 'mc', 'mn')}, s.ord) AS rn
      FROM ct c JOIN sc s ON c.product_id = s.product_id WHERE {_tier('c.color', 'n', 'mc', 'mn')} IS NOT NULL) WHERE rn = 1""",
    "mrows": f"""SELECT product_id, mc AS color, ord, url FROM sc UNION ALL
      SELECT ct.product_id, coalesce(mc, ct.color), ord + 1000000, url FROM ct LEFT JOIN cm ON cm.product_id = ct.product_id AND cm.color = ct.color""",
    "mnorm": f"SELECT *, {_N('color')} AS norm FROM mrows",
}
_SF = lambda c: f"replace(replace(lower({c}), ' | ', ' / '), '|', '/')"
_STORE = _OPT | {
    "ss": f"SELECT DISTINCT product_id, {_SF('color')} AS s FROM vopt WHERE color <> ''",
    "kept_": f"""SELECT m.product_id, m.color, m.ord FROM cmap m WHERE m.color = '__all__' OR NOT EXISTS (SELECT 1 FROM ss WHERE ss.product_id = m.product_id)
        OR EXISTS (SELECT 1 FROM ss WHERE ss.product_id = m.product_id AND (starts_with({_SF('m.color')}, s) OR starts_with(s, {_SF('m.color')}) OR split_part({_SF('m.color')}, ' / ', 1) = split_part(s, ' / ', 1)))""",
}
_FLAGS = ", ".join(f"CASE WHEN regexp_matches(body_html, '(?i){_unicode_words(p)}') THEN '{m.replace(chr(39), chr(39) * 2)}' END" for p, m in Y.PROHIBITED)
# An HTML parser also decodes an entity that lost its semicolon.
_UNESC = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'))"

_CHANGES = {
    "changes_": """SELECT *, doc_id % 101 AS confidence, 'run_' || (doc_id % 3) AS run_id,
        CASE WHEN quality IS NULL THEN 'pending' WHEN doc_id % 11 = 0 THEN 'applied' WHEN doc_id % 13 = 0 THEN 'reverted' WHEN doc_id % 7 = 0 AND quality = 1 THEN 'edited'
             WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status FROM outputs""",
    "ch": """SELECT *, CASE WHEN nu > 0 THEN 'toxic' WHEN status = 'rejected' AND doc_id % 2 = 0 THEN 'off topic' ELSE '' END AS reason,
        CASE WHEN status = 'edited' THEN '<b>x</b>' || body_html ELSE '' END AS edited,
        list_distinct(list_transform(range(1, doc_id % 4 + 2), lambda i: (doc_id + i * 2) % 7)) AS cur, list_distinct(list_transform(range(1, doc_id % 3 + 2), lambda i: (doc_id + i * 3) % 7)) AS new FROM changes_""",
    "fb": """SELECT handle, run_id, confidence, CASE WHEN status IN ('approved', 'rejected', 'edited') THEN status WHEN reason <> '' THEN 'rejected' WHEN edited <> '' THEN 'edited' ELSE 'approved' END AS disposition,
        CASE WHEN status IN ('rejected', 'applied', 'reverted') THEN reason ELSE '' END AS reason,
        CASE status WHEN 'rejected' THEN '' WHEN 'edited' THEN edited ELSE body_html END AS final_html FROM ch WHERE status <> 'pending'""",
}
_UNDO = {
    "mani": f"""SELECT 'run_' || (p_partkey % 3) AS run_id, replace(p_name, ' ', '-') || '-' || p_partkey AS handle, p_name, p_partkey AS p FROM part""",
    "acts": """SELECT run_id, handle, 'delete_image' AS action, (p * 10 + unnest(range(1, p % 4 + 2)))::VARCHAR AS target, '' AS value FROM mani WHERE p % 5 <> 0
      UNION ALL SELECT * FROM (SELECT run_id, handle, 'restore_variants', i::VARCHAR, i || ',' || (i + 1) FROM (SELECT *, p * 10 + unnest(range(1, p % 3 + 2)) AS i FROM mani) WHERE i % 2 = 0)
      UNION ALL SELECT run_id, handle, 'restore_body', handle, p_name FROM mani WHERE p % 4 <> 0""",
}
_DEC = {
    "dec": """SELECT p_partkey AS p, k, 'h-' || (p_partkey % 700) AS handle, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS vendor, CASE WHEN p_partkey % 9 = 0 THEN 'bolt' ELSE '' END AS kind,
        CASE WHEN p_partkey % 3 = 1 THEN p_name || ' Low ' || (p_partkey % 50) ELSE p_name END AS catalog_title,
        ['accept', 'reject_title_gate', 'reject_bot_blocked', 'skip_low_confidence', 'reject_post_extraction', 'accept', 'reject_title_gate'][((p_partkey * 3 + k * 5) % 7)::INT + 1] AS outcome,
        ((p_partkey * 7 + k * 13) % 100)::DOUBLE AS rc, CASE WHEN (p_partkey + k) % 5 <> 0 THEN ((p_partkey * 3 + k) % 100)::DOUBLE END AS conf,
        CASE (p_partkey + k) % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' boots deluxe edition' ELSE 'spare catalog entry' END AS page_title,
        (p_partkey + k * 11) % 100 / 100.0::DOUBLE AS m_ts, (p_partkey * 3 + k) % 50 / 100.0::DOUBLE AS m_wo, p_partkey % 2 = 0 AS even, (p_partkey + k) % 4 = 0 AS fpen,
        (p_partkey * 11 + k) % 100 / 100.0::DOUBLE AS st, (p_partkey * 5 + k) % 100 / 100.0::DOUBLE AS sp, (p_partkey * 3 + k * 7) % 100 / 100.0::DOUBLE AS sc, ((p_partkey + k) % 2)::DOUBLE AS sq
      FROM part, range(3) t(k)""",
    "failed": "SELECT * FROM dec WHERE outcome LIKE 'reject_%' OR outcome LIKE 'skip_%'",
    "bands": """SELECT outcome, 1 AS rk, 'title_gate.word_overlap' AS param, 0.3::DOUBLE AS cur, count(*) AS hits, min(m_wo) AS lo FROM failed WHERE m_wo BETWEEN 0.3::DOUBLE * 0.8::DOUBLE AND 0.3::DOUBLE GROUP BY 1
      UNION ALL SELECT outcome, 2, 'title_gate.title_similarity', 0.4::DOUBLE, count(*), min(m_ts) FROM failed WHERE m_ts BETWEEN 0.4::DOUBLE * 0.8::DOUBLE AND 0.4::DOUBLE GROUP BY 1""",
    "props": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY rk) AS rn FROM bands WHERE outcome NOT IN ('reject_bot_blocked')) WHERE rn = 1",
}
_GATED = _DEC | {
    "g1": f"""SELECT *, len(list_intersect({_MEAN('catalog_title')}, {_MEAN('page_title')}))::DOUBLE / greatest(len({_MEAN('catalog_title')}), 1) AS ov,
        {_LEV.format(a='lower(page_title)', b='lower(catalog_title)')} AS sim FROM dec WHERE outcome NOT IN ('reject_bot_blocked', 'skip_low_confidence')""",
    "g2": """SELECT *, parameter, CASE WHEN parameter = 'title_gate.title_similarity' THEN v ELSE 0.4::DOUBLE END AS ts, CASE WHEN parameter = 'title_gate.word_overlap' THEN v ELSE 0.3::DOUBLE END AS tw
      FROM g1, (VALUES ('title_gate.word_overlap', 0.225::DOUBLE), ('title_gate.title_similarity', 0.6::DOUBLE)) q(parameter, v)""",
    "g3": """SELECT parameter, p AS decision_id, k::BIGINT AS ord, CASE WHEN outcome = 'reject_title_gate' AND NOT (sim < ts AND ov < tw) THEN 'recovered'
        WHEN outcome <> 'reject_title_gate' AND NOT (sim < 0.4 AND ov < 0.3) AND sim < ts AND ov < tw THEN 'regressed' END AS change, -1.0::DOUBLE AS new_confidence FROM g2""",
    "s1": """SELECT 'pipeline.candidate_skip' AS parameter, p AS decision_id, k::BIGINT AS ord, CASE WHEN outcome = 'skip_low_confidence' AND rc >= 40 THEN 'recovered' WHEN outcome = 'accept' AND rc < 40 THEN 'regressed' END AS change FROM dec
      UNION ALL SELECT 'resolver.foreign_product_penalty', p, k, CASE WHEN NOT fpen OR NOT even THEN NULL WHEN outcome = 'skip_low_confidence' THEN CASE WHEN rc + 10 >= 50 THEN 'recovered' END
        WHEN rc + 10 < 50 THEN 'regressed' END FROM dec""",
    "s2": "SELECT parameter, decision_id, ord, change, -1.0::DOUBLE AS new_confidence FROM (SELECT *, row_number() OVER (PARTITION BY parameter, decision_id ORDER BY ord) AS rn FROM s1 WHERE change IS NOT NULL) WHERE rn = 1",
    "e1": """SELECT parameter, p AS decision_id, k::BIGINT AS ord, outcome, bar, st * w + sp * ((100.0::DOUBLE - w) * 25 / 60) + sc * ((100.0::DOUBLE - w) * 25 / 60) + sq * ((100.0::DOUBLE - w) * 10 / 60) AS nc
      FROM dec, (VALUES ('post_extraction.pass_threshold', 40.0::DOUBLE, 40.0::DOUBLE), ('post_extraction.title_weight', 30.0::DOUBLE, 50.0::DOUBLE)) q(parameter, w, bar) WHERE conf IS NOT NULL""",
    "e2": f"""SELECT parameter, decision_id, ord, CASE WHEN outcome = 'reject_post_extraction' AND nc >= bar THEN 'recovered' WHEN outcome <> 'reject_post_extraction' AND nc < bar THEN 'regressed' END AS change,
        {r('nc', 1)} AS new_confidence FROM e1""",
    "flips": "SELECT * FROM g3 WHERE change IS NOT NULL UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM e2 WHERE change IS NOT NULL",
}
_ITER = {
    "its": """SELECT i AS iteration, (doc_id + i * 3) % 26 AS a, (doc_id * 3 + i) % 16 AS b, (doc_id + i) % 16 AS c, (doc_id * 5 + i * 2) % 16 AS d, CASE WHEN doc_id % 10 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents, range(5) t(i)""",
    "itr": "SELECT iteration, avg(a) AS aa, avg(b) AS ab, avg(c) AS ac, avg(d) AS ad, sum((a + b + c + d) * w) / sum(w) AS avg_score, max(a + b + c + d) AS max_score FROM its GROUP BY 1",
}

# The article of a page as segments: each begins at an opening tag, and what follows an unclosed paragraph lies inside it.
_PAGE = {
    "marked_": """SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'),
        '<p><b>', chr(1) || 'O', 'g'), '<p>', chr(1) || 'P', 'g'), '<h1>', chr(1) || 'H', 'g'), '</(p|h1)>', chr(1) || 'X', 'g'), '<br>', '', 'g') AS m FROM pages""",
    "segments_": f"""SELECT page_id, nth, left(s, 1) AS kind, trim({_UNESC("substr(s, 2)")}, ' ' || chr(9) || chr(10) || chr(13)) AS said
        FROM (SELECT page_id, generate_subscripts(string_split(m, chr(1)), 1) AS nth, unnest(string_split(m, chr(1))) AS s FROM marked_) WHERE s <> ''""",
    "sized_": """SELECT *, CASE WHEN kind = 'O' THEN sum(length(said)) OVER (PARTITION BY page_id ORDER BY nth DESC) > 20 WHEN kind = 'X' THEN false ELSE length(said) > 20 END AS visible FROM segments_""",
    "owned_": """SELECT page_id, nth, said, CASE WHEN visible THEN nth ELSE max(CASE WHEN kind = 'O' AND visible THEN nth END) OVER (PARTITION BY page_id ORDER BY nth) END AS owner FROM sized_""",
    "own_": """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY owner) AS nth, t FROM (SELECT page_id, owner, string_agg(said, '' ORDER BY nth) AS t FROM owned_ WHERE owner IS NOT NULL GROUP BY 1, 2)
        WHERE t <> '' AND NOT regexp_matches(t, '(?i)(regular price|sale price|starting at|\\$\\d+\\.\\d{2})|open media \\d+ in modal') AND NOT regexp_matches(t, '^[\\w\\s'']+(>|/|›|»)[\\w\\s'']+((>|/|›|»)[\\w\\s'']+)*$')""",
    "fold_": """SELECT page_id, 0::BIGINT AS nth, []::VARCHAR[] AS kept FROM pages UNION ALL
        SELECT f.page_id, o.nth, CASE WHEN list_contains(kept, t) OR (length(t) < 200 AND len(list_filter(kept, lambda b: contains(b, t) OR contains(t, b))) > 0) THEN kept ELSE list_append(kept, t) END
        FROM fold_ f JOIN own_ o ON o.page_id = f.page_id AND o.nth = f.nth + 1""",
    "folded_": "SELECT page_id, arg_max(kept, nth) AS kept FROM fold_ GROUP BY 1",
}

ORACLES = {
    "page_extract": with_tables(f"""SELECT p.page_id, {_UNESC("regexp_extract(html, '<h1[^>]*>([^<]*)', 1)")} AS product_name, {_UNESC("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS page_title,
        len(kept) AS blocks, '' AS bullets, array_to_string(kept, chr(10)) AS text, '' AS images, '' AS price, url AS canonical_url FROM pages p JOIN folded_ USING (page_id)""", _PAGE).replace("WITH ", "WITH RECURSIVE ", 1),
    "known_colors": with_tables("SELECT product_id, color, first_variant, coalesce(catalog_image, '') AS catalog_image FROM kc", _OPT),
    "route_status": with_tables("SELECT * FROM routed", _VENDORS),
    "run_status": with_tables("SELECT CASE WHEN status LIKE 'SKIPPED%' THEN 'SKIPPED' ELSE status END AS status, count(*) AS rows FROM routed GROUP BY 1", _VENDORS),
    "catalog_direct": with_tables(f"""SELECT n.product_id, count(*) AS colors, 90 AS confidence FROM needs_ n JOIN kc k ON k.product_id = n.product_id WHERE NOT nd GROUP BY 1
        HAVING count(*) = count(*) FILTER (EXISTS (SELECT 1 FROM kc o WHERE o.product_id = k.product_id AND o.catalog_image IS NOT NULL AND {_tier('k.color', _N('k.color'), 'o.color', _N('o.color'))} IS NOT NULL))""", _VENDORS | _OPT),
    "color_image_merge": with_tables("""SELECT DISTINCT m.product_id, l.color, m.url FROM mnorm m JOIN (SELECT product_id, norm, arg_min(color, (ord, color)) AS color FROM mnorm GROUP BY 1, 2) l
        ON l.product_id = m.product_id AND l.norm = m.norm""", _MERGE),
    "store_colors": with_tables("SELECT * FROM kept_", _STORE),
    "variant_image_rows": with_tables("""SELECT v.product_id, variant_id, sku, CASE WHEN color <> '' THEN 'Color' ELSE 'Size' END AS option_name, CASE WHEN color <> '' THEN color ELSE size END AS option_value, h.url AS image,
          h.confidence, 'EXPANDED_FROM_ALL' AS warning FROM vopt v JOIN heroes h USING (product_id)
        UNION ALL SELECT v.product_id, variant_id, sku, 'Color', v.color, mm.url, mm.confidence, '' FROM vopt v JOIN mm ON mm.product_id = v.product_id AND mm.color = v.color
        UNION ALL SELECT product_id, 0, '', 'Color', mc, url, confidence, 'NO_VARIANT_DATA' FROM mcols WHERE product_id NOT IN (SELECT product_id FROM vopt)
        UNION ALL SELECT product_id, 0, '', '__all__', '', url, confidence, 'ASSIGN_TO_ALL_VARIANTS' FROM heroes WHERE product_id NOT IN (SELECT product_id FROM vopt)
        UNION ALL SELECT product_id, 0, '', 'Color', '', '', 0, 'VARIANT_IMAGE_NOT_ASSIGNED' FROM handles WHERE product_id NOT IN (SELECT product_id FROM cmap)""", _EXPAND),
    "color_variants": with_tables("""SELECT DISTINCT v.product_id, variant_id, w.color FROM variants v JOIN (SELECT product_id, candidate AS color FROM page_colors UNION ALL SELECT product_id, 'XL' FROM handles) w
        ON w.product_id = v.product_id AND (w.color = option1_value OR w.color = option2_value)""", _MATCH),
    "image_pairs": with_tables("""SELECT product_id, option1_value AS color, split_part(image_src, '?', 1) AS image_url, arg_min(variant_id, position) AS variant_id, arg_min(image_src, position) AS image_src
        FROM variants WHERE option1_value <> '' AND image_src <> '' GROUP BY 1, 2, 3"""),
    "selected_images": with_tables("""SELECT product_id, color, url, CASE WHEN o % 2 = 0 THEN o + 1 ELSE 0 END AS position FROM mm JOIN (SELECT product_id, url, min(ord) AS o FROM cmap GROUP BY 1, 2) USING (product_id, url)""", _EXPAND),
    "output_policy": with_tables(f"""SELECT handle, concat_ws('; ', CASE WHEN body_html <> '' THEN nullif(concat_ws('; ', {_FLAGS}), '') END, CASE WHEN t <> '' THEN
          CASE WHEN trim(t) = '' THEN 'Title is empty' ELSE nullif(concat_ws('; ', CASE WHEN length(t) > 150 THEN 'Title exceeds 150 characters (' || length(t) || ')' END,
          CASE WHEN t = upper(t) AND length(t) > 10 THEN 'Title is all caps (GMC may flag as spammy)' END, CASE WHEN regexp_matches(t, '[!]{{2,}}|[?]{{2,}}') THEN 'Title contains excessive punctuation' END), '') END END) AS flags
        FROM (SELECT *, string_split(text, chr(10))[1] AS t FROM outputs) WHERE flags <> ''"""),
    "mismatch_vendors": "SELECT p_brand AS vendor, count(*) AS mismatches FROM part WHERE p_partkey % 7 < 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "collection_lookup": with_tables("SELECT variant_id, product_id, sku FROM variants WHERE product_id IN (SELECT product_id FROM products JOIN part ON p_partkey = product_id WHERE vendor = 'Brand#2' AND status = 'active' AND p_type = 'PROMO')"),
    "page_titles": f"""SELECT page_id, {_UNESC("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS page_title, {_UNESC("regexp_extract(html, '<h1[^>]*>([^<]*)', 1)")} AS h1,
        len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""",
    "apply_summary": with_tables(f"""SELECT run_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IN ('approved', 'edited')) AS approved,
        count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'applied') AS applied,
        {r("(count(*) FILTER (status IN ('approved', 'edited')))::DOUBLE / greatest(count(*) FILTER (status <> 'pending'), 1)", 6)} AS approval_rate FROM ch GROUP BY 1""", _CHANGES),
    "disposition_join": with_tables("""SELECT handle, CASE WHEN l.quality = 1 THEN 'approved' WHEN l.toxic = 1 THEN 'rejected' ELSE status END AS status,
        CASE WHEN l.quality <> 1 AND l.toxic = 1 THEN 'toxic' ELSE reason END AS reason FROM ch LEFT JOIN labels l ON l.doc_id = ch.doc_id""", _CHANGES),
    "feedback_rows": with_tables("SELECT handle, run_id, disposition, reason, length(final_html) AS final_chars, confidence FROM fb", _CHANGES),
    "feedback_summary": with_tables(f"""SELECT count(*) AS total, count(*) FILTER (disposition = 'approved') AS approved, count(*) FILTER (disposition = 'rejected') AS rejected, count(*) FILTER (disposition = 'edited') AS edited,
        {r("(count(*) FILTER (disposition = 'approved'))::DOUBLE / greatest(count(*), 1)", 6)} AS approval_rate FROM fb""", _CHANGES),
    "rejection_reasons": with_tables("SELECT reason, count(*) AS entries FROM fb WHERE disposition = 'rejected' AND reason <> '' GROUP BY 1", _CHANGES),
    "change_plan": with_tables("""SELECT handle, trim(body_html) <> '' AND body_html <> CASE WHEN doc_id % 4 = 0 THEN body_html ELSE '<p>old</p>' END AS body_changed, len(list_intersect(cur, new))::BIGINT AS kept,
        (len(new) - len(list_intersect(cur, new)))::BIGINT AS added, (len(cur) - len(list_intersect(cur, new)))::BIGINT AS removed FROM ch""", _CHANGES),
    "review_rows": with_tables("""SELECT handle, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS confidence_class,
        CASE WHEN doc_id % 5 = 0 THEN 'product_type,tags' ELSE 'tags' END AS missing_fields, len(list_intersect(cur, new))::BIGINT AS kept FROM ch""", _CHANGES),
    "undo_plan": with_tables("SELECT * FROM acts", _UNDO),
    "undo_totals": with_tables("""SELECT run_id, count(DISTINCT handle) AS products, count(*) FILTER (action = 'delete_image') AS images_deleted, count(*) FILTER (action = 'restore_variants') AS variants_restored,
        count(*) FILTER (action = 'restore_body') AS bodies_restored FROM acts GROUP BY 1""", _UNDO),
    "vendor_capped_batch": with_tables(f"""SELECT product_id, vendor, {r('priority_score', 3)} AS priority_score FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY priority_score DESC, product_id) AS rn
        FROM audited WHERE gap_count > 0 AND product_id % 3 <> 0 AND vendor NOT IN ('Brand#2', 'Brand#7') AND vendor IN (SELECT vendor FROM vendors_)) b WHERE rn <= 3 ORDER BY b.priority_score DESC, product_id LIMIT 30""", _VENDORS),
    "resume_antijoin": with_tables("SELECT product_id, handle, vendor FROM products WHERE product_id % 2 <> 0"),
    "regression_check": with_tables("""SELECT CASE WHEN product_id % 10 = 0 THEN 'skipped' WHEN url = win THEN 'passed' ELSE 'regressed' END AS verdict, count(*) AS products
        FROM (SELECT product_id, ord, url, first_value(url) OVER (PARTITION BY product_id ORDER BY score DESC, ord) AS win FROM u4) WHERE ord = product_id % 3 GROUP BY 1""", _HITS),
    "failure_clusters": with_tables(f"""SELECT f.outcome, failures, coalesce(common_vendor, '') AS common_vendor, coalesce(common_type, '') AS common_type, f.outcome <> 'reject_bot_blocked' AS actionable,
        f.outcome <> 'reject_bot_blocked' AND stacked AND param IS NULL AS penalty_stacking, coalesce(param, '') AS param, coalesce(cur, -1.0::DOUBLE) AS current_value,
        CASE WHEN lo IS NULL THEN -1.0::DOUBLE ELSE {r('lo * 0.9::DOUBLE', 4)} END AS proposed_value, coalesce(hits, 0) AS hits
        FROM (SELECT outcome, count(*) AS failures, CASE WHEN min(nullif(vendor, '')) = max(nullif(vendor, '')) THEN min(nullif(vendor, '')) END AS common_vendor,
                CASE WHEN min(nullif(kind, '')) = max(nullif(kind, '')) THEN min(nullif(kind, '')) END AS common_type, bool_or(even) AS stacked FROM failed GROUP BY 1 HAVING count(*) >= 3) f
        LEFT JOIN props USING (outcome)""", _DEC),
    "cluster_handles": with_tables("SELECT outcome, handle, min(p) AS first_decision, count(*) AS failures FROM failed GROUP BY 1, 2", _DEC),
    "replay_diff_edit": with_tables("SELECT * FROM flips", _GATED),
    "replay_summary": with_tables("""SELECT parameter, proposed, count(*) FILTER (change = 'recovered') AS recovered, count(*) FILTER (change = 'regressed') AS regressed,
        (SELECT count(*) FROM part) - count(DISTINCT decision_id) AS unchanged FROM (VALUES """ + ", ".join(f"('{p.parameter}', {p.proposed}::DOUBLE)" for p in PROPOSALS) + """) q(parameter, proposed)
        LEFT JOIN flips USING (parameter) GROUP BY 1, 2""", _GATED),
    "outcome_histogram": with_tables("""SELECT outcome, count(*) AS handles FROM (SELECT handle, arg_max(o, p) AS outcome FROM (SELECT p, any_value(handle) AS handle, CASE WHEN bool_or(outcome = 'accept') THEN 'accept' ELSE 'no_match' END AS o
        FROM dec GROUP BY 1) GROUP BY 1) GROUP BY 1""", _DEC),
    "iteration_results": with_tables(f"SELECT iteration, max_score, {r('aa', 6)} AS avg_structure, {r('ab', 6)} AS avg_length, {r('ac', 6)} AS avg_anti_hype, {r('ad', 6)} AS avg_coverage, {r('itr.avg_score', 6)} AS avg_score FROM itr", _ITER),
    "iteration_compare": with_tables(f"""SELECT count(*) AS iterations, arg_max(iteration, (avg_score, -iteration)) AS best_iteration, {r('arg_min(avg_score, iteration)', 6)} AS baseline_avg, {r('max(avg_score)', 6)} AS best_avg,
        {r('max(avg_score) - arg_min(avg_score, iteration)', 6)} AS improvement FROM itr""", _ITER),
    "campaign_metrics": f"""SELECT vendor, count(*) AS products, {r('sum(cost) / count(*)', 6)} AS cost_per_product, {r('avg(conf)', 6)} AS avg_confidence,
        {r('CASE WHEN sum(cost) = 0 THEN 0 ELSE avg(conf) / (sum(cost) / count(*) * 100) END', 6)} AS efficiency
        FROM (SELECT p_brand AS vendor, p_partkey % 16 / 1024.0::DOUBLE AS cost, p_partkey % 101 AS conf FROM part) GROUP BY 1""",
    "rolling_signals": with_tables(f"""SELECT day AS start_day, pid AS product_id, sessions, orders, {r('revenue', 2)} AS revenue,
        {r('CASE WHEN sessions = 0 THEN 0 ELSE (1 - least(1.0::DOUBLE, orders::DOUBLE / sessions)) * least(sessions / 100.0::DOUBLE, 1.0::DOUBLE) END', 6)} AS opportunity_gap
        FROM (SELECT floor(epoch(ts) / 86400)::BIGINT - b AS day, pid, count(*) FILTER (event_type IN ('view', 'click')) AS sessions, count(*) FILTER (event_type = 'purchase') AS orders,
          coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue FROM ev, range(7) t(b) GROUP BY 1, 2)"""),
    "daily_outcomes": with_tables("""SELECT floor(p * 600 / 86400)::BIGINT AS start_day, vendor, o AS outcome, count(*) AS decisions FROM (SELECT p, any_value(vendor) AS vendor,
        CASE WHEN bool_or(outcome = 'accept') THEN 'accept' ELSE 'no_match' END AS o FROM dec GROUP BY 1) GROUP BY 1, 2, 3""", _DEC),
}
