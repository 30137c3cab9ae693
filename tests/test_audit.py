import random

from pyspark.sql import functions as F

from merchgrid.operators import audit as A
from merchgrid.operators import inventory as I
from merchgrid.operators import signals as G
from merchgrid.operators import weights as W


def products(spark, rows):
    return spark.createDataFrame(rows, "product_id long, handle string, title string, vendor string, product_type string, tags string, body_html string, status string")


def variants(spark, rows):
    return spark.createDataFrame(rows, "product_id long, variant_id long, position long, sku string, barcode string, price double, cost double, image_src string")


def no_signals(spark):
    online = spark.createDataFrame([], "title string, sessions long, conversion_rate double, online_revenue double, orders long, opportunity_gap double")
    listing = spark.createDataFrame([], "product_id long, clicks long, impressions long, ctr double, disapproved boolean, issues array<struct<issue string, n long>>, discovery_gap double")
    return online, listing


def test_gap_count_and_labels(spark):
    p = products(spark, [(1, "a", "A", "V", "T", "x", "", "active"), (2, "b", "B", "V", "T", "x", "<p>short</p>", "active"), (3, "c", "C", "Brand#25", "T", "x", "", "active")])
    v = variants(spark, [(1, 11, 1, "s1", "b1", 10.0, 5.0, "i.jpg"), (1, 12, 2, "s2", "b2", 20.0, 5.0, "")])
    inv = spark.createDataFrame([(1, 4, 100.0, 50.0)], "product_id long, total long, value double, full_price_value double")
    out = {r.product_id: r for r in A.audit(p, v, inv, *no_signals(spark)).collect()}
    assert set(out) == {1, 2}  # the house vendor is excluded
    assert out[1].gap_count == 1.0 and out[1].gaps == ["Missing description"]
    assert out[1].priority_score == 100.0 * 1.0 * 1.5
    assert (out[1].barcode, out[1].price) == ("b1", 15.0)
    # no variants: no product image, but no variant image is missing
    assert out[2].gaps == ["Missing product image", "Short description (5 chars)"] and out[2].gap_count == 2.0
    assert out[2].completeness_pct == 60.0


def test_opportunity_and_priority_with_signals(spark):
    r = spark.range(1).select(G.opportunity_gap(F.lit(50), F.lit(0.02)).alias("o"), G.discovery_gap(F.lit(0), F.lit(0.1)).alias("d")).first()
    assert abs(r.o - 0.49) < 1e-12 and r.d == 0.0


def test_listing_rollup_sums_variants(spark):
    listing = spark.createDataFrame(
        [("shopify_US_100", 10, 500, False, ["a"]), ("shopify_US_200", 5, 300, True, ["a", "b"]), ("shopify_US_10_999", 1, 100, False, []), ("bare", 9, 9, False, []), ("shopify_US_x", 1, 1, False, [])],
        "offer_id string, clicks long, impressions long, disapproved boolean, issues array<string>")
    v = spark.createDataFrame([(100, 10), (200, 10)], "variant_id long, product_id long")
    r = G.listing_by_product(listing, v).collect()
    assert len(r) == 1 and (r[0].product_id, r[0].clicks, r[0].impressions, r[0].disapproved) == (10, 16, 900, True)
    assert [(i.issue, i.n) for i in r[0].issues] == [("a", 2), ("b", 1)]
    assert abs(r[0].ctr - 16 / 900) < 1e-15


def test_status_last_row_wins_and_issues_per_context(spark):
    landed = spark.createDataFrame(
        [("o", 1, "DISAPPROVED", [("fix", [("ads", ["US"])])]), ("o", 2, "eligible", [("fix", [("ads", ["US"]), ("free", []), ("x", ["DE"])])])],
        "offer_id string, ord long, status string, item_issues array<struct<resolution string, contexts array<struct<context string, countries array<string>>>>>")
    r = G.listing_status(landed).first()
    assert r.disapproved is False and r.issues == ["fix", "fix"]


def test_lenient_numbers_and_paths(spark):
    df = spark.createDataFrame([("$1,200.50", "/products/a-b/?x=1"), ("n/a", "/pages/x"), (None, "/products/"), ("12%", "/products/z#t")], "v string, p string")
    rows = df.select(G.lenient_double(F.col("v")).alias("v"), G.handle_from_path(F.col("p")).alias("h")).collect()
    assert [r.v for r in rows] == [1200.5, 0.0, 0.0, 12.0]
    assert [r.h for r in rows] == ["a-b", "", "", "z"]


def test_velocity_fixture(spark):
    lines = spark.createDataFrame([(1, 8.0, "2024-01-20 00:00:00"), (1, 5.0, "2023-01-01 00:00:00")], "product_id long, units double, s string").withColumn("sold_at", F.to_timestamp("s"))
    r = I.sales_velocity(lines, F.to_timestamp(F.lit("2024-01-28 00:00:00"))).collect()
    assert [(x.product_id, x.units, x.weekly_avg) for x in r] == [(1, 8.0, 2.0)]


def score_rows(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"h{i}", f"v{rng.randint(0, 8)}", rng.randint(0, 5), 6, rng.randint(0, 400) * 1.0, rng.randint(0, 200) * 1.0, rng.randint(0, 90), rng.random(), rng.randint(0, 2000), rng.random(),
             rng.random() < 0.2, *[rng.random() < 0.6 for _ in range(5)]) for i in range(n)]
    return spark.createDataFrame(rows, "product_id long, handle string, vendor string, variants_missing_images int, variant_count int, inventory_value double, full_price_inventory_value double, online_sessions int, "
                                 "opportunity_gap double, listing_impressions int, discovery_gap double, listing_disapproved boolean, has_product_image boolean, has_all_variant_images boolean, has_description boolean, "
                                 "has_product_type boolean, has_tags boolean")


def test_sweep_equals_single_vectors_and_stays_in_range(spark):
    s = score_rows(spark)
    grid = W.weight_grid(seed=1, per_transform=2)
    swept = {r.weight_id: r for r in W.sweep(s, grid, top_n=20).collect()}
    for i in (0, 3, 6):
        one = W.coverage(s, grid[i][1], top_n=20).first()
        assert abs(one.composite - swept[i].composite) < 1e-12
    assert all(0 <= r.composite <= 1 for r in swept.values())
    best = W.best_vector(W.sweep(s, grid, top_n=20)).first()
    assert best.best_efficiency == max(r.composite for r in swept.values())
    assert best.baseline_efficiency == swept[0].composite


def test_weights_as_columns_equal_literals(spark):
    s = score_rows(spark)
    w = W.weight_grid(seed=5, per_transform=1)[2][1]
    joined = s.select("*", *[F.lit(v).alias("w_" + k) for k, v in w.__dict__.items()])
    diff = joined.select((A.priority(w.columns()) - A.priority({k: F.col("w_" + k) for k in w.__dict__})).alias("d")).where("abs(d) > 1e-9").count()
    assert diff == 0


def test_fused_rollup_equals_separate_tables(spark):
    rows = [(1, 10 + i, i, f"s{i}", f"b{i}", i * 1.25, i * 0.5, "x" if i == 3 else "", i % 4, i % 2 == 0) for i in range(6)]
    v = spark.createDataFrame(rows, "product_id long, variant_id long, position long, sku string, barcode string, price double, cost double, image_src string, qty long, on_sale boolean")
    fused = A.variant_rollup(v).first()
    apart = A.variant_stats(v).join(I.inventory_totals(v), "product_id").first()
    for c in ("variant_count", "any_image", "price", "cost", "total", "value", "full_price_value", "barcode", "sku"):
        assert fused[c] == apart[c]
