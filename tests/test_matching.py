import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from merchgrid.functions import urls as U
from merchgrid.functions.similarity import sequence_ratio
from merchgrid.operators import matching as M


def rows(spark, data):
    return spark.createDataFrame(data, "url string, title string, snippet string, product_title string, vendor string, price double, ord long")


def scores(spark, data, live=False):
    return {r.ord: (r.url_score, r.confidence, r.reasoning) for r in M.rescore(rows(spark, data), live=live).collect()}


def test_sequence_ratio_is_difflib(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc d") for _ in range(rng.randint(0, 260))), "".join(rng.choice("abc d") for _ in range(rng.randint(0, 260)))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = {r.i: r.s for r in df.select("i", sequence_ratio(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == SequenceMatcher(None, a, b).ratio()


def test_url_score_parts(spark):
    u = "https://v.example.com"
    got = scores(spark, [
        (u + "/products/alpine-jacket-x", "Alpine Jacket X", "", "Alpine Jacket X", "V", 0.0, 1),  # 50+20+10+5+5+10
        (u + "/products/", "shop", "", "", "V", 0.0, 2),                                         # bare listing: 50+10-25
        (u + "/shop/mens/tops/jackets", "Jackets", "", "", "V", 0.0, 3),                        # 50-10-15
        (u + "/collections/all?page=2", "Shop all | Official", "", "", "V", 0.0, 4),            # 50-20+10-15+5-15
    ])
    assert [got[i][0] for i in (1, 2, 3, 4)] == [100, 35, 25, 15]


def test_title_adjustments(spark):
    u = "https://v.example.com/p/1"
    base = lambda t: (u, t, "", "Reverb 99 Skis", "Acme", 0.0)
    got = scores(spark, [(*base("Reverb 99 Skis"), 1), (*base("Revolve 99 Skis"), 2), (*base("Reverb 88 Skis"), 3), (*base("Reverb 99 Boots"), 4), (*base("Reverb 99 Skis Limited"), 5), (*base("Womens Reverb 99 Skis"), 6)])
    assert "+title_match(100%)" in got[1][2] and got[1][1] == min(100, got[1][0] + 20)
    # offline: one foreign name for one missing costs 20, the boost still applies
    assert "-foreign_product(revolve)" in got[2][2]
    assert "-critical_mismatch" in got[3][2] and got[3][1] == got[3][0] - 30
    assert "-critical_mismatch" in got[4][2]
    assert "-collab_mismatch" in got[5][2]
    live = scores(spark, [(*base("Revolve 99 Skis"), 1), (*base("Banana 99 Skis"), 2)], live=True)
    assert "-near_homonym(revolvevsreverb)" in live[1][2] and live[1][1] == live[1][0] - 40
    assert "-foreign_product(banana)" in live[2][2] and live[2][1] == live[2][0] - 35


def test_clamps_apply_step_by_step(spark):
    # -25 and -15 from a low base stop at 0, so the later boost counts in full
    u = "https://v.example.com/search/shop/mens/a/b/c/d?page=1"
    got = scores(spark, [(u, "shop all Mid Limited Alpha One", "", "Alpha One", "V", 100.0, 1), ("https://v.example.com/p/1", "Alpha One", "now $110.00", "Alpha One", "V", 100.0, 2), ("https://v.example.com/p/1", "Alpha One", "$1,20", "Alpha One", "V", 100.0, 3)])
    base, conf, trail = got[1]
    assert base == 0 and "-asymmetric_height" in trail and "-collab_mismatch" in trail and conf == 20
    assert "+price_match($110≈$100)" in got[2][2]
    assert "+price_match($120≈$100)" in got[3][2]  # a decimal comma is dropped, not read


def test_vendor_prefix_is_cleaned(spark):
    df = spark.createDataFrame([("Acme - Alpha One", "acme"), ("Alpha One", "acme"), (None, "acme")], "t string, v string")
    assert [r.c for r in df.select(M.clean_title(F.col("t"), F.col("v")).alias("c")).collect()] == ["Alpha One", "Alpha One", ""]


def gate(spark, page, cat):
    return M.title_gate(spark.createDataFrame([(page, cat)], "page_title string, catalog_title string")).first()


def test_title_gate(spark):
    assert gate(spark, "Mens Alpha Jacket", "Women's Alpha Jacket").reason == "demographic_mismatch"
    ok = gate(spark, "Men's Alpha Jacket", "Mens Alpha Jacket")
    assert ok.passed and ok.demographic_match
    low = gate(spark, "Completely Different Zebra", "Quixotic Lamp")
    assert not low.passed and low.reason.startswith("title_similarity_too_low")
    assert gate(spark, "Alpha", "Alpha Jacket With Very Long Descriptive Name Of Everything").demographic_match is None


def test_post_extraction_signals(spark):
    df = spark.createDataFrame(
        [(1, "Alpha One", "Alpha One", 140.0, 100.0, ["Red", "Black"], ["red", "teal"], 30.0), (2, "", "Alpha One", None, 100.0, [], ["red"], 0.0)],
        "id long, product_name string, catalog_title string, scraped_price double, catalog_price double, catalog_colors array<string>, vendor_colors array<string>, content_score double")
    r = {x.id: x for x in M.post_extraction(df).collect()}
    assert (r[1].sig_title, r[1].sig_color, r[1].sig_quality) == (1.0, 0.5, 1.0) and abs(r[1].sig_price - 0.5) < 1e-9
    assert abs(r[1].match_confidence - (40 + 12.5 + 12.5 + 10)) < 1e-9 and r[1].match_passed
    assert (r[2].sig_title, r[2].sig_price, r[2].sig_color, r[2].match_confidence) == (0.0, 0.5, 0.5, 25.0)


def test_decisions_stop_at_the_first_accept(spark):
    cands = spark.createDataFrame([(1, f"u{i}", i, c, "Alpha One", 100.0, ["Red"]) for i, c in enumerate([90, 80, 70, 60])] + [(2, "u9", 0, 40, "Alpha One", 100.0, ["Red"])],
                                  "product_id long, url string, ord long, confidence int, catalog_title string, catalog_price double, catalog_colors array<string>")
    body = "# Alpha One\n" + "text " * 150
    pages = spark.createDataFrame([("u0", "Access denied", "Alpha One", 100.0, ["red"], 80.0), ("u1", body, "Alpha One", 100.0, ["red"], 80.0), ("u2", body, "Alpha One", 100.0, ["red"], 80.0)],
                                  "url string, markdown string, product_name string, scraped_price double, vendor_colors array<string>, content_score double")
    out = [(r.product_id, r.attempt, r.outcome) for r in M.decide(cands, pages).orderBy("product_id", "attempt").collect()]
    assert out == [(1, 1, "reject_bot_blocked"), (1, 2, "accept"), (2, 1, "skip_low_confidence")]


def test_every_candidate_is_tried_without_a_limit(spark):
    cands = spark.createDataFrame([(1, f"u{i}", i, 90 - i, "Alpha One", 100.0, ["Red"]) for i in range(5)],
                                  "product_id long, url string, ord long, confidence int, catalog_title string, catalog_price double, catalog_colors array<string>")
    body = "# Alpha One\n" + "text " * 150
    pages = spark.createDataFrame([(f"u{i}", body, "Alpha One", 100.0, ["red"], 80.0) for i in (3, 4)],
                                  "url string, markdown string, product_name string, scraped_price double, vendor_colors array<string>, content_score double")
    out = [(r.attempt, r.outcome) for r in M.decide(cands, pages, k=None).orderBy("attempt").collect()]
    assert out == [(1, "reject_bot_blocked"), (2, "reject_bot_blocked"), (3, "reject_bot_blocked"), (4, "accept")]


def test_best_heading(spark):
    md = "# Menu\n## Alpha Two\n## Alpha One Jacket\n### Alpha One Jacket again\n"
    r = spark.createDataFrame([(md, "Alpha One Jacket"), (md, "Zzz"), (None, "x")], "m string, t string").select(M.best_heading(F.col("m"), F.col("t")).alias("h")).collect()
    assert [x.h for x in r] == ["Alpha One Jacket", None, None]


def test_prices_from_specs_and_offers(spark):
    df = spark.createDataFrame([({"Our Price": "from $1,299.50"}, None), ({"x": "$3"}, '{"offers":[{"price":"12.5"}]}'), ({}, '{"offers":{"price":7}}'), ({}, "oops")], "specs map<string,string>, ld string")
    got = [r.p for r in df.select(M.facts_price(F.col("specs"), M.offers_price(F.col("ld"))).alias("p")).collect()]
    assert got == [1299.5, 12.5, 7.0, None]


def test_year_hints(spark):
    df = spark.createDataFrame([("https://x/2024/a-2025-b",), ("https://x/fw24-item/ss-25",), ("https://x/20241",)], "u string")
    assert [r.y for r in df.select(M.url_years(F.col("u")).alias("y")).collect()] == [["2024", "2025"], ["2024"], []]


def test_title_join_against_all_pairs(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)] + ["common"] * 3
    title = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))
    left = [(rng.randint(0, 1), i, title()) for i in range(60)]
    right = [(rng.randint(0, 1), i, title()) for i in range(60)]
    got = {r.product_id: (r.other_id, r.score) for r in M.title_join(
        spark.createDataFrame(left, "domain long, product_id long, title string"), spark.createDataFrame(right, "domain long, other_id long, other_title string")).collect()}
    want = {}
    for d, i, t in left:
        best = None
        for d2, j, u in right:
            a, b = set(t.split()), set(u.split())
            if d == d2:
                s = len(a & b) / len(a | b) * (0.5 if b - a and a - b else 1)
                if s > 0.3 and (best is None or s > best[1]):
                    best = (j, s)
        if best:
            want[i] = best
    assert got == want


def test_urls(spark):
    f = lambda fn, *v: [r.o for r in spark.createDataFrame([(x,) for x in v], "u string").select(fn(F.col("u")).alias("o")).collect()]
    assert f(U.normalize, "https://a.b/c/#x", "https://a.b/", "https://a.b/c?d=1#f") == ["https://a.b/c", "https://a.b/", "https://a.b/c?d=1"]
    assert f(U.host, "https://www.a.b/c", "a.b/c") == ["a.b", "a.b"]
    assert f(U.drop_resize_params, "https://a/b.jpg?w=3&v=9&Width=1", "https://a/b.jpg?w=3", "https://a/b.jpg") == ["https://a/b.jpg?v=9", "https://a/b.jpg", "https://a/b.jpg"]
    assert f(U.widest_source, "/a-1.jpg 300w, /a-2.jpg 900w, /a-3.jpg 900w") == ["/a-2.jpg"]
    assert f(U.image_reject_reason, "x.svg?v", "logo.png", "data:abc", "a.jpg") == ["unsupported format", "likely icon/badge", "data URI", None]


def test_a_word_of_a_third_of_all_titles_is_joined_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    title = lambda k: " ".join([*(["jacket"] if k % 3 == 0 else []), *(rng.choice(vocab) for _ in range(rng.randint(1, 5)))])
    left, right = ([(0, i, title(i)) for i in range(240)] for _ in range(2))
    frames = spark.createDataFrame(left, "domain long, product_id long, title string"), spark.createDataFrame(right, "domain long, other_id long, other_title string")
    want = sorted(map(tuple, M.title_join(*frames).collect()))
    seen = []
    whole = M.blocked

    def watched(*args):
        a, b = whole(*args)
        for side, n in ((a, 4), (b, 4)):
            most = side.groupBy("domain", "w", "bl", "br").count().agg(F.max("count")).first()[0]
            seen.append(most <= n * 3)
        assert a.where("bl > 0 or br > 0").count() > 0
        return a, b

    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "blocked", watched)
    assert sorted(map(tuple, M.title_join(*frames).collect())) == want and seen == [True, True]
