import random

from pyspark.sql import functions as F

from merchgrid.operators import health as H
from merchgrid.operators import policy as P
from merchgrid.operators import quality as Q
from merchgrid.operators import shipping as S
from merchgrid.operators import feed as D
from merchgrid.operators import taxonomy as T
from merchgrid.operators import variant_order as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("o")).first().o


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    vocab = ["a", "b", "c", "d", "e", "f", "the", "the"]
    docs = {d: [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 25))] for d in range(20)}
    docs[99] = ["same line here"] * 300 + ["same line here now"]  # one group of copies holds almost all rows
    df = spark.createDataFrame([(d, x) for d, xs in docs.items() for x in xs], "doc long, line string")
    got = {r.doc: r.pairs for r in Q.near_duplicate_counts(df, "doc").collect()}
    want = {}
    for d, xs in docs.items():
        sets = [set(x.split()) for x in xs]
        n = sum(1 for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.7)
        if n:
            want[d] = n
    assert got == want


def test_shared_ngrams(spark):
    rows = [(1, ["one two three four five six seven"], ["x One two three four five six", "one two"]), (2, ["a b c d e f"] * 3, ["a b c d e f g", "a b c d e f"]), (3, ["a b c d e f"], []), (4, ["a b c d e f"], ["b a c d e f"])]
    df = spark.createDataFrame(rows, "k int, blocks array<string>, bullets array<string>")
    assert {r.k: r.shared for r in Q.shared_ngrams(df, "k").collect()} == {1: 1, 2: 1}
    long = "word " * 400_000 + "one two three four five six"
    assert Q.shared_ngrams(spark.createDataFrame([(1, [long], [long])], df.schema), "k").first().shared == 7


def test_boilerplate_lines(spark):
    lines = ["Skip to content", "Only $12.99 today for you", "tiny line", "GORE", "has 3", "A perfectly normal sentence here"]
    assert one(spark, lines, Q.real_lines, "array<string>") == ["GORE", "has 3", "A perfectly normal sentence here"]


def facts(spark, **kw):
    base = dict(handle="h", product_name="Alpha Jacket", brand="B", blocks=["Alpha jacket made of nylon with 400 g GTX shell fabric."], bullets=["Waterproof up to 20 m depth", "Weighs 400 g in total", "Made for long cold days"],
                specs={"Weight": "400 g", "Fit": "Regular"}, materials="80% nylon", care="wash cold", ld_description="")
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], "handle string, product_name string, brand string, blocks array<string>, bullets array<string>, specs map<string,string>, materials string, care string, ld_description string")


def test_fact_quality_full_and_empty(spark):
    r = Q.fact_quality(facts(spark)).first()
    assert (r.signal, r.completeness, r.specificity, r.uniqueness) == (28, 25, 7 + 6 + 4 + 6, 20)
    e = Q.fact_quality(facts(spark, product_name="", brand="", blocks=[], bullets=[], specs={}, materials="", care="", ld_description="x" * 51)).first()
    assert (e.signal, e.completeness, e.specificity, e.uniqueness) == (5, 0, 0, 20)


def test_output_quality_axes(spark):
    html = "<p>" + "word " * 110 + "stunning ultimate</p><ul><li>one two</li><li>" + "long " * 13 + "</li></ul>"
    df = spark.createDataFrame([("h", html, [], ["bullet text wordy"], {}, "", "", "PASS", 3, 1, 0)],
                               "handle string, body_html string, blocks array<string>, bullets array<string>, specs map<string,string>, materials string, care string, verdict string, n_supported int, n_unsupported int, n_embellished int")
    r = Q.output_quality(df).first()
    assert (r.structure, r.length, r.anti_hype, r.fidelity) == (8 + 7 + 5 + 3, 10 + 2, 5, 22)
    assert r.coverage == 5 + 0 + 5


def test_drafts(spark):
    assert one(spark, "```html\n<p>x</p>\n```", Q.draft_cleanup) == "<p>x</p>"
    assert one(spark, "<p>x</p>\n---\nnotes", Q.draft_cleanup) == "<p>x</p>"
    assert one(spark, "Sorry, I cannot do this", Q.refusal) == "i cannot" and one(spark, "<p>Fine</p>", Q.refusal) is None
    r = facts(spark, blocks=["a <b> & 'c'"], bullets=["x" * 120], specs={}).select(Q.fallback_html(F.col("blocks"), F.col("bullets"), F.col("specs"), item_chars=100).alias("h")).first().h
    assert r == "<p>a &lt;b&gt; &amp; &#39;c&#39;</p>\n<h3>Features</h3>\n<ul>\n<li>" + "x" * 97 + "...</li>\n</ul>"


def test_image_order(spark):
    img = spark.createDataFrame([("h", 0, "https://x/polarized.jpg", "gallery", "", "Alpha Jacket"), ("h", 1, "https://x/a.jpg?v=1", "img_tag", "", "Alpha Jacket"), ("h", 2, "https://x/a.jpg?v=2", "json_ld", "", "Alpha Jacket"),
                                 ("h", 3, "https://x/alpha-jacket.jpg", "img_tag", "own", "Alpha Jacket"), ("h", 4, "https://x/logo.png", "json_ld", "", "Alpha Jacket")],
                                "handle string, ord int, url string, source_hint string, alt string, product_name string")
    got = [(r.position, r.src, r.alt) for r in Q.ranked_images(img).orderBy("position").collect()]
    assert got == [(1, "https://x/alpha-jacket.jpg", "own"), (2, "https://x/a.jpg?v=1", "Alpha Jacket - Image 2"), (3, "https://x/polarized.jpg", "Alpha Jacket - Image 3")]


def test_description_quality(spark):
    df = spark.createDataFrame([(None, "T"), ("<p>Alpha</p>", "alpha"), ("<p>" + "Please contact your local dealer for this and that item today" + "</p>", "x"), ("<b>" + "good words " * 8 + "</b>", "x"), ("  ", "x"), ("<p>few</p>", "x")], "b string, t string")
    got = [r.r for r in df.select(H.description_reason(F.col("b"), F.col("t")).alias("r")).collect()]
    assert got == ["No description", "Title repeated as description", "Boilerplate: 'contact your local dealer'", "", "No description", "Too short (3 chars)"]


def test_coherence_by_stem(spark):
    df = spark.createDataFrame([("Alpine Jackets", "", "A jacket for rain"), ("Alpine", "Boots", "nothing here"), ("A of", "", "zz"), ("Alpine", "", "")], "t string, k string, b string")
    assert [r.c for r in df.select(H.coherent(F.col("t"), F.col("k"), F.col("b")).alias("c")).collect()] == [True, False, True, True]


def test_shipping_tiers(spark):
    got = [one(spark, w, S.carrier_cost, "double") for w in (2.5, 0.0, 500.0, 1.0)]
    assert got == [11.5, 0.0, 120.0, 9.5]


def test_price_tiers_and_sizes(spark):
    assert [one(spark, p, D.price_tier, "double") for p in (49.99, 50.0, 200.0, None)] == ["under-50", "50-100", "over-200", "under-50"]
    df = spark.createDataFrame([("Size", "32 oz", None), ("Color", "Red", "M"), ("Color", "Red", "Default Title"), ("Style", "X", "500ml"), ("Width", "2E", "L")], "a string, b string, c string")
    assert [r.s for r in df.select(D.variant_size(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()] == ["", "M", "", "", ""]


def test_feed_gender_and_tags(spark):
    df = spark.createDataFrame([("x, Gender:Mens, gender:womens", "Kids hat"), ("", "Youth Women's Hat"), ("", "Women's Hat"), ("", "Men's Hat"), ("", "Hat"), ("activity:Hiking x, season:fall", "")], "g string, t string")
    rows = df.select(D.gender(F.col("g"), F.col("t")).alias("g"), D.age_group(F.col("g"), F.col("t")).alias("a"), D.season(F.col("g")).alias("s"), D.activity(F.col("g")).alias("v")).collect()
    assert [r.g for r in rows] == ["male", "unisex", "female", "male", "", ""]
    assert [r.a for r in rows] == ["kids", "kids", "adult", "adult", "adult", "adult"]
    assert rows[5].s == "fall-winter" and rows[5].v == "Hiking x" and rows[0].s == "year-round"


def test_gtin(spark):
    cases = {"4006381333931": True, "036000291452": True, "036000291453": False, "00000000": False, "96385074": True, "abc": False, "": False, "10614141000415": True, "123456789": False}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.v for r in df.select("c", P.valid_gtin(F.col("c")).alias("v")).collect()} == cases


def test_titles_and_terms(spark):
    assert one(spark, "  ", P.title_violations) == ["Title is empty"]
    assert one(spark, "BUY THIS NOW!!", P.title_violations) == ["Title is all caps (GMC may flag as spammy)", "Title contains excessive punctuation"]
    assert one(spark, "Free shipping on the best deal, $5 off", P.prohibited_terms) == ["Promotional: 'free shipping'", "Superlative: 'best'", "Price mention in description"]
    assert one(spark, "the bestö", P.prohibited_terms) == []


def test_tagger_look_ahead_and_existing_tags(spark):
    df = spark.createDataFrame([(1, "ring binder", "", ""), (2, "ring", "", ""), (3, "women's hot bolt", "", "Gender:Womens")], "product_id long, title string, body_html string, tags string")
    got = {r.product_id: (r.inferred_type, r.new_tags) for r in T.infer_tags(df).collect()}
    assert got == {1: ("", ["activity:assembly"]), 2: ("Ring", ["activity:assembly"]), 3: ("Fastener", ["activity:forging", "activity:assembly"])}


def test_taxonomy_priority_and_queue(spark):
    df = spark.createDataFrame([(1, "a", "red gizmo", "Brand#3", "Bolt", "x, x", "", ""), (2, "b", "red bolt", "Brand#3", "", "", "S > Rings", ""), (3, "c", "red bolt", "Brand#3", "", "", "", ""), (4, "d", "women's hot rod", "V", " ", "", "", "male")],
                               "product_id long, handle string, title string, vendor string, product_type string, tags string, category string, gender string")
    m = T.assign_taxonomy(df)
    got = {r.handle: (r.new_type, r.new_tags) for r in m.collect()}
    assert got["a"] == ("Fastener", "activity:assembly, group:hardware") and got["b"][0] == "Ring" and got["c"][0] == "Widget"
    assert got["d"] == ("Heated Part", "gender:womens, season:winter, feature:heated")
    q = {(r.handle, r.field): (r.old_value, r.new_value) for r in T.update_queue(m).collect()}
    assert q["a", "tags"] == ("x, x", "x, x, activity:assembly, group:hardware") and q["a", "product_type"] == ("Bolt", "Fastener")


def test_variant_order(spark):
    rows = [(1, i, i, "Color", c, "Size", s) for i, (c, s) in enumerate([("Red", "S"), ("Red", "XL"), ("Blue", "One Size"), ("Blue", "M")])]
    rows += [(2, 10 + i, i, "Color", c, "Size", s) for i, (c, s) in enumerate([("Red", "S"), ("Blue", "S"), ("Red", "M")])]
    rows += [(3, 20 + i, i, "Size", s, "", "") for i, s in enumerate(["8.5", "9", "10"])] + [(4, 30, 0, "Size", "S", "", "")]
    rows += [(5, 40 + i, None, "Color", "Red", "Size", s) for i, s in enumerate(["M", "S"])]
    df = spark.createDataFrame([(*r, f"k{r[1]}") for r in rows], "product_id long, variant_id long, position long, option1_name string, option1_value string, option2_name string, option2_value string, sku string")
    assert {r.product_id: r.verdict for r in V.order_check(df).collect()} == {1: "sorted", 2: "violation", 3: "sorted", 5: "no_position_data"}
    got = {r.variant_id: (r.actual_place, r.expected_place) for r in V.order_rows(df).collect()}
    assert got == {10: (1, 1), 11: (2, 3), 12: (3, 2)}


def _page(spark, body):
    from merchgrid.operators import pages as P

    return P.extract(spark.createDataFrame([(1, "https://s.example.com/p/x", f"<html><body>{body}</body></html>")], "page_id long, url string, html string")).first()


def test_store_product_inside_a_script(spark):
    r = _page(spark, """<h1>Name</h1><script>var meta = {"product": {"options": ["Size", "Color"], "variants": [
        {"option1": "S", "option2": "Red", "featured_image": {"src": "/a.jpg"}}, {"option1": "M", "option2": "Red", "image": "/b.jpg"}, {"option1": "S", "option2": "Blue {x}", "featured_image": null}]}};
        </script>""")
    assert (r.colors, r.sizes, r.parse_error) == (["Red", "Blue {x}"], ["S", "M"], None)
    assert r.variant_image_candidates == {"Red": ["https://s.example.com/a.jpg", "https://s.example.com/b.jpg"]}
    r = _page(spark, '<script>x = 1; window.data = {"id": 1, "variants": [{"option1": "Teal", "option2": "10"}]}; f({"variants": 3});</script>')
    assert (r.colors, r.sizes) == (["Teal"], ["10"])


def test_offer_images_by_colour(spark):
    r = _page(spark, """<script type="application/ld+json">{"@type": "Product", "name": "N", "offers": [{"name": "N - L / black", "image": "/k.jpg"}, {"name": "N - M / black", "image": "/k.jpg"}, {"name": "N - M / red"}]}</script>""")
    assert (r.colors, r.sizes) == (["black", "red"], ["L", "M"]) and r.variant_image_candidates == {"black": ["https://s.example.com/k.jpg"]}


def test_no_block_or_bullet_is_cut(spark):
    r = _page(spark, "<main>" + "".join(f"<p>This is paragraph number {i} of a long page.</p>" for i in range(40)) + "<ul>" + "".join(f"<li>a feature that is number {i} and long enough to stay</li>" for i in range(30)) + "</ul></main>")
    assert len(r.description_blocks) == 40 and len(r.feature_bullets) == 30
