import json
import random
import time

import pytest
from pyspark.sql import functions as F

from merchgrid.functions.html import folded_blocks, parsed
from merchgrid.operators import images as M
from merchgrid.operators import intake as N
from merchgrid.operators import pages as P
from merchgrid.operators import review as R
from merchgrid.plans import core
from merchgrid.bind import Tables
from merchgrid.sources import readers as S
from merchgrid.sources import sinks as K
from merchgrid.streaming import jobs as J

SF = "/root/testdata/sf0.001"
RULES = P.rules()


def test_input_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "﻿Product Handle,Vendor,Has Image,Has Variant Images,Has Description,Gaps,Priority Score\n"
        'a,V,Yes,t,0,"x, y",5.5\nb,V,,maybe,1,,oops\nc,W,TRUE,no,Y,,\n,V,1,1,1,,\n', encoding="utf-8")
    rows = {r.handle: r for r in S.read_input(spark, str(tmp_path / "in.csv")).collect()}
    assert set(rows) == {"a", "c"}
    a = rows["a"]
    assert (a.has_image, a.has_variant_images, a.has_description, a.has_tags, a.gaps, a.priority_score) == (True, True, False, True, "x, y", 5.5)
    assert [(r.vendor, r.rows) for r in S.vendor_counts(S.read_input(spark, str(tmp_path / "in.csv"))).collect()] == [("V", 1), ("W", 1)]


def test_priority_csv_round_trip(spark, tmp_path):
    t = Tables(spark, SF)
    s = core.scores(t)
    K.write_csv(K.priority_rows(s), str(tmp_path / "p"))
    back = S.read_input(spark, str(tmp_path / "p"))
    assert back.count() == s.where("gap_count > 0").count()
    assert len(K.priority_rows(s).columns) == 23 and len(K.audit_rows(s).columns) == 20
    dash = R.payoff_rows(spark.read.csv(str(tmp_path / "p"), header=True, escape='"'))
    assert dash.where("size(gaps) = 0").count() == 0


def test_export_continuation_rows(spark, tmp_path):
    head = "Handle,Title,Option1 Name,Option1 Value,Option2 Name,Option2 Value,Option3 Name,Option3 Value,Image Src\n"
    (tmp_path / "e.csv").write_text(head + ",orphan,,,,,,,\nh1,One,Color,Red,Size,,,,a\n,,Color,Blue,Color,Navy,,,b\nh2,Two,,,,,,,c\n,,Size,M,,,,,d\n")
    df = S.read_export(spark, str(tmp_path / "e.csv"))
    got = [(r.Handle, r["Image Src"]) for r in df.orderBy("row_order").collect()]
    assert got == [("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "d")]
    opts = {r["Image Src"]: r.options for r in N.option_map(df).collect()}
    assert opts == {"a": {"Color": "Red"}, "b": {"Color": "Navy"}, "d": {"Size": "M"}}


def test_export_fill_crosses_splits(spark, tmp_path):
    body = "Handle,Image Src\n" + "".join(f"{'h%d' % (i // 50) if i % 50 == 0 else ''},{i:05d}{'x' * 40}\n" for i in range(2000))
    (tmp_path / "big.csv").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = S.read_export(spark, str(tmp_path / "big.csv"), multi_line=False)
        rows = df.select("Handle", F.substring("Image Src", 1, 5).cast("int").alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2000 and all(r.Handle == f"h{r.i // 50}" for r in rows)


def test_decision_log(spark, tmp_path):
    d = tmp_path / "run" / "x"
    d.mkdir(parents=True)
    good = {"handle": "h", "vendor": "V", "catalog_title": "T", "timestamp": "2026-01-01T00:00:00Z", "outcome": "accept",
            "candidates_tried": [{"url": "u", "stage": "gate", "action": "accepted", "pre_scrape_confidence": 80, "post_scrape_confidence": 61.5, "word_overlap": 0.2}]}
    (d / "log.jsonl").write_text(json.dumps(good) + "\n{broken\n\n")
    r = S.read_decisions(spark, str(tmp_path)).collect()
    assert len(r) == 1
    c = r[0].candidates_tried[0]
    assert (c.outcome, c.resolver_confidence, c.confidence, c.metrics) == ("accept", 80.0, 61.5, {"word_overlap": 0.2})


def test_artifacts_by_folder(spark, tmp_path):
    for h, body in (("h1", '{"confidence": 3}'), ("h2", "{broken"), ("h3", '{"confidence": 5}')):
        (tmp_path / h).mkdir()
        (tmp_path / h / "merch_output.json").write_text(body)
    got = {r.handle: r.confidence for r in S.read_artifacts(spark, str(tmp_path), "merch_output.json", "confidence int").collect()}
    assert got == {"h1": 3, "h3": 5}


def test_vendor_config_defaults(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"vendors": {"A": {"domain": "a.com", "blocked": True, "junk": 1}, "B": None}}))
    got = {r.vendor: r for r in S.read_vendors(spark, str(tmp_path / "v.json")).collect()}
    assert got["A"].blocked and got["A"].blocked_paths and not got["B"].blocked and got["B"].domain == ""


def test_update_queue_replaces_its_source_only(spark, tmp_path):
    path = str(tmp_path / "q")
    q = lambda rows: spark.createDataFrame(rows, "handle string, source string")
    K.replace_queue(q([("a", "taxonomy_map"), ("b", "other")]), path)
    K.replace_queue(q([("c", "taxonomy_map")]), path)
    assert {(r.handle, r.source) for r in spark.read.parquet(path).collect()} == {("b", "other"), ("c", "taxonomy_map")}


def test_import_rows(spark):
    df = spark.createDataFrame([("h", "<p>", [("a", 1, "x"), ("b", 2, "")]), ("g", None, [])], "handle string, body_html string, images array<struct<src string, position int, alt string>>")
    rows = K.import_rows(df).collect()
    assert len(rows[0]) == 32
    assert [(r.Handle, r["Body (HTML)"], r["Image Src"], r["Image Position"]) for r in rows] == [("g", "", "", ""), ("h", "<p>", "a", "1"), ("h", "", "b", "2")]


def test_store_json_and_search_results(spark):
    raw = '{"id":1,"handle":"h","title":"T","vendor":"V","product_type":"X","body_html":"<p>One</p><p>Two</p>","images":[{"id":1,"src":"a","variant_ids":[5,6]},{"id":2,"src":"b","variant_ids":[]}],"variants":[{"id":5,"option1":"Red"},{"id":6,"option1":"Default Title"}]}'
    df = spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", S.STORE_SCHEMA).alias("d")).select("d.*")
    r = S.store_facts(df).first()
    assert r.description_blocks == ["One", "Two"] and r.colors == ["Red"] and r.variant_image_candidates == {"Red": ["a"]} and r.specs == {"Product Type": "X"}
    res = [("t", "p", "dom", "high", ("th",), ("full", 900, 900)), ("t", "p", "dom", "high", ("th",), ("full2", 900, 900)), ("t", "p", "d2", "low", ("th",), ("f", 900, 900)), ("t", "p", "d3", "medium", ("th",), ("f3", 100, 900))]
    q = spark.createDataFrame([("q", res)], "query string, results array<struct<title string, url string, source string, confidence string, thumbnail struct<src string>, properties struct<url string, width int, height int>>>")
    assert [x.full_url for x in S.search_images(q).collect()] == ["full"]


def test_store_bodies_keep_all_paragraphs(spark):
    raw = '{"id":1,"body_html":"%s","images":[],"variants":[]}' % "".join(f"<p>P{i}</p>" for i in range(8))
    df = spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", S.STORE_SCHEMA).alias("d")).select("d.*")
    assert S.store_facts(df).first().description_blocks == [f"P{i}" for i in range(8)]
    assert S.store_facts(df, paragraphs=5).first().description_blocks == [f"P{i}" for i in range(5)]


def test_structured_facts_and_markdown(spark):
    df = spark.createDataFrame([("u", '{"product_name":"P","images":["http://x/a.jpg?w=3","http://x/a.jpg","ftp://x"],"specs":{"a":"b"}}')], "url string, json string")
    r = S.structured_facts(df).first()
    assert (r.product_name, r.images, r.specs, r.brand) == ("P", ["http://x/a.jpg"], {"a": "b"}, "")
    m = spark.createDataFrame([("text", ["u1"]), ("![x](http://a/b.png)", ["u1"])], "m string, u array<string>").select(S.append_images(F.col("m"), F.col("u")).alias("o")).collect()
    assert [x.o for x in m] == ["text\n\n![](u1)", "![x](http://a/b.png)"]


def test_report_rows(spark):
    df = spark.createDataFrame([(["7", "x"], ["sessions", "path"])], "row array<string>, columns array<string>")
    r = S.report_rows(df, ["path", "sessions", "absent"]).first()
    assert (r.path, r.sessions, r.absent) == ("x", "7", None)


def test_bulk_export_applies_last_present_value(spark):
    v = spark.createDataFrame([(1, 9, "old", 4), (2, 9, "keep", None)], "variant_id long, product_id long, image_src string, position int")
    e = spark.createDataFrame([("1", "p9", " new ", None, 0), ("1", "p9", "", "2", 1), ("x", "p9", "z", None, 2), ("77", "p8", "z", None, 3), ("", "p7", "z", None, 4)], "variant_id string, product_id string, image string, pos string, ord int")
    got = {r.variant_id: (r.image_src, r.position) for r in M.apply_bulk_export(v, e).collect()}
    assert got == {1: ("new", 2), 2: ("keep", None)}
    c = M.bulk_export_counts(v, e).first()
    assert (c.variants_updated, c.variants_skipped, c.images_set, c.positions_set, c.products_seen) == (2, 2, 1, 1, 1)


PAGE = """<html><head><title>Acme Jacket</title><meta name="description" content="Fine"><link rel="canonical" href="/p/alpine">
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Alpine","brand":{"name":"Acme"},"image":["/a.jpg"],"offers":[{"name":"Alpine - L / black","price":"99.5"},{"name":"Alpine - M / red"}]}]}</script></head>
<body><nav><ul><li>Home page link</li><li>Second link here</li></ul></nav><main><h1>Alpine Jacket</h1><p>This is a long description of the jacket.</p><p>Only $12.99 while it is on the shelf here</p>
<ul><li>Waterproof to 20k<li>Weighs 400 grams<li>waterproof to 20k</ul><table><tr><th>Weight</th><td>400 g</td></tr><tr><th>Weight</th><td>500 g</td></tr></table><dl><dt>Fit</dt><dd>Regular</dd></dl>
<img srcset="/i-300.jpg 300w, /i-900.jpg 900w" src="/s.jpg" alt="front"><img src="/logo.png"><span data-color="Red" data-image="/red.jpg"></span>
<script>var x = {variants: [{"option1":"Blue","featured_image":{"src":"/blue.jpg"}}]};</script></main></body></html>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "https://s.example.com/x", PAGE), (2, "https://s.example.com/y", "<p>bad <b"), (3, "https://s.example.com/z", None)], "page_id long, url string, html string")
    r = {x.page_id: x for x in P.extract(df).collect()}
    a = r[1]
    assert (a.product_name, a.brand, a.page_title, a.meta_description, a.canonical_url, a.offers_price) == ("Alpine", "Acme", "Acme Jacket", "Fine", "https://s.example.com/p/alpine", "99.5")
    assert a.description_blocks == ["This is a long description of the jacket."]
    assert a.feature_bullets == ["Waterproof to 20k", "Weighs 400 grams"] and a.specs == {"Weight": "400 g", "Fit": "Regular"}
    assert [i.url for i in a.images] == ["https://s.example.com/a.jpg", "https://s.example.com/i-900.jpg"]
    assert (a.colors, a.sizes) == (["black", "red"], ["L", "M"])
    assert a.variant_image_candidates == {"Red": ["https://s.example.com/red.jpg"], "Blue": ["https://s.example.com/blue.jpg"]}
    assert r[2].product_name == "" and r[3].description_blocks == []


def test_long_elements_keep_their_own_text(spark):
    long, item = "word " * 600 + "end.", "item " * 150 + "end."
    html = {
        1: f"<article><p>{long}</p><p>Another paragraph of the text.</p></article>",
        2: f"<article><p><b>The first paragraph is not closed.<p>{long}<p>Another paragraph of the text.</article>",
        3: f"<article><div>Words of the box itself, <b>bold</b>.<p>{long}</p>More.</div></article>",
        4: f"<article><ul><li>{item}</li><li>Outer item<ul><li>Inner one</li><li>Inner two</li></ul></li></ul></article>",
        5: "<article><p>Some words <span>and a span inside of them</span> and more.</p></article>",
    }
    df = spark.createDataFrame([(i, "https://s.example.com/x", h) for i, h in html.items()], "page_id long, url string, html string")
    r = {x.page_id: x for x in P.source_text(P.elements(df)).collect()}
    assert r[1].visible_text_blocks == [long, "Another paragraph of the text."]
    assert r[2].visible_text_blocks == ["The first paragraph is not closed.", long, "Another paragraph of the text."]
    assert r[3].visible_text_blocks == ["Words of the box itself,bold.More.", long]
    assert r[4].bullet_lists == [[item, "Outer item"], ["Inner one", "Inner two"]]
    assert r[5].visible_text_blocks == ["Some wordsand a span inside of themand more."]


def test_streams_equal_batches(spark, tmp_path):
    t = Tables(spark, SF)
    ev = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    keyed = lambda df: df.withColumn("product_id", F.col("user_id"))
    J.run_available(J.rolling_signals(keyed(J.event_stream(spark, str(tmp_path / "ev"))), late="400 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    batch = J.rolling_signals(keyed(spark.read.parquet(str(tmp_path / "ev"))))
    q = J.rolling_signals(keyed(J.event_stream(spark, str(tmp_path / "ev")))).writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    got = {(r.window_start, r.product_id): (r.sessions, r.orders) for r in spark.table("rolled").collect()}
    assert got == {(r.window_start, r.product_id): (r.sessions, r.orders) for r in batch.collect()}
    log = [{"handle": f"h{i}", "vendor": f"v{i % 2}", "outcome": "accept" if i % 3 else "no_match", "timestamp": f"2026-01-0{1 + i % 5}T01:00:00Z"} for i in range(50)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, log)))
    q = J.outcome_counts(J.decision_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    batch = J.outcome_counts(spark.read.schema(S.DECISION_SCHEMA).json(str(tmp_path / "log")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("counted")) == rows(batch)


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    from merchgrid.sources import sinks

    path = str(tmp_path / "log")
    df = spark.createDataFrame([("a", "accept"), ("b", "no_match")], "handle string, outcome string")
    for run in ("r1", "r2", "r1"):
        sinks.append_decisions(df, path, run)
    assert spark.read.json(path).count() == 4
    scores = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, score int")
    for _ in range(2):
        sinks.write_run_json(scores, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).count() == 2


def test_records_of_one_handle_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"handle": "h", "outcome": "no_match", "retries": 1}\n{"handle": "h", "outcome": "no_match", "retries": 2}\nnot json\n{"outcome": "x"}\n', encoding="utf-8")
    d = S.read_decisions(spark, str(tmp_path))
    assert d.select("decision_id").distinct().count() == 2
    assert S.rejected_lines(spark, str(tmp_path)).count() == 2


def test_rejected_input_rows_are_counted(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Product Handle,Vendor,Has Image,Has Variant Images,Has Description,Priority Score\na,V,yes,no,yes,1\n,V,yes,no,yes,1\nb,V,yes,no,yes,oops\n", encoding="utf-8")
    assert [r.handle for r in S.read_input(spark, str(tmp_path / "i.csv")).collect()] == ["a"]
    assert S.read_input(spark, str(tmp_path / "i.csv"), rejected=True).count() == 2


def test_blank_barcodes_stay_out_of_the_join(spark):
    from merchgrid.operators.images import with_catalog_image

    v = spark.createDataFrame([(i, "" if i % 2 else f"{i}") for i in range(100)], "variant_id long, barcode string")
    items = spark.createDataFrame([("2", "https://x/2.jpg"), ("", "https://x/no.jpg")], "barcode string, image_url string")
    out = with_catalog_image(v, items)
    assert out.count() == 100 and [r.variant_id for r in out.where("catalog_image is not null").collect()] == [2]


@pytest.mark.parametrize("unit", ["<div>x", "<ul><li>x", "<p>word ", "<span>a", "<li>some words ", "<b>", "</div>", "<div>x</span>", "<dl><dt>a<dd>b", "<div class=nav>x", "<main><h1>x", "<p>Some words that make a block.</p>"])
def test_pages_parse_in_linear_time_and_space(unit):
    html = unit * (200_000 // len(unit))
    start = time.perf_counter()
    elements, said, blocks, lists, specs, error = parsed(html, RULES)
    assert time.perf_counter() - start < 4 and error is None
    assert sum(len(e["raw"] or "") for e in elements) + len(said) + sum(map(len, blocks)) + sum(len(i) for x in lists for i in x) + sum(len(s["key"] + s["value"]) for s in specs) <= 2 * len(html)


def test_intervals_and_own_texts():
    elements, said, blocks, _, _, _ = parsed("<body><main><div>Outer words of the box <p>Inner words of the paragraph</p> tail</div><p>x</p></main></body>", RULES)
    by = {e["tag"]: e for e in elements if e["tag"] != "p"}
    inner = next(e for e in elements if e["tag"] == "p")
    assert by["main"]["ord"] < by["div"]["ord"] < inner["ord"] <= by["div"]["last"] < by["main"]["last"]
    assert said[by["div"]["begin"] : by["div"]["end"]] == "Outer words of the boxInner words of the paragraphtail" and said[inner["begin"] : inner["end"]] == "Inner words of the paragraph"
    assert blocks == ["Outer words of the boxtail", "Inner words of the paragraph"]


def test_folded_blocks_equal_the_pairwise_rule():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choice("ab c") for _ in range(rng.choice((1, 2, 3, 5, 8, 250)))) for _ in range(rng.randint(0, 14))]
        want = []
        for t in texts:
            if t not in want and not (len(t) < 200 and any(t in b or b in t for b in want)):
                want.append(t)
        assert folded_blocks(texts) == want


def test_a_batch_that_runs_again_replaces_its_records(spark, tmp_path, monkeypatch):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    (tmp_path / "log").mkdir()
    for k in range(6):
        (tmp_path / "log" / f"{k}.json").write_text("".join(json.dumps({"handle": f"h{k}-{i}", "vendor": "V", "outcome": "enriched"}) + "\n" for i in range(3)))
    whole, seen = J.write_run_json, []

    def failing(df, path, column):
        whole(df, path, column)
        seen.append(1)
        if len(seen) == 2:  # killed after the write, before the batch is committed
            raise RuntimeError("lost")

    monkeypatch.setattr(J, "write_run_json", failing)
    stream = lambda: J.decision_stream(spark, log, 2).select("handle", "vendor", "outcome")
    with pytest.raises(Exception, match="lost"):
        J.append_stream(stream(), out, state).awaitTermination()
    assert len(seen) == 2
    J.append_stream(stream(), out, state).awaitTermination()
    rows = [r.handle for r in spark.read.json(out).collect()]
    assert sorted(rows) == sorted(f"h{k}-{i}" for k in range(6) for i in range(3)) and len(seen) == 4


def test_export_in_many_splits_equals_one_task(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for f in range(2):
        rows, above = [], None
        for i in range(60):
            body = "".join(rng.choice(["a", '"', ",", "\n", " ", "é", "word "]) for _ in range(rng.choice([0, 3, 20, 300])))
            own = f"h{f}-{i}" if rng.random() < 0.5 else ""
            above = own or above
            rows.append(f'{own},"{body.replace(chr(34), chr(34) * 2)}",{i}')
            if above:
                want.append((above, body, str(i)))
        (tmp_path / f"{f}.csv").write_text("Handle,Body,N\n" + "\n".join(rows) + "\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = S.read_export(spark, str(tmp_path))
        rows = got.collect()
        assert len({r.row_order._block for r in rows}) > 20
        assert sorted((r.Handle, r.Body or "", r.N) for r in rows) == sorted(want)
        assert [r.N for r in sorted(rows, key=lambda r: tuple(r.row_order)) if r.Handle.startswith("h0")] == [n for h, _, n in want if h.startswith("h0")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "FILE_ROWS", 10)
    K.write_csv(spark.range(0, 95, 1, 1), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 10
    assert sorted(int(r.id) for r in spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).collect()) == list(range(95))
