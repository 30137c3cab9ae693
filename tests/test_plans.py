"""What the plans of the larger queries send to every task, and over how many tasks they deal their rows."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# Query and the broadcasts it may hold: those of lists whose size does not follow the tables.
GROWING = {
    "color_match": 0, "color_image_merge": 0, "variant_image_rows": 0, "selected_images": 0, "store_colors": 0, "color_variants": 0, "export_images": 0,
    "candidate_context": 1, "candidate_decisions_edit": 0, "candidate_decisions_all": 0, "audit_priority": 0, "regression_check": 0, "search_hit_scores": 0,
    "variant_order_check": 0, "quality_rollup": 0,
}


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GROWING)
def test_growing_sides_are_not_broadcast(spark, name):
    assert plan(spark, name).count("BroadcastExchange") <= GROWING[name]


@pytest.mark.parametrize("name", ["rescore_edit", "output_policy", "search_hit_scores"])
def test_rows_are_dealt_out_without_a_setting(spark, name):
    set_ = spark.conf.get("spark.merchgrid.scan.partitions")
    spark.conf.unset("spark.merchgrid.scan.partitions")
    try:
        assert "REPARTITION_BY_NUM" in plan(spark, name)
    finally:
        spark.conf.set("spark.merchgrid.scan.partitions", set_)


def test_flagless_outputs_are_not_filtered_below_the_dealing(spark):
    # the patterns are tested above the exchange that deals the documents out, and not at their scan
    assert "RLIKE" not in plan(spark, "output_policy").split("REPARTITION_BY_NUM", 1)[1]


def test_pages_are_parsed_in_stretches():
    import pandas as pd

    from merchgrid.functions import html as H
    from merchgrid.operators import pages as P

    page = "<title>t</title><p>" + "word " * 100 + "</p>"
    pdf = pd.DataFrame({"page_id": range(5000), "html": [page if k % 7 else None for k in range(5000)]})
    out = list(H.parse_pages(P.rules(None, None))(iter([pdf])))
    assert len(out) > 1 and [k for o in out for k in o["page_id"]] == list(range(5000))
    assert all(o["page_id"].map(lambda k: len(page) if k % 7 else 0).sum() <= H.PARSED_AT_ONCE for o in out)
    one = pd.DataFrame({"page_id": [1, 2], "html": ["x" * (H.PARSED_AT_ONCE + 1), "y"]})  # a page is never cut
    assert [list(o["page_id"]) for o in H.stretches(one, H.PARSED_AT_ONCE)] == [[1], [2]]


@pytest.mark.parametrize("name", ["candidate_decisions", "candidate_decisions_edit", "candidate_decisions_all"])
def test_page_texts_stay_below_the_join(spark, name):
    # a page's text is searched once, and not again in the rows of its candidates
    assert "markdown" not in plan(spark, name).split("SortMergeJoin", 1)[0]


@pytest.mark.parametrize("name, scans", [("color_match", 2), ("selected_images", 5), ("color_image_merge", 8)])
def test_sides_of_color_joins_are_built_once(spark, name, scans):
    assert plan(spark, name).count("FileScan") <= scans


def test_variant_order_reads_the_variants_twice(spark):
    # for the products' counts and for the spans, which also have the blocks' starts
    assert plan(spark, "variant_order_check").count("FileScan") <= 2


def test_listing_events_are_dealt_out_before_they_are_grouped(spark):
    assert plan(spark, "listing_merge").count("REPARTITION_BY_NUM") >= 2  # the daily rows and the status rows
