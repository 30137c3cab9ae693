"""What the plans of the larger queries shuffle."""

import random
import time
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__ as entry
from merchgrid import session
from merchgrid.functions.similarity import edit_ratio
from merchgrid.operators import matching as X
from merchgrid.operators import quality as Q
from merchgrid.operators import variant_order as V


def test_lines_dealt_by_their_document_are_not_shuffled_again(spark):
    rows = [(k, f"word{k} common other thing\nword{k} common other\n\nelse\nelse") for k in range(20)]
    lines = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    counts = Q.near_duplicate_counts(lines, "doc_id")
    # nothing is exchanged but in the rows' own dealing
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan
    assert {r.doc_id: r.pairs for r in counts.collect()} == {k: 2 for k in range(20)}


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_written_table_leaves_no_shuffle_files(spark, tmp_path):
    setting = spark.conf.get(session.CLEANED, None)
    parts = [spark.range(1000).where(f"id % 2 = {k}").repartition(3, "id") for k in range(2)]
    before = shuffle_files(spark)
    table = session.written(*parts)
    for _ in range(100):  # they are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert sorted(r.id for r in table.collect()) == list(range(1000)) and spark.conf.get(session.CLEANED, None) == setting


def test_catalog_check_holds_the_shuffles_of_one_step(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    df = entry.queries()["catalog_check_text_edit"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the rows and the descriptions, by product
    assert len(set(folder.iterdir()) - before) == 1  # the tables of the earlier steps are gone


def test_tables_have_a_folder_without_the_setting():
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local[2]"))
    assert Path(session.scratch(bare)).parent.is_dir()


def test_catalog_check_of_odd_keys(spark):
    variants = spark.createDataFrame(
        [(1, "a", 10.0), (2, "b", 20.0), (3, "b", 30.0), (3, "b", 31.0), (4, "c", None), (None, "d", 5.0), (6, "", 1.0), (7, None, 1.0)], "variant_id long, barcode string, price double")
    products = spark.createDataFrame([("h", 1, "red bolt"), ("h", 2, "blue nut"), (None, 3, "none"), ("g", None, "no id")], "handle string, product_id long, title string")
    items = spark.createDataFrame([("b", "https://i/2"), ("b", "https://i/1"), ("", "https://i/0"), ("x", "https://i/x")], "barcode string, image_url string")
    texts = spark.createDataFrame([(1, "z"), (1, "y"), (2, ""), (None, "n")], "product_id long, description string")
    rows = [(1, 1, "h", "a", "red bolt", 10.0), (2, 3, "g", "b", "no id", 90.0), (3, 2, None, "b", "none", 90.0), (4, 99, "gone", "b", "x", 21.0), (5, None, "h", "b", None, None),
            (6, 5, "h", "d", "", 50.0), (7, 4, "h", "c", "", 1.0), (8, 8, "h", "x", "red bolt", 1.0), (9, 9, "h", "", "red bolt", 1.0), (10, 10, "h", None, "red bolt", 1.0)]
    rows = spark.createDataFrame(rows, "row_id long, variant_id long, handle string, barcode string, product_name string, scraped_price double")

    def check(rows):
        out = X.catalog_cross_check(rows, variants, products, items, texts, similarity=edit_ratio)
        return sorted(((r.row_id, "".join(w[:5] for w in r.warnings), (r.warnings or [""])[-1].rsplit("$", 1)[-1][:5], r.catalog_image, r.catalog_description) for r in out.collect()), key=repr)

    none = [(k, "", "", None, None) for k in (10, 8, 9)]
    twice = [(k, "", "", None, d) for k in (7,) for d in (None, "y")]
    # a barcode's own variant gives the price, once for each of its rows; a handle of two products gives two rows
    own = [(2, "PRICE", "30.00", "https://i/1", None), (2, "PRICE", "31.00", "https://i/1", None), (3, "PRICE", "20.00", "https://i/1", None)]
    same = [(4, "", "", "https://i/1", None), (5, "", "", "https://i/1", None), (5, "", "", "https://i/1", "y"), (6, "", "", None, None), (6, "", "", None, "y")]
    first = [(1, "", "", None, "y"), (1, "PRODU", "PRODU", None, None)]
    got = check(rows)
    assert [r for r in got if r[0] != 1] == sorted(none + twice + own + same, key=repr) and [r[0] for r in got].count(1) == len(first)
    # without the variant's id the smallest one gives the price
    assert [r[2] for r in check(rows.drop("variant_id")) if r[0] == 2] == ["20.00"]


def test_variant_order_rows_shuffle_the_variants_twice(spark):
    # lines to variants, variants to products; nothing is written between
    plan = entry.queries()["variant_order_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "ExistingRDD" not in plan


def test_places_of_large_products_are_those_of_small_ones(spark, monkeypatch):
    rnd = random.Random(4)
    pick = rnd.choice
    rows = [(pick([1, 1, 1, 2, 3, 4, None]), k, pick([None, *range(9)]) if k % 4 else k, pick(["Color", "color", "Size", None]) if k % 3 else "Size", pick(["Red", "Blue", "", None]), pick(["S", "XL", "10.5", "9", "nan", "odd", "", None]), pick(["", None, "sku"]))
            for k in range(150)]
    rows += [(p, 900 + i, i, "Color", "Red", s, "x") for p, sizes in ((7, "SML"), (8, "LMS")) for i, s in enumerate(sizes)]
    rows += [(9, 950 + i, None, "Color", "Red", s, "x") for i, s in enumerate("LMS")]
    df = spark.createDataFrame(rows, "product_id long, variant_id long, position long, option1_name string, option1_value string, option2_name string, sku string").withColumnRenamed("option2_name", "option2_value")

    def places():
        out = V.order_rows(df)
        return out.columns, out.dtypes, sorted(tuple(r) for r in out.collect())

    small = places()
    assert {r[0] for r in small[2]} == {1, 2, 3, 4, 8}
    for product in (1, 2, 3, 4, 8):
        ids = [(r[2] or 0, r[1]) for r in rows if r[0] == product]
        assert [r[1] for r in sorted((r for r in small[2] if r[0] == product), key=lambda r: r[3])] == [i for _, i in sorted(ids)]
        assert sorted(r[4] for r in small[2] if r[0] == product) == list(range(1, len(ids) + 1))
    monkeypatch.setattr(V, "LARGE", 30)  # product 1 alone is larger
    assert places() == small
    monkeypatch.setattr(V, "LARGE", 0)
    assert places() == small
    assert "ExistingRDD" not in V._far_places(df)._jdf.queryExecution().executedPlan().toString()  # compressed tables, not checkpoints
