"""Bind the driver tables to the engine's logical catalog tables.

Everything here is arithmetic on keys so another SQL engine can repeat it.  A real
deployment replaces this module by reads of its own catalog tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchgrid.functions.common import merged
from merchgrid.operators.images import with_catalog_image
from merchgrid.operators.intake import variant_options


def quarter(c):
    """Round to quarter dollars."""
    return F.floor(c * 4 + 0.5) / 4


# Tables that feed expensive per-row work, and the key by which their rows are dealt out.  A file is read by as many tasks as it
# has row groups, and these compress well: a million parts may be one group of a few MB.  There are as many parts as the
# session has shuffle partitions, unless ``spark.merchgrid.scan.partitions`` names another number.
DEALT = {"part": "p_partkey", "documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

COLORS = ["Red", "Navy Blue", "Matte Black / Polarized Gray", "Forest Green", "grey heather", "Off White"]
PAGE_COLORS = ["red", "Navy Blue", "Matte Black | Polarized Gray", "Forest", "Heather Grey", "Forest Green - New", "Off", "Grey Heather"]
SIZES = ["S", "M", "L", "XL", "XXS", "10.5", "32", "One Size"]


class Tables:
    """Lazy logical tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def scan(self, name: str) -> DataFrame:
        """A driver table as its files hold it; the footer is read once per instance."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def raw(self, name: str) -> DataFrame:
        """A driver table, dealt out if expensive work follows."""
        if name not in DEALT:
            return self.scan(name)
        return self._dealt(self.scan(name), DEALT[name])

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        parts = self.spark.conf.get("spark.merchgrid.scan.partitions", None) or self.spark.conf.get("spark.sql.shuffle.partitions")
        return rows.repartition(int(parts), key)

    # -- scalars -----------------------------------------------------------
    def reference_date(self):
        """Latest order date as a scalar subquery column."""
        return self.raw("orders").agg(F.max("o_orderdate").cast("timestamp")).scalar()

    def last_sale(self):
        """The same as stored, without a time zone."""
        return self.raw("orders").agg(F.max("o_orderdate")).scalar()

    def part_count(self):
        return self.scan("part").agg(F.count(F.lit(1))).scalar()

    # -- catalog -----------------------------------------------------------
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        docs = self.raw("documents").select(F.col("doc_id"), "text")
        kind = F.when(key % 17 == 0, F.lit("")).otherwise(F.initcap(F.element_at(F.split("p_name", " "), 2)))
        gender = F.when(key % 4 == 0, F.lit("gender:womens")).when(key % 4 == 1, F.lit("gender:mens"))
        season = F.when(key % 3 == 0, F.lit("season:winter"))
        tags = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat_ws(", ", F.lower("p_type"), gender, season))
        return self.raw("part").join(merged(docs), key == F.col("doc_id"), "left").select(
            key.alias("product_id"),
            self._handle().alias("handle"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("vendor"),
            kind.alias("product_type"),
            tags.alias("tags"),
            F.coalesce(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")), F.lit("")).alias("body_html"),
            F.when(key % 50 == 49, "draft").otherwise("active").alias("status"),
            F.element_at(F.split("p_name", " "), 2).alias("style"),
            F.when(key % 34 == 0, "Supply > Forge > Gears").when(key % 51 == 0, "Supply > Bars").otherwise("").alias("category"),
            F.when(key % 2 == 0, "female").otherwise("").alias("gender"),
            F.when(
                key % 97 != 0,
                F.timestamp_seconds(F.unix_seconds(self.reference_date()) - (key % 90) * 86400 - key % 5000),
            ).alias("created_at"),
        )

    @staticmethod
    def _handle():
        return F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))

    def handles(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), self._handle().alias("handle"), F.col("p_name").alias("title")
        )

    def variants(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        base = self.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(
            F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
            F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("disc_pts"),
            F.count(F.lit(1)).alias("n"),
        )
        # Quarter dollars are exact binary fractions, so sums agree in any order.
        price = quarter(F.col("cents") / F.col("units") / 100)
        disc = F.col("disc_pts") / F.col("n") / 100
        color = F.get(F.array(*[F.lit(c) for c in COLORS]), ((p + s) % 6).cast("int"))
        size = F.get(F.array(*[F.lit(c) for c in SIZES]), (s % 8).cast("int"))
        return base.select(
            (p * 100000 + s).alias("variant_id"),
            p.alias("product_id"),
            s.alias("position"),
            F.concat(F.lit("SKU-"), p.cast("string"), F.lit("-"), s.cast("string")).alias("sku"),
            F.when(s % 9 == 0, F.lit("")).otherwise(F.lpad((p * 1000 + s).cast("string"), 12, "0")).alias("barcode"),
            price.alias("price"),
            F.when(F.col("disc_pts") > 5 * F.col("n"), quarter(price * 1.25)).alias("compare_at_price"),
            quarter(price * (1 - disc) * 0.6).alias("cost"),
            F.when(p % 10 == 9, "Material").otherwise("Color").alias("option1_name"),
            color.alias("option1_value"),
            F.lit("Size").alias("option2_name"),
            size.alias("option2_value"),
            F.when((p % 6 == 0) | (s % 5 == 0), F.lit(""))
            .otherwise(
                F.concat(F.lit("https://img.example.com/"), p.cast("string"), F.lit("/"), ((p + s) % 6).cast("string"),
                         F.lit(".jpg?v="), s.cast("string"))
            ).alias("image_src"),
            F.when((p * 3 + s) % 31 == 0, F.lit(0.0)).otherwise(((p * 37 + s * 11) % 2500 + 40).cast("double")).alias("grams"),
            (s % 13 != 0).alias("requires_shipping"),
            ((p * 7 + s * 13) % 40).alias("qty"),
            (F.col("disc_pts") > 5 * F.col("n")).alias("on_sale"),
        )

    def inventory_levels(self) -> DataFrame:
        return self.variants().select(
            "variant_id", "product_id", "cost", "on_sale", F.concat(F.lit("loc"), (F.col("position") % 3).cast("string")).alias("location"), "qty")

    def order_lines(self) -> DataFrame:
        """Sold units with their order date."""
        return self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(
            merged(self.raw("orders").select("o_orderkey", "o_orderdate")), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("units"), F.col("o_orderdate").alias("sold_at"))

    # -- traffic -----------------------------------------------------------
    def _events(self) -> DataFrame:
        return self.raw("events").withColumn("pid", F.col("event_id") % self.part_count())

    def sessions_by_path(self) -> DataFrame:
        ev = self._events().join(merged(self.handles()), F.col("pid") == F.col("product_id"))
        path = F.concat(F.lit("/products/"), F.col("handle"), F.when(F.col("event_id") % 3 == 0, F.lit("?src=x")).otherwise(F.lit("")))
        seen = F.count_if(F.col("event_type").isin("view", "click"))
        bought = F.count_if(F.col("event_type") == "purchase")
        return ev.groupBy(path.alias("path")).agg(
            seen.alias("sessions"),
            F.least(F.lit(1.0), F.coalesce(F.try_divide(bought.cast("double"), seen.cast("double")), F.lit(0.0))).alias("conversion_rate"),
        )

    def online_sales(self) -> DataFrame:
        ev = self._events().where("event_type = 'purchase'").join(merged(self.handles()), F.col("pid") == F.col("product_id"))
        return ev.groupBy("title").agg(
            F.sum("value").alias("total_sales"), F.count(F.lit(1)).alias("orders"), F.count(F.lit(1)).alias("quantity_ordered")
        )

    @staticmethod
    def _offer():
        e, p = F.col("event_id"), F.col("pid")
        vid = (p * 100000 + e % 100).cast("string")
        return (
            F.when(e % 11 == 0, F.concat(F.lit("bare"), e.cast("string")))
            .when(e % 4 == 0, F.concat_ws("_", F.lit("shopify"), F.lit("US"), p.cast("string"), vid))
            .otherwise(F.concat_ws("_", F.lit("shopify"), F.lit("US"), vid))
        )

    def listing_perf(self) -> DataFrame:
        """Daily listing performance rows per offer."""
        # nearly every event is a group of its own, so a task that reads a large row group would hold it in its table
        ev = self._dealt(self._events().where(F.col("event_type").isin("view", "click")), "event_id")
        return ev.groupBy(self._offer().alias("offer_id"), F.to_date("ts").alias("day")).agg(
            F.count_if(F.col("event_type") == "click").alias("clicks"),
            (F.count_if(F.col("event_type") == "view") * 40).alias("impressions"),
        )

    def listing_status(self) -> DataFrame:
        """One landed status row per error event, with nested issues per reporting context."""
        e, v = F.col("event_id"), F.col("value")
        country = F.when(e % 2 == 0, F.array(F.lit("US"))).otherwise(F.array().cast("array<string>"))
        ctx = lambda name, c: F.struct(F.lit(name).alias("context"), c.alias("countries"))
        issue = lambda name, *cs: F.struct(F.lit(name).alias("resolution"), F.array(*cs).alias("contexts"))
        return self._dealt(self._events().where("event_type = 'error'"), "event_id").select(
            self._offer().alias("offer_id"),
            e.alias("ord"),
            F.when(v > 10, "DISAPPROVED").otherwise("ELIGIBLE").alias("status"),
            F.array(
                issue("fix_image", ctx("ads", country), ctx("free", F.array(F.lit("US")))),
                issue("fix_price", ctx("ads", F.when(v > 30, F.array(F.lit("US"))).otherwise(F.array().cast("array<string>")))),
            ).alias("item_issues"),
        )

    def image_queue(self) -> DataFrame:
        """Product images waiting for a colour: some labelled, some with a free description."""
        v = self.variants().where("image_src <> ''")
        p, s = F.col("product_id"), F.col("position")
        words = F.array(*[F.lit(x) for x in ("deep red", "blue and navy", "black polarized", "bright green forest", "grey", "a product")])
        return v.select(
            "product_id", s.cast("bigint").alias("ord"), F.col("image_src").alias("url"),
            F.when((p + s) % 3 == 0, F.col("option1_value")).alias("label"),
            F.get(words, ((p + s * 5) % 6).cast("int")).alias("description"),
        )

    def color_options(self) -> DataFrame:
        v = self.variants()
        return v.groupBy("product_id", F.col("option1_value").alias("option")).agg(F.min("position").cast("bigint").alias("ord"))

    # -- curation ----------------------------------------------------------
    def rank_overrides(self) -> DataFrame:
        """Hand-made overrides for a few handles (pins, boosts, buries)."""
        key = F.col("product_id")
        return self.handles().where((key % 41 == 3) | (key % 37 == 5)).select(
            "handle",
            F.when(key % 41 == 3, key % 23 + 1).alias("pin"),
            F.when(key % 5 == 0, F.lit(0.25)).otherwise(F.lit(0.0)).alias("boost"),
            (key % 37 == 5).alias("bury"),
        )

    def collection_members(self) -> DataFrame:
        return self.raw("part").select(F.lower("p_type").alias("collection"), F.col("p_partkey").alias("product_id"))

    def catalog_items(self) -> DataFrame:
        """Vendor catalog rows: images by barcode and by (vendor, style, colour)."""
        full = F.col("product_id") % 10 == 3  # products whose every barcode is in the catalog
        v = self.variants().where(((F.col("position") % 7 == 1) | full) & (F.col("barcode") != ""))
        host = F.when((F.col("position") % 2 == 0) | full, F.lit("https://cdn.example.org/")).otherwise(F.lit("https://swatch.example.net/"))
        coded = v.select(
            F.col("barcode"), F.concat(host, F.col("barcode"), F.lit(".jpg")).alias("image_url"),
            F.lit("").alias("vendor"), F.lit("").alias("style"), F.lit("").alias("color"),
        )
        key = F.col("p_partkey")
        styled = self.raw("part").where(key % 13 == 0).select(
            F.lit("").alias("barcode"), F.concat(F.lit("https://cdn.example.org/style/"), key.cast("string"), F.lit(".jpg")).alias("image_url"),
            F.col("p_brand").alias("vendor"), F.element_at(F.split("p_name", " "), 2).alias("style"),
            F.get(F.array(*[F.lit(c) for c in COLORS]), (key % 6).cast("int")).alias("color"),
        )
        return coded.unionByName(styled)

    def page_colors(self) -> DataFrame:
        """Colour names as a vendor page spells them, with their order on the page."""
        names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("candidate")) for i, c in enumerate(PAGE_COLORS)])
        rows = self.raw("part").select(F.col("p_partkey").alias("product_id"), F.explode(names).alias("c")).select("product_id", "c.*")
        return rows.where((F.col("product_id") + F.col("ord")) % 3 != 0)

    def color_labels(self) -> DataFrame:
        """Image labels as a classifier would land them."""
        v = self.variants().where("image_src <> '' and product_id % 3 = 0")
        fam = F.get(F.array(F.lit("Red"), F.lit("Navy"), F.lit("Black")), (F.col("position") % 3).cast("int"))
        return v.select("product_id", F.col("option1_value").alias("color"), F.substring_index("image_src", "?", 1).alias("image_url"), fam.alias("label")).distinct()

    # -- matching ------------------------------------------------------------
    def search_results(self) -> DataFrame:
        """Landed search hits: six candidate shapes per part."""
        p = F.col("p_partkey")
        ps = p.cast("string")
        v = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
        noun = F.element_at(F.split("p_name", " "), 2)
        site = F.concat(F.lit("https://www."), v, F.lit(".example.com"))
        handle = self._handle()
        price = F.floor("p_retailprice").cast("bigint")

        def row(kind, url, title, snippet=F.lit("")):
            return F.struct(F.lit(kind).alias("strategy"), F.concat(*url).alias("url"), F.concat(*title).alias("title"), snippet.alias("snippet"))

        code = F.lpad((p * 1000).cast("string"), 12, "0")
        rows = F.array(
            row("barcode", [site, F.lit("/products/"), handle], [F.col("p_name")],
                F.concat(F.lit("Code "), F.when(p % 2 == 0, code).otherwise("none"), F.lit(" now $"), (price + p % 3 * 300).cast("string"), F.lit(".50"))),
            row("sku", [site, F.lit("/shop/mens/jackets/all/"), noun], [F.col("p_name"), F.lit(" Mid "), (2020 + p % 6).cast("string")]),
            row("title", [F.lit("https://"), v, F.lit(".example.com/collections/all?page=2&sort=x")], [F.lit("Shop all "), noun, F.lit("s | Official")]),
            row("title", [site, F.lit("/p/"), ps, F.lit("/")], [F.col("p_brand"), F.lit(" "), noun, F.lit(" "), (p % 100).cast("string"), F.lit(" limited")],
                F.concat(F.lit("from $"), price.cast("string"))),
            row("title", [site, F.lit("/blog/about-"), noun, F.lit("-story-"), ps], [noun, F.lit(" boots for women")]),
            row("title", [site, F.lit("/products/"), handle, F.lit("/")], [F.col("p_name"), F.lit(" - "), F.col("p_brand")]),
        )
        title = (
            F.when(p % 3 == 0, F.concat("p_brand", F.lit(" "), "p_name")).when(p % 3 == 1, F.concat("p_name", F.lit(" Low "), (p % 50).cast("string")))
            .otherwise(F.col("p_name"))
        )
        base = self.raw("part").select(
            p.alias("product_id"), title.alias("product_title"), F.col("p_brand").alias("vendor"), price.cast("double").alias("price"),
            code.alias("barcode"), F.concat(F.lit("SKU-"), ps).alias("sku"), (p % 5).alias("broad_count"), F.posexplode(rows).alias("ord", "r"),
        )
        return base.select("product_id", "product_title", "vendor", "price", "barcode", "sku", "broad_count", F.col("ord").cast("bigint").alias("ord"), "r.*").withColumn(
            "live", (F.col("product_id") + F.col("ord")) % 4 != 0
        )

    def candidate_pages(self) -> DataFrame:
        """Scraped page and extracted facts per candidate URL."""
        c = self.search_results()
        p, o = F.col("product_id"), F.col("ord")
        blank = F.array().cast("array<string>")
        return c.select(
            "url",
            F.when((p + o) % 9 == 0, F.lit("Just a moment, checking your browser")).otherwise(
                F.concat(F.lit("# Menu\n\n## "), "title", F.lit("\n\n"), F.repeat(F.lit("A long product story about parts. "), 20))
            ).alias("markdown"),
            F.when((p + o) % 7 == 0, F.lit("")).otherwise(F.col("title")).alias("product_name"),
            F.when(o % 2 == 0, F.col("price") * (1.0 + (p % 8) / 10.0)).alias("scraped_price"),
            F.when(p % 4 == 0, blank).otherwise(F.array(F.lit("red"), F.lit("Black"), F.lit("forest green"))).alias("vendor_colors"),
            ((p + o * 3) % 10 * 10.0).alias("content_score"),
        )

    def title_pairs(self) -> DataFrame:
        """Each answer as page title, the last user turn before it as catalog title."""
        before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        asked = F.last(F.when(F.col("role") == "user", F.struct("turn", "text")), ignorenulls=True).over(before)
        c = self.raw("conversations").withColumn("q", asked).where("role = 'assistant' and q is not null")
        return c.select("conv_id", "q.turn", F.col("q.text").alias("catalog_title"), F.col("text").alias("page_title"))

    def season_rows(self) -> DataFrame:
        p = F.col("p_partkey")
        cols = lambda *c: F.array(*[F.lit(x) for x in c])
        return self.raw("part").select(
            p.alias("product_id"),
            F.when(p % 3 == 0, cols("Red", "Black", "Forest Green")).when(p % 3 == 1, cols("Navy Blue", "Sand / Oat")).otherwise(cols("Red")).alias("catalog_colors"),
            F.when(p % 5 == 0, cols("red", "Sand | Oat")).when(p % 5 == 1, cols("teal", "Matte Black", "plum")).otherwise(cols("forest green", "red")).alias("vendor_colors"),
            F.array(F.concat(F.lit("season:"), (2022 + p % 4).cast("string")), F.lit("sale")).alias("tags"),
            F.concat(F.lit("https://x.example.com/"), F.when(p % 2 == 0, F.concat((2021 + p % 7).cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("fw"), (22 + p % 5).cast("string"), F.lit("-"))),
                     F.lit("item")).alias("url"),
        )

    def vendor_catalog(self) -> DataFrame:
        """Another catalog to match titles against: words of the part names, reordered and mixed."""
        p = F.col("p_partkey")
        w = F.split("p_name", " ")
        extra = F.get(F.array(*[F.lit(x) for x in ("", " deluxe", " boots", " 2025", " verbier edition")]), (p % 5).cast("int"))
        return self.raw("part").select(
            (p % 4).alias("domain"), p.alias("other_id"), F.concat(F.element_at(w, 2), F.lit(" "), F.element_at(w, 1), extra).alias("other_title")
        )

    def match_titles(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select(
            (p % 4).alias("domain"), p.alias("product_id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(p % 2 == 0, " boots").otherwise("")).alias("title")
        )

    # -- content -------------------------------------------------------------
    def facts(self) -> DataFrame:
        """Extracted facts per document: long lines are blocks, short lines are bullets."""
        d = F.col("doc_id")
        lines = F.split("text", "\n")
        return self.raw("documents").select(
            d, F.concat(F.lit("doc-"), d.cast("string")).alias("handle"),
            F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("product_name"),
            F.when(d % 3 != 0, F.col("source")).otherwise("").alias("brand"),
            F.filter(lines, lambda x: F.length(x) >= 120).alias("blocks"),
            F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 120)).alias("bullets"),
            F.when(d % 4 == 0, F.create_map().cast("map<string,string>")).when(
                d % 4 == 1, F.create_map(F.lit("weight"), F.concat(F.col("n_chars").cast("string"), F.lit(" g")))
            ).otherwise(F.create_map(F.lit("weight"), F.concat(F.col("n_chars").cast("string"), F.lit(" g")), F.lit("fit"), F.col("lang"))).alias("specs"),
            F.when(d % 3 == 0, "80% cotton, 20% nylon").when(d % 3 == 1, "soft shell fabric").otherwise("").alias("materials"),
            F.when(d % 5 == 0, "machine wash cold inside").otherwise("").alias("care"),
            F.when(d % 10 == 0, F.col("text")).otherwise("").alias("ld_description"), "lang", "text",
        )

    def outputs(self) -> DataFrame:
        """Generated descriptions with facts and verification counts."""
        f, d = self.facts(), F.col("doc_id")
        li = F.transform("bullets", lambda b: F.concat(F.lit("<li>"), F.regexp_replace(b, "[<>]", " "), F.lit("</li>")))
        html = F.concat(
            F.when(d % 9 != 8, F.concat(F.lit("<p>"), F.regexp_replace(F.when(F.size("blocks") > 0, F.array_join("blocks", "\n")).otherwise("A stunning perfect part."), "[<>]", " "), F.lit("</p>"))).otherwise(""),
            F.when(d % 2 == 0, F.concat(F.lit("<ul>"), F.array_join(li, ""), F.lit("</ul>"))).otherwise(""),
            F.when(d % 3 == 0, F.lit("<h3>Specs</h3><table><tr><td>80% cotton, 20% nylon</td></tr></table>")).otherwise(""),
        )
        lab = self.raw("labels").select(F.col("doc_id").alias("lid"), "quality", "toxic")
        return f.join(merged(lab), d == F.col("lid"), "left").select(
            *f.columns, html.alias("body_html"), F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").alias("verdict"),
            (F.col("quality") * 3 + d % 3).alias("n_supported"), F.coalesce("toxic", F.lit(0)).alias("n_unsupported"), (d % 2).alias("n_embellished"),
        )

    # -- review ---------------------------------------------------------------
    def decisions(self) -> DataFrame:
        """Decision log: three tried candidates per part."""
        p = F.col("p_partkey")
        outcomes = ["accept", "reject_title_gate", "reject_bot_blocked", "skip_low_confidence", "reject_post_extraction", "accepted", "reject_title_gate"]
        title = F.when(p % 3 == 1, F.concat("p_name", F.lit(" Low "), (p % 50).cast("string"))).otherwise(F.col("p_name"))

        def tried(k: int):
            kind = F.get(F.array(*[F.lit(o) for o in outcomes]), ((p * 3 + k * 5) % 7).cast("int"))
            noun = F.element_at(F.split("p_name", " "), 2)
            page = F.when((p + k) % 3 == 0, F.col("p_name")).when((p + k) % 3 == 1, F.concat(noun, F.lit(" boots deluxe edition"))).otherwise(F.lit("spare catalog entry"))
            hundredth = lambda c: c / F.lit(100.0)
            return F.struct(
                F.concat(F.lit("https://x.example.com/"), p.cast("string"), F.lit(f"/{k}")).alias("url"), kind.alias("outcome"),
                ((p * 7 + k * 13) % 100).cast("double").alias("resolver_confidence"), F.when((p + k) % 5 != 0, ((p * 3 + k) % 100).cast("double")).alias("confidence"),
                page.alias("title_extracted"),
                F.create_map(F.lit("title_similarity"), hundredth((p + k * 11) % 100), F.lit("word_overlap"), hundredth((p * 3 + k) % 50)).alias("metrics"),
                F.create_map(F.lit("foreign"), F.when(p % 2 == 0, -20.0).otherwise(-5.0), F.lit("critical"), F.lit(-30.0), F.lit("demographic"), F.lit(-15.0)).alias("penalties"),
                F.when((p + k) % 4 == 0, " -foreign_product(x)").otherwise("").alias("rescore_reasoning"),
                F.struct(hundredth((p * 11 + k) % 100).alias("title_similarity"), hundredth((p * 5 + k) % 100).alias("price_ratio"),
                         hundredth((p * 3 + k * 7) % 100).alias("color_overlap"), ((p + k) % 2).cast("double").alias("content_quality")).alias("signals"))

        base = self.raw("part").select(
            p.alias("decision_id"), F.concat(F.lit("h-"), (p % 700).cast("string")).alias("handle"), F.when(p % 6 == 0, "").otherwise(F.col("p_brand")).alias("vendor"),
            title.alias("catalog_title"), (p * 10).alias("ts"), F.when(p % 9 == 0, F.array(F.lit("bolt"))).otherwise(F.array().cast("array<string>")).alias("type_words"),
            F.array(*[tried(k) for k in range(3)]).alias("candidates_tried"), F.when(p % 2 == 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("resolver_candidates"))
        ok = F.exists("candidates_tried", lambda c: c["outcome"].isin("accept", "accepted"))
        return base.withColumn("outcome", F.when(ok, "accept").otherwise("no_match"))

    def changes(self) -> DataFrame:
        """Proposed product changes with their review state, from documents and labels."""
        o, d = self.outputs(), F.col("doc_id")
        status = (
            F.when(F.col("verdict").isNull(), "pending").when(d % 11 == 0, "applied").when(d % 13 == 0, "reverted")
            .when((d % 7 == 0) & (F.col("verdict") == "PASS"), "edited").when(F.col("verdict") == "PASS", "approved").otherwise("rejected"))
        img = lambda n, salt: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("https://i.example.com/"), ((d + i * salt) % 7).cast("string"), F.lit(".jpg")))
        return o.select(
            "doc_id", "handle", F.concat(F.lit("run_"), (d % 3).cast("string")).alias("run_id"), status.alias("status"),
            F.when(F.col("n_unsupported") > 0, "toxic").when((status == "rejected") & (d % 2 == 0), "off topic").otherwise("").alias("reason"),
            F.col("body_html").alias("new_body_html"), F.when(d % 4 == 0, F.col("body_html")).otherwise("<p>old</p>").alias("current_body_html"),
            F.when(status == "edited", F.concat(F.lit("<b>x</b>"), F.col("body_html"))).otherwise("").alias("edited_body_html"), (d % 101).cast("int").alias("confidence"),
            img(d % 4 + 1, 2).alias("current_images"), img(d % 3 + 1, 3).alias("new_images"), F.when(d % 5 == 0, "").otherwise("Bolt").alias("product_type"), F.lit("").alias("tags"))

    def manifest(self) -> DataFrame:
        p = F.col("p_partkey")
        ids = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: p * 10 + i)
        none = F.array().cast("array<bigint>")
        return self.raw("part").select(
            F.concat(F.lit("run_"), (p % 3).cast("string")).alias("run_id"), self._handle().alias("handle"), F.col("p_name").alias("before_body"),
            F.transform(ids(p % 3 + 1), lambda i: F.struct(i.alias("id"), F.when(i % 2 == 0, F.array(i, i + 1)).otherwise(none).alias("variant_ids"))).alias("before_images"),
            F.when(p % 4 != 0, F.lit("<p>new</p>")).alias("pushed_body"), F.when(p % 5 == 0, none).otherwise(ids(p % 4 + 1)).alias("images_created"))

    def iteration_scores(self) -> DataFrame:
        """Stored description scores of five prompt iterations."""
        d, i = F.col("doc_id"), F.col("iteration")
        return self.raw("documents").select(d, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("iteration")).select(
            i, F.concat(F.lit("doc-"), d.cast("string")).alias("handle"), ((d + i * 3) % 26).alias("structure"), ((d * 3 + i) % 16).alias("length"), ((d + i) % 16).alias("anti_hype"),
            ((d * 5 + i * 2) % 16).alias("coverage"), (d % 10 == 0).alias("in_feedback"))

    def vendors(self) -> DataFrame:
        n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        return self.raw("part").select("p_brand", n.alias("n")).distinct().where("n % 6 <> 5").select(
            F.col("p_brand").alias("vendor"), (F.col("n") % 4 == 1).alias("blocked"), (F.col("n") % 8 == 1).alias("house_brand"))

    def variants_with_options(self) -> DataFrame:
        """Variants with colour, size and the catalog image of their barcode."""
        return with_catalog_image(variant_options(self.variants()), self.catalog_items())

    def color_map(self) -> DataFrame:
        """Scraped colour to image rows per product, a hero for some and none for others."""
        p = F.col("product_id")
        rows = self.page_colors().where(p % 8 != 7).select(
            "product_id", F.when((p % 8 == 3) & (F.col("ord") <= 1), "__all__").otherwise(F.col("candidate")).alias("color"), F.col("ord").cast("bigint").alias("ord"),
            F.concat(F.lit("https://scraped.example.com/"), p.cast("string"), F.lit("/"), F.col("ord").cast("string"), F.lit(".jpg")).alias("url"),
            (p % 50 + 50).cast("int").alias("confidence"))
        return rows
