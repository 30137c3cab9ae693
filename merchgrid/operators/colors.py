"""Colour jobs over products: cross-source matching, family votes, image assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions.colors import best_option, description_words, family, loosely_contains, normalize, option_words
from merchgrid.functions.common import merged


def _grams(c: Column) -> Column:
    """Blocking keys of a longer name: its 3-grams, and 1/2-grams when a name below 3 letters could fit."""
    n = F.length(c)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>"))
    short = F.when(n < 6, F.concat(cut(1), cut(2))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(3), short))


def match_colors(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate colour per (product_id, color): exact, normalised, then containment.

    ``candidates(product_id, candidate, ord)``; within a tier the lowest ``ord`` wins.
    One equi-join serves all tiers, so each side is built once: names meet by their normal
    form, and for containment by letter grams, as the shorter name's first three letters must
    occur in the longer one.  The join is exact without pairing all colours of a product.
    """
    t = targets.select("product_id", "color").distinct().withColumn("norm", normalize(F.col("color")))
    c = candidates.groupBy("product_id", "candidate").agg(F.min("ord").alias("ord")).withColumn("cnorm", normalize(F.col("candidate")))
    # n: equal names; i: the candidate begins inside the target; o: the target begins inside the candidate
    marked = lambda kind, c: F.concat(F.lit(kind), c)
    heads = lambda n, kind: F.array(marked("n", F.col(n)), marked(kind, F.left(F.col(n), F.lit(3))))
    grams = lambda n, kind: F.transform(_grams(F.col(n)), lambda g: marked(kind, g))
    t = t.withColumn("k", F.explode(F.concat(heads("norm", "o"), grams("norm", "i"))))
    c = c.withColumn("k", F.explode(F.concat(heads("cnorm", "i"), grams("cnorm", "o"))))
    tier = F.when(F.col("color") == F.col("candidate"), 1).when(F.col("norm") == F.col("cnorm"), 2).when(loosely_contains(F.col("norm"), F.col("cnorm")), 3)
    met = t.join(merged(c), ["product_id", "k"]).select("product_id", "color", F.struct(tier.alias("tier"), "ord", "candidate").alias("m")).where("m.tier is not null")
    return met.groupBy("product_id", "color").agg(F.min("m").alias("m")).select(
        "product_id", "color", F.col("m.candidate").alias("matched"), F.col("m.tier").alias("tier")
    )


def color_groups(variants: DataFrame) -> DataFrame:
    """Distinct images (query string dropped) per product and colour."""
    url = F.substring_index("image_src", "?", 1)
    named = variants.where("option1_value <> '' and image_src <> ''")
    return named.select("product_id", F.col("option1_value").alias("color"), url.alias("image_url")).distinct()


def image_pairs(variants: DataFrame) -> DataFrame:
    """One row per (product, colour, image without query) with its first variant as representative."""
    named = variants.where("option1_value <> '' and image_src <> ''").withColumn("image_url", F.substring_index("image_src", "?", 1))
    return named.groupBy("product_id", F.col("option1_value").alias("color"), "image_url").agg(
        F.min_by(F.struct("variant_id", "image_src"), F.struct("position", "variant_id")).alias("r")
    ).select("product_id", "color", "image_url", "r.variant_id", "r.image_src")


def family_votes(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Colour family per (product, colour): most voted image label, else the name.

    Votes are counted per label before the winner is taken; more than one distinct
    image marks an anomaly.
    """
    images = groups.groupBy("product_id", "color").agg(F.count(F.lit(1)).alias("images"))
    votes = (
        groups.join(merged(labels), ["product_id", "color", "image_url"])
        .groupBy("product_id", "color", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("product_id", "color").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("voted"))
    )
    by_name = family(F.col("color"))
    return images.join(merged(votes), ["product_id", "color"], "left").select(
        "product_id", "color", "images",
        F.coalesce("voted", by_name, F.lit("")).alias("family"),
        F.when(F.col("voted").isNotNull(), "vision").when(by_name.isNotNull(), "text").otherwise("unknown").alias("source"),
        (F.col("images") > 1).alias("anomaly"),
    )


def assign_images(images: DataFrame, options: DataFrame) -> DataFrame:
    """One image per colour (W13): labelled images first, free descriptions for the rest.

    ``images(product_id, ord, url, label, description)``, ``options(product_id, option, ord)``.
    A label goes to its first image.  Descriptions are consumed in image order and each
    taken colour leaves the pool: one fold per product over its images with the pool as state, planned
    as a whole.  Images that fit no open colour are left out before, and of equally described
    ones only as many as the pool has colours can be taken, so a product's list stays short however
    many images repeat a description.
    """
    labelled = images.join(merged(options.select("product_id", F.col("option").alias("label")).distinct()), ["product_id", "label"])
    first = labelled.groupBy("product_id", F.col("label").alias("option")).agg(F.min(F.struct("ord", "url")).alias("i"))
    done = first.select("product_id", "option", "i.url", F.lit("label").alias("via"))
    pools = options.join(merged(done.select("product_id", "option")), ["product_id", "option"], "left_anti").groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "option", option_words(F.col("option")).alias("words")))).alias("pool"))
    # Images that lost their label's colour do not come back: only unlabelled ones are described.
    free = images.where("label is null and description is not null").select("product_id", "ord", "url", description_words(F.col("description")).alias("words"))
    fit = free.join(merged(pools), "product_id").where(best_option(F.col("words"), F.col("pool")).isNotNull())
    nth = F.row_number().over(Window.partitionBy("product_id", "words").orderBy("ord", "url"))
    fit = fit.withColumn("nth", nth).where(F.col("nth") <= F.size("pool"))
    queues = fit.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url", "words"))).alias("queue"), F.min("pool").alias("pool"))
    start = F.struct(F.col("pool"), F.array().cast("array<struct<option:string,url:string>>").alias("taken"))

    def take(state: Column, image: Column) -> Column:
        after = lambda o: F.when(o.isNull(), state).otherwise(F.struct(
            F.filter(state["pool"], lambda x: x["option"] != o).alias("pool"), F.concat(state["taken"], F.array(F.struct(o.alias("option"), image["url"].alias("url")))).alias("taken")))
        return F.get(F.transform(F.array(best_option(image["words"], state["pool"])), after), F.lit(0))

    taken = queues.select("product_id", F.explode(F.aggregate("queue", start, take, lambda s: s["taken"])).alias("t"))
    return done.unionByName(taken.select("product_id", "t.option", "t.url", F.lit("description").alias("via")))


def selected_images(variants: DataFrame, mapped: DataFrame, images: DataFrame) -> DataFrame:
    """Position of the proposed image of every variant colour.

    ``mapped(product_id, color, ord, url)`` is the colour map, ``images(product_id, position,
    url)`` the proposed list; colours meet through the tiers of ``match_colors``.
    """
    first = mapped.groupBy("product_id", "color").agg(F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"))
    found = match_colors(variants.where("color <> ''").select("product_id", "color"), first.select("product_id", F.col("color").alias("candidate"), "ord"))
    place = images.groupBy("product_id", "url").agg(F.min("position").alias("position"))
    return found.join(merged(first.select("product_id", F.col("color").alias("matched"), "url")), ["product_id", "matched"]).join(merged(place), ["product_id", "url"], "left").select(
        "product_id", "color", "url", F.coalesce("position", F.lit(0)).alias("position"))
