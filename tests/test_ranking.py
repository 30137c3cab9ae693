import random

from pyspark.sql import functions as F

from merchgrid.functions.ranking import distributed_rank, top_k
from merchgrid.operators import ranking as R


def slots_by_hand(items):
    """items: (id, score, pin); the slot rule written out for one small group."""
    n = len(items)
    pins = {}
    for i, _, pin in sorted(items):
        if pin is not None:
            pins[pin] = i
    rank = {i: 0 for i, _, _ in items}
    queue = [i for i, s, p in sorted(items, key=lambda t: (-t[1], t[0])) if p is None]
    free = [k for k in range(1, n + 1) if k not in pins]
    for p, i in pins.items():
        if 1 <= p <= n:
            rank[i] = p
    rank.update(dict(zip(queue, free)))
    return rank


def scored(spark, groups):
    rows = [(g, i, float(s), p) for g, items in groups.items() for i, s, p in items]
    return spark.createDataFrame(rows, "g string, product_id long, total_score double, pin long")


def test_pins_fixture(spark):
    items = [(1, 9, None), (2, 8, 1), (3, 7, None), (4, 1, 3), (5, 0.5, 9)]
    out = {r.product_id: r["rank"] for r in R.assign_slots(scored(spark, {"a": items}), "g").collect()}
    assert [out[i] for i in range(1, 6)] == [2, 1, 4, 3, 0]


def test_pins_random_groups(spark):
    rng = random.Random(4)
    groups = {f"g{k}": [(i, rng.randint(0, 6), rng.choice([None, None, None, rng.randint(1, 14)])) for i in range(rng.randint(1, 12))] for k in range(15)}
    df = scored(spark, groups)
    got = {(r.g, r.product_id): r["rank"] for r in R.assign_slots(df, "g").collect()}
    for g, items in groups.items():
        assert {i: got[g, i] for i, _, _ in items} == slots_by_hand(items)


def test_no_product_of_a_large_collection_is_cut(spark):
    n = 5000
    members = spark.range(1, n + 1).select(F.lit("c").alias("collection"), F.col("id").alias("product_id"), F.concat(F.lit("h"), "id").alias("handle"), F.lit(None).cast("timestamp").alias("created_at"))
    v = spark.range(1, n + 1).select(F.col("id").alias("product_id"), F.lit(5.0).alias("cost"), F.lit(10.0).alias("price"))
    vel = spark.range(1, n + 1).select(F.col("id").alias("product_id"), F.col("id").cast("double").alias("weekly_avg"))
    inv = v.select("product_id", F.lit(50).cast("long").alias("total"))
    none = spark.createDataFrame([], "handle string, pin long, boost double, bury boolean")
    ref = F.to_timestamp(F.lit("2024-01-01"))
    out = R.rank_collections(members, v, vel, inv, none, ref)
    assert out.count() == n and out.where("rank = 1").first().product_id == n
    assert sorted(r["rank"] for r in R.rank_collections(members, v, vel, inv, none, ref, limit=3).collect()) == [1, 2, 3]


def test_distributed_rank_with_one_hot_group(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 7919 % 50).alias("s"))
    out = distributed_rank(df, ["g"], [F.desc("s"), F.col("id")], "r")
    rows = out.collect()
    assert len(rows) == 5000
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(((-r.s, r.id), r.r))
    for g in by.values():
        assert [r for _, r in sorted(g)] == list(range(1, len(g) + 1))


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = top_k(df, ["g"], [F.desc("id")], 2)
    assert sorted(r.id for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_margin_uses_the_count_of_costed_variants(spark):
    v = spark.createDataFrame([(1, 5.0, 10.0), (1, 0.0, 10.0)], "product_id long, cost double, price double")
    assert R.margin_stats(v).first().margin_pct == (20.0 - 5.0) / 20.0 * 100


def test_age_floors_elapsed_time(spark):
    r = spark.sql("select timestamp'2024-01-01 23:59:59' a, timestamp'2024-01-02 00:00:00' b").select(
        R.age_days(F.col("a"), F.col("b")).alias("d"), R.age_days(F.lit(None).cast("timestamp"), F.col("b")).alias("n")).first()
    assert (r.d, r.n) == (0, 999)


def test_bury_and_pin_in_a_collection(spark):
    members = spark.createDataFrame([("c", 1, "fast", "F", "V"), ("c", 2, "slow", "S", "V")], "collection string, product_id long, handle string, title string, vendor string").withColumn("created_at", F.lit(None).cast("timestamp"))
    v = spark.createDataFrame([(1, 5.0, 10.0), (2, 5.0, 10.0)], "product_id long, cost double, price double")
    vel = spark.createDataFrame([(1, 40.0), (2, 1.0)], "product_id long, weekly_avg double")
    inv = spark.createDataFrame([(1, 200), (2, 5)], "product_id long, total long")
    ref = F.to_timestamp(F.lit("2024-01-01"))
    run = lambda over: {r.handle: r["rank"] for r in R.rank_collections(members, v, vel, inv, spark.createDataFrame(over, "handle string, pin long, boost double, bury boolean"), ref).collect()}
    assert run([("slow", 1, 0.0, False)]) == {"slow": 1, "fast": 2}
    assert run([("fast", None, 0.0, True)]) == {"slow": 1, "fast": 2}
    assert run([("none", 1, 0.0, False)]) == {"fast": 1, "slow": 2}
