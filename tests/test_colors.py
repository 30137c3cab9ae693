import random

from pyspark.sql import functions as F

from merchgrid.functions import colors as FC
from merchgrid.operators import colors as C
from merchgrid.operators import intake as N


def col(spark, values, fn):
    return [r.o for r in spark.createDataFrame([(v,) for v in values], "c string").select(fn(F.col("c")).alias("o")).collect()]


def test_normalize(spark):
    a, b, c, d = col(spark, ["Matte Black / Polarized Gray", "Matte Black | Polarized Gray", "Black w/Black", "X-Dye - Red"], FC.normalize)
    assert a == b == "matte black polarized gray" and c == "black w black" and d == "x-dye red"


def test_query_term(spark):
    got = col(spark, ["Black / Silver w/ Mirror Silver Lens", "Black Rib", "Ceramic", "Black / Black", "Teal Blue", "navy", "Heather"], FC.query_term)
    assert got == ["black silver", "black", "beige", "black", "teal blue", "dark blue", "heather"]


def test_family(spark):
    got = col(spark, ["Navy Blue", "Red/Blue", "Default Title", "", "Obsidian", "Deep Forest", "charcoal-x", "zzz", "Grey", "Red/", None], FC.family)
    assert got == ["Navy", "Multi", None, None, "Black", "Green", "Gray", None, None, "Red", None]


def norm(c):
    import re
    c = re.sub(r"\s*[/|]\s*", " ", c)
    return re.sub(r"\s+", " ", re.sub(r"\s+-\s+", " ", c)).strip().lower()


def close_by_hand(c, t):
    short, long = sorted([norm(c), norm(t)], key=len)
    return bool(short) and short in long and len(short) * 2 > len(long)


def match_by_hand(t, cands):
    for i, tier in enumerate([lambda c: c == t, lambda c: norm(c) == norm(t), lambda c: close_by_hand(c, t)]):
        for c in cands:
            if tier(c):
                return c, i + 1
    return None


def test_match_colors_against_all_pairs(spark):
    rng = random.Random(9)
    words = ["red", "Red", "navy", "blue", "ab", "a", "ba", "matte", "black / gray", "black | gray", "gr", "gray", "green - new"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
    targets = [(p, make()) for p in range(40) for _ in range(4)]
    cands = {p: list(dict.fromkeys(make() for _ in range(6))) for p in range(40)}
    t = spark.createDataFrame(targets, "product_id long, color string")
    c = spark.createDataFrame([(p, x, i) for p, xs in cands.items() for i, x in enumerate(xs)], "product_id long, candidate string, ord long")
    got = {(r.product_id, r.color): (r.matched, r.tier) for r in C.match_colors(t, c).collect()}
    want = {}
    for p, color in set(targets):
        # equal normal forms and containment of equal length strings rank below exact
        m = match_by_hand(color, cands[p])
        if m:
            want[p, color] = m
    assert got == want


def fuzzy_by_hand(desc, options):
    noise = set("and with the a an dark light bright deep pale matte product is color colored".split())
    d = {w.strip(",.") for w in desc.lower().split()} - noise
    best, score, dom = None, 0, False
    for o in options:
        ws = [w for w in o.lower().replace("/", " ").replace("-", " ").split() if w not in noise]
        n = len(d & set(ws))
        if n > score:
            best, score, dom = o, n, bool(ws) and ws[0] in d
    if score < 1 or (score < (2 if len(d) >= 2 else 1) and not dom):
        return None
    return best


def test_assign_images_against_the_sequential_rule(spark):
    rng = random.Random(2)
    pool = ["Red/Black", "Navy Blue", "Forest Green", "Red Sand", "Black"]
    descs = ["dark red", "black and red", "navy blue product", "green forest", "sand", "blue", "a product", "red sand black"]
    imgs, opts, want = [], [], set()
    for p in range(30):
        options = rng.sample(pool, rng.randint(1, 5))
        opts += [(p, o, i) for i, o in enumerate(options)]
        mine = [(p, i, f"u{p}-{i}", rng.choice([None, None, *options, "Plaid"]), rng.choice([*descs, None])) for i in range(rng.randint(0, 9))]
        imgs += mine
        left = list(options)
        for _, _, url, label, _ in mine:
            if label in left:
                want.add((p, label, url))
                left.remove(label)
        for _, _, url, label, desc in mine:
            if label is None and desc and left:
                hit = fuzzy_by_hand(desc, left)
                if hit:
                    want.add((p, hit, url))
                    left.remove(hit)
    i = spark.createDataFrame(imgs, "product_id long, ord long, url string, label string, description string")
    o = spark.createDataFrame(opts, "product_id long, option string, ord long")
    got = {(r.product_id, r.option, r.url) for r in C.assign_images(i, o).collect()}
    assert got == want


def test_family_vote_and_fallback(spark):
    g = spark.createDataFrame([(1, "Obsidian", "a"), (1, "Obsidian", "b"), (1, "Obsidian", "c"), (2, "Ivory", "d"), (3, "zz", "e")], "product_id long, color string, image_url string")
    lab = spark.createDataFrame([(1, "Obsidian", "a", "Gray"), (1, "Obsidian", "b", "Gray"), (1, "Obsidian", "c", "Black")], "product_id long, color string, image_url string, label string")
    got = {r.product_id: (r.family, r.source, r.anomaly) for r in C.family_votes(g, lab).collect()}
    assert got == {1: ("Gray", "vision", True), 2: ("White", "text", False), 3: ("", "unknown", False)}


def test_store_colors_keep_prefix_and_segment_matches(spark):
    m = spark.createDataFrame([(1, "Flint", 0, "u"), (1, "Flint / Tarmac | X", 1, "u"), (1, "Green", 2, "u"), (1, "__all__", 3, "u"), (2, "Green", 0, "u")], "product_id long, color string, ord long, url string")
    v = spark.createDataFrame([(1, "Flint / Tarmac / Y"), (1, "")], "product_id long, color string")
    got = {(r.product_id, r.color) for r in N.keep_store_colors(m, v).collect()}
    assert got == {(1, "Flint"), (1, "Flint / Tarmac | X"), (1, "__all__"), (2, "Green")}
