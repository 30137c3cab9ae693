"""Rule tables of the bound catalog: types, tags, weights, feed attributes.

The vocabulary is that of the bound part data.  A shop replaces the tables; the
structure and the precedence live in the operators.
"""

# Vendors kept out of audits and feeds (compared case-insensitively).
HOUSE_VENDORS = ["Brand#25", "Brand#24"]

# -- typing ----------------------------------------------------------------
OLD_TYPE_TO_TYPE = {"Bolt": "Fastener", "Rod": "Bar Stock", "Plate": "Sheet Stock"}
CATEGORY_LEAF_TO_TYPE = {"fasteners": "Fastener", "bars": "Bar Stock", "rings": "Ring", "gears": "Gear"}
VENDOR_TO_TYPE = {"Brand#3": "Widget", "Brand#7": "Gizmo", "Brand#11": "Anvil"}
# Ordered: the first pattern found in "vendor title" decides.
TITLE_TYPE_RULES = [
    (r"\bhot (rod|bolt)\b", "Heated Part"),
    (r"\bbolt\b", "Fastener"),
    (r"\brod\b", "Bar Stock"),
    (r"\bplate\b", "Sheet Stock"),
    (r"\bring\b", "Ring"),
    (r"\bgear\b", "Gear"),
    (r"\banvil\b", "Anvil"),
    (r"\b(widget|gizmo)\b", "Widget"),
]

# -- tags --------------------------------------------------------------------
ACTIVITY_PATH_RULES = [("forge", "activity:forging"), ("bars", "activity:machining"), ("fasteners", "activity:assembly")]
ACTIVITY_FROM_TYPE = {
    "Anvil": ["activity:forging"],
    "Gear": ["activity:machining", "activity:assembly"],
    "Fastener": ["activity:assembly"],
    "Bar Stock": ["activity:machining"],
}
GENDER_TO_TAG = {"male": "gender:mens", "female": "gender:womens", "kids": "gender:kids", "unisex": "gender:unisex"}
SOFT_TYPES = ["Widget", "Gizmo"]
WINTER_TYPES = ["Heated Part", "Anvil"]
SUMMER_TYPES = ["Ring"]
# (title pattern, tag); tags in CONTEXT_TAGS need one of CONTEXT_TYPES.
FEATURE_RULES = [(r"\bhot\b", "feature:heated"), (r"\bcold\b", "feature:cooled"), (r"\bsmall\b", "feature:compact"), (r"\bnew\b", "feature:new")]
CONTEXT_TAGS = ["feature:heated"]
CONTEXT_TYPES = ["Heated Part", "Anvil", "Sheet Stock"]
TYPE_TO_GROUP = {"Fastener": "group:hardware", "Ring": "group:hardware", "Bar Stock": "group:stock", "Sheet Stock": "group:stock"}
# Fixed value: words that mark gender in a title, tested in this order.
TITLE_GENDER_TAG_RULES = [
    (r"\b(women'?s|wmns|woman'?s|girls)\b", "gender:womens"),
    (r"\b(men'?s|mens)\b", "gender:mens"),
    (r"\b(kids'?|kid's|boys|youth|toddler|junior|baby)\b", "gender:kids"),
]

# -- shopping feed -------------------------------------------------------------
TYPE_TO_CATEGORY = {
    "Bolt": "Hardware > Fasteners > Bolts",
    "Ring": "Hardware > Fasteners > Rings",
    "Gear": "Business & Industrial > Machinery > Gears",
    "Rod": "Business & Industrial > Stock > Rods",
    "Plate": "Business & Industrial > Stock > Plates",
    "Widget": "Home & Garden > Widgets",
}
# Fixed values of the public product-feed attributes.
TAG_TO_GENDER = {"gender:mens": "male", "gender:womens": "female", "gender:unisex": "unisex", "gender:kids": "unisex"}
TITLE_FEED_GENDER_RULES = [
    (r"(?i)\b(kids?|boys?|girls?|youth|jr\.?|junior)\b", "unisex"),
    (r"(?i)\b(women'?s|women|wmn'?s?)\b", "female"),
    (r"(?i)\b(men'?s|men)\b", "male"),
]
SEASON_TAG_MAP = {
    "season:spring-summer": "spring-summer", "season:spring": "spring-summer", "season:summer": "spring-summer",
    "season:fall-winter": "fall-winter", "season:fall": "fall-winter", "season:winter": "fall-winter",
    "season:year-round": "year-round",
}
# Price tiers of the feed.
PRICE_TIERS = [(50, "under-50"), (100, "50-100"), (200, "100-200")]
TOP_PRICE_TIER = "over-200"
EU_SIZE_VENDORS = ["Brand#9", "Brand#12"]
MONDO_TYPES = ["Ring"]
STORE_NAME = "Part Depot"
STORE_PLACE = "Springfield"
TYPE_PHRASES = {"Gear": "Precision cut gear", "Anvil": "Drop-forged anvil", "Ring": "Machined ring"}

# -- weights ---------------------------------------------------------------
# Fixed value: grams of a pound.
LB_TO_GRAMS = 453.592
TYPE_WEIGHT_LB = {"Bolt": 0.25, "Ring": 0.5, "Gear": 2.0, "Rod": 3.5, "Plate": 4.0, "Widget": 1.0, "Anvil": 5.0}
BULKY_TYPES = ["Anvil", "Plate", "Rod"]
# Fixed value: carrier rate by weight tier (upper bound in lb, dollars).
SHIPPING_TIERS = [
    (1, 9.50), (2, 10.50), (3, 11.50), (5, 13.50), (10, 18.00),
    (20, 25.00), (30, 33.00), (50, 50.00), (70, 70.00), (150, 120.00),
]

# -- ranking ---------------------------------------------------------------
# Fixed value: factor weights of the collection score.
RANK_WEIGHTS = {"velocity": 0.35, "margin": 0.20, "inventory": 0.20, "new_arrival": 0.15, "low_stock": 0.10}
# Days a product is new, and units that are low stock.
NEW_ARRIVAL_DAYS = 30
LOW_STOCK = 3
