"""Vocabularies of the text-quality scores. All are fixed values."""

BANNED_WORDS = [
    "amazing", "incredible", "must-have", "must have", "game-changer", "game changer", "revolutionary", "unbelievable",
    "stunning", "breathtaking", "perfect", "flawless", "best-selling", "best selling", "world-class", "world class",
    "cutting-edge", "cutting edge", "unmatched", "unparalleled", "extraordinary", "phenomenal", "superb", "ultimate",
    "fantastic",
]
BOILERPLATE = [
    r"^Open media \d+ in modal$",
    r"Skip to (product|content|search|navigation|footer|region)",
    r"\$[\d,]+\.?\d*",
    r"Liquid error",
    r"javascript required|enable javascript|update your browser",
    r"^(New Arrivals|Best Sellers|Gift Cards|Shop All|My Account|Track My Order|Help Center|Find a Store|Top Rated|Follow Along|Watch Now)\s*$",
    r"We.ve got our hands full|This page will automatically refresh|please call.*\d{3}.*\d{4}",
    r"(regular price|sale price|starting at)",
]
MATERIALS = (
    "polyester|nylon|cotton|wool|merino|spandex|elastane|lycra|gore-tex|primaloft|thinsulate|pertex|cordura|ripstop|fleece|"
    "down|silk|linen|rayon|modal|tencel|hemp|kevlar|dyneema|polartec"
)
UNITS = "mm|cm|m|g|kg|oz|lb|in|ft|denier|D|L|ml|mL"
# Phrases of a reply that comments on the task instead of describing the product, tested in this order.
REFUSALS = [
    "does not contain sufficient", "insufficient descriptive content", "not contain enough", "unable to create", "cannot generate",
    "no product information", "appears to be navigation", "placeholder rather than", "provided does not include", "i cannot",
    "i'm unable", "the provided product information", "the available data appears", "not enough information to",
    "vendor facts provided", "don't contain usable", "no usable product information", "what i'd recommend",
    "what i would recommend", "re-run with", "want me to", "paste the content from", "violates rule", "i'd be inventing",
    "to write this description, i need", "where to get this", "checkout ui text", "checkout boilerplate",
]
# Spec keys that are body or garment measures.
MEASURE_KEYS = ["arm length", "inseam", "chest", "waist", "hips", "seat", "center back"]
CRITICAL_WARNINGS = ["NO_IMAGES_FOUND", "INSUFFICIENT_CONTENT", "HTML_GENERATION_ERROR"]
# File-name parts of pictures that show a badge or a swatch.
BADGE_FILES = [
    "chromapop", "polarized", "technology", "feature", "tech-", "certification", "warranty", "award", "colorswatch", "terrain-type",
]
