"""Registry of tunable thresholds in lookup order. Fixed values."""

LOWER, RAISE = "lower_to_recover", "raise_to_recover"
REGISTRY = [
    ("title_gate.word_overlap", 0.3, LOWER),
    ("title_gate.title_similarity", 0.4, LOWER),
    ("resolver.strong_overlap", 0.6, LOWER),
    ("resolver.strong_seq", 0.5, LOWER),
    ("resolver.weak_overlap", 0.2, RAISE),
    ("resolver.weak_seq", 0.3, RAISE),
    ("resolver.moderate_overlap", 0.3, RAISE),
    ("resolver.foreign_product_penalty", -35.0, RAISE),
    ("resolver.near_homonym_penalty", -40.0, RAISE),
    ("resolver.demographic_penalty", -15.0, RAISE),
    ("resolver.critical_mismatch_penalty", -30.0, RAISE),
    ("post_extraction.pass_threshold", 50.0, LOWER),
    ("post_extraction.title_weight", 40.0, LOWER),
    ("pipeline.candidate_skip", 50.0, LOWER),
]
NOT_ACTIONABLE = ["reject_bot_blocked", "reject_no_candidates", "reject_timeout"]
SKIP_BELOW = 50.0
APPLIED_FOREIGN_PENALTY = -20.0
