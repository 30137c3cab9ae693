import random

from merchgrid.operators import feedback as B
from merchgrid.operators import review as R

CAND = ("struct<url string, outcome string, resolver_confidence double, confidence double, title_extracted string, metrics map<string,double>, penalties map<string,double>, "
        "rescore_reasoning string, signals struct<title_similarity double, price_ratio double, color_overlap double, content_quality double>>")
SCHEMA = f"decision_id long, handle string, vendor string, catalog_title string, ts long, outcome string, type_words array<string>, candidates_tried array<{CAND}>, resolver_candidates array<string>"


def cand(outcome, conf=None, rc=0.0, title=None, metrics=None, pen=None, why="", sig=None):
    return ("u", outcome, rc, conf, title, metrics or {}, pen or {}, why, sig)


def log(spark, rows):
    return B.normalize_decisions(spark.createDataFrame([(i, f"h{i}", "V", t, i, "no_match", w, c, raw) for i, (t, w, c, raw) in enumerate(rows)], SCHEMA))


def test_threshold_proposal_fixture(spark):
    d = log(spark, [("T", ["jacket"], [cand("reject_title_gate", metrics={"word_overlap": v})], []) for v in (0.25, 0.26, 0.27, 0.28, 0.29)] + [("T", [], [cand("reject_bot_blocked")], [])] * 3)
    got = {r.outcome: r for r in B.failure_clusters(d).collect()}
    g = got["reject_title_gate"]
    assert (g.failures, g.common_vendor, g.common_type, g.param, g.current_value, g.proposed_value, g.hits) == (5, "V", "jacket", "title_gate.word_overlap", 0.3, 0.225, 5)
    assert got["reject_bot_blocked"].actionable is False and got["reject_bot_blocked"].param is None


def test_penalty_stacking(spark):
    stack = {"a": -20.0, "b": -20.0, "c": -15.0}
    d = log(spark, [("T", [], [cand("reject_x", pen=stack)], [])] * 3 + [("T", [], [cand("reject_y", pen={"a": -60.0, "b": -5.0})], [])] * 3 + [("T", [], [cand("reject_z")], [])] * 2)
    got = {r.outcome: r.penalty_stacking for r in B.failure_clusters(d).collect()}
    assert got == {"reject_x": True, "reject_y": False}  # two failures make no cluster


def test_replay_recovers_a_lowered_threshold(spark):
    d = log(spark, [("T", [], [cand("reject_post_extraction", conf=45.0, sig=(0.6, 0.5, 0.5, 1.0))], [])])
    props = [B.Proposal("post_extraction.pass_threshold", 40.0)]
    r = B.replay(d, props).collect()
    assert [(x.change, x.new_confidence) for x in r] == [("recovered", 59.0)]
    s = B.replay_summary(d, B.replay(d, props), props).first()
    assert (s.recovered, s.regressed, s.unchanged) == (1, 0, 0)


def test_replay_with_current_values_changes_nothing(spark):
    rng = random.Random(1)
    names = ["Alpha One", "Beta", "Zebra Quilt", "Alpha Mens One", "Lamp womens"]
    rows = []
    for _ in range(40):
        t, p = rng.choice(names), rng.choice(names)
        from difflib import SequenceMatcher
        a, b = set(t.lower().split()) - {"mens", "womens"}, set(p.lower().split()) - {"mens", "womens"}
        demo = ({"mens", "womens"} & set(t.lower().split()), {"mens", "womens"} & set(p.lower().split()))
        clash = bool(demo[0] and demo[1] and not demo[0] & demo[1])
        bad = clash or (SequenceMatcher(None, p.lower(), t.lower()).ratio() < 0.4 and len(a & b) / max(len(a), 1) < 0.3)
        rows.append((t, [], [cand("reject_title_gate" if bad else "accept", title=p, rc=80.0)], []))
    d = log(spark, rows)
    same = [B.Proposal("title_gate.word_overlap", 0.3), B.Proposal("title_gate.title_similarity", 0.4), B.Proposal("pipeline.candidate_skip", 50.0)]
    assert B.replay(d, same).count() == 0
    assert {r.unchanged for r in B.replay_summary(d, B.replay(d, same), same).collect()} == {40}


def test_resolver_replay_first_candidate_decides(spark):
    d = log(spark, [
        ("T", [], [cand("skip_low_confidence", rc=45.0), cand("accepted", rc=30.0)], []),
        ("T", [], [cand("accept", rc=30.0), cand("skip_low_confidence", rc=45.0)], []),
        ("T", [], [cand("skip_low_confidence", rc=45.0, why="-foreign_product(x)")], ["raw"]),
        ("T", [], [cand("skip_low_confidence", rc=45.0, why="-foreign_product(x)")], []),
    ])
    got = {(r.parameter.split(".")[1], r.decision_id): r.change for r in B.replay(d, [B.Proposal("pipeline.candidate_skip", 40.0), B.Proposal("resolver.foreign_product_penalty", -10.0)]).collect()}
    assert got == {("candidate_skip", 0): "recovered", ("candidate_skip", 1): "regressed", ("candidate_skip", 2): "recovered", ("candidate_skip", 3): "recovered", ("foreign_product_penalty", 2): "recovered"}


def changes(spark, rows):
    return spark.createDataFrame(rows, "handle string, run_id string, status string, reason string, new_body_html string, edited_body_html string, confidence int")


def test_dispositions_and_feedback(spark):
    c = changes(spark, [(h, "r", "pending", "", "new", "", 50) for h in "abcd"] + [("e", "r", "applied", "bad", "new", "", 1), ("f", "r", "reverted", "", "new", "ed", 1), ("g", "r", "failed", "", "new", "", 1)])
    d = spark.createDataFrame([("a", "approved", None, None), ("b", "rejected", "off", None), ("c", "edited", None, "mine")], "handle string, status string, reason string, edited_body_html string")
    got = {r.handle: (r.disposition, r.reason, r.final_html) for r in B.collect_feedback(B.apply_dispositions(c, d)).collect()}
    assert got == {"a": ("approved", "", "new"), "b": ("rejected", "off", ""), "c": ("edited", "", "mine"), "e": ("rejected", "bad", "new"), "f": ("edited", "", "ed"), "g": ("approved", "", "new")}
    s = B.feedback_summary(B.collect_feedback(B.apply_dispositions(c, d))).first()
    assert (s.total, s.approved, s.rejected, s.edited) == (6, 2, 2, 2)


def test_iteration_weights(spark):
    s = spark.createDataFrame([(0, "a", 10, 0, 0, 0, True), (0, "b", 40, 0, 0, 0, False), (1, "a", 30, 0, 0, 0, True)], "iteration int, handle string, structure int, length int, anti_hype int, coverage int, in_feedback boolean")
    r = {x.iteration: x for x in B.iteration_results(s).collect()}
    assert (r[0].avg_score, r[0].max_score, r[1].avg_score) == (20.0, 40, 30.0)
    c = B.iteration_compare(B.iteration_results(s)).first()
    assert (c.best_iteration, c.improvement) == (1, 10.0)


def test_next_batch_caps_vendors(spark):
    s = spark.createDataFrame([(i, f"h{i}", "big" if i < 20 else "small", 1.0, 100.0 - i) for i in range(25)], "product_id long, handle string, vendor string, gap_count double, priority_score double")
    tested = spark.createDataFrame([("h0",)], "handle string")
    known = spark.createDataFrame([("big",), ("small",)], "vendor string")
    assert [r.handle for r in R.next_batch(s, tested, known, [], 5).collect()] == ["h1", "h2", "h3", "h20", "h21"]


def test_undo_plan(spark):
    m = spark.createDataFrame([("r", "h", "old", [(7, [1, 2]), (8, [])], "new", [70, 71]), ("r", "g", "old", [], None, [])],
                              "run_id string, handle string, before_body string, before_images array<struct<id long, variant_ids array<long>>>, pushed_body string, images_created array<long>")
    got = {(r.handle, r.action, r.target, r.value) for r in R.undo_plan(m).collect()}
    assert got == {("h", "delete_image", "70", ""), ("h", "delete_image", "71", ""), ("h", "restore_variants", "7", "1,2"), ("h", "restore_body", "h", "old")}
