"""Review feedback: dispositions, failure clusters, threshold proposals, what-if replay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import half_up, ratio, text
from merchgrid.functions.similarity import sequence_ratio
from merchgrid.operators.matching import gate_words
from merchgrid.rules import thresholds as rules

# -- dispositions and summaries ----------------------------------------------------


def apply_dispositions(changes: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Review decision onto each change (J14); unknown handles stay as they are."""
    d = dispositions.select("handle", F.col("status").alias("_s"), F.col("reason").alias("_r"), F.col("edited_body_html").alias("_e"))
    known = F.col("_s").isin("approved", "rejected", "edited")
    return changes.join(d, "handle", "left").withColumns({
        "status": F.when(known, F.col("_s")).otherwise(F.col("status")),
        "reason": F.when(F.col("_s") == "rejected", text(F.col("_r"))).otherwise(F.col("reason")),
        "edited_body_html": F.when(F.col("_s") == "edited", text(F.col("_e"))).otherwise(F.col("edited_body_html")),
    }).drop("_s", "_r", "_e")


def apply_summary(changes: DataFrame) -> DataFrame:
    """Counts of a run; approval rate over decided changes."""
    s = F.col("status")
    n, pending, ok = F.count(F.lit(1)), F.count_if(s == "pending"), F.count_if(s.isin("approved", "edited"))
    return changes.groupBy("run_id").agg(
        n.alias("total"), pending.alias("pending"), ok.alias("approved"), F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s == "applied").alias("applied"), (ok / F.greatest(n - pending, F.lit(1)).cast("double")).alias("approval_rate"),
    )


def collect_feedback(changes: DataFrame) -> DataFrame:
    """One feedback row per decided change; the disposition of a finished change is inferred."""
    s, reason, edited = F.col("status"), text(F.col("reason")), text(F.col("edited_body_html"))
    finished = s.isin("applied", "reverted", "failed")
    kind = (
        F.when(s.isin("approved", "rejected", "edited"), s).when(finished & (reason != ""), "rejected")
        .when(finished & (edited != ""), "edited").when(finished, "approved")
    )
    new = text(F.col("new_body_html"))
    final = (
        F.when(s == "approved", new).when(s == "rejected", "").when(s == "edited", edited)
        .otherwise(F.when(edited != "", edited).otherwise(new))
    )
    return changes.where(s != "pending").select(
        "handle", "run_id", kind.alias("disposition"), F.when((s == "rejected") | finished, reason).otherwise("").alias("reason"),
        new.alias("generated_html"), final.alias("final_html"), "confidence",
    ).where("disposition is not null")


def feedback_summary(entries: DataFrame) -> DataFrame:
    """Counts and approval rate."""
    c = lambda v: F.count_if(F.col("disposition") == v)
    n = F.count(F.lit(1))
    return entries.agg(
        n.alias("total"), c("approved").alias("approved"), c("rejected").alias("rejected"), c("edited").alias("edited"),
        (c("approved") / F.greatest(n, F.lit(1)).cast("double")).alias("approval_rate"),
    )


def rejection_reasons(entries: DataFrame) -> DataFrame:
    return entries.where("disposition = 'rejected' and reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))


# -- failure clusters (M28) ----------------------------------------------------------


def normalize_decisions(decisions: DataFrame) -> DataFrame:
    """One spelling of the candidate shape: ``accept``, and one confidence per role."""
    return decisions.withColumn("candidates_tried", F.transform("candidates_tried", lambda c: F.struct(
        c["url"].alias("url"), F.when(c["outcome"] == "accepted", "accept").otherwise(c["outcome"]).alias("outcome"),
        c["resolver_confidence"].alias("resolver_confidence"), c["confidence"].alias("confidence"), c["title_extracted"].alias("title_extracted"),
        c["metrics"].alias("metrics"), c["penalties"].alias("penalties"), c["rescore_reasoning"].alias("rescore_reasoning"), c["signals"].alias("signals"),
    )))


def failed_candidates(decisions: DataFrame) -> DataFrame:
    """Rejected and skipped candidates with their decision's handle and vendor."""
    tried = decisions.select("decision_id", "handle", "vendor", F.array_join("type_words", " ").alias("kind"), F.posexplode("candidates_tried").alias("ord", "c"))
    return tried.select("decision_id", "handle", "vendor", "kind", "ord", "c.*").where(F.col("outcome").startswith("reject_") | F.col("outcome").startswith("skip_"))


def penalty_stack(penalties: Column) -> Column:
    """Penalties above 50 in sum without one above 60 % of it."""
    sizes = F.transform(F.map_values(penalties), F.abs)
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce((total > 50) & F.forall(sizes, lambda v: v / total <= 0.6), F.lit(False))


def threshold_proposals(failed: DataFrame) -> DataFrame:
    """First registry threshold with failures close to it, per outcome.

    The registry is a fixed table of 14 rows, looked up per metric of a candidate.
    """
    registry = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(p).alias("param"), F.lit(p.rsplit(".", 1)[1]).alias("key"), F.lit(float(c)).alias("cutoff"), F.lit(d).alias("direction"))
        for i, (p, c, d) in enumerate(rules.REGISTRY)
    ])
    entries = failed.where(~F.col("outcome").isin(rules.NOT_ACTIONABLE)).select("outcome", F.explode("metrics").alias("key", "v"))
    hit = entries.select("outcome", "v", F.explode(F.filter(registry, lambda r: r["key"] == F.col("key"))).alias("r")).select("outcome", "v", "r.*")
    lower, c, v = F.col("direction") == rules.LOWER, F.col("cutoff"), F.col("v")
    near = F.when(lower, v.between(c * 0.8, c)).when(c < 0, v.between(c, c * 0.8)).otherwise(v.between(c, c * 1.2))
    bands = hit.where(near).groupBy("outcome", "rank", "param", "cutoff", "direction").agg(
        F.count(F.lit(1)).alias("hits"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    first = bands.groupBy("outcome").agg(F.min_by(F.struct("param", "cutoff", "direction", "hits", "lo", "hi"), "rank").alias("b")).select("outcome", "b.*")
    factor = F.when(F.col("direction") == rules.LOWER, 0.9).otherwise(1.1)
    return first.select(
        "outcome", "param", F.col("cutoff").alias("current_value"), half_up(F.col("lo") * factor, 4).alias("proposed_value"), "hits", "lo", "hi"
    )


def failure_clusters(decisions: DataFrame, at_least: int = 3) -> DataFrame:
    """Outcome clusters with common vendor and type, proposal and stacking flag.

    Handles are not gathered into the cluster row: see ``cluster_handles``.
    """
    failed = failed_candidates(decisions)
    v, k = F.nullif("vendor", F.lit("")), F.nullif("kind", F.lit(""))
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    groups = failed.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("failures"), same(v).alias("common_vendor"), same(k).alias("common_type"),
        F.bool_or(penalty_stack(F.col("penalties"))).alias("stacked"),
    ).where(F.col("failures") >= at_least)
    actionable = ~F.col("outcome").isin(rules.NOT_ACTIONABLE)
    return groups.join(threshold_proposals(failed), "outcome", "left").withColumns({
        "actionable": actionable, "penalty_stacking": actionable & F.col("stacked") & F.col("param").isNull(),
    }).drop("stacked")


def cluster_handles(decisions: DataFrame) -> DataFrame:
    """Distinct handles per failing outcome with their first decision and count, as long rows."""
    return failed_candidates(decisions).groupBy("outcome", "handle").agg(F.min("decision_id").alias("first_decision"), F.count(F.lit(1)).alias("failures"))


# -- replay (M29) ------------------------------------------------------------------


@dataclass(frozen=True)
class Proposal:
    parameter: str
    proposed: float


def _proposals(items: list[Proposal], prefix: tuple[str, ...]) -> Column | None:
    mine = [p for p in items if p.parameter.startswith(prefix)]
    if not mine:
        return None
    return F.array(*[F.struct(F.lit(p.parameter).alias("parameter"), F.lit(float(p.proposed)).alias("proposed")) for p in mine])


def _candidates(decisions: DataFrame) -> DataFrame:
    return decisions.select("decision_id", "handle", "catalog_title", F.posexplode("candidates_tried").alias("ord", "c")).select(
        "decision_id", "handle", "catalog_title", "ord", "c.*")


def replay_title_gate(decisions: DataFrame, items: list[Proposal], similarity=sequence_ratio) -> DataFrame | None:
    """Candidates whose title gate flips; similarity and overlap are computed once for all proposals."""
    props = _proposals(items, ("title_gate.",))
    if props is None:
        return None
    usable = (text(F.col("title_extracted")) != "") & (text(F.col("catalog_title")) != "") & ~F.col("outcome").isin("reject_bot_blocked", "skip_low_confidence")
    match, overlap = gate_words(F.col("title_extracted"), F.col("catalog_title"))
    c = _candidates(decisions).where(usable).withColumns({"clash": F.coalesce(~match, F.lit(False)), "overlap": overlap}).withColumn(
        "sim", similarity(F.when(~F.col("clash"), F.lower("title_extracted")), F.when(~F.col("clash"), F.lower("catalog_title"))))  # a clash decides alone
    low = lambda s, o: F.col("clash") | ((F.col("sim") < s) & (F.col("overlap") < o))
    p = c.select("*", F.explode(props).alias("p")).select("*", "p.*")
    s = F.when(F.col("parameter") == "title_gate.title_similarity", F.col("proposed")).otherwise(0.4)
    o = F.when(F.col("parameter") == "title_gate.word_overlap", F.col("proposed")).otherwise(0.3)
    rejected = F.col("outcome") == "reject_title_gate"
    change = F.when(rejected & ~low(s, o), "recovered").when(~rejected & ~low(F.lit(0.4), F.lit(0.3)) & low(s, o), "regressed")
    return p.withColumn("change", change).where("change is not null").select("parameter", "proposed", "decision_id", "handle", "ord", "change", F.lit(None).cast("double").alias("new_confidence"))


def replay_resolver(decisions: DataFrame, items: list[Proposal]) -> DataFrame | None:
    """Skip-threshold and foreign-penalty what-ifs: the first affected candidate decides the decision."""
    props = _proposals(items, ("resolver.", "pipeline."))
    if props is None:
        return None
    p = decisions.select("decision_id", "handle", "candidates_tried", (F.size(F.coalesce("resolver_candidates", F.array().cast("array<string>"))) > 0).alias("has_raw"),
                         F.explode(props).alias("p")).select("*", "p.*")
    value, raw = F.col("proposed"), F.col("has_raw")

    def skip(c):
        conf = F.coalesce(c["resolver_confidence"], F.lit(0.0))
        return F.when((c["outcome"] == "skip_low_confidence") & (conf >= value), "recovered").when((c["outcome"] == "accept") & (conf < value), "regressed")

    def foreign(c):
        conf = F.coalesce(c["resolver_confidence"], F.lit(0.0)) + value - rules.APPLIED_FOREIGN_PENALTY
        hit = text(c["rescore_reasoning"]).contains("foreign_product") & raw
        skipped = c["outcome"] == "skip_low_confidence"
        return F.when(hit & skipped & (conf >= rules.SKIP_BELOW), "recovered").when(hit & ~skipped & (conf < rules.SKIP_BELOW), "regressed")

    def first(rule):
        return F.get(F.filter(F.transform("candidates_tried", lambda c, i: F.struct(rule(c).alias("change"), i.alias("ord"))), lambda x: x["change"].isNotNull()), F.lit(0))

    hit = F.when(F.col("parameter") == "pipeline.candidate_skip", first(skip)).when(F.col("parameter") == "resolver.foreign_product_penalty", first(foreign))
    return p.withColumn("h", hit).where("h is not null").select(
        "parameter", "proposed", "decision_id", "handle", "h.ord", "h.change", F.lit(None).cast("double").alias("new_confidence"))


def replayed_confidence(s: Column, title_weight: Column) -> Column:
    """Confidence with the title weight changed and the rest shared 25/25/10."""
    rest = 100.0 - title_weight
    get = lambda name, default: F.coalesce(s[name], F.lit(default))
    return (
        get("title_similarity", 0.0) * title_weight + get("price_ratio", 0.5) * (rest * 25 / 60) + get("color_overlap", 0.5) * (rest * 25 / 60)
        + get("content_quality", 0.0) * (rest * 10 / 60)
    )


def replay_post_extraction(decisions: DataFrame, items: list[Proposal]) -> DataFrame | None:
    props = _proposals(items, ("post_extraction.",))
    if props is None:
        return None
    p = _candidates(decisions).where("signals is not null and confidence is not null").select("*", F.explode(props).alias("p")).select("*", "p.*")
    weight = F.when(F.col("parameter") == "post_extraction.title_weight", F.col("proposed")).otherwise(40.0)
    bar = F.when(F.col("parameter") == "post_extraction.pass_threshold", F.col("proposed")).otherwise(50.0)
    new = replayed_confidence(F.col("signals"), weight)
    was = ~F.col("outcome").isin("reject_post_extraction", "low_post_scrape_confidence")
    change = F.when(~was & (new >= bar), "recovered").when(was & (new < bar), "regressed")
    return p.withColumn("change", change).where("change is not null").select(
        "parameter", "proposed", "decision_id", "handle", "ord", "change", half_up(new, 1).alias("new_confidence"))


def replay(decisions: DataFrame, items: list[Proposal], similarity=sequence_ratio) -> DataFrame:
    """All changes under the proposals as long rows."""
    parts = [replay_title_gate(decisions, items, similarity), replay_resolver(decisions, items), replay_post_extraction(decisions, items)]
    parts = [p for p in parts if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replay_summary(decisions: DataFrame, changes: DataFrame, items: list[Proposal]) -> DataFrame:
    """Recovered, regressed and unchanged decisions per proposal."""
    all_props = decisions.sparkSession.createDataFrame([(p.parameter, float(p.proposed)) for p in items], "parameter string, proposed double")
    total = decisions.agg(F.count(F.lit(1))).scalar()
    per = changes.groupBy("parameter", "proposed").agg(
        F.count_if(F.col("change") == "recovered").alias("recovered"), F.count_if(F.col("change") == "regressed").alias("regressed"),
        F.count_distinct("decision_id").alias("touched"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_props.join(per, ["parameter", "proposed"], "left").select(
        "parameter", "proposed", zero(F.col("recovered")).alias("recovered"), zero(F.col("regressed")).alias("regressed"),
        (total - zero(F.col("touched"))).alias("unchanged"))


# -- runs and iterations ------------------------------------------------------------


def mark_feedback(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """Scores with ``in_feedback``: the handle was rejected or edited by a reviewer."""
    marked = feedback.where(F.col("disposition").isin("rejected", "edited")).select("handle").distinct().withColumn("in_feedback", F.lit(True))
    return scores.drop("in_feedback").join(marked, "handle", "left").fillna({"in_feedback": False})


def iteration_results(scores: DataFrame) -> DataFrame:
    """Axis means, feedback-weighted mean and maximum per iteration.

    ``scores(iteration, handle, structure, length, anti_hype, coverage, in_feedback)``.
    """
    axes = ["structure", "length", "anti_hype", "coverage"]
    total = sum((F.col(a) for a in axes), F.lit(0))
    w = F.when(F.col("in_feedback"), 2.0).otherwise(1.0)
    return scores.groupBy("iteration").agg(
        *[F.avg(a).alias(f"avg_{a}") for a in axes], (F.sum(total * w) / F.sum(w)).alias("avg_score"), F.max(total).alias("max_score"))


def iteration_compare(results: DataFrame) -> DataFrame:
    """Best iteration against the first one."""
    return results.agg(
        F.count(F.lit(1)).alias("iterations"), F.min_by("avg_score", "iteration").alias("baseline_avg"), F.max("avg_score").alias("best_avg"),
        F.min_by("iteration", F.struct(-F.col("avg_score"), F.col("iteration"))).alias("best_iteration"),
    ).withColumn("improvement", F.col("best_avg") - F.col("baseline_avg"))


def last_outcomes(decisions: DataFrame) -> DataFrame:
    """Last recorded outcome per handle across runs."""
    return decisions.groupBy("handle").agg(F.max_by("outcome", F.struct("ts", "decision_id")).alias("outcome"))


def outcome_histogram(decisions: DataFrame) -> DataFrame:
    return last_outcomes(decisions).groupBy("outcome").agg(F.count(F.lit(1)).alias("handles"))


def campaign_metrics(rows: DataFrame) -> DataFrame:
    """Cost and efficiency per vendor (A25): ``rows(vendor, cost, confidence)``."""
    cost, conf = F.sum("cost") / F.count(F.lit(1)).cast("double"), F.avg("confidence")
    return rows.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("products"), cost.alias("cost_per_product"), conf.alias("avg_confidence"), ratio(conf, cost * 100).alias("efficiency"))
