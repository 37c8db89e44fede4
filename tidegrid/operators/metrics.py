"""Ranking metrics for any number of (species, candidate, split) groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, col
from .ranking import bucketed, row_ranks

EPSILON = 1e-6
COORDINATE_SET = "coordinates_allowed_as_bias_check"
TOP_SHARES = (0.05, 0.10, 0.20)


def curve_metrics(scored: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """ROC-AUC and average precision from the distinct scores of each group.

    Scores are pre-aggregated to (n, positives), so ties cost nothing and a constant score is
    one row; running counts over the ordered scores give both areas. One-class groups: NULL.
    """
    per_score = scored.groupBy(*groups, F.col(score).cast("double").alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("long")).alias("_p")
    )
    ranked = bucketed(
        per_score, groups, "_s", descending=True, sums={"c": F.col("_c"), "p": F.col("_p")}
    )
    upto = ranked.window().orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.rows.withColumns({"_cc": F.sum("_c").over(upto), "_cp": F.sum("_p").over(upto)})
    at = ranked.with_offsets(rows).withColumns({
        "_seen": F.col("_off_c") + F.col("_cc"),
        "_hits": F.col("_off_p") + F.col("_cp"),
    })
    negatives_at = F.col("_c") - F.col("_p")
    hits_above = F.col("_hits") - F.col("_p")
    pairs = negatives_at * (hits_above + F.col("_p") / 2)  # positives ranked above negatives
    out = at.groupBy(*groups).agg(
        F.max("_all_c").alias("_n"),
        F.max("_all_p").alias("_np"),
        F.sum(pairs.cast("double")).alias("_pairs"),
        F.sum(F.col("_p") * F.col("_hits") / F.col("_seen")).alias("_ap"),
    )
    both = (F.col("_np") > 0) & (F.col("_np") < F.col("_n"))
    return out.select(
        *groups,
        F.when(both, F.col("_pairs") / (F.col("_np").cast("double") * (F.col("_n") - F.col("_np")))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_np")).alias("pr_auc"),
    )


def count_metrics(scored: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Counts, prevalence, losses and the confusion table at 0.5 in one pass."""
    y = F.col(label).cast("double")
    s = clamp(score, EPSILON, 1 - EPSILON)
    loss = -(y * F.log(s) + (1 - y) * F.log(1 - s))
    yes = F.col(score) >= 0.5
    out = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(y == 1).alias("presence_count"),
        F.count_if(y == 0).alias("background_count"),
        F.avg(y).alias("baseline_prevalence"),
        F.avg(loss).alias("log_loss"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
        F.count_if(yes & (y == 1)).alias("true_positive"),
        F.count_if(yes & (y == 0)).alias("false_positive"),
        F.count_if(~yes & (y == 1)).alias("false_negative"),
        F.count_if(~yes & (y == 0)).alias("true_negative"),
    )
    both = (F.col("presence_count") > 0) & (F.col("background_count") > 0)
    tp, fp, fn = (F.col(f"{k}").cast("double") for k in ("true_positive", "false_positive", "false_negative"))
    return out.withColumns({
        "log_loss": F.when(both, F.col("log_loss")),
        "brier_score": F.when(both, F.col("brier_score")),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    })


def top_share_metrics(
    scored: DataFrame, groups: list[str], label: str, score: str, row_id: str,
    shares: tuple[float, ...] = TOP_SHARES,
) -> DataFrame:
    """Hit rate in the top ceil(n * share) rows, with precision and recall at 10 %."""
    ranked = row_ranks(scored, groups, score, row_id, descending=True, rank="_rank", total="_n")
    hit = F.col(label) == 1
    cut = {s: F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(s))) for s in {*shares, 0.10}}
    out = ranked.groupBy(*groups).agg(
        F.count_if(hit).alias("_p"),
        *[F.count_if(hit & (F.col("_rank") <= c)).alias(f"_in{int(s * 100)}") for s, c in cut.items()],
        F.max(cut[0.10]).alias("_cut10"),
    )
    rates = [
        F.try_divide(F.col(f"_in{int(s * 100)}").cast("double"), F.col("_p")).alias(f"top_{int(s * 100)}_hit_rate")
        for s in shares
    ]
    return out.select(
        *groups, *rates,
        (F.col("_in10") / F.col("_cut10")).alias("precision_at_top_10"),
        F.try_divide(F.col("_in10").cast("double"), F.col("_p")).alias("recall_at_top_10"),
    )


def evaluate(scored: DataFrame, groups: list[str], label: str, score: str, row_id: str) -> DataFrame:
    """All metrics per group. Scores are clipped to [1e-6, 1 - 1e-6] before ranking.

    Rows without a score take no part.
    """
    clipped = scored.select(
        *groups, row_id, label,
        clamp(score, EPSILON, 1 - EPSILON).alias(score),
    ).where(F.col(score).isNotNull())
    return (
        count_metrics(clipped, groups, label, score)
        .join(curve_metrics(clipped, groups, label, score), groups, "left")
        .join(top_share_metrics(clipped, groups, label, score, row_id), groups, "left")
    )


def poor_result_reasons(pr="validation_pr_auc", roc="validation_roc_auc", hit="validation_top_10_hit_rate", train_roc="train_roc_auc") -> Column:
    pr, roc, hit, train_roc = col(pr), col(roc), col(hit), col(train_roc)
    return F.concat_ws(
        ";",
        F.when(pr < 0.25, "validation_pr_auc_below_0_25"),
        F.when(roc < 0.60, "validation_roc_auc_below_0_60"),
        F.when(hit < 0.25, "validation_top_10_hit_rate_below_0_25"),
        F.when(train_roc - roc > 0.20, "possible_overfitting_train_validation_gap_gt_0_20"),
    )


def confidence_tier(presence="presence_count", roc="validation_roc_auc", hit="validation_top_10_hit_rate", corrected: bool = False) -> Column:
    n, roc, hit = col(presence), col(roc), col(hit)
    tier = F.when(n < 100, "Rule-based only")
    if not corrected:
        tier = tier.when((n >= 1000) & (roc >= 0.75) & (hit >= 0.50), "High")
    return tier.when((n >= 300) & (roc >= 0.65) & (hit >= 0.35), "Medium").otherwise("Low")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Best first per species: PR-AUC, top-10 hit, ROC-AUC, then without coordinates, then id.

    A candidate table holds one row per trained model, so its windows are short.
    """
    low = F.lit(-1.0)
    ready = candidates.withColumns({
        "_pr": F.coalesce("validation_pr_auc", low),
        "_hit": F.coalesce("validation_top_10_hit_rate", low),
        "_roc": F.coalesce("validation_roc_auc", low),
        "coordinate_penalty": (F.col("feature_set_name") == COORDINATE_SET).cast("long"),
    })
    w = Window.partitionBy("species_id").orderBy(
        F.desc("_pr"), F.desc("_hit"), F.desc("_roc"), "coordinate_penalty", "candidate_id"
    )
    ranked = ready.withColumn("candidate_rank", F.row_number().over(w).cast("long"))
    return ranked.drop("_pr", "_hit", "_roc")


def pick_candidate(ranked: DataFrame) -> DataFrame:
    """The best candidate without coordinates close to the best, else the best itself."""
    low = F.lit(-1.0)
    w = Window.partitionBy("species_id").orderBy("candidate_rank")
    pr, hit = F.coalesce("validation_pr_auc", low), F.coalesce("validation_top_10_hit_rate", low)
    near = (
        (F.col("coordinate_penalty") == 0)
        & (pr >= F.first(pr).over(w) - 0.02)
        & (hit >= F.first(hit).over(w) - 0.05)
    )
    flagged = ranked.withColumn("_near", F.when(near, 0).otherwise(1))
    order = Window.partitionBy("species_id").orderBy("_near", "candidate_rank")
    return flagged.withColumn("_pick", F.row_number().over(order)).where("_pick = 1").drop("_pick", "_near")
