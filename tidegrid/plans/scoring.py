"""Queries of ranks, metrics, audits, exports and rule scores (W*, T*, A10-A20, M1-M2, M6-M8, F8-F10, J14-J15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    CONTRAST_DEPTH_BINS,
    CURRENT_FEATURES,
    MODELLED_SPECIES,
    MONTH_NAMES,
    PREDICT_BOX,
    RULE_COMPONENT_NAMES,
    RULE_PROFILES,
    RULE_WEIGHTS,
    RULE_WEIGHT_CHANGES,
    SEASON_SCORES,
)
from ..functions import suitability as suit
from ..operators import audit, display, hotspots, metrics, models, ranking
from ..operators.sampling import assign_splits, class_table
from .alignment import rounded, training
from .expressions import bins_sql
from .fixtures import view
from .registry import query
from .sampling import CUTS, TIME_SQL

KEYS = ["species_id", "yr"]
RANK = "OVER (PARTITION BY species_id, yr ORDER BY"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored")


@query("w1_relative_score", "fx_scored", f"""
SELECT cell_id, round((row_number() {RANK} raw_score, cell_id) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY species_id, yr) - 1) AS DOUBLE) * 100, 6) AS relative_score FROM fx_scored""")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.relative_score(scored(spark, sf), KEYS, "raw_score", "cell_id", "relative_score")
    return rounded(out.select("cell_id", "relative_score"), "relative_score")


@query("w2_strict_percentile", "fx_scored", f"""
SELECT cell_id, CASE WHEN current_speed IS NOT NULL THEN round((rank() OVER (PARTITION BY species_id, yr, current_speed IS NULL ORDER BY current_speed)
  + (count(*) OVER (PARTITION BY species_id, yr, current_speed) - 1) / 2e0) / count(*) OVER (PARTITION BY species_id, yr, current_speed IS NULL) * 100, 6) END AS strict_percentile FROM fx_scored""")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    """Heavily tied values with gaps."""
    out = ranking.average_rank_percentile(scored(spark, sf), KEYS, "current_speed", "strict_percentile", "cell_id")
    return rounded(out.select("cell_id", "strict_percentile"), "strict_percentile")


@query("w3_first_rank_percentile", "fx_scored", """
SELECT cell_id, CASE WHEN depth_m IS NOT NULL THEN round(row_number() OVER (PARTITION BY species_id, yr, depth_m IS NULL ORDER BY depth_m, cell_id)
  / CAST(count(*) OVER (PARTITION BY species_id, yr, depth_m IS NULL) AS DOUBLE) * 100, 6) END AS percentile FROM fx_scored""")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.first_rank_percentile(scored(spark, sf), KEYS, "depth_m", "cell_id", "percentile")
    return rounded(out.select("cell_id", "percentile"), "percentile")


@query("w4_global_percentile", "fx_scored", """
SELECT cell_id, round((row_number() OVER (PARTITION BY model_source ORDER BY raw_score, cell_id) - 1) / CAST(count(*) OVER (PARTITION BY model_source) - 1 AS DOUBLE) * 100, 6) AS raw_global_percentile_score FROM fx_scored""")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    """Two huge groups: the case a plain window would send to two tasks."""
    out = ranking.relative_score(scored(spark, sf), ["model_source"], "raw_score", "cell_id", "raw_global_percentile_score", flat=1e-12)
    return rounded(out.select("cell_id", "raw_global_percentile_score"), "raw_global_percentile_score")


def first_pct_sql(value: str, *extra: str) -> str:
    part = ", ".join(["species_id", "yr", *extra, f"{value} IS NULL"])
    return (f"CASE WHEN {value} IS NULL THEN NULL WHEN max({value}) OVER (PARTITION BY {part}) - min({value}) OVER (PARTITION BY {part}) < 1e-12 THEN 50e0 "
            f"ELSE row_number() OVER (PARTITION BY {part} ORDER BY {value}, cell_id) / CAST(count(*) OVER (PARTITION BY {part}) AS DOUBLE) * 100 END")


@query("w5_contrast_score", "fx_scored", f"""
banded AS (SELECT *, current_speed AS current_edge_score, CASE WHEN distance_to_coast_km <= 20 THEN 1 WHEN distance_to_coast_km <= 50 THEN 2 WHEN distance_to_coast_km <= 100 THEN 3 WHEN distance_to_coast_km <= 1000 THEN 4 ELSE 0 END AS coast,
   {bins_sql('depth_m', CONTRAST_DEPTH_BINS, True)} AS depth_band FROM fx_scored),
pct AS (SELECT cell_id, coast, {first_pct_sql('raw_score')} AS overall, {first_pct_sql('raw_score', 'coast')} AS in_coast,
   CASE WHEN depth_band IS NOT NULL THEN {first_pct_sql('raw_score', 'depth_band')} END AS in_depth, coalesce({first_pct_sql('sst_front_strength')}, 50e0) AS front, coalesce({first_pct_sql('current_edge_score')}, 50e0) AS cur FROM banded)
SELECT cell_id, round(greatest(0e0, least(100e0, (0.58e0 * coalesce(in_coast, in_depth, overall, 50e0) + 0.2e0 * coalesce(in_depth, overall, 50e0) + 0.12e0 * coalesce(overall, 50e0) + 0.06e0 * front + 0.04e0 * cur)
  * CASE coast WHEN 1 THEN 1e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0.68e0 WHEN 4 THEN 0.48e0 ELSE 0.75e0 END)), 6) AS score FROM pct""")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    cells = scored(spark, sf).withColumnRenamed("current_speed", "current_edge_score")
    return rounded(display.contrast_score(cells, KEYS, "cell_id").select("cell_id", "score"), "score")


GROUPS = ["species_id", "yr", "model_source"]
METRICS = """
c AS (SELECT species_id, yr, model_source, cell_id, label, greatest(1e-6, least(1 - 1e-6, raw_score)) AS s FROM fx_scored),
r AS (SELECT *, rank() OVER (PARTITION BY species_id, yr, model_source ORDER BY s) + (count(*) OVER (PARTITION BY species_id, yr, model_source, s) - 1) / 2e0 AS ar,
  row_number() OVER (PARTITION BY species_id, yr, model_source ORDER BY s DESC, cell_id) AS rn, count(*) OVER (PARTITION BY species_id, yr, model_source) AS n,
  sum(label) OVER (PARTITION BY species_id, yr, model_source ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER (PARTITION BY species_id, yr, model_source ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS k FROM c),
m AS (SELECT species_id, yr, model_source, count(*) AS sample_count, count(*) FILTER (label = 1) AS presence_count, count(*) FILTER (label = 0) AS background_count, avg(CAST(label AS DOUBLE)) AS baseline_prevalence,
  avg(-(label * ln(s) + (1 - label) * ln(1 - s))) AS log_loss, avg((s - label) * (s - label)) AS brier_score,
  count(*) FILTER (s >= 0.5e0 AND label = 1) AS true_positive, count(*) FILTER (s >= 0.5e0 AND label = 0) AS false_positive, count(*) FILTER (s < 0.5e0 AND label = 1) AS false_negative, count(*) FILTER (s < 0.5e0 AND label = 0) AS true_negative,
  (sum(ar) FILTER (label = 1) - presence_count * (presence_count + 1) / 2e0) / (CAST(presence_count AS DOUBLE) * background_count) AS roc_auc, avg(CAST(tp AS DOUBLE) / k) FILTER (label = 1) AS pr_auc,
  count(*) FILTER (label = 1 AND rn <= ceil(n * 0.05e0)) / CAST(presence_count AS DOUBLE) AS top_5_hit_rate, count(*) FILTER (label = 1 AND rn <= ceil(n * 0.1e0)) / CAST(presence_count AS DOUBLE) AS top_10_hit_rate,
  count(*) FILTER (label = 1 AND rn <= ceil(n * 0.2e0)) / CAST(presence_count AS DOUBLE) AS top_20_hit_rate, count(*) FILTER (label = 1 AND rn <= ceil(n * 0.1e0)) / max(ceil(n * 0.1e0)) AS precision_at_top_10 FROM r GROUP BY 1, 2, 3)
"""
ROUNDED_METRICS = ["baseline_prevalence", "log_loss", "brier_score", "roc_auc", "pr_auc", "top_5_hit_rate", "top_10_hit_rate", "top_20_hit_rate", "precision_at_top_10"]


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(scored(spark, sf), GROUPS, "label", "raw_score", "cell_id")


@query("m6_evaluation", "fx_scored", METRICS + "SELECT species_id, yr, model_source, sample_count, presence_count, background_count, true_positive, false_positive, false_negative, true_negative, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED_METRICS)
       + ", round(top_10_hit_rate, 6) AS recall_at_top_10, round(2e0 * true_positive / (2 * true_positive + false_positive + false_negative), 6) AS f1 FROM m")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluated(spark, sf), *ROUNDED_METRICS, "recall_at_top_10", "f1")


@query("w10_top_share_hits", "fx_scored", """
r AS (SELECT model_source, label, row_number() OVER (PARTITION BY model_source ORDER BY raw_score DESC, cell_id) AS rn, count(*) OVER (PARTITION BY model_source) AS n FROM fx_scored)
SELECT model_source, round(count(*) FILTER (label = 1 AND rn <= ceil(n * 0.05e0)) / CAST(sum(label) AS DOUBLE), 6) AS top_5_hit_rate, round(count(*) FILTER (label = 1 AND rn <= ceil(n * 0.1e0)) / CAST(sum(label) AS DOUBLE), 6) AS top_10_hit_rate,
  round(count(*) FILTER (label = 1 AND rn <= ceil(n * 0.2e0)) / CAST(sum(label) AS DOUBLE), 6) AS top_20_hit_rate, round(count(*) FILTER (label = 1 AND rn <= ceil(n * 0.1e0)) / max(ceil(n * 0.1e0)), 6) AS precision_at_top_10,
  round(count(*) FILTER (label = 1 AND rn <= ceil(n * 0.1e0)) / CAST(sum(label) AS DOUBLE), 6) AS recall_at_top_10 FROM r GROUP BY 1""")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.top_share_metrics(scored(spark, sf), ["model_source"], "label", "raw_score", "cell_id")
    return rounded(out, *[c for c in out.columns if c != "model_source"])


CANDIDATES = METRICS + """
, cand AS (SELECT species_id, concat_ws('__', species_id, CAST(yr AS VARCHAR), model_source) AS candidate_id, CASE WHEN yr % 3 = 0 THEN 'coordinates_allowed_as_bias_check' ELSE 'no_coordinates' END AS feature_set_name,
  round(pr_auc, 6) AS validation_pr_auc, round(top_10_hit_rate, 6) AS validation_top_10_hit_rate, round(roc_auc, 6) AS validation_roc_auc, presence_count, round(roc_auc + baseline_prevalence, 6) AS train_roc_auc FROM m),
ranked AS (SELECT *, CASE WHEN feature_set_name = 'coordinates_allowed_as_bias_check' THEN 1 ELSE 0 END AS pen,
  row_number() OVER (PARTITION BY species_id ORDER BY coalesce(validation_pr_auc, -1) DESC, coalesce(validation_top_10_hit_rate, -1) DESC, coalesce(validation_roc_auc, -1) DESC, CASE WHEN feature_set_name = 'coordinates_allowed_as_bias_check' THEN 1 ELSE 0 END, candidate_id) AS candidate_rank FROM cand)
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every (species, year, model) group as a candidate with its metrics."""
    e = evaluated(spark, sf)
    with_coordinates = F.when(F.col("yr") % 3 == 0, metrics.COORDINATE_SET).otherwise("no_coordinates")
    return e.select(
        "species_id", F.concat_ws("__", "species_id", F.col("yr").cast("string"), "model_source").alias("candidate_id"),
        with_coordinates.alias("feature_set_name"), F.round("pr_auc", 6).alias("validation_pr_auc"),
        F.round("top_10_hit_rate", 6).alias("validation_top_10_hit_rate"), F.round("roc_auc", 6).alias("validation_roc_auc"),
        "presence_count", F.round(F.col("roc_auc") + F.col("baseline_prevalence"), 6).alias("train_roc_auc"),
    )


@query("w12_candidate_ranking", "fx_scored", CANDIDATES + "SELECT species_id, candidate_id, candidate_rank FROM ranked")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rank_candidates(candidates(spark, sf)).select("species_id", "candidate_id", "candidate_rank")


@query("w13_production_pick", "fx_scored", CANDIDATES + """
, best AS (SELECT species_id, validation_pr_auc AS bp, validation_top_10_hit_rate AS bh FROM ranked WHERE candidate_rank = 1)
SELECT species_id, candidate_id, candidate_rank FROM ranked JOIN best USING (species_id)
QUALIFY row_number() OVER (PARTITION BY species_id ORDER BY CASE WHEN pen = 0 AND validation_pr_auc >= bp - 0.02e0 AND validation_top_10_hit_rate >= bh - 0.05e0 THEN 0 ELSE 1 END, candidate_rank) = 1""")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    ranked = metrics.rank_candidates(candidates(spark, sf))
    return metrics.pick_candidate(ranked).select("species_id", "candidate_id", "candidate_rank")


@query("m7_poor_result_reasons", "fx_scored", CANDIDATES + """
SELECT candidate_id, concat_ws(';', CASE WHEN validation_pr_auc < 0.25e0 THEN 'validation_pr_auc_below_0_25' END, CASE WHEN validation_roc_auc < 0.6e0 THEN 'validation_roc_auc_below_0_60' END,
  CASE WHEN validation_top_10_hit_rate < 0.25e0 THEN 'validation_top_10_hit_rate_below_0_25' END, CASE WHEN train_roc_auc - validation_roc_auc > 0.2e0 THEN 'possible_overfitting_train_validation_gap_gt_0_20' END) AS reasons FROM cand""")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("candidate_id", metrics.poor_result_reasons().alias("reasons"))


@query("m8_confidence", "fx_scored", CANDIDATES + """
, up AS (SELECT *, validation_roc_auc + 0.2e0 AS v, validation_top_10_hit_rate + 0.35e0 AS h FROM cand)
SELECT candidate_id, CASE WHEN presence_count < 100 THEN 'Rule-based only' WHEN presence_count >= 1000 AND v >= 0.75e0 AND h >= 0.5e0 THEN 'High' WHEN presence_count >= 300 AND v >= 0.65e0 AND h >= 0.35e0 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN presence_count < 100 THEN 'Rule-based only' WHEN presence_count >= 300 AND v >= 0.65e0 AND h >= 0.35e0 THEN 'Medium' ELSE 'Low' END AS confidence_corrected FROM up""")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    up = candidates(spark, sf).withColumns({
        "validation_roc_auc": F.col("validation_roc_auc") + 0.2,
        "validation_top_10_hit_rate": F.col("validation_top_10_hit_rate") + 0.35,
    })
    return up.select(
        "candidate_id", metrics.confidence_tier().alias("confidence"),
        metrics.confidence_tier(corrected=True).alias("confidence_corrected"),
    )


@query("t1_top_cells", "fx_scored", """
SELECT cell_id, species_id, day_date, row_number() OVER (PARTITION BY species_id, day_date ORDER BY raw_score DESC, cell_id) AS rank FROM fx_scored QUALIFY rank <= 500""")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return display.top_cells(scored(spark, sf).select("cell_id", "species_id", "day_date", "raw_score"), ["species_id", "day_date"], 500, "raw_score", "cell_id").drop("raw_score")


@query("t1_top_cells_1200", "fx_scored", """
SELECT cell_id, species_id, row_number() OVER (PARTITION BY species_id ORDER BY raw_score DESC, cell_id) AS rank FROM fx_scored QUALIFY rank <= 1200""")
def t1b(spark: SparkSession, sf: str) -> DataFrame:
    return display.top_cells(scored(spark, sf).select("cell_id", "species_id", "raw_score"), ["species_id"], 1200, "raw_score", "cell_id").drop("raw_score")


RATED = "rated AS (SELECT *, round(raw_score * 95, 4) AS score, CASE WHEN raw_score * 95 >= 95 THEN 'Prime' WHEN raw_score * 95 >= 85 THEN 'Good' WHEN raw_score * 95 >= 60 THEN 'Possible' ELSE 'Low' END AS rating FROM fx_scored)"


def rated(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("raw_score") * 95
    return scored(spark, sf).withColumns({"score": F.round(s, 4), "rating": suit.rating_strict(s)})


@query("t3_stratified_export", "fx_scored", RATED + """

SELECT cell_id, species_id, rating, row_number() OVER (PARTITION BY species_id, rating ORDER BY md5(concat_ws('|', '42', CAST(cell_id AS VARCHAR)))) AS draw FROM rated""")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    """Every rated cell with its place in the draw of its rating, which limits would go by."""
    cells = rated(spark, sf).select("cell_id", "species_id", "rating", "score")
    return display.stratified_export(cells, ["species_id"], "cell_id").drop("score")


@query("t4_recommended_list", "fx_scored", "SELECT cell_id, species_id, raw_score FROM fx_scored ORDER BY raw_score DESC, cell_id LIMIT 30")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("cell_id", "species_id", "raw_score").orderBy(F.desc("raw_score"), "cell_id").limit(30)


@query("t5_screen_buckets", "fx_scored", RATED + """
, z AS (SELECT *, unnest([8, 12]) AS zoom FROM rated WHERE score >= 30),
px AS (SELECT *, CASE WHEN zoom >= 12 THEN 7 ELSE 12 END AS size, (lon + 180) / 360 * 256e0 * power(2e0, zoom) AS x, sin(radians(lat)) AS s, (0.5e0 - ln((1 + s) / (1 - s)) / (4 * pi())) * 256e0 * power(2e0, zoom) AS y FROM z)
SELECT species_id, CAST(zoom AS BIGINT) AS zoom, CAST(floor(x / size + 0.5e0) AS BIGINT) AS bucket_x, CAST(floor(y / size + 0.5e0) AS BIGINT) AS bucket_y, cell_id, score FROM px
QUALIFY row_number() OVER (PARTITION BY species_id, zoom, bucket_x, bucket_y ORDER BY score DESC, cell_id) = 1""")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return display.screen_buckets(rated(spark, sf), ["species_id"], (8, 12), "score", "cell_id").drop("lat", "lon")


@query("t6_thinned_vectors", "fx_scored", """
SELECT cell_id, species_id FROM (SELECT cell_id, species_id, row_number() OVER (PARTITION BY species_id ORDER BY cell_id) - 1 AS i FROM fx_scored WHERE current_speed > 0.05e0) v WHERE i % 42 = 0""")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return display.thinned_vectors(scored(spark, sf), ["species_id"], "cell_id", zoom=10).select("cell_id", "species_id")


REPORT_FEATURES = ["sst_gradient", "depth_m", "distance_to_shelf_break", "current_speed"]


@query("a10_training_report", "fx_training", f"""
t AS (SELECT *, {TIME_SQL} AS split FROM fx_training),
sub AS (SELECT species_id, bool_and(p OR NOT b) AS subset FROM (SELECT species_id, day_date, bool_or(label = 1) AS p, bool_or(label = 0) AS b FROM t GROUP BY 1, 2) d GROUP BY 1)
SELECT species_id, count(*) AS total_samples, count(*) FILTER (label = 1) AS presence_samples, count(*) FILTER (label = 0) AS background_samples, count(DISTINCT day_date) AS unique_dates, min(day_date) AS date_min, max(day_date) AS date_max,
 CAST(min(year(day_date)) AS BIGINT) AS year_min, CAST(max(year(day_date)) AS BIGINT) AS year_max, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'validation') AS validation_samples, count(*) FILTER (split = 'test') AS test_samples,
 {", ".join(f"round(count(*) FILTER ({f} IS NULL) * 100e0 / count(*), 6) AS {f}_missing_pct" for f in REPORT_FEATURES)},
 min(sst_c) AS sst_c_min, max(sst_c) AS sst_c_max, round(avg(sst_c), 6) AS sst_c_mean, min(depth_m) AS depth_m_min, max(depth_m) AS depth_m_max, round(avg(depth_m), 6) AS depth_m_mean,
 count(*) FILTER (high_match_distance) AS high_match_distance_presence, count(*) FILTER (source_quality = 'low') AS low_source_quality_records, round(count(*) FILTER (label = 0) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 6) AS presence_background_ratio,
 CASE WHEN count(sst_c) = 0 THEN 'unavailable_missing_required_data' WHEN count(*) FILTER (label = 1) >= 300 AND count(depth_m) > 0 THEN 'trainable_sst_bathy_only' WHEN count(*) FILTER (label = 1) >= 300 THEN 'trainable_full_features'
  WHEN count(*) FILTER (label = 1) >= 100 THEN 'trainable_low_confidence' ELSE 'rule_based_only_insufficient_occurrence' END AS status, bool_and(subset) AS background_dates_subset_of_presence_dates FROM t JOIN sub USING (species_id) GROUP BY 1""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    data = assign_splits(training(spark, sf), "row_id", **CUTS)
    out = audit.training_report(data, REPORT_FEATURES)
    return rounded(out, "presence_background_ratio", "sst_c_mean", "depth_m_mean", *[f"{f}_missing_pct" for f in REPORT_FEATURES])


@query("a11_score_distribution", "fx_scored", RATED.replace("round(raw_score * 95, 4)", "floor(raw_score * 99)") + f"""
SELECT species_id, count(*) AS cell_count, count(*) FILTER (score >= 90) AS cells_ge_90, count(*) FILTER (score = 100) AS cells_eq_100, round(count(*) FILTER (score >= 90) * 100e0 / count(*), 6) AS percent_ge_90, round(count(*) FILTER (score = 100) * 100e0 / count(*), 6) AS percent_eq_100,
 count(*) FILTER (score >= 90) * 100e0 / count(*) > 20 AS saturation, count(*) FILTER (score = 100) * 100e0 / count(*) > 5 AS clipping_or_normalisation_issue, {", ".join(f"round(CAST(quantile_cont(CAST(score AS DOUBLE), {p}) AS DOUBLE), 6) AS {n}" for n, p in audit.QUANTILES.items())} FROM rated GROUP BY 1""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    cells = scored(spark, sf).withColumn("score", F.floor(F.col("raw_score") * 99).cast("double"))
    out = audit.score_distribution(cells, ["species_id"], "score", "cell_id")
    return rounded(out, "percent_ge_90", "percent_eq_100", *audit.QUANTILES)


@query("a12_high_score_bins", "fx_scored", RATED + f"""
, high AS (SELECT species_id, {bins_sql('depth_m', (None, 0, 20, 50, 100, 200, 500, 1000, None))} AS d, {bins_sql('distance_to_shelf_break', (None, 5, 20, 50, 100, 200, None))} AS s, {bins_sql('greatest(0e0, lon - 150.5e0) * 92e0', (None, 10, 25, 50, 100, 200, None))} AS c, lat, lon FROM rated WHERE score >= 90),
long AS (SELECT species_id, 'depth_bin' AS bin_column, CASE WHEN d IS NULL THEN 'none' ELSE list_extract(['(-inf, 0]','(0, 20]','(20, 50]','(50, 100]','(100, 200]','(200, 500]','(500, 1000]','(1000, inf]'], d + 1) END AS bin FROM high
 UNION ALL SELECT species_id, 'shelf_distance_bin', CASE WHEN s IS NULL THEN 'none' ELSE list_extract(['(-inf, 5]','(5, 20]','(20, 50]','(50, 100]','(100, 200]','(200, inf]'], s + 1) END FROM high
 UNION ALL SELECT species_id, 'coast_distance_bin', list_extract(['(-inf, 10]','(10, 25]','(25, 50]','(50, 100]','(100, 200]','(200, inf]'], c + 1) FROM high
 UNION ALL SELECT species_id, 'lat_bin', CAST(CAST(floor(lat) AS BIGINT) AS VARCHAR) FROM high UNION ALL SELECT species_id, 'lon_bin', CAST(CAST(floor(lon) AS BIGINT) AS VARCHAR) FROM high)
SELECT species_id, bin_column, bin, count(*) AS n FROM long GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY species_id, bin_column ORDER BY count(*) DESC, bin) <= 30""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return audit.high_score_bins(rated(spark, sf), ["species_id"], "score")


@query("a13_correlations", "fx_scored", """
SELECT species_id, yr, round(corr(raw_score, depth_m), 6) AS score_depth_correlation, round(corr(raw_score, distance_to_shelf_break), 6) AS score_shelf_correlation FROM fx_scored GROUP BY 1, 2""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    out = scored(spark, sf).groupBy(*KEYS).agg(
        audit.guarded_correlation("raw_score", "depth_m").alias("score_depth_correlation"),
        audit.guarded_correlation("raw_score", "distance_to_shelf_break").alias("score_shelf_correlation"),
    )
    return rounded(out, "score_depth_correlation", "score_shelf_correlation")


@query("a14_bathymetry_audit", "fx_scored", """
SELECT species_id, yr, count(*) AS cell_count, min(depth_m) AS depth_min, max(depth_m) AS depth_max, count(*) FILTER (depth_m <= 0) AS cells_depth_le_0, count(*) FILTER (depth_m < 20) AS cells_depth_lt_20, count(*) FILTER (depth_m < 50) AS cells_depth_lt_50,
 count(*) FILTER (depth_m > 200) AS cells_depth_gt_200, count(*) FILTER (NOT ocean_mask) AS non_ocean_cells, min(distance_to_shelf_break) AS distance_to_shelf_break_min, count(*) FILTER (depth_m < 50) / count(*) > 0.4e0 AS bathymetry_suspicious,
 round(CAST(median(depth_m) AS DOUBLE), 6) AS depth_median FROM fx_scored GROUP BY 1, 2""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.bathymetry_audit(scored(spark, sf), KEYS, "cell_id", ("distance_to_shelf_break",))
    return rounded(out, "depth_median")


PROFILE_COLUMNS = ["sst_c", "sst_gradient", "depth_m", "current_speed", "source_quality", "grid_lat", "high_match_distance"]


def profile_sql(c: str) -> str:
    n = f"TRY_CAST({c} AS DOUBLE)" if c != "high_match_distance" else f"CAST(CAST({c} AS INT) AS DOUBLE)"
    return (f"SELECT species_id, '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, count({n}) AS numbers, coalesce(min({n}) < max({n}), FALSE) AS varied FROM fx_training GROUP BY 1")


@query("a15_feature_screen", "fx_training", "prof AS (" + " UNION ALL ".join(profile_sql(c) for c in PROFILE_COLUMNS) + """)
SELECT species_id, "column", rows, filled, numbers, varied, numbers > 0 AND 1 - filled / CAST(rows AS DOUBLE) <= 0.8e0 AND varied AS kept FROM prof""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    profile = audit.column_profile(training(spark, sf), PROFILE_COLUMNS, ["species_id"])
    return profile.withColumn("kept", audit.keep_column())


@query("a16_current_features", "fx_training", "SELECT species_id, count(*) AS rows, count(*) FILTER (label = 1) AS presence, count(*) FILTER (label = 0) AS background, "
       + ", ".join(f"{'count(current_speed)' if c == 'current_speed' else 'CAST(0 AS BIGINT)'} AS {c}_non_null" for c in CURRENT_FEATURES)
       + ", count(current_speed) > 0 AS has_real_current_features, CASE WHEN count(current_speed) > 0 THEN 'ready_for_current_feature_retrain' ELSE 'blocked_missing_current_features' END AS trainability_for_current_retrain FROM fx_training GROUP BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return audit.current_feature_audit(training(spark, sf), ["species_id"])


@query("a17_class_tables", "fx_training", f"""
SELECT 'split' AS kind, species_id, {TIME_SQL} AS value, count(*) FILTER (label = 0) AS background, count(*) FILTER (label = 1) AS presence FROM fx_training GROUP BY 2, 3
UNION ALL SELECT 'month' AS kind, species_id, CAST(month(day_date) AS VARCHAR) AS value, count(*) FILTER (label = 0) AS background, count(*) FILTER (label = 1) AS presence FROM fx_training GROUP BY 2, 3""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    data = assign_splits(training(spark, sf), "row_id", **CUTS).withColumn("month", F.month("date").cast("string"))
    tables = [
        class_table(data, c, ["species_id"]).withColumnRenamed(c, "value").withColumn("kind", F.lit(c)) for c in ("split", "month")
    ]
    return tables[0].unionByName(tables[1])


@query("a18_rating_distribution", "fx_scored", RATED + """
SELECT species_id, yr, rating, count(*) AS count, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY species_id, yr), 6) AS percent FROM rated GROUP BY 1, 2, 3""")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audit.rating_distribution(rated(spark, sf), KEYS), "percent")


@query("a19_download_estimate", "fx_training", """
SELECT count(DISTINCT day_date) AS date_count, CAST(901 * 801 AS BIGINT) AS cells_per_date, CAST(count(DISTINCT day_date) * 901 * 801 AS BIGINT) AS estimated_cells, round(count(DISTINCT day_date) * (901 * 801 * 24e0 / 1024 / 1024), 6) AS estimated_mb FROM fx_training""")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audit.download_estimate(training(spark, sf), PREDICT_BOX, 0.005, 24.0), "estimated_mb")


@query("a20_missing_fractions", "fx_training", "prof AS (" + " UNION ALL ".join(profile_sql(c) for c in REPORT_FEATURES + ["sst_c"]) + """)
SELECT species_id, "column" AS feature, round(1 - filled / CAST(rows AS DOUBLE), 6) AS missing_fraction FROM prof WHERE filled < rows""")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.missing_fractions(training(spark, sf), REPORT_FEATURES + ["sst_c"], ["species_id"])
    return rounded(out, "missing_fraction")


# ---- rule scores ----

def rule_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of interest with a temperature and gradient of their own."""
    return hotspots.rule_context(
        view(spark, sf, "fx_poi").withColumns({
            "sst_c": 16.0 + (F.col("poi_id") % 23) * 0.5, "gradient_strength": (F.col("poi_id") % 11) * 0.2
        }),
        month=F.col("poi_id") % 12 + 1,
    )


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def profile_rows_sql() -> str:
    rows = []
    for species, name, pref, ext, depths, structures, seasons in RULE_PROFILES:
        w = {**RULE_WEIGHTS, **RULE_WEIGHT_CHANGES.get(species, {})}
        season = "[" + ", ".join(f"{SEASON_SCORES[seasons.get(m, 'possible')]}e0" for m in MONTH_NAMES) + "]"
        rows.append(f"('{species}', {pref[0]}e0, {pref[1]}e0, {ext[0]}e0, {ext[1]}e0, {sql_list(depths)}, {sql_list(structures)}, {season}, "
                    + ", ".join(f"{w[k]}e0" for k in RULE_COMPONENT_NAMES) + ")")
    return ", ".join(rows)


RULES = f"""
prof AS (SELECT * FROM (VALUES {profile_rows_sql()}) AS t(species_id, lo, hi, elo, ehi, depths, prefs, seasons, {", ".join("w_" + k for k in RULE_COMPONENT_NAMES)})),
ctx AS (SELECT *, 16e0 + (poi_id % 23) * 0.5e0 AS sst_c, (poi_id % 11) * 0.2e0 AS g, round(0.48e0 + greatest(0e0, lon - 151) * 0.12e0, 2) AS speed, lon > 152 AND lat > -34.6e0 AND lat < -33.4e0 AS eddy_on FROM fx_poi),
comp AS (SELECT poi_id, species_id, sst_c, poi_type, depth_class, prof.* EXCLUDE (species_id), seasons[poi_id % 12 + 1] AS season, CASE WHEN sst_c BETWEEN lo AND hi THEN 100e0 WHEN sst_c <= elo OR sst_c >= ehi THEN 0e0 WHEN sst_c < lo THEN 100e0 * (sst_c - elo) / (lo - elo) ELSE 100e0 * (ehi - sst_c) / (ehi - hi) END AS sst,
 least(100e0, greatest(0e0, g * 48)) AS front, least(100e0, greatest(0e0, 35 + speed * 72)) AS current, CASE WHEN list_contains(depths, depth_class) THEN 85e0 ELSE 45e0 END AS bathy,
 least(100e0, 35e0 + CASE WHEN list_contains(prefs, poi_type) THEN 40 ELSE 0 END + CASE WHEN list_contains(depths, depth_class) THEN 25 ELSE 0 END + CASE WHEN poi_type IN ('shelf_break', 'canyon') AND list_has_any(prefs, ['shelf_break', 'canyon']) THEN 10 ELSE 0 END + CASE WHEN poi_type = 'fad_demo' AND list_contains(prefs, 'fad_demo') THEN 25 ELSE 0 END) AS structure,
 CASE WHEN poi_type = 'fad_demo' AND list_contains(prefs, 'fad_demo') THEN 95e0 ELSE 40e0 END AS fad, CASE WHEN poi_type IN ('shelf_break', 'canyon') THEN 90e0 ELSE 45e0 END AS shelf_canyon, CASE WHEN g >= 1 THEN 68e0 ELSE 42e0 END AS chlorophyll, CASE WHEN eddy_on THEN 70e0 ELSE 48e0 END AS eddy FROM ctx, prof),
rule AS (SELECT *, round_even(greatest(0e0, least(100e0, {" + ".join(f"{k} * w_{k}" for k in RULE_COMPONENT_NAMES)} - 6)), 1) AS score FROM comp)
"""


@query("f10_rule_composite", "fx_poi", RULES + f"""
, drivers AS (SELECT poi_id, species_id, string_agg(name, '|' ORDER BY v DESC, pos) AS key_drivers FROM (SELECT poi_id, species_id, name, v, pos, row_number() OVER (PARTITION BY poi_id, species_id ORDER BY v DESC, pos) AS r FROM (
  {" UNION ALL ".join(f"SELECT poi_id, species_id, '{n}' AS name, {k} AS v, {i} AS pos FROM comp" for i, (k, n) in enumerate(RULE_COMPONENT_NAMES.items()))}) u) d WHERE r <= 4 GROUP BY 1, 2)
SELECT r.poi_id, r.species_id, r.score, CASE WHEN score < 30 THEN 'Low' WHEN score < 55 THEN 'Possible' WHEN score < 75 THEN 'Good' ELSE 'Prime' END AS rating, d.key_drivers FROM rule r JOIN drivers d USING (poi_id, species_id)""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    """Every point against every rule species (J14)."""
    rows = hotspots.rule_hotspots(rule_points(spark, sf), per_species=None)
    return rows.select("poi_id", "species_id", "score", "rating", F.concat_ws("|", "key_drivers").alias("key_drivers"))


@query("j14_points_by_species", "fx_poi", RULES + "SELECT species_id, count(*) AS pairs, count(DISTINCT poi_id) AS points FROM comp GROUP BY 1")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Points expanded to the fixed species table by an array, not by a cross join."""
    rows = hotspots.rule_hotspots(rule_points(spark, sf), per_species=None)
    return rows.groupBy("species_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("poi_id").alias("points"))


@query("t2_species_top_lists", "fx_poi", RULES + """
SELECT poi_id, species_id, score, row_number() OVER (PARTITION BY species_id ORDER BY score DESC, poi_id) AS rank FROM rule QUALIFY rank <= 5""")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    rows = hotspots.rule_hotspots(rule_points(spark, sf))
    return rows.select("poi_id", "species_id", "score", "rank").orderBy(F.desc("score"), "species_id", "poi_id")


@query("f9_structure_score", "fx_poi", RULES + "SELECT poi_id, species_id, structure FROM comp")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    rows = hotspots.rule_hotspots(rule_points(spark, sf), per_species=None)
    return rows.select("poi_id", "species_id", F.col("c_structure").alias("structure"))


@query("f8_season_score", "fx_poi", RULES + "SELECT poi_id, species_id, season FROM comp")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    rows = hotspots.rule_hotspots(rule_points(spark, sf), per_species=None)
    return rows.select("poi_id", "species_id", F.col("c_season").alias("season"))


@query("q3_rule_hotspots", "fx_poi", RULES + """
SELECT poi_id, species_id, score, printf('SST is %.1f C, giving a %d/100 species suitability component.', sst_c, CAST(round_even(sst, 0) AS BIGINT)) || '|' || printf('The synthetic front/gradient score is %d/100.', CAST(round_even(front, 0) AS BIGINT))
  || '|Structure/depth context is ' || poi_type || ' in ' || depth_class || ' water.|Confidence is limited because this v0.1 demo uses synthetic ocean data.' || """ + f"""
  CASE WHEN least({", ".join(RULE_COMPONENT_NAMES)}) < 45 THEN '|Limiting factor: ' || CASE {" ".join(f"WHEN {k} = least({', '.join(RULE_COMPONENT_NAMES)}) THEN '{k}'" for k in RULE_COMPONENT_NAMES)} END || ' is weak in this demo scenario.' ELSE '' END AS explanation, TRUE AS demo_only
FROM rule WHERE score >= 40 QUALIFY row_number() OVER (PARTITION BY species_id ORDER BY score DESC, poi_id) <= 5""")
def q3(spark: SparkSession, sf: str) -> DataFrame:
    """Best five points per species (T2) over a minimum score."""
    rows = hotspots.rule_hotspots(rule_points(spark, sf), min_score=40.0)
    shown = rows.withColumn("explanation", F.concat_ws("|", "explanation"))
    return shown.select("poi_id", "species_id", "score", "explanation", "demo_only").orderBy(F.desc("score"), "species_id", "poi_id")


@query("j15_species_lookup", "fx_training", """
names AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{s}', '{sci}', '{n}')" for i, (s, sci, n) in enumerate(MODELLED_SPECIES)) + """) AS t(i, species, scientific_name, common_name)),
coded AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) * 0 + row_id) % 5 AS i FROM fx_training)
SELECT species, scientific_name, common_name, count(*) AS n FROM coded JOIN names USING (i) GROUP BY 1, 2, 3""")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """Names from the fixed species table, broadcast (five rows)."""
    names = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(MODELLED_SPECIES)], "i long, species string, scientific_name string, common_name string"
    )
    coded = training(spark, sf).select((F.col("row_id") % 5).alias("i"))
    return coded.join(F.broadcast(names), "i").groupBy("species", "scientific_name", "common_name").agg(F.count(F.lit(1)).alias("n"))


# ---- model tables that SQL can express ----

M_FEATURES = ["sst_c", "sst_gradient", "depth_m", "distance_to_shelf_break", "current_speed"]


@query("m1_feature_sets", "fx_training", """
SELECT s AS feature_set, f AS feature FROM (SELECT count(*) AS n FROM fx_training) c, (VALUES ('minimum_sst_bathy', ['sst_c','sst_gradient','depth_m','distance_to_shelf_break']), ('sst_bathy_season', ['sst_c','sst_gradient','depth_m','distance_to_shelf_break']),
 ('full_available_oceanographic', ['sst_c','sst_gradient','depth_m','distance_to_shelf_break','current_speed']), ('no_coordinates', ['sst_c','sst_gradient','depth_m','distance_to_shelf_break','current_speed']),
 ('coordinates_allowed_as_bias_check', ['sst_c','sst_gradient','depth_m','distance_to_shelf_break','current_speed','grid_lat','grid_lon'])) AS t(s, fs), unnest(fs) AS u(f)""")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    sets = models.feature_sets(training(spark, sf))
    rows = [(name, c) for name, columns in sets.items() for c in columns]
    return spark.createDataFrame(rows, "feature_set string, feature string")


def standard_sql(c: str) -> str:
    return (f"med_{c} AS (SELECT CAST(median({c}) AS DOUBLE) AS v FROM train), st_{c} AS (SELECT avg(coalesce({c}, v)) AS m, stddev_samp(coalesce({c}, v)) AS s FROM train, med_{c})")


@query("m2_preprocess", "fx_training", f"train AS (SELECT * FROM fx_training WHERE day_date <= DATE '1998-12-31'), {', '.join(standard_sql(c) for c in M_FEATURES)} SELECT row_id, "
       + ", ".join(f"round((coalesce(t.{c}, (SELECT v FROM med_{c})) - (SELECT m FROM st_{c})) / (SELECT s FROM st_{c}), 6) AS {c}" for c in M_FEATURES) + " FROM fx_training t")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    data = training(spark, sf)
    prep = models.Preprocessor.fit(data.where(F.col("date") <= F.to_date(F.lit("1998-12-31"))), M_FEATURES, "row_id")
    return rounded(prep.apply(data.select("row_id", *M_FEATURES)), *M_FEATURES)
