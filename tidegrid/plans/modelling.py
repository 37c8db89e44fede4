"""Queries that fit models (M3-M5, M9-M16), for every species and at full effort.

SQL cannot fit a model, so each query has a twin (``_facts``) that holds what SQL can tell of its
result: ids, counts, statuses and the bounds of its metrics. Training is the same for several
queries; a session trains once per set of tables and hands on the written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MINIMUM_FEATURES, OPTIONAL_FEATURES
from ..functions.dates import season_features
from ..operators import audit, keyed_models, metrics, models
from ..operators.ranking import relative_score
from ..operators.sampling import assign_splits, strategy_samples
from ..session import cut, held
from .alignment import training
from .fixtures import view
from .registry import query
from .sampling import BLOCKS, CUTS, POOLS, TIME_SQL, split_columns

CELL_CUTS = {"train_until": "1996-12-31", "validation_until": "1997-12-31"}
_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable):
    """What ``make`` returns, made once per session and set of tables."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def forget() -> None:
    """Make everything anew at the next call, as a measurement must."""
    _MADE.clear()


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with season features and the time split."""
    rows = training(spark, sf).withColumns(season_features("date"))
    return assign_splits(rows, "row_id", **CUTS)


def held_samples(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "samples", lambda: held(samples(spark, sf)))


def trained(spark: SparkSession, sf: str) -> models.Trained:
    return once(spark, sf, "trained", lambda: models.train_all(held_samples(spark, sf), "row_id"))


def baselines(spark: SparkSession, sf: str) -> models.Trained:
    """The baselines alone, unless the whole grid has been trained."""
    if (spark.sparkContext.applicationId, sf, "trained") in _MADE:
        return trained(spark, sf)
    return once(spark, sf, "baselines", lambda: models.train_all(held_samples(spark, sf), "row_id", tuned=False))


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """The selected candidate of every trained species."""
    def make() -> DataFrame:
        presence = held_samples(spark, sf).groupBy("species_id").agg(F.count_if(F.col("label") == 1).alias("presence_count"))
        return cut(models.select_models(trained(spark, sf).candidates, presence))

    return once(spark, sf, "chosen", make)


def corrected(spark: SparkSession, sf: str) -> models.Trained:
    def make() -> models.Trained:
        data = held_samples(spark, sf)
        # presences are in every strategy, and a species without any has no sample
        species = cut(data.where("label = 1").select("species_id").distinct())
        return models.corrected_retrain(strategy_samples(data), "row_id", species=species)

    return once(spark, sf, "corrected", make)


def bias(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        run = trained(spark, sf)
        own = models.own_models(run, chosen(spark, sf))
        return cut(models.bias_audit(held_samples(spark, sf), "row_id", chosen(spark, sf), keyed_models.importances(own, run.columns)))

    return once(spark, sf, "bias", make)


def bounded(*names: str, chance: str | None = None) -> Column:
    """Whether metrics exist and lie in [0, 1], and training beats chance."""
    inside = F.lit(True)
    for name in names:
        inside = inside & F.coalesce(F.col(name).between(0, 1), F.lit(False))
    return inside & F.coalesce(F.col(chance) > 0.5, F.lit(False)) if chance else inside


METRICS = ("train_roc_auc", "validation_roc_auc", "validation_pr_auc", "validation_top_10_hit_rate", "validation_brier_score",
           "test_roc_auc", "test_pr_auc", "test_top_10_hit_rate")
BASE = [e.name for e in keyed_models.BASELINES]

# fixed values: columns of the fixture and the sets that name them
SEASON = ["month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos"]
MINIMAL = ["sst_c", "sst_gradient", "depth_m", "distance_to_shelf_break", *SEASON]
SETS = {
    "minimum_sst_bathy": MINIMAL, "sst_bathy_season": MINIMAL, "full_available_oceanographic": [*MINIMAL, "current_speed"],
    "no_coordinates": [*MINIMAL, "current_speed"], "coordinates_allowed_as_bias_check": [*MINIMAL, "current_speed", "grid_lat", "grid_lon"],
}
NULLS = {
    "coordinates_only_null_model": ["grid_lat", "grid_lon"], "month_only_null_model": SEASON,
    "depth_distance_only_null_model": ["depth_m", "distance_to_shelf_break"],
    "sst_bathy_season_only": ["sst_c", "sst_gradient", "depth_m", *SEASON],
}


def names_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def sets_sql(sets: dict[str, list[str]]) -> str:
    return ", ".join(f"('{n}', {names_sql(cs)})" for n, cs in sets.items())


#: columns of the samples, by how often they are filled and whether they vary, per group
_SEASON_SQL = {c: ("month(day_date)" if c.startswith("month") else "dayofyear(day_date)") for c in SEASON}
_ALL = SETS["coordinates_allowed_as_bias_check"]


def facts_sql(rows: str, groups: str) -> str:
    at = lambda c: _SEASON_SQL.get(c, c)
    return (f"SELECT {groups}, unnest({names_sql(_ALL)}) AS c, unnest([{', '.join(f'count({at(c)})' for c in _ALL)}]) AS filled, "
            f"unnest([{', '.join(f'min({at(c)}) < max({at(c)})' for c in _ALL)}]) AS varied, count(*) AS n FROM {rows} GROUP BY {groups}")


READY_SQL = f"""
t AS (SELECT *, {TIME_SQL} AS split FROM fx_training),
reasons AS (SELECT species_id, count(*) FILTER (label = 1) AS p, CASE WHEN count(*) FILTER (label = 1) < 100 THEN 'fewer than 100 presence records; rule-based only' ELSE 'ready' END AS reason FROM t GROUP BY 1),
facts AS ({facts_sql('t', 'species_id')}),
kept AS (SELECT species_id, c FROM facts JOIN reasons USING (species_id) WHERE reason = 'ready' AND filled > 0 AND 1 - filled / n <= 0.8e0 AND varied),
sets(s, cs) AS (VALUES {sets_sql(SETS)}),
counted AS (SELECT species_id, s, count(*) AS n FROM kept JOIN sets ON list_contains(cs, c) GROUP BY 1, 2 HAVING count(*) >= 3)"""


def candidates_sql(estimators) -> str:
    pool = ", ".join(f"('{e.name}', {'TRUE' if e.tuned else 'FALSE'})" for e in estimators)
    return READY_SQL + f"""
, pool(m, tuned) AS (VALUES {pool}), ratios AS (SELECT unnest([10, 5]) AS r)
SELECT species_id, s || '__br' || r || '__' || m AS candidate_id, m AS model_name, s AS feature_set_name, n AS feature_count, CAST(r AS BIGINT) AS background_ratio, 'trained' AS status, '' AS reason, TRUE AS bounded
FROM counted, ratios, pool WHERE NOT tuned OR (r = 10 AND s IN ('full_available_oceanographic', 'no_coordinates', 'sst_bathy_season'))
UNION ALL SELECT species_id, species_id || '__none', NULL, NULL, NULL, NULL, 'not_trained', reason, TRUE FROM reasons WHERE reason <> 'ready'"""


def candidate_facts(candidates: DataFrame) -> DataFrame:
    ok = F.when(F.col("status") == "trained", bounded(*METRICS, chance="train_roc_auc")).otherwise(True)
    return candidates.select("species_id", "candidate_id", "model_name", "feature_set_name", "feature_count", "background_ratio", "status", "reason", ok.alias("bounded"))


@query("m3_baseline_models")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    """Three weighted baselines of every species, feature set and ratio, with metrics of every split."""
    return baselines(spark, sf).candidates.where(F.col("model_name").isin(BASE) | (F.col("status") != "trained"))


@query("m3_baseline_facts", "fx_training", candidates_sql(keyed_models.BASELINES))
def m3_facts(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_facts(m3(spark, sf))


@query("m4_tuned_models")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    """The six forests and nine boosters of the tuning grid beside the baselines, for every species."""
    return trained(spark, sf).candidates


@query("m4_tuned_facts", "fx_training", candidates_sql((*keyed_models.BASELINES, *keyed_models.TUNED)))
def m4_facts(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_facts(m4(spark, sf))


@query("m5_training_guards", "fx_training", """
SELECT species_id, CASE WHEN count(*) FILTER (label = 1) < 100 THEN 'fewer than 100 presence records; rule-based only' ELSE 'ready' END AS reason FROM fx_training GROUP BY 1""")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return models.training_reasons(samples(spark, sf))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    run = trained(spark, sf)
    return keyed_models.importances(models.own_models(run, chosen(spark, sf)), run.columns)


@query("m9_selection")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    """Selected candidate of every species with its confidence and feature importance."""
    listed = importance(spark, sf)
    return chosen(spark, sf).select("species_id", "candidate_id", "confidence_level", "validation_pr_auc").join(listed, ["species_id", "candidate_id"])


@query("m9_selection_facts", "fx_training", READY_SQL + """
SELECT species_id, any_value(p) AS presence_count, CAST(sum(CASE WHEN s IN ('full_available_oceanographic', 'no_coordinates', 'sst_bathy_season') THEN 21 ELSE 6 END) AS BIGINT) AS candidates, TRUE AS close_to_best, TRUE AS all_listed
FROM counted JOIN reasons USING (species_id) GROUP BY 1""")
def m9_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts behind each selection; the choice is near the best and every feature has an importance."""
    each = trained(spark, sf).candidates.where("status = 'trained'").groupBy("species_id").agg(
        F.count("*").alias("candidates"), F.max("validation_pr_auc").alias("_best"))
    listed = importance(spark, sf).groupBy("species_id").agg(F.count("importance").alias("_listed"))
    return chosen(spark, sf).join(each, "species_id").join(listed, "species_id").select(
        "species_id", "presence_count", "candidates", (F.col("validation_pr_auc") >= F.col("_best") - 0.02).alias("close_to_best"),
        (F.col("_listed") == F.col("feature_count")).alias("all_listed"))


@query("m9_permutation_importance")
def m9_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """What each selected model loses of its validation ROC-AUC when one feature is permuted."""
    run = trained(spark, sf)
    own = models.own_models(run, chosen(spark, sf))
    return keyed_models.permutation_importance(held_samples(spark, sf), own, run.columns, "row_id", metrics.evaluate)


@query("m10_bias_audit")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    """Null models against the selected model of every species and its own feature importance."""
    return bias(spark, sf)


@query("m10_bias_facts", "fx_training", READY_SQL + f"""
, nulls(s, cs) AS (VALUES {sets_sql(NULLS)})
SELECT DISTINCT species_id, s AS null_model, TRUE AS bounded, TRUE AS judged FROM facts JOIN reasons USING (species_id) JOIN nulls ON list_contains(cs, c)
WHERE reason = 'ready' AND filled > 0 AND varied""")
def m10_facts(spark: SparkSession, sf: str) -> DataFrame:
    return m10(spark, sf).select("species_id", "null_model", bounded("roc_auc", "pr_auc").alias("bounded"), F.col("model_likely_biased").isNotNull().alias("judged"))


@query("m11_spatiotemporal_validation")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    """The main booster of every species on four kinds of split, against null models."""
    def make() -> DataFrame:
        data = split_columns(spark, sf).withColumns(season_features("date"))
        splits = {
            "temporal_holdout": "time_split", "spatial_block": "spatial_split",
            "spatial_temporal_holdout": "spatial_temporal_split", "leave_nearshore_out": "offshore_time_split",
        }
        return cut(models.split_validation(held(data), "row_id", splits, MINIMUM_FEATURES + OPTIONAL_FEATURES))

    return once(spark, sf, "validation", make)


@query("m11_validation_facts", "fx_training", BLOCKS + """
, parts AS (SELECT species_id, label, unnest(['temporal_holdout', 'spatial_block', 'spatial_temporal_holdout', 'leave_nearshore_out']) AS split_name,
  unnest([time_split, spatial_split, CASE WHEN spatial_split = time_split THEN time_split END, CASE WHEN b.depth_m >= 100 THEN time_split END]) AS part FROM blocked b JOIN fx_training USING (row_id))
SELECT species_id, split_name, CASE WHEN count(DISTINCT (part, label)) FILTER (part IN ('train', 'validation')) = 4 THEN 'evaluated' ELSE 'skipped' END AS status, TRUE AS bounded
FROM parts GROUP BY 1, 2""")
def m11_facts(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.when(F.col("status") == "evaluated", bounded("validation_roc_auc", "validation_pr_auc", "best_null_roc_auc")).otherwise(True)
    return m11(spark, sf).select("species_id", "split_name", "status", ok.alias("bounded"))


@query("m12_corrected_retrain")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    """Three coordinate-free models of every species on each viable strategy and ratio, ranked."""
    return metrics.rank_candidates(corrected(spark, sf).candidates)


VIABLE_SQL = POOLS + f"""
, ratios AS (SELECT unnest([3, 5, 10]) AS ratio), counts AS (SELECT species_id, count(*) AS p FROM pr GROUP BY 1),
drawn AS (SELECT species_id, strategy, ratio, row_id, row_number() OVER (PARTITION BY species_id, strategy, ratio ORDER BY md5(concat_ws('|', 'ratio', CAST(100 + ratio AS VARCHAR), CAST(row_id AS VARCHAR)))) AS r FROM pools, ratios),
sampled AS (SELECT d.species_id, d.strategy, ratio, row_id, 0 AS y FROM drawn d JOIN counts USING (species_id) WHERE r <= p * ratio
  UNION ALL SELECT pr.species_id, s.strategy, ratio, row_id, 1 AS y FROM pr, ratios, (SELECT DISTINCT strategy FROM pools) s),
deep AS (SELECT s.species_id, s.strategy, s.ratio, s.y, t.* EXCLUDE (species_id) FROM sampled s JOIN fx_training t USING (row_id)
  WHERE t.depth_m >= 50 AND strategy IN ('offshore_constrained_background', 'environment_stratified_background', 'spatial_buffered_background')),
viable AS (SELECT species_id, strategy, ratio FROM deep GROUP BY 1, 2, 3 HAVING count(*) FILTER (y = 1) >= 100 AND count(*) FILTER (y = 0) >= 100),
facts AS ({facts_sql('deep', 'species_id, strategy, ratio')}),
usable AS (SELECT species_id, strategy, ratio, count(*) AS n FROM facts JOIN viable USING (species_id, strategy, ratio) WHERE filled > 0 AND varied AND c NOT IN ('grid_lat', 'grid_lon') GROUP BY 1, 2, 3 HAVING count(*) >= 4)"""


@query("m12_corrected_facts", "fx_training", VIABLE_SQL + f"""
SELECT species_id, strategy || '__br' || ratio || '__' || m AS candidate_id, m AS model_name, strategy AS feature_set_name, n AS feature_count, CAST(ratio AS BIGINT) AS background_ratio, 'trained' AS status, '' AS reason, TRUE AS bounded
FROM usable, unnest({names_sql(e.name for e in keyed_models.CORRECTED)}) AS e(m)
UNION ALL SELECT DISTINCT species_id, species_id || '__none', NULL, NULL, NULL, NULL, 'not_trained', 'no viable corrected candidates', TRUE FROM fx_training WHERE species_id NOT IN (SELECT species_id FROM usable)""")
def m12_facts(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_facts(m12(spark, sf))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the columns that models use and a time split; features that no source has stay absent."""
    rows = view(spark, sf, "fx_scored").drop("raw_score").withColumnRenamed("day_date", "date").withColumns(season_features("date"))
    return assign_splits(rows, "cell_id", **CELL_CUTS).withColumn("current_edge_score", F.col("current_speed"))


def scored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell scored by the booster of its own species, in one pass."""
    def make() -> DataFrame:
        rows = held(cells(spark, sf))
        own, columns = models.species_models(rows, "cell_id", MINIMUM_FEATURES + OPTIONAL_FEATURES)
        keep = ["cell_id", "species_id", "yr", "lat", "lon", "depth_m", "ocean_mask", "distance_to_coast_km", "sst_c", "sst_front_strength",
                "current_speed", "current_edge_score", "distance_to_shelf_break"]
        return held(keyed_models.score_rows(rows, own, columns, keep, salts=(keyed_models.SALTS, 1)).drop("candidate_id"))

    return once(spark, sf, "cells", make)


@query("m13_batch_scoring")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    """Fine-grid path: probability, percentile, contrast score and rating for whole tables."""
    out = models.batch_predictions(scored_cells(spark, sf), ["species_id", "yr"], "cell_id", "fine")
    return out.select("cell_id", "species_id", "yr", "raw_score", "raw_global_percentile_score", "score", "rating")


@query("m13_corrected_scoring")
def m13b(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected path: percentiles only inside the offshore mask."""
    out = models.batch_predictions(scored_cells(spark, sf), ["species_id", "yr"], "cell_id", "corrected")
    return out.select("cell_id", "species_id", "yr", "raw_score", "score", "rating")


@query("m13_scoring_facts", "fx_scored", """
SELECT species_id, yr, count(*) AS cells, count(*) FILTER (coalesce(depth_m, -999) >= 50 AND ocean_mask) AS masked, TRUE AS bounded FROM fx_scored GROUP BY 1, 2""")
def m13_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and masked cells of each species and year; all scores are probabilities."""
    masked = m13b(spark, sf).groupBy("species_id", "yr").agg(F.count("*").alias("masked"), F.bool_and(F.col("score").between(0, 100)).alias("_ok"))
    whole = scored_cells(spark, sf).groupBy("species_id", "yr").agg(F.count("*").alias("cells"), F.bool_and(F.col("raw_score").between(0, 1)).alias("_in"))
    return whole.join(masked, ["species_id", "yr"]).select("species_id", "yr", "cells", "masked", (F.col("_ok") & F.col("_in")).alias("bounded"))


def neural_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Multilayer perceptron on balanced rows, at its full number of epochs."""
    def make() -> DataFrame:
        columns = SETS["no_coordinates"]
        data = held_samples(spark, sf)
        train = models.downsample_background(data.where(F.col("split") == "train"), 1, ["species_id"], "row_id")
        fitted = models.fit_candidate(train, columns, models.neural_estimator(len(columns)), "row_id")
        scored = fitted.score(data, keep=["row_id", "species_id", "label", "split"])
        return cut(scored.withColumn("model_source", F.lit("deep_learning")))

    return once(spark, sf, "neural", make)


@query("m14_neural_scores")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    """Neural scores, written under their own model source."""
    return neural_scores(spark, sf)


@query("m14_neural_facts", "fx_training", """
SELECT species_id, count(*) AS scored, 'deep_learning' AS model_source, TRUE AS bounded FROM fx_training GROUP BY 1""")
def m14_facts(spark: SparkSession, sf: str) -> DataFrame:
    return neural_scores(spark, sf).groupBy("species_id", "model_source").agg(
        F.count("raw_score").alias("scored"), F.bool_and(F.col("raw_score").between(0, 1)).alias("bounded"))


@query("m15_training_rollup")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    """Training report beside the chosen model of every species."""
    report = audit.training_report(held_samples(spark, sf), ["depth_m"])
    return models.training_rollup(report.select("species_id", "status", "presence_samples", "background_samples"), chosen(spark, sf))


@query("m15_rollup_facts", "fx_training", """
SELECT species_id, count(*) FILTER (label = 1) AS presence_samples, count(*) FILTER (label = 0) AS background_samples,
  CASE WHEN count(*) FILTER (label = 1) >= 300 THEN 'trainable_sst_bathy_only' WHEN count(*) FILTER (label = 1) >= 100 THEN 'trainable_low_confidence' ELSE 'rule_based_only_insufficient_occurrence' END AS status,
  count(*) FILTER (label = 1) >= 100 AS has_model FROM fx_training GROUP BY 1""")
def m15_facts(spark: SparkSession, sf: str) -> DataFrame:
    return m15(spark, sf).select("species_id", "presence_samples", "background_samples", "status", F.col("candidate_id").isNotNull().alias("has_model"))


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of every trained species: its own scores, its bias audit, its corrected retrain."""
    def make() -> DataFrame:
        run, data = trained(spark, sf), held_samples(spark, sf)
        own = models.own_models(run, chosen(spark, sf))
        keep = ["row_id", "species_id", "depth_m", "distance_to_shelf_break"]
        scored = held(keyed_models.score_rows(data, own, run.columns, keep, salts=(keyed_models.SALTS, 1)))
        ranked = held(relative_score(scored, ["species_id"], "raw_score", "row_id", "score"))
        distribution = audit.score_distribution(ranked, ["species_id"], "score", "row_id")
        bathymetry = audit.bathymetry_audit(ranked.withColumns({"distance_to_coast_km": F.lit(None).cast("double"), "ocean_mask": F.lit(True)}), ["species_id"], "row_id")
        likely = bias(spark, sf).groupBy("species_id").agg(F.bool_or("model_likely_biased").alias("model_likely_biased"))
        return cut(audit.audit_rollup(distribution, bathymetry, likely, models.corrected_status(corrected(spark, sf).candidates)))

    return once(spark, sf, "rollup", make)


@query("m16_audit_rollup")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    """Saturation, clipping and bathymetry of the own scores, bias flag of M10, status of M12."""
    return rollup(spark, sf)


@query("m16_rollup_facts", "fx_training", VIABLE_SQL + """
SELECT species_id, count(*) FILTER (depth_m < 50) / count(*) > 0.4e0 AS bathymetry_suspicious, FALSE AS saturation_detected, TRUE AS judged,
  CASE WHEN species_id IN (SELECT species_id FROM usable) THEN 'selected_corrected_under_audit' ELSE 'not_trained' END AS corrected_status
FROM fx_training GROUP BY 1 HAVING count(*) FILTER (label = 1) >= 100""")
def m16_facts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup(spark, sf).select("species_id", "bathymetry_suspicious", "saturation_detected", F.col("model_likely_biased").isNotNull().alias("judged"), "corrected_status")
