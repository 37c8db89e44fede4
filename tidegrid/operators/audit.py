"""Data-quality and score audits: distributions, screens and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CLIPPING_LIMIT_PCT,
    COAST_BINS,
    CURRENT_FEATURES,
    DEPTH_BINS,
    FLAG_FEATURES,
    SATURATION_LIMIT_PCT,
    SHALLOW_SHARE_LIMIT,
    SHELF_BINS,
    Box,
)
from ..functions.geo import audit_coast_distance_km, lattice_size
from ..functions.numbers import bin_label, col
from .ranking import exact_quantiles

# fixed values: reported quantiles
QUANTILES = {
    "min": 0.0, "p1": 0.01, "p5": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75,
    "p90": 0.90, "p95": 0.95, "p99": 0.99, "max": 1.0,
}


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def close_to(c: Column, value: float) -> Column:
    return F.abs(c - value) <= 1e-8 + 1e-5 * abs(value)


def score_distribution(scored: DataFrame, groups: list[str], score: str, row_id: str) -> DataFrame:
    """Exact quantiles with saturation (>= 90) and clipping (= 100) shares and flags."""
    s = F.col(score)
    counts = scored.where(s.isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(s >= 90).alias("cells_ge_90"),
        F.count_if(close_to(s, 100.0)).alias("cells_eq_100"),
    )
    flagged = counts.withColumns({
        "percent_ge_90": percent(F.col("cells_ge_90"), F.col("cell_count")),
        "percent_eq_100": percent(F.col("cells_eq_100"), F.col("cell_count")),
    }).withColumns({
        "saturation": F.col("percent_ge_90") > SATURATION_LIMIT_PCT,
        "clipping_or_normalisation_issue": F.col("percent_eq_100") > CLIPPING_LIMIT_PCT,
    })
    return flagged.join(exact_quantiles(scored, groups, score, QUANTILES, row_id), groups)


def spatial_bins(cells: DataFrame) -> DataFrame:
    """Right-closed audit bins and one-degree floor bins as text."""
    km = audit_coast_distance_km("lon")
    return cells.withColumns({
        "depth_bin": bin_label("depth_m", DEPTH_BINS),
        "shelf_distance_bin": bin_label("distance_to_shelf_break", SHELF_BINS),
        "audit_coast_km": km,
        "coast_distance_bin": bin_label(km, COAST_BINS),
        "lat_bin": F.coalesce(F.floor("lat").cast("string"), F.lit("none")),
        "lon_bin": F.coalesce(F.floor("lon").cast("string"), F.lit("none")),
    })


BIN_COLUMNS = ("depth_bin", "coast_distance_bin", "shelf_distance_bin", "lat_bin", "lon_bin")


def high_score_bins(cells: DataFrame, groups: list[str], score: str, floor: float = 90.0, keep: int = 30) -> DataFrame:
    """Most frequent bins of high-score rows, all five bin columns in one pass."""
    high = spatial_bins(cells.where(F.col(score) >= floor))
    long = high.select(*groups, *BIN_COLUMNS).unpivot(groups, list(BIN_COLUMNS), "bin_column", "bin")
    counts = long.groupBy(*groups, "bin_column", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups, "bin_column").orderBy(F.desc("n"), "bin")
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def guarded_correlation(a: str, b: str) -> Column:
    """Aggregate Pearson r over complete rows; needs three rows and spread on both sides."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    usable = (F.count_if(both) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(usable, F.corr(x, y))


def bathymetry_audit(cells: DataFrame, groups: list[str], row_id: str, contours: tuple[str, ...] = ()) -> DataFrame:
    depth = F.col("depth_m")
    out = cells.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.min(depth).alias("depth_min"),
        F.max(depth).alias("depth_max"),
        F.count_if(depth <= 0).alias("cells_depth_le_0"),
        F.count_if(depth < 20).alias("cells_depth_lt_20"),
        F.count_if(depth < 50).alias("cells_depth_lt_50"),
        F.count_if(depth > 200).alias("cells_depth_gt_200"),
        F.count_if(~F.coalesce(F.col("ocean_mask"), F.lit(False))).alias("non_ocean_cells"),
        *[F.min(c).alias(f"{c}_min") for c in contours],
    )
    share = F.col("cells_depth_lt_50") / F.greatest(F.col("cell_count"), F.lit(1))
    median = exact_quantiles(cells, groups, "depth_m", {"depth_median": 0.5}, row_id)
    return out.withColumn("bathymetry_suspicious", share > SHALLOW_SHARE_LIMIT).join(
        median, groups, "left"
    )


def column_profile(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """(column, rows, filled, numbers, varied) for every column in one pass."""
    groups = groups or []

    def facts(c: str) -> Column:
        v = F.col(c)
        n = v.cast("double") if df.schema[c].dataType.typeName() != "string" else v.try_cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("filled"),
            F.count(n).alias("numbers"),
            F.coalesce(F.min(n) < F.max(n), F.lit(False)).alias("varied"),
        )

    wide = df.groupBy(*groups).agg(F.array(*[facts(c) for c in columns]).alias("facts"))
    return wide.select(*groups, F.explode("facts").alias("f")).select(*groups, "f.*")


def keep_column(flags: tuple[str, ...] = FLAG_FEATURES) -> Column:
    """Kept: some numbers, at most 80 % missing, more than one value (flags may break both)."""
    is_flag = F.col("column").isin(*flags)
    missing = 1 - F.col("filled") / F.col("rows")
    return (
        (F.col("numbers") > 0)
        & (is_flag | (missing <= 0.80))
        & (is_flag | F.col("varied"))
    )


def usable_columns(df: DataFrame, candidates, strict: bool = True) -> list[str]:
    """Screened feature names in the given order: one row per column reaches the driver."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return []
    rule = keep_column() if strict else (F.col("numbers") > 0) & F.col("varied")
    kept = {r["column"] for r in column_profile(df, have).where(rule).collect()}
    return [c for c in have if c in kept]


def current_feature_audit(data: DataFrame, groups: list[str]) -> DataFrame:
    have = [c for c in CURRENT_FEATURES if c in data.columns]
    out = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 1).alias("presence"),
        F.count_if(F.col("label") == 0).alias("background"),
        *[F.count(c).alias(f"{c}_non_null") for c in have],
    )
    zero = F.lit(0).cast("long")
    out = out.withColumns({f"{c}_non_null": zero for c in CURRENT_FEATURES if c not in have})
    some = reduce(lambda a, b: a | b, [F.col(f"{c}_non_null") > 0 for c in CURRENT_FEATURES])
    return out.withColumns({
        "has_real_current_features": some,
        "trainability_for_current_retrain": F.when(some, "ready_for_current_feature_retrain")
        .otherwise("blocked_missing_current_features"),
    })


def missing_fractions(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Features with any gap and their missing share."""
    profile = column_profile(df, columns, groups)
    share = 1 - F.col("filled") / F.col("rows")
    return profile.select(*groups, F.col("column").alias("feature"), share.alias("missing_fraction")).where(
        F.col("filled") < F.col("rows")
    )


def training_status(presence: str = "presence_samples", sst: str = "has_sst", bathymetry: str = "has_bathymetry") -> Column:
    n = col(presence)
    return (
        F.when(~F.col(sst), "unavailable_missing_required_data")
        .when((n >= 300) & F.col(bathymetry), "trainable_sst_bathy_only")
        .when(n >= 300, "trainable_full_features")
        .when(n >= 100, "trainable_low_confidence")
        .otherwise("rule_based_only_insufficient_occurrence")
    )


def training_report(data: DataFrame, features: list[str], day: str = "date", groups: list[str] | None = None) -> DataFrame:
    """One wide row per species: classes, splits, dates, gaps, ranges, flags and status."""
    groups = groups or ["species_id"]
    is_p, is_b = F.col("label") == 1, F.col("label") == 0
    out = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(is_p).alias("presence_samples"),
        F.count_if(is_b).alias("background_samples"),
        F.count_distinct(day).alias("unique_dates"),
        F.min(day).alias("date_min"),
        F.max(day).alias("date_max"),
        F.min(F.year(day)).cast("long").alias("year_min"),
        F.max(F.year(day)).cast("long").alias("year_max"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in ("train", "validation", "test")],
        *[percent(F.count_if(F.col(f).isNull()), F.count(F.lit(1))).alias(f"{f}_missing_pct") for f in features],
        *[fn(c).alias(f"{c}_{name}") for c in ("sst_c", "depth_m")
          for name, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.count_if("high_match_distance").alias("high_match_distance_presence"),
        F.count_if(F.col("source_quality") == "low").alias("low_source_quality_records"),
        (F.count("sst_c") > 0).alias("has_sst"),
        (F.count("depth_m") > 0).alias("has_bathymetry"),
    )
    days = data.groupBy(*groups, day).agg(F.bool_or(is_p).alias("_p"), F.bool_or(is_b).alias("_b"))
    subset = days.groupBy(*groups).agg(
        F.bool_and(F.col("_p") | ~F.col("_b")).alias("background_dates_subset_of_presence_dates")
    )
    out = out.withColumns({
        "presence_background_ratio": F.try_divide(
            F.col("background_samples").cast("double"), F.col("presence_samples")
        ),
        "status": training_status(),
    })
    return out.join(subset, groups).drop("has_sst", "has_bathymetry")


def rating_distribution(cells: DataFrame, groups: list[str], rating: str = "rating") -> DataFrame:
    counts = cells.groupBy(*groups, F.coalesce(rating, F.lit("Unknown")).alias("rating")).agg(
        F.count(F.lit(1)).alias("count")
    )
    whole = F.sum("count").over(Window.partitionBy(*groups))
    return counts.withColumn("percent", percent(F.col("count"), whole))


def grid_cell_count(box: Box, step: float) -> int:
    n_lat, n_lon = lattice_size(box, step)
    return n_lat * n_lon


def download_estimate(dates: DataFrame, box: Box, step: float, bytes_per_cell: float) -> DataFrame:
    """Cells and megabytes for one row per wanted day."""
    cells = grid_cell_count(box, step)
    return dates.agg(F.count_distinct("date").alias("date_count")).withColumns({
        "cells_per_date": F.lit(cells).cast("long"),
        "estimated_cells": F.col("date_count") * cells,
        "estimated_mb": F.col("date_count") * (cells * bytes_per_cell / 1024 / 1024),
    })


def audit_rollup(distribution: DataFrame, bathymetry: DataFrame, bias: DataFrame, corrected: DataFrame) -> DataFrame:
    """One status row per species from the audit tables (all of them small)."""
    saturated = distribution.groupBy("species_id").agg(
        F.bool_or("saturation").alias("saturation_detected"),
        F.bool_or("clipping_or_normalisation_issue").alias("clipping_detected"),
    )
    shallow = bathymetry.groupBy("species_id").agg(
        F.bool_or("bathymetry_suspicious").alias("bathymetry_suspicious")
    )
    return (
        saturated.join(shallow, "species_id", "left")
        .join(bias.select("species_id", "model_likely_biased"), "species_id", "left")
        .join(corrected.select("species_id", F.col("status").alias("corrected_status")), "species_id", "left")
        .withColumn("corrected_status", F.coalesce("corrected_status", F.lit("not_trained")))
    )
