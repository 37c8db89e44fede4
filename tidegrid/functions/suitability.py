"""Rule-based suitability, ratings and the text that explains them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    FAD_TYPE,
    MONTH_NAMES,
    RULE_COMPONENT_NAMES,
    RULE_PROFILES,
    RULE_WEIGHT_CHANGES,
    RULE_WEIGHTS,
    SEASON_SCORES,
    SEASON_UNKNOWN,
)
from .numbers import clamp, col

PROFILE_SCHEMA = (
    "species_id string, common_name string, preferred array<double>, extended array<double>, "
    "depth_preference array<string>, structure_preference array<string>, "
    "seasonality map<string,string>, weights map<string,double>"
)


def profiles(spark: SparkSession) -> DataFrame:
    """The rule-scored species, one row each (a fixed table of seven)."""
    rows = []
    for species, name, preferred, extended, depths, structures, seasons in RULE_PROFILES:
        rows.append((
            species, name, list(preferred), list(extended), list(depths), list(structures),
            dict(seasons),
            {**RULE_WEIGHTS, **RULE_WEIGHT_CHANGES.get(species, {})},
        ))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def range_score(value, low, high, ext_low, ext_high) -> Column:
    """Trapezoid: 100 on [low, high], linear to 0 at the extended ends."""
    value, low, high, ext_low, ext_high = (col(c) for c in (value, low, high, ext_low, ext_high))
    rising = 100.0 * (value - ext_low) / F.nullif(low - ext_low, F.lit(0.0))
    falling = 100.0 * (ext_high - value) / F.nullif(ext_high - high, F.lit(0.0))
    return (
        F.when(value.between(low, high), 100.0)
        .when((value <= ext_low) | (value >= ext_high), 0.0)
        .when(value < low, rising)
        .when(value > high, falling)
    )


def season_score(seasonality, month) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    label = F.coalesce(
        F.try_element_at(col(seasonality), F.try_element_at(names, col(month).cast("int"))),
        F.lit("possible"),
    )
    scored = reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), SEASON_SCORES.items(), F)
    return scored.otherwise(SEASON_UNKNOWN)


def structure_score(structure_preference, depth_preference, poi_type, depth_class) -> Column:
    prefs, depths = col(structure_preference), col(depth_preference)
    kind, depth = col(poi_type), col(depth_class)
    edge = F.array(F.lit("shelf_break"), F.lit("canyon"))

    def points(condition: Column, amount: float) -> Column:
        return F.when(condition, amount).otherwise(0.0)

    return clamp(
        F.lit(35.0)
        + points(F.array_contains(prefs, kind), 40.0)
        + points(F.array_contains(depths, depth), 25.0)
        + points(F.array_contains(edge, kind) & F.arrays_overlap(prefs, edge), 10.0)
        + points((kind == FAD_TYPE) & F.array_contains(prefs, F.lit(FAD_TYPE)), 25.0)
    )


def rule_components(c: dict[str, Column | str] | None = None) -> dict[str, Column]:
    """The ten component scores over a row that carries a profile and a context."""
    g = F.coalesce(F.col("gradient_strength"), F.lit(0.0))
    speed = F.coalesce(F.col("current_speed_m_s"), F.lit(0.4))
    kind = F.coalesce(F.col("poi_type"), F.lit("current_edge"))
    depth = F.coalesce(F.col("depth_class"), F.lit("deep"))
    prefs, depths = F.col("structure_preference"), F.col("depth_preference")

    def either(condition: Column, yes: float, no: float) -> Column:
        return F.when(condition, yes).otherwise(no)

    return {
        "sst": range_score(
            "sst_c",
            F.col("preferred")[0], F.col("preferred")[1],
            F.col("extended")[0], F.col("extended")[1],
        ),
        "front": clamp(g * 48),
        "current": clamp(35 + speed * 72),
        "bathy": either(F.array_contains(depths, depth), 85.0, 45.0),
        "structure": structure_score(prefs, depths, kind, depth),
        "fad": either((kind == FAD_TYPE) & F.array_contains(prefs, F.lit(FAD_TYPE)), 95.0, 40.0),
        "shelf_canyon": either(kind.isin("shelf_break", "canyon"), 90.0, 45.0),
        "season": season_score("seasonality", "month"),
        "chlorophyll": either(g >= 1.0, 68.0, 42.0),
        "eddy": either(F.col("eddy_signal"), 70.0, 48.0),
    }


def rule_score(df: DataFrame) -> DataFrame:
    """Weighted rule composite with its strongest drivers and the limiting factor.

    Needs profile columns plus sst_c, gradient_strength, current_speed_m_s, poi_type,
    depth_class, eddy_signal, month and data_confidence.
    """
    names = list(RULE_COMPONENT_NAMES)
    scored = df.withColumns({f"c_{k}": v for k, v in rule_components().items()})
    total = reduce(
        lambda a, b: a + b,
        [F.col(f"c_{k}") * F.element_at("weights", F.lit(k)) for k in names],
    )
    is_mock = F.coalesce(F.col("data_confidence"), F.lit("mock")) == "mock"
    score = F.rint(clamp(total - F.when(is_mock, 6.0).otherwise(0.0)) * 10) / 10
    # equal components keep their listed order, as a stable sort would
    ranked = F.array_sort(
        F.array(*[
            F.struct((-F.col(f"c_{k}")).alias("neg"), F.lit(i).alias("pos"),
                     F.lit(RULE_COMPONENT_NAMES[k]).alias("name"))
            for i, k in enumerate(names)
        ])
    )
    weakest = F.array_min(
        F.array(*[
            F.struct(F.col(f"c_{k}").alias("value"), F.lit(i).alias("pos"),
                     F.lit(RULE_COMPONENT_NAMES[k]).alias("name"), F.lit(k).alias("key"))
            for i, k in enumerate(names)
        ])
    )
    out = scored.withColumn("score", score).withColumn("_ranked", ranked).withColumn("_weak", weakest)
    return out.withColumns({
        "rating": rating_loose("score"),
        "confidence": F.when(is_mock, "Low").otherwise("Medium"),
        "key_drivers": F.transform(F.slice("_ranked", 1, 4), lambda r: r["name"]),
        "limiting_factor": F.when(F.col("_weak.value") < 45, F.col("_weak.name")),
        "explanation": rule_notes(F.when(F.col("_weak.value") < 45, F.col("_weak.key"))),
    }).drop("_ranked", "_weak")


def whole_number(value: Column) -> Column:
    """Rounded half to even, as text."""
    return F.rint(value).cast("long").cast("string")


# fixed values: the texts of rule scores, feature notes and cell sentences
def rule_notes(weak: Column) -> Column:
    """Explanation of a rule score; what is missing is left out."""
    return notes(
        F.concat(F.lit("SST is "), F.when(F.col("sst_c").isNotNull(), F.format_string("%.1f", "sst_c")), F.lit(" C, giving a "), whole_number(F.col("c_sst")), F.lit("/100 species suitability component.")),
        F.concat(F.lit("The synthetic front/gradient score is "), whole_number(F.col("c_front")), F.lit("/100.")),
        F.concat(F.lit("Structure/depth context is "), F.coalesce("poi_type", F.lit("current_edge")), F.lit(" in "), F.coalesce("depth_class", F.lit("deep")), F.lit(" water.")),
        F.lit("Confidence is limited because this v0.1 demo uses synthetic ocean data."),
        F.concat(F.lit("Limiting factor: "), weak, F.lit(" is weak in this demo scenario.")),
    )


def feature_notes(features: tuple[str, ...]) -> tuple[Column, Column]:
    """(drivers, explanation) of a model's cell, from the features the model uses."""
    listed = (
        ("sst_c", "sst_c", "SST is included as a core habitat suitability feature."),
        ("sst_front_strength", "sst_front_strength", "SST front strength contributes to the relative hotspot score."),
        ("distance_to_shelf_break", "distance_to_shelf_break", "Shelf-break proximity is represented in the model features."),
        ("distance_to_nearest_fad_km", "distance_to_nearest_fad_km", "FAD/structure proximity is included where available."),
        ("month_sin", "seasonality", "Seasonal timing is included via cyclic date features."),
    )
    used = [(d, text) for f, d, text in listed if f in features or f == "month_sin" and "month_cos" in features]
    # the temperature counts only where the cell has one
    there = lambda d, value: F.when(F.col("sst_c").isNotNull(), value) if d == "sst_c" else F.lit(value)
    return (
        notes(*[there(d, d) for d, _ in used], keep=5),
        notes(*[there(d, text) for d, text in used], default="Relative suitability estimated from available environmental predictors."),
    )


def cell_sentence() -> Column:
    """One line on a fine-grid cell; NULL where temperature, depth or coast distance is missing."""
    base = F.format_string("SST %.1fC; depth about %.0fm; %.1fkm from coast proxy", "sst_c", "depth_m", "distance_to_coast_km")
    known = F.col("sst_c").isNotNull() & F.col("depth_m").isNotNull() & F.col("distance_to_coast_km").isNotNull()
    speed = F.when(F.col("current_speed").isNotNull(), F.format_string("; current speed %.2fm/s", "current_speed")).otherwise(".")
    return F.when(known, F.concat(base, speed))


def rating_loose(score) -> Column:
    """30 / 55 / 75 thresholds (rule scores)."""
    score = col(score)
    return (
        F.when(score < 30, "Low").when(score < 55, "Possible").when(score < 75, "Good")
        .when(score >= 75, "Prime")
    )


def rating_strict(score, visible: Column | None = None) -> Column:
    """60 / 85 / 95 thresholds (percentile scores); 'Masked' when hidden or unscored."""
    score = col(score)
    shown = score.isNotNull() if visible is None else score.isNotNull() & visible
    return (
        F.when(~shown, "Masked").when(score >= 95, "Prime").when(score >= 85, "Good")
        .when(score >= 60, "Possible").otherwise("Low")
    )


def sst_category(sst) -> Column:
    sst = col(sst)
    return (
        F.when(sst < 18, "cool").when(sst < 21, "moderate").when(sst < 24, "warm")
        .when(sst >= 24, "very_warm")
    )


def notes(*parts: Column, keep: int | None = None, default: str | None = None) -> Column:
    """Non-null parts as an array, cut to ``keep``; ``default`` alone when nothing is left."""
    found = F.filter(F.array(*parts), lambda x: x.isNotNull())
    if keep is not None:
        found = F.slice(found, 1, keep)
    if default is None:
        return found
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def habitat_notes() -> Column:
    """Explanation of one masked, percentile-ranked cell."""
    return notes(
        F.when(F.col("sst_c").isNotNull(), F.format_string("SST feature available (%.1f C).", "sst_c")),
        F.when(F.col("sst_front_strength").isNotNull(), F.lit("SST front proxy contributes to the ranking.")),
        F.when(F.col("depth_m").isNotNull(), F.format_string("Depth passes offshore display mask (%.0f m).", "depth_m")),
        F.when(F.col("distance_to_shelf_break").isNotNull(), F.lit("Shelf-break distance is included where available.")),
        keep=4,
        default="Relative suitability ranked within the prediction grid.",
    )


def spot_drivers() -> Column:
    """Short driver list of one recommended spot."""
    return notes(
        F.when(F.col("sst_c").isNotNull(), F.format_string("SST %.1fC", "sst_c")),
        F.when(F.col("sst_front_strength").isNotNull(), F.format_string("SST front proxy %.3f", "sst_front_strength")),
        F.when(F.col("current_speed").isNotNull(), F.format_string("Current %.2fm/s", "current_speed")),
        F.when(F.col("depth_m").isNotNull(), F.format_string("Depth %.0fm", "depth_m")),
        F.when(F.col("distance_to_coast_km").isNotNull(), F.format_string("%.1fkm from coast", "distance_to_coast_km")),
    )
