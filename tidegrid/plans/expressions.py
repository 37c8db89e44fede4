"""Queries of the scalar functions and predicates (F*, P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    COAST_BINS,
    CONTRAST_DEPTH_BINS,
    DEPTH_BINS,
    FINE_CELL_DEG,
    LANDMARK,
    PREDICT_BOX,
    SHELF_BINS,
    TRAIN_BOX,
)
from ..functions import dates, geo
from ..functions import suitability as suit
from ..functions.numbers import bin_index
from ..operators import alignment, display, fields
from ..operators.sampling import offshore
from .fixtures import view
from .registry import query

TAU = "6.283185307179586e0"
EARTH = "6371e0"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    half_lat = f"sin(radians(({c}) - ({a})) / 2)"
    half_lon = f"sin(radians(({d}) - ({b})) / 2)"
    return (
        f"(CASE WHEN ({a}) + ({b}) + ({c}) + ({d}) IS NOT NULL THEN 2 * {EARTH} * asin(least(sqrt({half_lat} * {half_lat} + cos(radians({a})) * cos(radians({c})) "
        f"* {half_lon} * {half_lon}), 1e0)) END)"
    )


def bins_sql(c: str, edges: tuple, lowest: bool = False) -> str:
    low, high = edges[0], edges[-1]
    outside = [f"{c} IS NULL"]
    if low is not None:
        outside.append(f"{c} {'<' if lowest else '<='} {low}")
    if high is not None:
        outside.append(f"{c} > {high}")
    steps = " ".join(f"WHEN {c} <= {e} THEN {i}" for i, e in enumerate(edges[1:-1]))
    return f"CAST(CASE WHEN {' OR '.join(outside)} THEN NULL {steps} ELSE {len(edges) - 2} END AS BIGINT)"


@query("f1_haversine", "fx_scored", f"""
SELECT cell_id, round({haversine_sql('lat', 'lon', str(LANDMARK[0]), str(LANDMARK[1]))}, 6) AS km FROM fx_scored""")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    km = geo.haversine_km("lat", "lon", F.lit(LANDMARK[0]), F.lit(LANDMARK[1]))
    return view(spark, sf, "fx_scored").select("cell_id", F.round(km, 6).alias("km"))


@query("f2_snap_cell", "fx_scored", """
SELECT cell_id, CAST(round_even(lat / 0.05e0, 0) AS BIGINT) AS iy, CAST(round_even(lon / 0.05e0, 0) AS BIGINT) AS ix,
  round(round_even(lat / 0.05e0, 0) * 0.05e0, 4) AS grid_lat, round(round_even(lon / 0.5e0, 0) * 0.5e0, 4) AS weather_lon,
  printf('%.4f_%.4f', round(round_even(lat / 0.05e0, 0) * 0.05e0, 4), round(round_even(lon / 0.05e0, 0) * 0.05e0, 4)) AS grid_id
FROM fx_scored""")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = geo.snap("lat", 0.05), geo.snap("lon", 0.05)
    return view(spark, sf, "fx_scored").select(
        "cell_id", geo.cell_index("lat", 0.05).alias("iy"), geo.cell_index("lon", 0.05).alias("ix"),
        lat.alias("grid_lat"), geo.snap("lon", 0.5).alias("weather_lon"), geo.cell_name(lat, lon).alias("grid_id"),
    )


@query("f3_lattice", "fx_scored", """
SELECT s.iy, s.ix, round(-36.5e0 + s.iy * 0.005e0, 4) AS lat, round(150.5e0 + s.ix * 0.005e0, 4) AS lon, s.n AS cell_rows
FROM (SELECT CAST(round_even((lat + 36.5e0) / 0.005e0, 0) AS BIGINT) AS iy, CAST(round_even((lon - 150.5e0) / 0.005e0, 0) AS BIGINT) AS ix, count(*) AS n
      FROM fx_scored GROUP BY 1, 2) s""")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows counted on the fine lattice of the prediction box."""
    held = view(spark, sf, "fx_scored").groupBy(
        geo.cell_index(F.col("lat") - PREDICT_BOX.south, FINE_CELL_DEG).alias("iy"),
        geo.cell_index(F.col("lon") - PREDICT_BOX.west, FINE_CELL_DEG).alias("ix"),
    ).agg(F.count(F.lit(1)).alias("cell_rows"))
    return geo.lattice(spark, PREDICT_BOX, FINE_CELL_DEG).join(held, ["iy", "ix"])


@query("f4_date_range", "fx_training", """
SELECT species_id, CAST(unnest(generate_series(min(day_date), max(day_date), INTERVAL 7 DAY)) AS DATE) AS date
FROM fx_training GROUP BY species_id""")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "fx_training").groupBy("species_id").agg(
        F.min("day_date").alias("a"), F.max("day_date").alias("b")
    )
    return spans.select("species_id", F.explode(dates.day_sequence("a", "b", 7)).alias("date"))


@query("f5_season", "fx_training", f"""
SELECT row_id, CAST(year(day_date) AS BIGINT) AS year, CAST(month(day_date) AS BIGINT) AS month,
  CAST(dayofyear(day_date) AS BIGINT) AS day_of_year,
  round(sin({TAU} * month(day_date) / 12), 6) AS month_sin, round(cos({TAU} * month(day_date) / 12), 6) AS month_cos,
  round(sin({TAU} * dayofyear(day_date) / 365.25e0), 6) AS day_of_year_sin,
  round(cos({TAU} * dayofyear(day_date) / 365.25e0), 6) AS day_of_year_cos
FROM fx_training""")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    made = dates.season_features("day_date")
    return view(spark, sf, "fx_training").select("row_id", *[
        (F.round(c, 6) if n.endswith(("sin", "cos")) else c).alias(n) for n, c in made.items()
    ])


@query("f6_lunar", "fx_training", f"""
ages AS (SELECT row_id, date_diff('day', DATE '2000-01-06', day_date) AS d,
   d - floor(d / 29.530588853e0) * 29.530588853e0 AS age, age / 29.530588853e0 AS phase FROM fx_training)
SELECT row_id, round(age, 4) AS moon_age_days, round(phase, 6) AS moon_phase_fraction,
  round(0.5e0 * (1 - cos({TAU} * phase)), 6) AS moon_illumination,
  round(sin({TAU} * phase), 8) AS moon_phase_sin, round(cos({TAU} * phase), 8) AS moon_phase_cos,
  CASE WHEN phase < 0.03e0 OR phase > 0.97e0 THEN 'new_moon' WHEN phase < 0.25e0 THEN 'waxing_crescent'
   WHEN phase < 0.28e0 THEN 'first_quarter' WHEN phase < 0.47e0 THEN 'waxing_gibbous' WHEN phase < 0.53e0 THEN 'full_moon'
   WHEN phase < 0.72e0 THEN 'waning_gibbous' WHEN phase < 0.78e0 THEN 'last_quarter' ELSE 'waning_crescent' END AS moon_phase_label
FROM ages""")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    made = dates.lunar_features("day_date")
    return view(spark, sf, "fx_training").select("row_id", *[c.alias(n) for n, c in made.items()])


@query("f7_range_score", "fx_scored", """
SELECT cell_id, round(CASE WHEN sst_c BETWEEN 20 AND 24.5e0 THEN 100e0 WHEN sst_c <= 17.5e0 OR sst_c >= 27 THEN 0e0
  WHEN sst_c < 20 THEN 100e0 * (sst_c - 17.5e0) / 2.5e0 WHEN sst_c > 24.5e0 THEN 100e0 * (27e0 - sst_c) / 2.5e0 END, 6) AS suitability
FROM fx_scored""")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    s = suit.range_score("sst_c", F.lit(20.0), F.lit(24.5), F.lit(17.5), F.lit(27.0))
    return view(spark, sf, "fx_scored").select("cell_id", F.round(s, 6).alias("suitability"))


@query("f11_ratings", "fx_scored", """
SELECT cell_id,
  CASE WHEN raw_score * 95 < 30 THEN 'Low' WHEN raw_score * 95 < 55 THEN 'Possible' WHEN raw_score * 95 < 75 THEN 'Good' ELSE 'Prime' END AS rating_loose,
  CASE WHEN NOT ocean_mask THEN 'Masked' WHEN raw_score * 95 >= 95 THEN 'Prime' WHEN raw_score * 95 >= 85 THEN 'Good'
       WHEN raw_score * 95 >= 60 THEN 'Possible' ELSE 'Low' END AS rating_strict
FROM fx_scored""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("raw_score") * 95
    return view(spark, sf, "fx_scored").select(
        "cell_id", suit.rating_loose(s).alias("rating_loose"),
        suit.rating_strict(s, F.col("ocean_mask")).alias("rating_strict"),
    )


@query("f12_current_vector", "fx_physics", """
SELECT day_date AS date, level_idx, lat, lon, uo, vo, round(sqrt(uo*uo + vo*vo), 6) AS current_speed,
  round(CASE WHEN degrees(atan2(uo, vo)) + 360 >= 360 THEN degrees(atan2(uo, vo)) ELSE degrees(atan2(uo, vo)) + 360 END, 6) AS current_direction_degrees
FROM fx_physics""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_physics").select(
        F.col("day_date").alias("date"), "level_idx", "lat", "lon", "uo", "vo",
        F.round(geo.current_speed("uo", "vo"), 6).alias("current_speed"),
        F.round(geo.current_direction("uo", "vo"), 6).alias("current_direction_degrees"),
    )


@query("f13_bins", "fx_scored", f"""
SELECT cell_id, {bins_sql('depth_m', DEPTH_BINS)} AS depth_bin, {bins_sql('distance_to_shelf_break', SHELF_BINS)} AS shelf_bin,
  {bins_sql('distance_to_coast_km', COAST_BINS)} AS coast_bin, {bins_sql('depth_m', CONTRAST_DEPTH_BINS, True)} AS contrast_depth_bin,
  CASE WHEN distance_to_coast_km <= 20 THEN 'nearshore_0_20km' WHEN distance_to_coast_km <= 50 THEN 'mid_20_50km'
       WHEN distance_to_coast_km <= 100 THEN 'offshore_50_100km' WHEN distance_to_coast_km <= 1000 THEN 'far_offshore_100km_plus' END AS distance_band,
  CAST(floor(lat) AS BIGINT) AS lat_bin, CAST(floor(lon) AS BIGINT) AS lon_bin
FROM fx_scored""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").select(
        "cell_id", bin_index("depth_m", DEPTH_BINS).alias("depth_bin"),
        bin_index("distance_to_shelf_break", SHELF_BINS).alias("shelf_bin"),
        bin_index("distance_to_coast_km", COAST_BINS).alias("coast_bin"),
        bin_index("depth_m", CONTRAST_DEPTH_BINS, True).alias("contrast_depth_bin"),
        geo.distance_band("distance_to_coast_km").alias("distance_band"),
        F.floor("lat").alias("lat_bin"), F.floor("lon").alias("lon_bin"),
    )


COAST_SQL = """CASE WHEN lat <= -36.5e0 THEN 150.72e0
  WHEN lat <= -35.1e0 THEN 150.72e0 + (lat + 36.5e0) / 1.4e0 * 0.06e0
  WHEN lat <= -34.2e0 THEN 150.78e0 + (lat + 35.1e0) / 0.9e0 * 0.38e0
  WHEN lat <= -33.6e0 THEN 151.16e0 + (lat + 34.2e0) / 0.6e0 * 0.18e0
  WHEN lat <= -32e0 THEN 151.34e0 + (lat + 33.6e0) / 1.6e0 * 0.48e0 ELSE 151.82e0 END"""


@query("f14_coast_distance", "fx_scored", f"""
SELECT cell_id, round({COAST_SQL}, 6) AS coast_lon, round(greatest(0e0, (lon - ({COAST_SQL})) * 111.32e0 * cos(radians(lat))), 6) AS coast_km,
  round(greatest(0e0, lon - 150.5e0) * 92e0, 6) AS audit_coast_km FROM fx_scored""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").select(
        "cell_id", F.round(geo.coast_lon("lat"), 6).alias("coast_lon"),
        F.round(geo.coast_distance_km("lat", "lon"), 6).alias("coast_km"),
        F.round(geo.audit_coast_distance_km("lon"), 6).alias("audit_coast_km"),
    )


SEGMENT_SQL = "CAST(greatest(0, least(7, trunc((lat + 36.5e0) / 4.5e0 * 8))) AS BIGINT)"
BAND_SQL = "CASE WHEN distance_to_coast_km <= 20 THEN 'nearshore' WHEN distance_to_coast_km <= 50 THEN 'midshore' ELSE 'offshore' END"


@query("f15_coast_segment", "fx_scored", f"SELECT cell_id, {SEGMENT_SQL} AS segment, {BAND_SQL} AS band FROM fx_scored")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").select(
        "cell_id", geo.coast_segment("lat").alias("segment"),
        geo.coast_priority_band("distance_to_coast_km").alias("band"),
    )


@query("f17_contour_proxy", "fx_static", """
SELECT iy, ix, round(abs(depth_m - 200) / 25e0, 6) AS distance_to_200m_contour, round(abs(depth_m - 500) / 25e0, 6) AS distance_to_500m_contour,
  round(abs(depth_m - 1000) / 25e0, 6) AS distance_to_1000m_contour FROM fx_static""")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    made = fields.contour_proxies()
    return view(spark, sf, "fx_static").select("iy", "ix", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("f18_sst_category", "fx_scored", """
SELECT CASE WHEN sst_c < 18 THEN 'cool' WHEN sst_c < 21 THEN 'moderate' WHEN sst_c < 24 THEN 'warm' WHEN sst_c >= 24 THEN 'very_warm' END AS category,
  count(*) AS n FROM fx_scored GROUP BY 1""")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").groupBy(suit.sst_category("sst_c").alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("f19_explanations", "fx_scored", """
parts AS (SELECT cell_id,
  list_filter([CASE WHEN sst_c IS NOT NULL THEN printf('SST feature available (%.1f C).', sst_c) END,
   CASE WHEN sst_front_strength IS NOT NULL THEN 'SST front proxy contributes to the ranking.' END,
   CASE WHEN depth_m IS NOT NULL THEN printf('Depth passes offshore display mask (%.0f m).', depth_m) END,
   CASE WHEN distance_to_shelf_break IS NOT NULL THEN 'Shelf-break distance is included where available.' END], lambda x: x IS NOT NULL) AS notes FROM fx_scored)
SELECT cell_id, CASE WHEN len(notes) = 0 THEN 'Relative suitability ranked within the prediction grid.' ELSE array_to_string(notes, ' ') END AS explanation FROM parts""")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").select("cell_id", F.concat_ws(" ", suit.habitat_notes()).alias("explanation"))


F19_FEATURES = ("sst_c", "sst_front_strength", "distance_to_shelf_break", "month_cos")


@query("f19_feature_notes", "fx_scored", """
SELECT cell_id, CASE WHEN sst_c IS NOT NULL THEN 'sst_c,' ELSE '' END || 'sst_front_strength,distance_to_shelf_break,seasonality' AS drivers,
  CASE WHEN sst_c IS NOT NULL THEN 'SST is included as a core habitat suitability feature. ' ELSE '' END || 'SST front strength contributes to the relative hotspot score. Shelf-break proximity is represented in the model features. Seasonal timing is included via cyclic date features.' AS explanation
FROM fx_scored""")
def f19_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers and notes of a model's cell by the features it uses."""
    drivers, explanation = suit.feature_notes(F19_FEATURES)
    return view(spark, sf, "fx_scored").select("cell_id", F.concat_ws(",", drivers).alias("drivers"), F.concat_ws(" ", explanation).alias("explanation"))


@query("f19_cell_sentence", "fx_scored", """
SELECT cell_id, CASE WHEN sst_c IS NOT NULL AND depth_m IS NOT NULL AND distance_to_coast_km IS NOT NULL THEN printf('SST %.1fC; depth about %.0fm; %.1fkm from coast proxy', sst_c, depth_m, distance_to_coast_km)
  || CASE WHEN current_speed IS NOT NULL THEN printf('; current speed %.2fm/s', current_speed) ELSE '.' END END AS explanation FROM fx_scored""")
def f19_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").select("cell_id", suit.cell_sentence().alias("explanation"))


@query("p1_in_box", "fx_scored", """
SELECT lat BETWEEN -36.5e0 AND -32e0 AND lon BETWEEN 150.5e0 AND 154.5e0 AS in_predict,
  lat + lat / 10 BETWEEN -39 AND -27 AND lon + 5 BETWEEN 148.5e0 AND 158.5e0 AS in_train, count(*) AS n FROM fx_scored GROUP BY 1, 2""")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_scored").groupBy(
        geo.in_box("lat", "lon", PREDICT_BOX).alias("in_predict"),
        geo.in_box(F.col("lat") + F.col("lat") / 10, F.col("lon") + 5, TRAIN_BOX).alias("in_train"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p2_lenient_date", "fx_occurrence", """
texts AS (SELECT seq, CASE seq % 7 WHEN 0 THEN event_date_text WHEN 1 THEN event_date_text || 'T10:00' WHEN 2 THEN substr(event_date_text, 1, 7)
    WHEN 3 THEN replace(event_date_text, '-', '/') WHEN 4 THEN ' ' || event_date_text || ' ' WHEN 5 THEN substr(event_date_text, 1, 8) || '31' ELSE substr(event_date_text, 1, 4) || '-02-30' END AS t FROM fx_occurrence),
tried AS (SELECT seq, t, regexp_matches(trim(t), '^[0-9]{4}') AS y4, CASE WHEN y4 THEN CAST(try_strptime(substr(trim(t), 1, 10), '%Y-%m-%d') AS DATE) END AS a,
    CASE WHEN y4 THEN CAST(try_strptime(substr(trim(t), 1, 7), '%Y-%m') AS DATE) END AS b, CASE WHEN y4 THEN CAST(try_strptime(substr(trim(t), 1, 4), '%Y') AS DATE) END AS c FROM texts)
SELECT seq, t AS event_date_text, coalesce(a, b, c) AS date, CASE WHEN a IS NOT NULL THEN 'day' WHEN b IS NOT NULL THEN 'month' WHEN c IS NOT NULL THEN 'year' END AS date_precision FROM tried""")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""CASE seq % 7 WHEN 0 THEN event_date_text WHEN 1 THEN event_date_text || 'T10:00' WHEN 2 THEN substr(event_date_text, 1, 7)
      WHEN 3 THEN replace(event_date_text, '-', '/') WHEN 4 THEN ' ' || event_date_text || ' ' WHEN 5 THEN substr(event_date_text, 1, 8) || '31'
      ELSE substr(event_date_text, 1, 4) || '-02-30' END""")
    texts = view(spark, sf, "fx_occurrence").select("seq", text.alias("event_date_text"))
    return texts.select(
        "seq", "event_date_text", dates.lenient_date("event_date_text").alias("date"),
        dates.date_precision("event_date_text").alias("date_precision"),
    )


@query("p7_offshore_mask", "fx_scored", """
SELECT species, count(*) AS n FROM (SELECT CASE species_id WHEN 'A' THEN 'mahi_mahi' WHEN 'N' THEN 'striped_marlin' ELSE 'other' END AS species, depth_m, ocean_mask FROM fx_scored) s
WHERE ocean_mask AND coalesce(depth_m, -999) >= CASE species WHEN 'mahi_mahi' THEN 30 WHEN 'striped_marlin' THEN 100 ELSE 50 END GROUP BY 1""")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("species_id") == "A", "mahi_mahi").when(F.col("species_id") == "N", "striped_marlin").otherwise("other")
    cells = view(spark, sf, "fx_scored").withColumn("species_id", named)
    return cells.where(offshore()).groupBy(F.col("species_id").alias("species")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_display_mask", "fx_scored", """
SELECT species, count(*) AS n FROM (SELECT CASE species_id WHEN 'A' THEN 'mahi_mahi' WHEN 'N' THEN 'southern_bluefin_tuna' ELSE 'other' END AS species, depth_m, sst_c FROM fx_scored) s
WHERE depth_m IS NOT NULL AND sst_c IS NOT NULL AND depth_m >= CASE species WHEN 'mahi_mahi' THEN 8 WHEN 'southern_bluefin_tuna' THEN 50 ELSE 5 END GROUP BY 1""")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("species_id") == "A", "mahi_mahi").when(F.col("species_id") == "N", "southern_bluefin_tuna").otherwise("other")
    cells = view(spark, sf, "fx_scored").withColumn("species_id", named)
    return cells.where(display.display_mask()).groupBy(F.col("species_id").alias("species")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_known_land", "fx_static", "SELECT iy, ix, ocean_mask FROM fx_static WHERE ocean_mask IS NULL OR ocean_mask")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.known_land_removed(view(spark, sf, "fx_static")).select("iy", "ix", "ocean_mask")


@query("p10_feature_set_label", "fx_scored", """
SELECT CASE WHEN depth_m IS NOT NULL AND distance_to_shelf_break IS NOT NULL THEN 'sst_bathy_structure' WHEN depth_m IS NOT NULL THEN 'sst_bathy_only' ELSE 'sst_only' END AS feature_set_name,
  count(*) AS n FROM fx_scored GROUP BY 1""")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    flagged = view(spark, sf, "fx_scored").select(
        F.col("depth_m").isNotNull().alias("has_bathymetry"),
        F.col("distance_to_shelf_break").isNotNull().alias("has_structure"),
    )
    return flagged.groupBy(alignment.feature_set_name().alias("feature_set_name")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_source_label", "fx_scored", """
SELECT species_id, yr, concat_ws(',', CASE WHEN bool_or(sst_c > 25.5e0) THEN 'MUR SST' END, CASE WHEN bool_or(depth_m > 2999) THEN 'GEBCO bathymetry' END,
  CASE WHEN bool_or(current_speed > 5) THEN 'Copernicus physics' END) AS data_sources_available FROM fx_scored GROUP BY 1, 2""")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    flagged = view(spark, sf, "fx_scored").select(
        "species_id", "yr", (F.col("sst_c") > 25.5).alias("has_sst"),
        (F.col("depth_m") > 2999).alias("has_bathymetry"), (F.col("current_speed") > 5).alias("has_physics"),
    )
    label = alignment.source_label({
        "MUR SST": "has_sst", "GEBCO bathymetry": "has_bathymetry", "Copernicus physics": "has_physics"
    })
    return flagged.groupBy("species_id", "yr").agg(label.alias("data_sources_available"))


@query("p12_layer_cells", "fx_scored", """
SELECT cell_id, 'front' AS layer FROM fx_scored WHERE sst_front_strength > 0.08e0
UNION ALL SELECT cell_id, 'heat' AS layer FROM fx_scored WHERE raw_score * 95 >= 30""")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    cells = view(spark, sf, "fx_scored").withColumn("score", F.col("raw_score") * 95)
    front = display.front_cells(cells, [F.col("cell_id")], gradient="sst_front_strength")
    return front.select("cell_id", F.lit("front").alias("layer")).unionByName(
        display.heat_cells(cells).select("cell_id", F.lit("heat").alias("layer"))
    )
