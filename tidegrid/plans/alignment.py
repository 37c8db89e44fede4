"""Queries of fields and joins (J*, W6-W9, A4-A9, F16, S6, S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LANDMARK
from ..functions.geo import cell_name
from ..operators import alignment as al
from ..operators import fields as fl
from ..operators.nearest import nearest_point
from ..sources import tabular
from .cleaning import CLEAN, clean
from .expressions import TAU, haversine_sql
from .fixtures import view
from .registry import query

STEP = 0.25


def field(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_field").withColumnRenamed("day_date", "date")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_physics").withColumnRenamed("day_date", "date")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_poi")


def weather(spark: SparkSession, sf: str) -> DataFrame:
    hourly = view(spark, sf, "fx_hourly").drop("date").withColumnRenamed("day_date", "date")
    return fl.daily_weather(hourly.withColumn("pressure_msl", F.col("surface_pressure") + 5))


def training(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_training").withColumnRenamed("day_date", "date")
    return rows.withColumns({"grid_id": cell_name("grid_lat", "grid_lon"), "label": F.col("label").cast("long")})


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


NEAREST = f"""
near AS (SELECT c.iy, c.ix, p.poi_type, round({haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')}, 6) AS km FROM fx_static c, fx_poi p
  QUALIFY row_number() OVER (PARTITION BY c.iy, c.ix ORDER BY km, p.poi_id) = 1),
fad AS (SELECT c.iy, c.ix, min(round({haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')}, 6)) AS km FROM fx_static c, fx_poi p WHERE p.poi_type = 'fad_demo' GROUP BY 1, 2)
"""


@query("j3_structure_distances", "fx_static fx_poi", NEAREST + f"""
SELECT c.iy, c.ix, near.km AS distance_to_nearest_poi_km, near.poi_type AS nearest_poi_type, fad.km AS distance_to_nearest_fad_km,
  round({haversine_sql('c.lat', 'c.lon', str(LANDMARK[0]), str(LANDMARK[1]))}, 6) AS distance_to_browns_mountain_km
FROM fx_static c LEFT JOIN near USING (iy, ix) LEFT JOIN fad USING (iy, ix)""")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    cells = al.structure_distances(view(spark, sf, "fx_static"), points(spark, sf))
    return rounded(cells, "distance_to_browns_mountain_km").drop("lat", "lon", "depth_m", "ocean_mask")


@query("j3_nearest_point_rows", "fx_scored fx_poi", f"""
SELECT c.cell_id, p.poi_id AS nearest_poi_id, p.poi_type AS nearest_poi_type, round({haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')}, 6) AS nearest_km
FROM fx_scored c, fx_poi p QUALIFY row_number() OVER (PARTITION BY c.cell_id ORDER BY nearest_km, p.poi_id) = 1""")
def j3_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = view(spark, sf, "fx_scored").select("cell_id", "lat", "lon")
    return nearest_point(cells, points(spark, sf), ["poi_id", "poi_type"]).drop("lat", "lon")


PHYSICS = """
raw AS (SELECT *, CAST(round_even(lat / 0.25e0, 0) AS BIGINT) AS yy, CAST(round_even(lon / 0.25e0, 0) AS BIGINT) AS xx,
  sqrt(uo*uo + vo*vo) AS speed, CASE WHEN degrees(atan2(uo, vo)) + 360 >= 360 THEN degrees(atan2(uo, vo)) ELSE degrees(atan2(uo, vo)) + 360 END AS toward FROM fx_physics WHERE level_idx = 0),
regrid AS (SELECT day_date AS date, yy, xx, yy * 0.25e0 AS lat, xx * 0.25e0 AS lon, avg(uo) AS uo, avg(vo) AS vo, avg(zos) AS zos, avg(speed) AS current_speed,
  avg(toward) AS current_direction_degrees FROM raw GROUP BY day_date, yy, xx)
"""


def regridded(spark: SparkSession, sf: str) -> DataFrame:
    surface = samples(spark, sf).where(F.col("level_idx") == 0)
    return fl.regrid_physics(surface, STEP)


@query("a4_regrid_physics", "fx_physics", PHYSICS + """
SELECT date, yy AS iy, xx AS ix, lat, lon, round(uo, 6) AS uo, round(vo, 6) AS vo, round(zos, 6) AS zos, round(current_speed, 6) AS current_speed,
  round(current_direction_degrees, 6) AS current_direction_degrees FROM regrid""")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regridded(spark, sf), "uo", "vo", "zos", "current_speed", "current_direction_degrees")


WEATHER = f"""
weather AS (SELECT day_date AS date, weather_lat, weather_lon, avg(surface_pressure) AS surface_pressure_hpa_mean, min(surface_pressure) AS surface_pressure_hpa_min,
  max(surface_pressure) AS surface_pressure_hpa_max, avg(surface_pressure + 5) AS pressure_msl_hpa_mean, avg(wind_speed) AS wind_speed_10m_kmh_mean,
  max(wind_speed) AS wind_speed_10m_kmh_max, sum(precipitation) AS precipitation_mm_sum, avg(sin(radians(wind_direction))) AS s, avg(cos(radians(wind_direction))) AS c,
  (degrees(atan2(s, c)) + 360) - 360 * floor((degrees(atan2(s, c)) + 360) / 360) AS wind_direction_10m_deg_circular_mean FROM fx_hourly GROUP BY 1, 2, 3)
"""
W_COLUMNS = list(al.WEATHER_COLUMNS)


@query("a5_daily_weather", "fx_hourly", WEATHER + "SELECT date, weather_lat, weather_lon, "
       + ", ".join(f"round({c}, 7) AS {c}" for c in W_COLUMNS) + " FROM weather")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather(spark, sf), *W_COLUMNS, places=7)


@query("a6_circular_mean", "fx_hourly", """
SELECT day_date AS date, round(degrees(atan2(avg(sin(radians(wind_direction))), avg(cos(radians(wind_direction))))) +
  CASE WHEN degrees(atan2(avg(sin(radians(wind_direction))), avg(cos(radians(wind_direction))))) < 0 THEN 360 ELSE 0 END, 5) AS wind_direction FROM fx_hourly GROUP BY 1""")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    hourly = view(spark, sf, "fx_hourly")
    return hourly.groupBy(F.col("day_date").alias("date")).agg(
        F.round(fl.circular_mean("wind_direction"), 5).alias("wind_direction")
    )


@query("a7_cell_date_plan", "fx_occurrence", CLEAN + """
SELECT round(round_even(lat / 0.5e0, 0) * 0.5e0, 4) AS weather_lat, round(round_even(lon / 0.5e0, 0) * 0.5e0, 4) AS weather_lon,
  array_to_string(list_sort(list(DISTINCT CAST(d AS VARCHAR))), ',') AS dates, min(d) AS start_date, max(d) AS end_date FROM clean GROUP BY 1, 2""")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    plan = fl.cell_date_plan(clean(spark, sf), 0.5)
    return plan.withColumn("dates", F.concat_ws(",", F.col("dates").cast("array<string>")))


@query("a8_year_batches", "fx_training", """
SELECT CAST(year(day_date) AS BIGINT) AS year, min(day_date) AS start_date, max(day_date) AS end_date, count(DISTINCT day_date) AS date_count,
  CAST(max(day_date) - min(day_date) + 1 AS BIGINT) AS span_days FROM fx_training GROUP BY 1""")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return fl.year_batches(training(spark, sf))


@query("a9_day_summary", "fx_field", """
SELECT day_date AS date, count(*) AS cell_count, min(sst_c) AS min_value, max(sst_c) AS max_value, round(avg(sst_c), 6) AS mean_value,
  round(avg(CASE WHEN sst_c IS NULL THEN 100e0 ELSE 0e0 END), 6) AS missing_pct FROM fx_field GROUP BY 1""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fl.day_summary(field(spark, sf), "sst_c"), "mean_value", "missing_pct")


def gradient_sql(source: str, day: str, iy: str, ix: str, value: str, out: str) -> str:
    """CTEs ending in ``out``(day, iy, ix, g): gradient on the day's lattice, neighbours by window."""
    beside = lambda f, line, rank, step: f"CASE WHEN {f}({rank}) OVER {line} = {rank} {step} 1 THEN {f}(v) OVER {line} END"
    return f"""
{out}_y AS (SELECT {day}, {iy}, row_number() OVER (PARTITION BY {day} ORDER BY {iy}) AS ry, count(*) OVER (PARTITION BY {day}) AS ny FROM (SELECT DISTINCT {day}, {iy} FROM {source}) t),
{out}_x AS (SELECT {day}, {ix}, row_number() OVER (PARTITION BY {day} ORDER BY {ix}) AS rx, count(*) OVER (PARTITION BY {day}) AS nx FROM (SELECT DISTINCT {day}, {ix} FROM {source}) t),
{out}_g AS (SELECT s.{day}, s.{iy}, s.{ix}, s.{value} AS v, ry, ny, rx, nx FROM {source} s JOIN {out}_y USING ({day}, {iy}) JOIN {out}_x USING ({day}, {ix})),
{out}_n AS (SELECT *, {beside('lead', 'h', 'rx', '+')} AS e, {beside('lag', 'h', 'rx', '-')} AS w, {beside('lead', 'u', 'ry', '+')} AS n, {beside('lag', 'u', 'ry', '-')} AS s
  FROM {out}_g WINDOW h AS (PARTITION BY {day}, ry ORDER BY rx), u AS (PARTITION BY {day}, rx ORDER BY ry)),
{out}_d AS (SELECT {day}, {iy}, {ix}, nx, ny, CASE WHEN rx = 1 THEN e - v WHEN rx = nx THEN v - w ELSE (e - w) / 2 END AS gx,
  CASE WHEN ry = 1 THEN n - v WHEN ry = ny THEN v - s ELSE (n - s) / 2 END AS gy FROM {out}_n),
{out} AS (SELECT {day}, {iy}, {ix}, CASE WHEN nx > 1 AND ny > 1 THEN sqrt(gx * gx + gy * gy) END AS g FROM {out}_d)
"""


@query("w6_grid_gradient", "fx_field", gradient_sql("fx_field", "day_date", "iy", "ix", "sst_c", "grad")
       + "SELECT day_date AS date, iy, ix, round(g, 6) AS sst_gradient, round(g, 6) AS sst_front_strength FROM grad")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    """Central-difference gradient, with the front strength (W8) beside it."""
    sloped = fl.grid_gradient(field(spark, sf), "sst_c", "sst_gradient")
    sloped = sloped.withColumn("sst_front_strength", fl.front_strength())
    return rounded(sloped, "sst_gradient", "sst_front_strength").select(
        "date", "iy", "ix", "sst_gradient", "sst_front_strength"
    )


@query("w8_front_strength", "fx_scored", """
SELECT cell_id, CASE WHEN depth_m IS NOT NULL THEN greatest(depth_m - 1000, 0e0) END AS front_strength FROM fx_scored""")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    """max(x, 0) over signed values; real gradients are never negative."""
    signed = view(spark, sf, "fx_scored").withColumn("g", F.col("depth_m") - 1000)
    return signed.select("cell_id", fl.front_strength("g").alias("front_strength"))


@query("w7_forward_gradient", "fx_field", """
SELECT f.day_date AS date, f.iy, f.ix, CASE WHEN f.sst_c IS NOT NULL THEN round(sqrt(power(coalesce(e.sst_c - f.sst_c, 0e0), 2) + power(coalesce(n.sst_c - f.sst_c, 0e0), 2)), 5) END AS sst_gradient
FROM fx_field f LEFT JOIN fx_field e ON e.day_date = f.day_date AND e.iy = f.iy AND e.ix = f.ix + 1 LEFT JOIN fx_field n ON n.day_date = f.day_date AND n.ix = f.ix AND n.iy = f.iy + 1""")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return fl.forward_gradient(field(spark, sf), "sst_c", "sst_gradient").select("date", "iy", "ix", "sst_gradient")


@query("w9_physics_features", "fx_physics", PHYSICS + "," + gradient_sql("regrid", "date", "yy", "xx", "current_speed", "edge") + ","
       + gradient_sql("regrid", "date", "yy", "xx", "zos", "height") + """
SELECT r.date, r.yy AS iy, r.xx AS ix, round(e.g, 6) AS current_edge_score, round(h.g, 6) AS sla_gradient, round(coalesce(e.g, 0e0) + coalesce(h.g, 0e0), 6) AS eddy_score
FROM regrid r JOIN edge e USING (date, yy, xx) JOIN height h USING (date, yy, xx)""")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    made = fl.physics_features(samples(spark, sf).where(F.col("level_idx") == 0), STEP)
    return rounded(made, "current_edge_score", "sla_gradient", "eddy_score").select(
        "date", "iy", "ix", "current_edge_score", "sla_gradient", "eddy_score"
    )


@query("j13_past_changes", "fx_field", """
SELECT f.day_date AS date, f.iy, f.ix, round(f.sst_c - a.sst_c, 6) AS sst_3d_change, round(f.sst_c - b.sst_c, 6) AS sst_7d_change FROM fx_field f
LEFT JOIN fx_field a ON a.iy = f.iy AND a.ix = f.ix AND a.day_date = f.day_date - 3 LEFT JOIN fx_field b ON b.iy = f.iy AND b.ix = f.ix AND b.day_date = f.day_date - 7""")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    changed = fl.past_changes(field(spark, sf), "sst_c")
    return rounded(changed, "sst_3d_change", "sst_7d_change").select("date", "iy", "ix", "sst_3d_change", "sst_7d_change")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The full daily feature grid of the fixtures."""
    sst = fl.past_changes(fl.grid_gradient(field(spark, sf), "sst_c", "sst_gradient"), "sst_c")
    sst = sst.withColumn("sst_front_strength", fl.front_strength())
    static = al.structure_distances(view(spark, sf, "fx_static"), points(spark, sf))
    return al.daily_feature_grid(sst, static, regridded(spark, sf), weather(spark, sf))


@query("j1_daily_feature_grid", "fx_field fx_static fx_poi fx_physics fx_hourly", NEAREST + "," + PHYSICS + "," + WEATHER + "," +
       gradient_sql("fx_field", "day_date", "iy", "ix", "sst_c", "grad") + f"""
SELECT f.day_date AS date, f.iy, f.ix, printf('%.4f_%.4f', f.lat, f.lon) AS grid_id, round(f.sst_c, 6) AS sst_c, f.sst_c IS NOT NULL AS has_sst, round(gr.g, 6) AS sst_gradient, s.depth_m, s.depth_m IS NOT NULL AS has_bathymetry,
  n.km AS distance_to_nearest_poi_km, n.poi_type AS nearest_poi_type, round(p.uo, 6) AS uo, round(p.current_speed, 6) AS current_speed, coalesce(p.uo, p.vo, p.current_speed) IS NOT NULL AS has_physics,
  round(w.surface_pressure_hpa_mean, 7) AS surface_pressure_hpa_mean, w.surface_pressure_hpa_mean IS NOT NULL AS has_weather, round(sin({TAU} * dayofyear(f.day_date) / 365.25e0), 6) AS day_of_year_sin,
  CASE WHEN s.depth_m IS NOT NULL AND n.km IS NOT NULL THEN 'sst_bathy_structure' WHEN s.depth_m IS NOT NULL THEN 'sst_bathy_only' ELSE 'sst_only' END AS feature_set_name
FROM fx_field f JOIN grad gr ON gr.day_date = f.day_date AND gr.iy = f.iy AND gr.ix = f.ix LEFT JOIN fx_static s ON s.iy = f.iy AND s.ix = f.ix LEFT JOIN near n ON n.iy = s.iy AND n.ix = s.ix
LEFT JOIN regrid p ON p.date = f.day_date AND p.lat = f.lat AND p.lon = f.lon
LEFT JOIN weather w ON w.date = f.day_date AND w.weather_lat = round_even(f.lat / 0.5e0, 0) * 0.5e0 AND w.weather_lon = round_even(f.lon / 0.5e0, 0) * 0.5e0
WHERE s.ocean_mask IS NULL OR s.ocean_mask""")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    sst = fl.grid_gradient(field(spark, sf), "sst_c", "sst_gradient")
    static = al.structure_distances(view(spark, sf, "fx_static"), points(spark, sf))
    # physics cells are counted from the equator, field cells from the box corner
    physics = regridded(spark, sf).withColumns({
        "iy": F.rint((F.col("lat") + 39) / STEP).cast("long"), "ix": F.rint((F.col("lon") - 148.5) / STEP).cast("long")
    })
    made = al.daily_feature_grid(sst, static, physics, weather(spark, sf))
    out = rounded(made, "sst_c", "sst_gradient", "uo", "current_speed", "day_of_year_sin")
    return rounded(out, "surface_pressure_hpa_mean", places=7).select(
        "date", "iy", "ix", "grid_id", "sst_c", "has_sst", "sst_gradient", "depth_m", "has_bathymetry",
        "distance_to_nearest_poi_km", "nearest_poi_type", "uo", "current_speed", "has_physics",
        "surface_pressure_hpa_mean", "has_weather", "day_of_year_sin", "feature_set_name",
    )


def simple_grid(spark: SparkSession, sf: str) -> DataFrame:
    static = view(spark, sf, "fx_static").select("iy", "ix", "depth_m", "ocean_mask")
    return field(spark, sf).join(static, ["iy", "ix"], "left")


MATCH = CLEAN + f"""
, grid AS (SELECT f.*, s.ocean_mask, s.depth_m FROM fx_field f LEFT JOIN fx_static s USING (iy, ix)),
matched AS (SELECT c.seq, c.species_id, c.source, c.d AS date, c.lat AS o_lat, c.lon AS o_lon, g.lat AS grid_lat, g.lon AS grid_lon, g.sst_c,
  CASE WHEN NOT (c.lat BETWEEN -39 AND -27 AND c.lon BETWEEN 148.5e0 AND 158.5e0) THEN 'outside_bbox' WHEN days.day_date IS NULL THEN 'no_grid_for_date' WHEN g.day_date IS NULL THEN 'no_such_cell'
    WHEN g.sst_c IS NULL THEN 'missing_sst' WHEN NOT g.ocean_mask THEN 'land_cell' END AS drop_reason,
  round({haversine_sql('c.lat', 'c.lon', 'g.lat', 'g.lon')}, 4) AS match_distance_km
  FROM clean c LEFT JOIN (SELECT DISTINCT day_date FROM grid) days ON days.day_date = c.d
  LEFT JOIN grid g ON g.day_date = c.d AND round_even(g.lat / 0.25e0, 0) = round_even(c.lat / 0.25e0, 0) AND round_even(g.lon / 0.25e0, 0) = round_even(c.lon / 0.25e0, 0))
"""


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return al.match_presence(clean(spark, sf), simple_grid(spark, sf), STEP)


@query("j2_presence_match", "fx_occurrence fx_field fx_static", MATCH + """
SELECT seq, species_id, date, drop_reason, match_distance_km, match_distance_km > 10 AS high_match_distance, printf('%.4f_%.4f', grid_lat, grid_lon) AS grid_id FROM matched""")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    m = matched(spark, sf)
    grid_id = F.when(F.col("grid_lat").isNotNull(), F.col("grid_id"))
    return m.select("seq", "species_id", "date", "drop_reason", "match_distance_km", "high_match_distance", grid_id.alias("grid_id"))


SOURCES = "src AS (SELECT DISTINCT day_date AS s FROM fx_training WHERE label = 1 AND source_quality = 'low'), tgt AS (SELECT DISTINCT day_date AS date FROM fx_training)"


def asof_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = training(spark, sf)
    return (
        t.select("date"),
        t.where("label = 1 and source_quality = 'low'").select("date", "species_id", "sst_c"),
    )


@query("j4_as_of_bounded", "fx_training", SOURCES + """
, pick AS (SELECT date, max(s) AS source_date FROM tgt JOIN src ON s <= date AND s >= date - 30 GROUP BY 1)
SELECT p.date, p.source_date, CAST(p.date - p.source_date AS BIGINT) AS offset_days, t.species_id, t.sst_c FROM pick p JOIN fx_training t ON t.day_date = p.source_date AND t.label = 1 AND t.source_quality = 'low'""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    targets, sources = asof_inputs(spark, sf)
    return al.as_of_field(targets, sources, max_age_days=30)


@query("j5_as_of_unbounded", "fx_training", SOURCES + """
SELECT tgt.date, max(s) AS source_date, CAST(date - max(s) AS BIGINT) AS offset_days FROM tgt LEFT JOIN src ON s <= date GROUP BY 1""")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return al.as_of_dates(*asof_inputs(spark, sf))


@query("j5_as_of_year_reach", "fx_training", SOURCES + """
SELECT tgt.date, max(s) AS source_date, CAST(date - max(s) AS BIGINT) AS offset_days FROM tgt LEFT JOIN src ON s <= date AND s >= make_date(CAST(year(date) AS BIGINT) - 1, 1, 1) GROUP BY 1""")
def j5b(spark: SparkSession, sf: str) -> DataFrame:
    return al.as_of_dates(*asof_inputs(spark, sf), earliest=al.last_year_start())


@query("j5_as_of_chain", "fx_training", SOURCES + """
, s AS (SELECT tgt.date, max(s) FILTER (s >= date - 7) AS near, max(s) AS latest FROM tgt LEFT JOIN src ON s <= date GROUP BY 1)
SELECT date, coalesce(near, latest) AS source_date, CAST(date - coalesce(near, latest) AS BIGINT) AS offset_days, CASE WHEN near IS NOT NULL THEN 'within_7_days' WHEN latest IS NOT NULL THEN 'latest_before' END AS method FROM s""")
def j5c(spark: SparkSession, sf: str) -> DataFrame:
    """The field of at most a week ago, else the latest one before the day."""
    return al.as_of_chain(*asof_inputs(spark, sf), {"within_7_days": {"max_age_days": 7}, "latest_before": {}})


@query("j6_nearest_date", "fx_training", SOURCES + """
SELECT date, CASE WHEN abs(date - s) <= 3 THEN s END AS source_date, CAST(CASE WHEN abs(date - s) <= 3 THEN date - s END AS BIGINT) AS offset_days
FROM tgt, src QUALIFY row_number() OVER (PARTITION BY date ORDER BY abs(date - s), s) = 1""")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return al.as_of_dates(*asof_inputs(spark, sf), max_age_days=3, direction="nearest")


@query("j7_without_presence", "fx_training", """
SELECT row_id FROM fx_training b WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM fx_training p WHERE p.label = 1 AND p.day_date = b.day_date AND round(p.grid_lat, 4) = round(b.grid_lat, 4) AND round(p.grid_lon, 4) = round(b.grid_lon, 4))""")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    t = training(spark, sf)
    return al.without_presence_cells(t.where("label = 0"), t.where("label = 1"), ["date", "grid_id"]).select("row_id")


@query("j8_spatial_buffer", "fx_training", """
cells AS (SELECT *, CAST(round_even(grid_lat / 0.5e0, 0) AS BIGINT) AS cy, CAST(round_even(grid_lon / 0.5e0, 0) AS BIGINT) AS cx FROM fx_training)
SELECT row_id FROM cells b WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM cells p WHERE p.label = 1 AND p.species_id = b.species_id AND p.day_date = b.day_date AND abs(p.cy - b.cy) <= 4 AND abs(p.cx - b.cx) <= 4)""")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    t = training(spark, sf)
    return al.buffered_background(t.where("label = 0"), t.where("label = 1"), step=0.5, reach=4).select("row_id")


@query("j10_nearest_cell", "fx_scored fx_static", """
SELECT c.cell_id, round(round_even(c.lat / 0.25e0, 0) * 0.25e0, 4) AS source_lat, round(round_even(c.lon / 0.25e0, 0) * 0.25e0, 4) AS source_lon, s.depth_m AS depth_m, s.ocean_mask
FROM fx_scored c LEFT JOIN fx_static s ON round_even(s.lat / 0.25e0, 0) = round_even(c.lat / 0.25e0, 0) AND round_even(s.lon / 0.25e0, 0) = round_even(c.lon / 0.25e0, 0)""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    cells = view(spark, sf, "fx_scored").select("cell_id", "lat", "lon")
    return fl.nearest_cell_resample(cells, view(spark, sf, "fx_static"), STEP, ["depth_m", "ocean_mask"]).drop("lat", "lon")


@query("j11_bilinear", "fx_scored fx_static", """
p AS (SELECT cell_id, (lat + 39) / 0.25e0 AS fy, (lon - 148.5e0) / 0.25e0 AS fx, least(floor(fy), 47) AS y0, least(floor(fx), 39) AS x0, fy - y0 AS ty, fx - x0 AS tx FROM fx_scored)
SELECT cell_id, round((1 - ty) * (1 - tx) * a.depth_m + (1 - ty) * tx * b.depth_m + ty * (1 - tx) * c.depth_m + ty * tx * d.depth_m, 6) AS depth_m FROM p
LEFT JOIN fx_static a ON a.iy = y0 AND a.ix = x0 LEFT JOIN fx_static b ON b.iy = y0 AND b.ix = x0 + 1 LEFT JOIN fx_static c ON c.iy = y0 + 1 AND c.ix = x0 LEFT JOIN fx_static d ON d.iy = y0 + 1 AND d.ix = x0 + 1""")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    pts = view(spark, sf, "fx_scored").select(F.col("cell_id").alias("point_id"), "lat", "lon")
    static = view(spark, sf, "fx_static").select("iy", "ix", "depth_m")
    out = fl.bilinear(pts, static, ["depth_m"], STEP, -39.0, 148.5, 49, 41)
    return out.select(F.col("point_id").alias("cell_id"), F.round("depth_m", 6).alias("depth_m"))


ELEVATION = """
coarse AS (SELECT CAST(round_even(lat / 0.05e0, 0) AS BIGINT) AS iy, CAST(round_even(lon / 0.05e0, 0) AS BIGINT) AS ix, lat, lon, 40 - depth_m / 60 AS elevation FROM fx_scored WHERE depth_m IS NOT NULL),
nearest AS (SELECT iy, ix, elevation FROM coarse QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY round(abs(lat - iy * 0.05e0), 9), round(abs(lon - ix * 0.05e0), 9), lat, lon, elevation) = 1),
lattice AS (SELECT *, 0 AS d FROM nearest)
"""


def elevation(spark: SparkSession, sf: str) -> DataFrame:
    fine = view(spark, sf, "fx_scored").where("depth_m is not null").select("lat", "lon", (40 - F.col("depth_m") / 60).alias("elevation"))
    return fl.downsample_elevation(fine, 0.05)


@query("j12_downsample_elevation", "fx_scored", ELEVATION + "SELECT iy, ix, round(iy * 0.05e0, 4) AS lat, round(ix * 0.05e0, 4) AS lon, round(elevation, 6) AS elevation FROM nearest")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(elevation(spark, sf), "elevation")


@query("f16_bathymetry", "fx_scored", ELEVATION + "," + gradient_sql("lattice", "d", "iy", "ix", "elevation", "slope") + """
SELECT l.iy, l.ix, round(greatest(0e0, -l.elevation), 6) AS depth_m, l.elevation < 0 AS ocean_mask, round(s.g, 6) AS slope FROM lattice l JOIN slope s USING (iy, ix)""")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    made = fl.bathymetry_features(elevation(spark, sf))
    return rounded(made, "depth_m", "slope").select("iy", "ix", "depth_m", "ocean_mask", "slope")


@query("s6_surface_field", "fx_physics fx_occurrence", CLEAN + """
SELECT day_date AS date, lat, lon, uo, vo FROM fx_physics WHERE level_idx = 0 AND day_date IN (SELECT d FROM clean)""")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.surface_on_dates(samples(spark, sf), clean(spark, sf)).select("date", "lat", "lon", "uo", "vo")


@query("s7_header_prefixes", "fx_scored", """
SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN species_id = 'A' THEN round(sst_c + 273.15e0 - 273.15e0, 6) ELSE round(sst_c, 6) END AS sst_c FROM fx_scored WHERE ocean_mask""")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns with units in their headers, one species in Kelvin, blanks for land."""
    kelvin = F.when(F.col("species_id") == "A", F.col("sst_c") + 273.15).otherwise(F.col("sst_c"))
    raw = view(spark, sf, "fx_scored").select(
        F.when(F.col("ocean_mask"), F.col("lat").cast("string")).otherwise("").alias("latitude (degrees_north)"),
        F.col("lon").cast("string").alias("Longitude (degrees_east)"),
        F.coalesce(kelvin.cast("string"), F.lit("NaN")).alias("analysed_sst (degree_C)"),
    )
    found = tabular.resolve_grid_columns(raw, {"latitude": "lat", "longitude": "lon", "analysed_sst": "sst_c"})
    return rounded(found, "sst_c")
