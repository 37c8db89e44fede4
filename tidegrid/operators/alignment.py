"""Joins that line up points, fields, static cells, weather and calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FAD_TYPE, LANDMARK, MATCH_DISTANCE_LIMIT_KM, TRAIN_BOX, WEATHER_CELL_DEG, Box
from ..functions.dates import lunar_features, season_features
from ..functions.geo import cell_index, cell_name, haversine_km, in_box
from ..functions.numbers import truthy
from ..session import calendar
from .nearest import nearest_by_place

PHYSICS_COLUMNS = (
    "uo", "vo", "current_speed", "current_direction_degrees", "current_edge_score", "zos",
    "sla_gradient", "eddy_score",
)
WEATHER_COLUMNS = (
    "surface_pressure_hpa_mean", "surface_pressure_hpa_min", "surface_pressure_hpa_max",
    "pressure_msl_hpa_mean", "wind_speed_10m_kmh_mean", "wind_speed_10m_kmh_max",
    "precipitation_mm_sum", "wind_direction_10m_deg_circular_mean",
)


def structure_distances(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point with its type, nearest aggregation device, and the landmark distance."""
    places = cells.select(F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon")).distinct()
    kinds = F.when(F.col("poi_type") == FAD_TYPE, F.array(F.lit("poi"), F.lit("fad"))).otherwise(F.array(F.lit("poi")))
    found = nearest_by_place(places, points.withColumn("_tag", F.explode(kinds)), ["poi_type"], tags=["poi", "fad"])
    of = lambda tag: F.max(F.when(F.col("_tag") == tag, F.col("_best")))
    best = found.groupBy("_qlat", "_qlon").agg(of("poi").alias("_poi"), of("fad").alias("_fad"))
    placed = cells.withColumns({"_qlat": F.col("lat"), "_qlon": F.col("lon")})
    near = placed.join(best, ["_qlat", "_qlon"], "left")
    return near.select(
        *cells.columns,
        F.col("_poi.km").alias("distance_to_nearest_poi_km"),
        F.col("_poi.props.poi_type").alias("nearest_poi_type"),
        F.col("_fad.km").alias("distance_to_nearest_fad_km"),
        haversine_km("lat", "lon", F.lit(LANDMARK[0]), F.lit(LANDMARK[1]))
        .alias("distance_to_browns_mountain_km"),
    )


def feature_set_name(bathymetry="has_bathymetry", structure="has_structure") -> Column:
    return (
        F.when(F.col(bathymetry) & F.col(structure), "sst_bathy_structure")
        .when(F.col(bathymetry), "sst_bathy_only")
        .otherwise("sst_only")
    )


def source_label(flags: dict[str, str]) -> Column:
    """Aggregate: names whose flag is true anywhere, comma separated."""
    return F.concat_ws(",", *[F.when(F.bool_or(truthy(c)), F.lit(n)) for n, c in flags.items()])


def known_land_removed(grid: DataFrame, mask: str = "ocean_mask") -> DataFrame:
    return grid.where(F.col(mask).isNull() | F.col(mask))


def daily_feature_grid(
    field: DataFrame, static: DataFrame, physics: DataFrame, weather: DataFrame
) -> DataFrame:
    """One wide row per (date, cell): temperature with all that is known about the cell.

    Every side joins on integer cell keys and dates and is unique there; missing sides give
    NULL and a flag. Calendar and lunar features are expressions of the date, not joins.
    """
    wx = weather.select(
        F.col("date"),
        cell_index("weather_lat", WEATHER_CELL_DEG).alias("_wy"),
        cell_index("weather_lon", WEATHER_CELL_DEG).alias("_wx"),
        *WEATHER_COLUMNS,
    )
    side = physics.select("date", "iy", "ix", *[c for c in PHYSICS_COLUMNS if c in physics.columns])
    absent = [c for c in PHYSICS_COLUMNS if c not in physics.columns]
    grid = (
        field.join(static.drop("lat", "lon"), ["iy", "ix"], "left")
        .join(side, ["date", "iy", "ix"], "left")
        .withColumns({
            "_wy": cell_index("lat", WEATHER_CELL_DEG), "_wx": cell_index("lon", WEATHER_CELL_DEG)
        })
        .join(wx, ["date", "_wy", "_wx"], "left")
        .drop("_wy", "_wx")
    )
    no_number = F.lit(None).cast("double")
    moon = lunar_features("date")
    grid = grid.withColumns({c: no_number for c in absent}).withColumns({
        "grid_id": cell_name("lat", "lon"),
        "has_sst": F.col("sst_c").isNotNull(),
        "sst_missing_flag": F.col("sst_c").isNull(),
        "has_bathymetry": F.col("depth_m").isNotNull(),
        "has_structure": F.col("distance_to_nearest_poi_km").isNotNull(),
        "has_physics": F.coalesce("uo", "vo", "current_speed").isNotNull(),
        "physics_missing_flag": F.coalesce("uo", "vo", "current_speed").isNull(),
        "has_weather": F.col("surface_pressure_hpa_mean").isNotNull(),
        "has_lunar": moon["moon_age_days"].isNotNull(),
        **season_features("date"),
        **moon,
        **{c: no_number for c in ("chl", "chl_log", "chl_gradient", "chl_edge_score")},
        "chl_missing_flag": F.lit(True),
        "has_chl": F.lit(False),
        **{c: no_number for c in ("o2", "dissolved_oxygen", "oxygen_saturation")},
        "oxygen_missing_flag": F.lit(True),
        "has_oxygen": F.lit(False),
    })
    return known_land_removed(grid.withColumn("feature_set_name", feature_set_name()))


def match_presence(
    points: DataFrame, grid: DataFrame, step: float, box: Box = TRAIN_BOX, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Snap points to cells and join the day's grid row; ``drop_reason`` tells what failed.

    Order of reasons: outside_bbox, no_grid_for_date, no_such_cell, missing_sst, land_cell.
    The grid is unique per (date, cell), so a hot cell grows no rows.
    """
    days = F.broadcast(calendar(grid).withColumn("_has_day", F.lit(True)))
    cells = grid.select(
        F.col("date"),
        cell_index("lat", step).alias("_iy"), cell_index("lon", step).alias("_ix"),
        F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"),
        F.lit(True).alias("_has_cell"),
        "sst_c", "ocean_mask", *keep,
    )
    snapped = points.withColumns({"_iy": cell_index("lat", step), "_ix": cell_index("lon", step)})
    joined = snapped.join(days, "date", "left").join(cells, ["date", "_iy", "_ix"], "left")
    reason = (
        F.when(~in_box("lat", "lon", box), "outside_bbox")
        .when(F.col("_has_day").isNull(), "no_grid_for_date")
        .when(F.col("_has_cell").isNull(), "no_such_cell")
        .when(F.col("sst_c").isNull(), "missing_sst")
        .when(~F.col("ocean_mask"), "land_cell")
    )
    km = F.round(haversine_km("lat", "lon", "grid_lat", "grid_lon"), 4)
    return joined.withColumns({
        "drop_reason": reason,
        "match_distance_km": km,
        "high_match_distance": km > MATCH_DISTANCE_LIMIT_KM,
        "grid_id": cell_name("grid_lat", "grid_lon"),
    }).drop("_iy", "_ix", "_has_day", "_has_cell")


def matched_only(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("drop_reason").isNull()).drop("drop_reason").withColumns({
        "label": F.lit(1).cast("long"), "sample_type": F.lit("presence"),
    })


def as_of_dates(
    targets: DataFrame, sources: DataFrame, max_age_days: int | None = None,
    earliest: Column | None = None, direction: str = "backward",
) -> DataFrame:
    """Per target date the chosen source date and its age (NULL when none qualifies).

    Works on distinct dates only, a table bounded by the calendar, so one ordered window
    replaces a range join. ``direction`` is backward or nearest (ties go to the past).
    """
    marks = targets.select("date").distinct().withColumn("_source", F.lit(None).cast("date"))
    marks = marks.unionByName(sources.select("date", F.col("date").alias("_source")).distinct())
    line = Window.orderBy("date")
    before = F.last("_source", True).over(line.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_source", True).over(line.rangeBetween(0, Window.unboundedFollowing))
    seen = marks.withColumns({"_before": before, "_after": after}).where(F.col("_source").isNull())
    age_before = F.datediff("date", "_before")
    age_after = F.datediff("_after", "date")
    chosen = F.col("_before")
    if direction == "nearest":
        chosen = F.when(
            F.col("_before").isNull() | (age_after < age_before), F.col("_after")
        ).otherwise(F.col("_before"))
    out = seen.select("date", chosen.alias("source_date"))
    limits = [F.lit(True)]
    if max_age_days is not None:
        limits.append(F.abs(F.datediff("date", "source_date")) <= max_age_days)
    if earliest is not None:
        limits.append(F.col("source_date") >= earliest)
    kept = F.when(reduce(lambda a, b: a & b, limits), F.col("source_date"))
    return out.select(
        "date", kept.alias("source_date"), F.datediff("date", kept).cast("long").alias("offset_days")
    )


def as_of_field(targets: DataFrame, field: DataFrame, **options) -> DataFrame:
    """The whole field of the chosen source day for each target day."""
    choice = as_of_dates(targets, field.select("date"), **options)
    chosen = choice.where(F.col("source_date").isNotNull())
    # one row per target day: bounded by the calendar
    return field.withColumnRenamed("date", "source_date").join(F.broadcast(chosen), "source_date")


def as_of_chain(targets: DataFrame, sources: DataFrame, steps: dict[str, dict]) -> DataFrame:
    """Per target date the source of the first step that finds one, with the step's name.

    ``steps`` maps a name to the options of ``as_of_dates``, in the order they are tried; a date
    that none serves keeps NULL.
    """
    found = None
    for name, options in steps.items():
        one = as_of_dates(targets, sources, **options).select(
            "date", F.when(F.col("source_date").isNotNull(), F.struct("source_date", "offset_days", F.lit(name).alias("method"))).alias(f"_{name}"))
        # one row a day: bounded by the calendar
        found = one if found is None else found.join(F.broadcast(one), "date")
    best = F.coalesce(*[F.col(f"_{name}") for name in steps])
    return found.select("date", best["source_date"].alias("source_date"), best["offset_days"].alias("offset_days"), best["method"].alias("method"))


def last_year_start(day: str = "date") -> Column:
    """First day of the previous year: the reach of a year-by-year catalogue search."""
    return F.add_months(F.trunc(day, "year"), -12)


def without_presence_cells(candidates: DataFrame, presence: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose cell holds no presence under the same keys."""
    return candidates.join(presence.select(*keys).distinct(), keys, "left_anti")


def buffered_background(
    background: DataFrame, presence: DataFrame, step: float = 0.01, reach: int = 0,
    keys: tuple[str, ...] = ("species_id", "date"),
) -> DataFrame:
    """Drop background within ``reach`` cells of a same-day presence (0 = the same cell).

    The ring is exploded on the distinct presence cells, so the join stays an equi-join.
    """
    ring = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    cells = presence.select(
        *keys, cell_index("grid_lat", step).alias("_y"), cell_index("grid_lon", step).alias("_x")
    ).distinct()
    taken = cells.select("*", ring.alias("_dy")).select("*", ring.alias("_dx")).select(
        *keys, (F.col("_y") + F.col("_dy")).alias("_y"), (F.col("_x") + F.col("_dx")).alias("_x")
    ).distinct()
    placed = background.withColumns({
        "_y": cell_index("grid_lat", step), "_x": cell_index("grid_lon", step)
    })
    return placed.join(taken, [*keys, "_y", "_x"], "left_anti").drop("_y", "_x")
