"""Daily gridded fields: regridding, gradients, changes, resampling and daily weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CELL_DEG
from ..functions.geo import cell_index, current_direction, current_speed, snap
from ..functions.numbers import col


def circular_mean(degrees) -> Column:
    """Mean direction in 0..360 as an aggregate; NULL directions are skipped."""
    r = F.radians(col(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))) + 360.0, F.lit(360.0))


def regrid_physics(samples: DataFrame, step: float = CELL_DEG, circular: bool = False) -> DataFrame:
    """Mean u, v, height, speed and direction per (date, cell)."""
    speed, toward = current_speed("uo", "vo"), current_direction("uo", "vo")
    direction = circular_mean(toward) if circular else F.avg(toward)
    return samples.groupBy(
        "date", cell_index("lat", step).alias("iy"), cell_index("lon", step).alias("ix")
    ).agg(
        F.avg("uo").alias("uo"),
        F.avg("vo").alias("vo"),
        F.avg("zos").alias("zos"),
        F.avg(speed).alias("current_speed"),
        direction.alias("current_direction_degrees"),
    ).withColumns({
        "lat": F.round(F.col("iy") * F.lit(step), 4),
        "lon": F.round(F.col("ix") * F.lit(step), 4),
    })


def _axis_rank(field: DataFrame, day: str, axis: str, out: str) -> DataFrame:
    """Position of each coordinate among those present that day (bounded by the lattice)."""
    present = field.select(day, axis).distinct()
    return present.withColumns({
        out: F.row_number().over(Window.partitionBy(day).orderBy(axis)),
        f"{out}_last": F.count(F.lit(1)).over(Window.partitionBy(day)),
    })


def _slope(value: str, line: list[str], rank: str) -> Column:
    """Unit-spaced difference along one axis: central inside, one-sided at the ends."""
    w = Window.partitionBy(*line).orderBy(rank)

    def near(step: int) -> Column:
        at, found = F.lead(rank, step), F.lead(value, step)
        return F.when(at.over(w) == F.col(rank) + step, found.over(w))

    r, last = F.col(rank), F.col(f"{rank}_last")
    return (
        F.when(r == 1, near(1) - F.col(value))
        .when(r == last, F.col(value) - near(-1))
        .otherwise((near(1) - near(-1)) / 2)
    )


def grid_gradient(
    field: DataFrame, value: str, out: str, day: str = "date", iy: str = "iy", ix: str = "ix"
) -> DataFrame:
    """Gradient magnitude on the day's lattice of distinct rows x distinct columns.

    A neighbour is the next coordinate present that day; where it has no row or no value the
    result is NULL. Windows hold one lattice line each.
    """
    # joined last on (day, iy), so the row windows need no shuffle of their own
    ranked = field.join(_axis_rank(field, day, ix, "_rx"), [day, ix]).join(
        _axis_rank(field, day, iy, "_ry"), [day, iy]
    )
    sloped = ranked.withColumn("_gx", _slope(value, [day, iy], "_rx"))
    sloped = sloped.withColumn("_gy", _slope(value, [day, ix], "_ry"))
    size = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    enough = (F.col("_rx_last") >= 2) & (F.col("_ry_last") >= 2)
    return sloped.withColumn(out, F.when(enough, size)).select(*field.columns, out)


def forward_gradient(
    field: DataFrame, value: str, out: str, day: str = "date", iy: str = "iy", ix: str = "ix"
) -> DataFrame:
    """hypot of differences to the next cell east and north; a missing neighbour counts 0.

    Windows hold one lattice line each, so a cell reaches its neighbour without a self-join.
    """
    def step(line: str, axis: str) -> Column:
        w = Window.partitionBy(day, line).orderBy(axis)
        beside = F.lead(axis).over(w) == F.col(axis) + 1
        return F.when(beside, F.abs(F.lead(value).over(w) - F.col(value)))

    dx, dy = step(iy, ix), step(ix, iy)
    flat = F.coalesce(F.col("_dx"), F.lit(0.0)), F.coalesce(F.col("_dy"), F.lit(0.0))
    size = F.sqrt(flat[0] * flat[0] + flat[1] * flat[1])
    with_steps = field.withColumn("_dx", dx).withColumn("_dy", dy)
    return with_steps.withColumn(out, F.when(F.col(value).isNotNull(), F.round(size, 5))).select(
        *field.columns, out
    )


def front_strength(gradient="sst_gradient") -> Column:
    """max(gradient, 0): equal to the gradient itself, kept as a column of record."""
    g = col(gradient)
    return F.when(g.isNotNull(), F.greatest(g, F.lit(0.0)))


def eddy_score(edge="current_edge_score", height="sla_gradient") -> Column:
    return F.coalesce(col(edge), F.lit(0.0)) + F.coalesce(col(height), F.lit(0.0))


def physics_features(samples: DataFrame, step: float = CELL_DEG) -> DataFrame:
    """Regridded physics with speed and height gradients and the eddy score."""
    grid = regrid_physics(samples, step)
    grid = grid_gradient(grid, "current_speed", "current_edge_score")
    grid = grid_gradient(grid, "zos", "sla_gradient")
    return grid.withColumns({
        "eddy_score": eddy_score(),
        "physics_missing_flag": F.lit(False),
        "physics_source_date": F.col("date"),
        "physics_date_offset_days": F.lit(0).cast("long"),
        "has_physics": F.lit(True),
    })


def past_changes(
    field: DataFrame, value: str, lags: tuple[int, ...] = (3, 7), day: str = "date",
    cell: tuple[str, ...] = ("iy", "ix"),
) -> DataFrame:
    """value - value exactly ``lag`` days before, same cell; NULL without that day.

    One shuffle by cell serves all lags: each is a one-day range frame, not a self-join.
    """
    days = F.unix_date(F.col(day))
    base = Window.partitionBy(*cell).orderBy(days)
    return field.withColumns({
        f"sst_{lag}d_change": F.col(value) - F.first(value).over(base.rangeBetween(-lag, -lag))
        for lag in lags
    })


def day_summary(field: DataFrame, value: str, day: str = "date") -> DataFrame:
    return field.groupBy(day).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1)) * 100).alias("missing_pct"),
    )


def nearest_cell_resample(targets: DataFrame, source: DataFrame, step: float, keep: list[str]) -> DataFrame:
    """Target points take the source row of the cell they snap to (source deduped on cell)."""
    cells = source.groupBy(
        cell_index("lat", step).alias("_iy"), cell_index("lon", step).alias("_ix")
    ).agg(F.min_by(F.struct(*keep), F.struct("lat", "lon")).alias("_row"))
    snapped = targets.withColumns({
        "_iy": cell_index("lat", step),
        "_ix": cell_index("lon", step),
        "source_lat": snap("lat", step),
        "source_lon": snap("lon", step),
    })
    joined = snapped.join(cells, ["_iy", "_ix"], "left")
    return joined.select(*targets.columns, "source_lat", "source_lon", *[f"_row.{c}" for c in keep])


def bilinear(
    points: DataFrame, field: DataFrame, values: list[str], step: float,
    lat0: float, lon0: float, n_lat: int, n_lon: int, on: list[str] | None = None,
) -> DataFrame:
    """Bilinear interpolation of ``values`` at points; NULL outside or when a corner is NULL.

    Each point explodes to its four corners and meets the field in one equi-join on integer
    indices. ``points`` must hold a unique ``point_id``.
    """
    on = on or []
    fy = (F.col("lat") - F.lit(lat0)) / F.lit(step)
    fx = (F.col("lon") - F.lit(lon0)) / F.lit(step)
    inside = fy.between(0, n_lat - 1) & fx.between(0, n_lon - 1)
    y0 = F.least(F.floor(fy), F.lit(n_lat - 2))
    x0 = F.least(F.floor(fx), F.lit(n_lon - 2))
    ty, tx = fy - y0, fx - x0
    corners = F.array(*[
        F.struct(
            (y0 + dy).cast("long").alias("iy"),
            (x0 + dx).cast("long").alias("ix"),
            ((ty if dy else 1 - ty) * (tx if dx else 1 - tx)).alias("w"),
        )
        for dy in (0, 1) for dx in (0, 1)
    ])
    spread = points.where(inside).select("point_id", *on, F.explode(corners).alias("c"))
    spread = spread.select("point_id", *on, "c.iy", "c.ix", "c.w")
    met = spread.join(field.select(*on, "iy", "ix", *values), [*on, "iy", "ix"])
    blended = met.groupBy("point_id").agg(*[
        F.when(F.count(v) == 4, F.sum(F.col("w") * F.col(v))).alias(v) for v in values
    ])
    return points.join(blended, "point_id", "left")


def downsample_elevation(fine: DataFrame, step: float = CELL_DEG) -> DataFrame:
    """Elevation of the fine sample nearest to each coarse cell centre."""
    iy, ix = cell_index("lat", step), cell_index("lon", step)
    off_lat, off_lon = F.abs(F.col("lat") - iy * step), F.abs(F.col("lon") - ix * step)
    # at equal distance the southern, then the western sample is taken
    order = F.struct(F.round(off_lat, 9), F.round(off_lon, 9), F.col("lat"), F.col("lon"), F.col("elevation"))
    return fine.groupBy(iy.alias("iy"), ix.alias("ix")).agg(
        F.min_by("elevation", order).alias("elevation")
    ).withColumns({
        "lat": F.round(F.col("iy") * F.lit(step), 4),
        "lon": F.round(F.col("ix") * F.lit(step), 4),
    })


def bathymetry_features(elevation: DataFrame) -> DataFrame:
    """Depth, slope and ocean flag from an elevation lattice."""
    one_day = elevation.withColumn("_day", F.lit(0))
    sloped = grid_gradient(one_day, "elevation", "slope", day="_day").drop("_day")
    return sloped.withColumns({
        "depth_m": F.when(
            F.col("elevation").isNotNull(), F.greatest(-F.col("elevation"), F.lit(0.0))
        ),
        "ocean_mask": F.col("elevation") < 0,
        **contour_proxies(),
    })


def contour_proxies(depth: str = "depth_m") -> dict[str, Column]:
    """Stand-in distances abs(depth - contour) / 25 for three contours."""
    return {
        f"distance_to_{c}m_contour": F.abs(F.col(depth) - float(c)) / 25.0 for c in (200, 500, 1000)
    }


def daily_weather(hourly: DataFrame) -> DataFrame:
    """Hourly rows to one row per (date, weather cell)."""
    return hourly.groupBy("date", "weather_lat", "weather_lon").agg(
        F.avg("surface_pressure").alias("surface_pressure_hpa_mean"),
        F.min("surface_pressure").alias("surface_pressure_hpa_min"),
        F.max("surface_pressure").alias("surface_pressure_hpa_max"),
        F.avg("pressure_msl").alias("pressure_msl_hpa_mean"),
        F.avg("wind_speed").alias("wind_speed_10m_kmh_mean"),
        F.max("wind_speed").alias("wind_speed_10m_kmh_max"),
        F.sum("precipitation").alias("precipitation_mm_sum"),
        circular_mean("wind_direction").alias("wind_direction_10m_deg_circular_mean"),
    )


def cell_date_plan(points: DataFrame, step: float) -> DataFrame:
    """Per weather cell: its distinct days in order, with first and last."""
    cells = points.select(
        snap("lat", step).alias("weather_lat"), snap("lon", step).alias("weather_lon"), "date"
    ).where(F.col("date").isNotNull())
    return cells.groupBy("weather_lat", "weather_lon").agg(
        F.array_sort(F.collect_set("date")).alias("dates"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def year_batches(dates: DataFrame) -> DataFrame:
    return dates.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("date").alias("date_count"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("span_days"),
    )
