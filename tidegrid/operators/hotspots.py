"""Spaced hotspot selection and the query surface over prediction tables.

Each pick excludes its surroundings, so picking is sequential inside one (date, species,
model) key and runs per key in pandas. What reaches that step is bounded: the best rows of
every (band, segment) list. A pick is accepted only when no row left out could have come
first; a key that runs past its lists is continued in another round on the rows that its
picks do not exclude. Rows that are never picked do not change a greedy choice, so the
rounds give exactly what one pass over all rows would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, SEGMENTS, coast_priority_band, coast_segment, haversine_km
from ..functions.suitability import profiles, rule_score, spot_drivers
from ..session import cut, small_side
from .audit import rating_distribution
from .nearest import nearest_point
from .ranking import top_n

BANDS = ("nearshore", "midshore", "offshore")
POOL = 999  # with the one extra row still inside Spark's map-side group limit of 1000
# fixed values: request bounds of the spot query (least, most)
RADIUS_M = (500, 2000)
LIMIT = (1, 50)
SEPARATION_KM = (0.5, 20.0)


def band_quotas(limit: int) -> dict[str, int]:
    near, mid = max(5, limit // 2), max(3, limit // 3)
    return {"nearshore": near, "midshore": mid, "offshore": max(1, limit - near - mid)}


@dataclass
class Greedy:
    """State of one key: candidates in order, what is excluded, and what has been picked."""

    pool: pd.DataFrame
    limit: int
    separation_km: float

    def __post_init__(self) -> None:
        p = self.pool
        self.score, self.ids = p["score"].to_numpy(), p["row_id"].to_numpy()
        self.band, self.segment = p["band"].to_numpy(), p["segment"].to_numpy()
        self.lat, self.lon = np.radians(p["lat"].to_numpy()), np.radians(p["lon"].to_numpy())
        self.free = np.ones(len(p), dtype=bool)
        self.picked: list[int] = []
        self.certain = True
        # per list the place of its last row when rows behind it were left out
        cut_rows = p.index[p["is_last_kept"]]
        self.ends = {(self.band[i], self.segment[i]): i for i in cut_rows}

    def count(self, band: str | None = None, segment: int | None = None) -> int:
        return sum(
            (band is None or self.band[i] == band) and (segment is None or self.segment[i] == segment)
            for i in self.picked
        )

    def take(self, band: str | None, segment: int | None, floor: float) -> bool:
        """Pick the best free candidate; False when there is none or it is not certain."""
        if len(self.picked) >= self.limit:
            return False
        fits = self.free & (self.score >= floor)
        if band is not None:
            fits &= self.band == band
        if segment is not None:
            fits &= self.segment == segment
        place = int(np.argmax(fits)) if fits.any() else len(fits)
        ends = [
            at for (b, s), at in self.ends.items()
            if (band is None or b == band) and (segment is None or s == segment)
            and self.score[at] >= floor
        ]
        if any(at < place for at in ends):
            self.certain = False
            return False
        if place == len(fits):
            return False
        half_lat = np.sin((self.lat - self.lat[place]) / 2)
        half_lon = np.sin((self.lon - self.lon[place]) / 2)
        h = half_lat**2 + np.cos(self.lat) * np.cos(self.lat[place]) * half_lon**2
        km = 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        self.free &= ~(km < self.separation_km)
        self.free[place] = False
        self.picked.append(place)
        return True

    def run(self) -> None:
        quotas = band_quotas(self.limit)
        for floor in (95, 85, 75):  # spread along the coast first
            for band in BANDS[:2]:
                for segment in range(SEGMENTS):
                    if self.count(band) >= quotas[band]:
                        break
                    if self.count(band, segment) == 0:
                        self.take(band, segment, floor)
                    if not self.certain:
                        return
        for floor in (85, 60):
            for band in BANDS:
                while self.count(band) < quotas[band] and self.take(band, None, floor):
                    pass
                if not self.certain:
                    return
        while self.take(None, None, -np.inf):
            pass


def _pick_key(keys: list[str], limit: int, separation_km: float):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf.sort_values(["score", "row_id"], ascending=[False, True], ignore_index=True)
        greedy = Greedy(pool, limit, separation_km)
        greedy.run()
        out = pool.loc[greedy.picked, [*keys, "row_id", "lat", "lon", "score", "band", "segment"]]
        out["pick_order"] = np.arange(len(out), dtype="int64")
        if not len(out):  # keep the key visible
            out = pool.loc[:0, out.columns.drop("pick_order")].assign(pick_order=np.int64(-1))
        return out.assign(certain=greedy.certain)

    return pick


def spaced_spots(
    cells: DataFrame, keys: list[str], row_id: str, limit: int = 30, separation_km: float = 4.0,
    radius_m: int = 500, pool_size: int = POOL,
) -> DataFrame:
    """Ranked, well-spaced spots per key: row_id, position, score, band, segment, spot_rank.

    ``cells`` needs lat, lon, score and distance_to_coast_km, and a unique numeric ``row_id``.
    """
    for value, (least, most), name in (
        (limit, LIMIT, "limit"), (separation_km, SEPARATION_KM, "separation_km"), (radius_m, RADIUS_M, "radius_m"),
    ):
        if not least <= value <= most:
            raise ValueError(f"{name} must lie between {least} and {most}")
    ready = cells.select(
        *keys, F.col(row_id).cast("long").alias("row_id"), "lat", "lon", "score",
        coast_priority_band("distance_to_coast_km").alias("band"),
        coast_segment("lat").alias("segment"),
    ).where(F.col("score").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    types = {f.name: f.dataType.simpleString() for f in ready.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "row_id", "lat", "lon", "score", "band", "segment"])
    schema += ", pick_order bigint, certain boolean"
    lists = [*keys, "band", "segment"]
    finished: DataFrame | None = None
    state: DataFrame | None = None
    rest = ready
    while True:
        # one row more than the pool tells that the list goes on; it is then the last known row
        pool = top_n(rest, lists, [F.desc("score"), F.col("row_id")], pool_size + 1, rank="_place")
        pool = pool.withColumn("is_last_kept", F.col("_place") == pool_size + 1).drop("_place")
        if state is not None:
            known = state.where(F.col("pick_order") >= 0).select(*ready.columns)
            pool = pool.unionByName(known.withColumn("is_last_kept", F.lit(False)))
        state = cut(pool.groupBy(*keys).applyInPandas(_pick_key(keys, limit, separation_km), schema))
        done = state.where("certain and pick_order >= 0")
        finished = done if finished is None else finished.unionByName(done)
        state = state.where("not certain")
        if state.isEmpty():
            break
        # at most ``limit`` picks per unfinished key travel with the rows they may exclude
        near = state.groupBy(*keys).agg(
            F.collect_list(F.when(F.col("pick_order") >= 0, F.struct("lat", "lon"))).alias("_picks")
        )
        excluded = F.exists("_picks", lambda p: haversine_km(p["lat"], p["lon"], F.col("lat"), F.col("lon")) < separation_km)
        rest = ready.join(near, keys).where(~excluded).drop("_picks")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "pick_order")
    return finished.withColumns({
        "spot_rank": F.row_number().over(order).cast("long"),
        "recommendation_radius_m": F.lit(radius_m).cast("long"),
    }).drop("certain", "pick_order").withColumnsRenamed(
        {"row_id": row_id, "band": "coast_priority_band", "segment": "coast_segment"}
    )


def described_spots(spots: DataFrame, cells: DataFrame, points: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Spots with their cell attributes, drivers and nearest point of interest."""
    attributes = [c for c in ("sst_c", "sst_front_strength", "current_speed", "depth_m", "distance_to_coast_km")]
    full = spots.join(cells.select(*keys, row_id, *attributes), [*keys, row_id])
    full = full.withColumn("top_drivers", spot_drivers())
    near = nearest_point(full, points, ["name", "poi_type"], prefix="poi_")
    context = F.format_string(
        "Nearest known/demo offshore feature: %s (%s), about %.2f km away.",
        "poi_name", "poi_poi_type", F.round("poi_km", 2),
    )
    return near.withColumn(
        "poi_context",
        F.when(F.col("poi_km").isNotNull(), context).otherwise("No nearby POI context available."),
    )


def pick_date(predictions: DataFrame, species_id: str, date: str | None, model_source: str) -> str | None:
    """The wanted day where it exists, else the latest one (one value reaches the driver)."""
    mine = predictions.where((F.col("species_id") == species_id) & (F.col("model_source") == model_source))
    want = F.to_date(F.lit(date))
    row = mine.agg(
        F.coalesce(F.max(F.when(F.col("date") == want, F.col("date"))), F.max("date")).alias("d")
    ).first()
    return None if row["d"] is None else row["d"].isoformat()


def prediction_rows(predictions: DataFrame, species_id: str, date: str | None = None, model_source: str = "scikit_learn") -> DataFrame:
    """Rows of one species, day and model source; partition columns prune the scan."""
    day = pick_date(predictions, species_id, date, model_source)
    return predictions.where(
        (F.col("species_id") == species_id)
        & (F.col("model_source") == model_source)
        & (F.col("date") == F.to_date(F.lit(day)))
    )


def prediction_metadata(rows: DataFrame) -> DataFrame:
    keys = ["species_id", "model_source", "date"]
    ratings = rating_distribution(rows, keys).groupBy(*keys).agg(
        F.sum("count").alias("feature_count"),
        F.array_sort(F.collect_list(F.struct("rating", "count", "percent"))).alias("rating_distribution"),
    )
    deep = F.col("model_source") == "deep_learning"
    return ratings.withColumn("model_confidence", F.when(deep, "Experimental").otherwise("Low"))


# fixed values: what is said of the scores of the two model sources
DEEP_SOURCE, DEEP_FEATURES = "deep_learning", "deep_mlp_tabular_oceanographic"
DEEP_EXPLANATION = "Deep learning MLP relative habitat suitability score; experimental sidecar model, not true catch probability."


def serving_contract(predictions: DataFrame, manifest: DataFrame, today: str) -> DataFrame:
    """Metadata of every day that may be served: mode, dates, confidence, audit status, warning and
    rating distribution, one row per species, model source and day.

    ``manifest`` has a row per species: available, model_confidence, feature_set_name,
    score_explanation, audit_status, warning, notes. Species that it does not list, or lists as not
    available, have no rows.
    """
    mode = F.when(F.col("date") >= F.to_date(F.lit(today)), "current").otherwise("demo")
    deep = F.col("model_source") == DEEP_SOURCE
    days = prediction_metadata(predictions).withColumn("mode", mode).drop("model_confidence")
    # a species has as many days as the calendar
    listed = days.groupBy("species_id", "model_source", "mode").agg(F.array_sort(F.collect_set("date")).alias("available_dates"))
    entry = small_side(manifest.where("available").select(
        "species_id", F.col("model_confidence").alias("_confidence"), F.col("feature_set_name").alias("_features"),
        F.col("score_explanation").alias("_explanation"), "audit_status", "warning", "notes"))
    return days.join(listed, ["species_id", "model_source", "mode"]).join(entry, "species_id").select(
        "mode", "species_id", "model_source", F.col("date").alias("prediction_date"), F.col("date").alias("target_date"), "available_dates",
        F.when(deep, "Experimental").otherwise(F.col("_confidence")).alias("model_confidence"),
        F.when(deep, DEEP_FEATURES).otherwise(F.col("_features")).alias("feature_set_name"),
        F.when(deep, DEEP_EXPLANATION).otherwise(F.col("_explanation")).alias("score_explanation"),
        "audit_status", "warning", "notes", "rating_distribution", "feature_count")


def latest_predictions(predictions: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of each species' latest day, or of the given day."""
    if date is not None:
        return predictions.where(F.col("date") == F.to_date(F.lit(date)))
    latest = predictions.groupBy("species_id").agg(F.max("date").alias("date"))
    return predictions.join(small_side(latest), ["species_id", "date"], "left_semi")


def availability_by_mode(predictions: DataFrame, today: str) -> DataFrame:
    """Latest day per species for past (demo) and current dates."""
    mode = F.when(F.col("date") >= F.to_date(F.lit(today)), "current").otherwise("demo")
    return predictions.groupBy(mode.alias("mode"), "species_id").agg(
        F.max("date").alias("prediction_date"), F.count_distinct("date").alias("date_count")
    )


def rule_context(points: DataFrame, month: int | Column | None = None) -> DataFrame:
    """Scoring context of points; expects sst_c and gradient_strength to be joined already.

    ``month`` is a number, a column of the points, or today's.
    """
    lon, lat = F.col("lon"), F.col("lat")
    return points.withColumns({
        "current_speed_m_s": F.round(0.48 + F.greatest(F.lit(0.0), lon - 151.0) * 0.12, 2),
        "eddy_signal": (lon > 152.0) & (lat > -34.6) & (lat < -33.4),
        "data_confidence": F.lit("mock"),
        "month": F.month(F.current_date()) if month is None else month if isinstance(month, Column) else F.lit(month),
    })


def rule_hotspots(
    context: DataFrame, species_id: str | None = None, min_score: float | None = None, per_species: int | None = 5
) -> DataFrame:
    """Every point scored for every rule species; the best ``per_species`` unless one is asked
    (None keeps all).

    The seven species are a fixed table, so points are expanded to them by an exploded array.
    """
    species = profiles(context.sparkSession)
    if species_id is not None:
        species = species.where(F.col("species_id") == species_id)
    rows = [r.asDict() for r in species.collect()]  # at most seven, defined in config
    options = F.array(*[
        F.struct(
            F.lit(r["species_id"]).alias("species_id"), F.lit(r["common_name"]).alias("common_name"),
            *[F.array(*[F.lit(v) for v in r[c]]).alias(c)
              for c in ("preferred", "extended", "depth_preference", "structure_preference")],
            *[F.create_map(*[F.lit(x) for kv in r[c].items() for x in kv]).alias(c)
              for c in ("seasonality", "weights")],
        )
        for r in rows
    ])
    paired = context.withColumn("_s", F.explode(options)).select(*context.columns, "_s.*")
    scored = rule_score(paired).withColumn("demo_only", F.lit(True))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    scored = scored.drop("seasonality", "weights")
    if species_id is not None or per_species is None:
        return scored
    return top_n(scored, ["species_id"], [F.desc("score"), F.col("poi_id")], per_species)
