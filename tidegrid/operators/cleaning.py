"""Occurrence cleaning: rejection waterfall, quality tiers, duplicates and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    FIRST_RUN_END,
    FIRST_RUN_START,
    LOW_CONFIDENCE_RECORDS,
    PREDICT_BOX,
    TRAIN_BOX,
    TRAINABLE_RECORDS,
    UNCERTAINTY_HIGH_QUALITY_M,
    UNCERTAINTY_LIMIT_M,
    Box,
)
from ..functions.dates import date_precision, lenient_date
from ..functions.geo import in_box
from ..session import calendar
from .ranking import first_rows, hash_key, row_ranks, top_n

REASONS = (
    "missing_coords", "invalid_coordinates", "missing_date", "before_start", "after_end",
    "outside_bbox", "high_uncertainty", "duplicates",
)
OCCURRENCE_KEY = ["species_id", "source", "date", "rounded_lat", "rounded_lon"]


def quality_tier(uncertainty) -> Column:
    u = F.col(uncertainty) if isinstance(uncertainty, str) else uncertainty
    return (
        F.when(u <= UNCERTAINTY_HIGH_QUALITY_M, "high")
        .when(u.isNull() | (u <= UNCERTAINTY_LIMIT_M), "medium")
        .otherwise("low")
    )


def eligibility_tier(records) -> Column:
    n = F.col(records) if isinstance(records, str) else records
    return (
        F.when(n >= TRAINABLE_RECORDS, "trainable")
        .when(n >= LOW_CONFIDENCE_RECORDS, "trainable but low confidence")
        .otherwise("insufficient for ML, use rule-based for now")
    )


def parse_occurrences(raw: DataFrame) -> DataFrame:
    """Typed columns from text: lat_text, lon_text, event_date_text, uncertainty_m."""
    lat = F.col("lat_text").try_cast("double")
    lon = F.col("lon_text").try_cast("double")
    return raw.withColumns({
        "lat": lat,
        "lon": lon,
        "date": lenient_date("event_date_text"),
        "date_precision": date_precision("event_date_text"),
        "uncertainty": F.col("uncertainty_m").try_cast("double"),
    }).withColumns({
        "rounded_lat": F.round("lat", 4),
        "rounded_lon": F.round("lon", 4),
    })


def first_reason(start: str, end: str, box: Box) -> Column:
    """First failing check, NULL when a row passes all but the duplicate check."""
    lat, lon, day = F.col("lat"), F.col("lon"), F.col("date")
    bad_number = F.isnan(lat) | F.isnan(lon)  # NaN compares as largest, so test it first
    valid = lat.between(-90, 90) & lon.between(-180, 180) & ~bad_number
    checks = (
        lat.isNull() | lon.isNull(),
        ~valid,
        day.isNull(),
        day < F.to_date(F.lit(start)),
        day > F.to_date(F.lit(end)),
        ~in_box("lat", "lon", box),
        F.coalesce(~F.isnan("uncertainty") & (F.col("uncertainty") > UNCERTAINTY_LIMIT_M), F.lit(False)),
    )
    return reduce(lambda chain, step: chain.when(step[0], step[1]), zip(checks, REASONS), F)


def with_reason(
    raw: DataFrame, start: str = FIRST_RUN_START, end: str = FIRST_RUN_END, box: Box = TRAIN_BOX
) -> DataFrame:
    return parse_occurrences(raw).withColumn("reason", first_reason(start, end, box))


def label_rejections(flagged: DataFrame) -> DataFrame:
    """Row-level reasons including duplicates (every row but the first of its key).

    A rejected row is a key of its own, so rejected rows spread out and are nobody's duplicate.
    One struct key keeps the reason expression from being repeated per key column.
    """
    own = F.when(F.col("reason").isNull(), F.lit(-1).cast("long")).otherwise(F.col("seq"))
    keyed = flagged.withColumn("_key", F.struct(*OCCURRENCE_KEY, own.alias("own")))
    first = keyed.groupBy("_key").agg(F.min("seq").alias("_first"))
    marked = keyed.join(first, keyed["_key"].eqNullSafe(first["_key"]))
    duplicate = F.when(F.col("seq") != F.col("_first"), "duplicates")
    return marked.withColumn("reason", F.coalesce("reason", duplicate)).select(*flagged.columns)


def accepted(flagged: DataFrame) -> DataFrame:
    """Clean rows: first per (species, source, date, rounded position).

    Rejected rows share one NULL key, which every task folds to a single row before the
    shuffle; filtering them first would parse every row twice.
    """
    key = F.when(F.col("reason").isNull(), F.struct(*OCCURRENCE_KEY))
    first = F.min_by(F.struct(*flagged.columns), "seq").alias("_row")
    kept = flagged.groupBy(key.alias("_key")).agg(first)
    kept = kept.where(F.col("_row.reason").isNull()).select("_row.*")
    return kept.withColumns({
        "year": F.year("date").cast("long"),
        "month": F.month("date").cast("long"),
        "day": F.day("date").cast("long"),
        "source_quality": quality_tier("uncertainty"),
        "in_prediction_bbox": in_box("lat", "lon", PREDICT_BOX),
    }).drop("reason")


def waterfall_counts(flagged: DataFrame) -> DataFrame:
    """Rows per species, source and first reason.

    Duplicates are the passing rows minus their distinct keys, so no row is joined back.
    """
    by_key = flagged.groupBy(
        "species_id", "source", "reason",
        *[F.when(F.col("reason").isNull(), F.col(k)).alias(k) for k in OCCURRENCE_KEY[2:]],
    ).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(0).cast("long")
    counts = [
        F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(one)).alias(f"removed_{r}")
        for r in REASONS[:-1]
    ]
    passed = F.col("reason").isNull()
    return by_key.groupBy("species_id", "source").agg(
        F.sum("n").alias("raw_count"),
        *counts,
        F.sum(F.when(passed, F.col("n") - 1).otherwise(one)).alias("removed_duplicates"),
        F.count_if(passed).alias("cleaned_count"),
    )


def merge_sources(clean: DataFrame) -> DataFrame:
    """One row per (species, date, position) over all sources: by source name, then order."""
    return first_rows(
        clean, ["species_id", "date", "rounded_lat", "rounded_lon"], ["source", "seq"]
    )


def merge_by_priority(sets: list[DataFrame]) -> DataFrame:
    """Best set first: an earlier set wins over a later one for the same position and day."""
    tagged = [frame.withColumn("priority", F.lit(i).cast("long")) for i, frame in enumerate(sets)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    kept = union.where(F.col("date").isNotNull())
    return first_rows(
        kept, ["species_id", "date", "rounded_lat", "rounded_lon"], ["priority", "source", "seq"]
    )


def species_summary(clean: DataFrame) -> DataFrame:
    out = clean.groupBy("species_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.count_distinct("date").alias("unique_dates"),
        F.count_if("in_prediction_bbox").alias("records_in_prediction_bbox"),
    )
    return out.withColumn("training_eligibility", eligibility_tier("records"))


def dates_per_year(clean: DataFrame) -> DataFrame:
    return clean.groupBy("species_id", "year").agg(F.count_distinct("date").alias("unique_dates"))


def distinct_dates(clean: DataFrame) -> DataFrame:
    return clean.select("date").distinct().orderBy("date")


def capped_by_arrival(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """All records with ``arrival``, their place among those of the species in arrival order; the
    first ``cap`` of them where a cap is given."""
    if cap is not None:
        return top_n(rows, ["species_id"], [F.col("seq")], cap, rank="arrival")
    # records without a species are a group of their own
    species = F.coalesce(F.concat(F.lit("="), F.col("species_id").cast("string")), F.lit(""))
    ranked = row_ranks(rows.withColumn("_species", species), ["_species"], "seq", "seq", rank="arrival")
    return ranked.select(*rows.columns, F.col("arrival").cast("long").alias("arrival"))


def training_dates(clean: DataFrame, per_month: int | None = None, seed: int = 42) -> DataFrame:
    """Species-dates for training: all of them, or a draw of ``per_month`` per species and month."""
    dates = clean.groupBy("species_id", "date", "year", "month").agg(F.lit(1).alias("_one")).drop("_one")
    if per_month is None:
        return dates
    draw = hash_key("species_id", "date", seed=seed)
    picked = top_n(
        dates.withColumn("_draw", draw), ["species_id", "year", "month"], [F.col("_draw")], per_month
    )
    return picked.drop("_draw", "rank")


def verified_fields(field: DataFrame, required: tuple[str, ...] = ("lat", "lon", "sst_c")) -> DataFrame:
    """Drop every day whose source text names synthetic, mock or proxy data."""
    missing = [c for c in required if c not in field.columns]
    if missing:
        raise ValueError(f"field lacks required columns {missing}")
    sources = [c for c in field.columns if "source" in c.lower()]
    if not sources:
        return field
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in sources]))
    banned = field.groupBy("date").agg(F.bool_or(text.rlike("synthetic|mock|proxy")).alias("_bad"))
    return field.join(calendar(banned.where("_bad")), "date", "left_anti")


def rows_on_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Keep rows whose day is wanted."""
    return rows.join(calendar(dates), "date", "left_semi")
