"""Date parsing and calendar, lunar and range features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REFERENCE_NEW_MOON, SYNODIC_MONTH_DAYS
from .numbers import col

TAU = 2 * math.pi
# fixed values: prefix length and shape, tried in this order
DATE_FORMS = (
    (10, r"^\d{4}-\d{1,2}-\d{1,2}$", "day"),
    (7, r"^\d{4}-\d{1,2}$", "month"),
    (4, r"^\d{4}$", "year"),
)


def _attempts(text) -> list[tuple[Column, str]]:
    """The cast reads all three shapes without a formatter or an exception per bad row."""
    clean = F.trim(col(text))
    prefixes = [(F.substring(clean, 1, size), shape, name) for size, shape, name in DATE_FORMS]
    return [(F.when(p.rlike(shape), p.try_cast("date")), name) for p, shape, name in prefixes]


def lenient_date(text) -> Column:
    """Day, month or year text to DATE; partial dates become the first of the period."""
    return F.coalesce(*[attempt for attempt, _ in _attempts(text)])


def date_precision(text) -> Column:
    return F.coalesce(*[F.when(attempt.isNotNull(), name) for attempt, name in _attempts(text)])


def season_features(day) -> dict[str, Column]:
    day = col(day)
    month, doy = F.month(day), F.dayofyear(day)
    return {
        "year": F.year(day).cast("long"),
        "month": month.cast("long"),
        "day_of_year": doy.cast("long"),
        "month_sin": F.sin(TAU * month / 12),
        "month_cos": F.cos(TAU * month / 12),
        "day_of_year_sin": F.sin(TAU * doy / 365.25),
        "day_of_year_cos": F.cos(TAU * doy / 365.25),
    }


def lunar_features(day) -> dict[str, Column]:
    days = F.datediff(col(day), F.to_date(F.lit(REFERENCE_NEW_MOON))).cast("double")
    age = F.pmod(days, F.lit(SYNODIC_MONTH_DAYS))
    phase = age / SYNODIC_MONTH_DAYS
    # fixed values: upper limit of each phase name
    label = (
        F.when((phase < 0.03) | (phase > 0.97), "new_moon")
        .when(phase < 0.25, "waxing_crescent")
        .when(phase < 0.28, "first_quarter")
        .when(phase < 0.47, "waxing_gibbous")
        .when(phase < 0.53, "full_moon")
        .when(phase < 0.72, "waning_gibbous")
        .when(phase < 0.78, "last_quarter")
        .otherwise("waning_crescent")
    )
    return {
        "moon_age_days": F.round(age, 4),
        "moon_phase_fraction": F.round(phase, 6),
        "moon_illumination": F.round(0.5 * (1 - F.cos(TAU * phase)), 6),
        "moon_phase_sin": F.round(F.sin(TAU * phase), 8),
        "moon_phase_cos": F.round(F.cos(TAU * phase), 8),
        "moon_phase_label": F.when(phase.isNotNull(), label),
    }


def date_range(spark: SparkSession, start: str, end: str, step_days: int = 1) -> DataFrame:
    bounds = spark.range(1).select(
        F.explode(
            F.sequence(
                F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_dt_interval(F.lit(step_days))
            )
        ).alias("date")
    )
    return bounds


def day_sequence(start, end, step_days: int = 1) -> Column:
    return F.sequence(col(start), col(end), F.make_dt_interval(F.lit(step_days)))
