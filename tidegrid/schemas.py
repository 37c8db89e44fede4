"""Declared schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from .config import PROVENANCE_COLUMNS


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# fixed values: Darwin Core field names kept from a landed record
RAW_OCCURRENCE_FIELDS = (
    "scientificName", "decimalLatitude", "decimalLongitude", "eventDate", "year", "month", "day",
    "coordinateUncertaintyInMeters", "basisOfRecord", "datasetName", "institutionCode", "occurrenceID",
    "license", "id", "date_start", "date_mid", "date_end", "date_year",
    "gbifID",
)
RAW_OCCURRENCE = text_schema(*RAW_OCCURRENCE_FIELDS)
PROVENANCE = text_schema(*PROVENANCE_COLUMNS)

GEOJSON_COLLECTION = (
    "type string, features array<struct<type:string, "
    "geometry:struct<type:string, coordinates:array<double>>, properties:map<string,string>>>"
)

HOURLY_PAYLOAD = (
    "latitude double, longitude double, hourly struct<time:array<string>, "
    "surface_pressure:array<double>, pressure_msl:array<double>, wind_speed_10m:array<double>, "
    "wind_direction_10m:array<double>, precipitation:array<double>>"
)
