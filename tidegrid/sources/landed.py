"""Landed JSON and HTML: occurrence pages, GeoJSON, hourly weather, coordinate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import lenient_date
from ..functions.numbers import blank_to_null, number
from ..schemas import GEOJSON_COLLECTION, HOURLY_PAYLOAD, RAW_OCCURRENCE_FIELDS


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text, one row each (``path``, ``text``)."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def event_date_text(row: str = "", with_end: bool = False) -> Column:
    names = ["eventDate", "date_mid", "date_start"] + (["date_end"] if with_end else [])
    return F.coalesce(*[blank_to_null(f"{row}{n}") for n in names])


def occurrence_records(
    pages: DataFrame, start: str, end: str, keep_undated: bool, with_end: bool = False,
    text: str = "text", records: str = "results",
) -> DataFrame:
    """Flatten record pages to text rows inside the window.

    ``pages`` carries species_id and source beside the JSON text. The first run keeps undated
    rows, the extended run drops them.
    """
    record = ", ".join(f"{n}:string" for n in RAW_OCCURRENCE_FIELDS)
    parsed = F.from_json(text, f"{records} array<struct<{record}>>")
    rows = pages.select("species_id", "source", F.explode(parsed[records]).alias("r")).select(
        "species_id", "source", "r.*"
    )
    rows = rows.withColumn("event_date_text", event_date_text(with_end=with_end))
    day = lenient_date("event_date_text")
    inside = day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    wanted = (F.col("event_date_text").isNull() | day.isNull() | inside) if keep_undated else inside
    return rows.where(F.coalesce(wanted, F.lit(False)))


def geojson_rows(documents: DataFrame, properties: list[str], text: str = "text") -> DataFrame:
    """FeatureCollections to rows: properties win, coordinates fill lat and lon when absent.

    Features without a position are skipped; property values are text.
    """
    parsed = F.from_json(text, GEOJSON_COLLECTION)
    feature = documents.select(F.explode(parsed["features"]).alias("f"))
    props, coords = F.col("f.properties"), F.col("f.geometry.coordinates")

    def given(name: str) -> Column:
        return F.try_element_at(props, F.lit(name))

    rows = feature.select(
        F.coalesce(number(given("lat")), F.try_element_at(coords, F.lit(2))).alias("lat"),
        F.coalesce(number(given("lon")), F.try_element_at(coords, F.lit(1))).alias("lon"),
        *[given(p).alias(p) for p in properties if p not in ("lat", "lon")],
    )
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def hourly_rows(payloads: DataFrame, text: str = "text") -> DataFrame:
    """Parallel hourly arrays to one row per hour, times read as UTC."""
    p = payloads.select(F.from_json(text, HOURLY_PAYLOAD).alias("p"))
    # an absent variable is an empty array, padded with NULL by the zip
    hour = F.arrays_zip(*[
        F.coalesce(F.col(f"p.hourly.{n}"), F.array()).alias(n)
        for n in ("time", "surface_pressure", "pressure_msl", "wind_speed_10m",
                  "wind_direction_10m", "precipitation")
    ])
    flat = p.select(
        F.col("p.latitude").alias("weather_lat"), F.col("p.longitude").alias("weather_lon"),
        F.explode(hour).alias("h"),
    )
    ts = F.coalesce(
        F.try_to_timestamp("h.time", F.lit("yyyy-MM-dd'T'HH:mm[:ss]")), F.try_to_timestamp("h.time")
    )
    return flat.select(
        "weather_lat", "weather_lon", ts.alias("ts"), ts.cast("date").alias("date"),
        "h.surface_pressure", "h.pressure_msl",
        F.col("h.wind_speed_10m").alias("wind_speed"),
        F.col("h.wind_direction_10m").alias("wind_direction"),
        "h.precipitation",
    )


# fixed values: patterns of degrees + minutes cells and of list numbers before names
LAT_CELL = r"\d{1,2}\D+\d{1,2}(?:\.\d+)?"
LON_CELL = r"\d{2,3}\D+\d{1,2}(?:\.\d+)?"
DEGREES_MINUTES = r"(\d{1,3})\D+(\d{1,2}(?:\.\d+)?)"
NAME_NUMBER = r"^\(\d+[A-Z]?\)\s*"
SLUG_LENGTH = 80
# fixed values: words that tell which cell of a row without columns is its name
NAME_WORDS = r"(?i)FAD|Sydney|Wollongong|Port|Bay|Shoalhaven|Newcastle|Kiama"
# fixed values: a position inside the text of a row, before its hemisphere
LAT_TEXT = rf"(?i)({LAT_CELL})\s*[\"']?\s*S"
LON_TEXT = rf"(?i)({LON_CELL})\s*[\"']?\s*E"
# fixed values: entities with a name
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "deg": "°", "prime": "′", "Prime": "″", "ndash": "–", "mdash": "—", "amp": "&"}


def _entity(found: Column) -> Column:
    """The character of an entity like ``&#176;``, ``&#xb0;`` or ``&deg;``; unknown ones stay."""
    body = F.substring(found, F.lit(2), F.length(found) - 2)
    hexed = F.lower(F.substring(body, 2, 1)) == "x"
    code = F.when(hexed, F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.length(body))).try_cast("long")
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), body)
    return F.coalesce(F.when(F.startswith(body, F.lit("#")), letter).otherwise(named), found)


def unescaped(text: Column) -> Column:
    """Entities decoded once: what they give is not read as another entity."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"), F.lit(0)))
    pairs = F.transform(found, lambda e: F.struct((_entity(e) == "&").alias("last"), e.alias("e"), _entity(e).alias("to")))
    # an ampersand comes last, or it would make new entities
    return F.aggregate(F.array_sort(pairs), text, lambda done, p: F.replace(done, p["e"], p["to"]))


def markup_text(html: Column) -> Column:
    """Text of a markup fragment: tags out, entities decoded, blanks squeezed."""
    bare = unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def slug(name: Column) -> Column:
    joined = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, SLUG_LENGTH)


def decimal_degrees(cell: Column, sign: int) -> Column:
    degrees = number(F.regexp_extract(cell, DEGREES_MINUTES, 1))
    minutes = number(F.regexp_extract(cell, DEGREES_MINUTES, 2))
    return F.round(sign * (degrees + minutes / 60.0), 6)


def html_elements(pages: DataFrame, tag: str) -> DataFrame:
    """(page_id, url, position, inner) for every element of one tag."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("position", "inner"))


def coordinate_rows(pages: DataFrame) -> DataFrame:
    """Named southern-eastern positions from HTML tables; first per position wins.

    A row counts when its second and third cells hold degrees and minutes, or else when its
    text carries them before an S and an E; its name is then the first cell with a place word.
    """
    cells = F.transform(
        F.regexp_extract_all("inner", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)),
        markup_text,
    )
    rows = html_elements(pages, "tr").withColumn("cells", cells).where(F.size("cells") > 0)

    def cell(i: int) -> Column:
        return F.try_element_at("cells", F.lit(i))

    columns = (F.size("cells") >= 5) & cell(2).rlike(LAT_CELL) & cell(3).rlike(LON_CELL)
    line = F.concat_ws(" | ", "cells")
    lat_text, lon_text = F.regexp_extract(line, LAT_TEXT, 1), F.regexp_extract(line, LON_TEXT, 1)
    place = F.coalesce(F.get(F.filter("cells", lambda c: c.rlike(NAME_WORDS)), F.lit(0)), cell(1))
    named = rows.select(
        "page_id", "url", "position",
        F.when(columns, F.trim(F.regexp_replace(cell(1), NAME_NUMBER, ""))).otherwise(place).alias("name"),
        F.when(columns, cell(2)).otherwise(lat_text).alias("_lat"),
        F.when(columns, cell(3)).otherwise(lon_text).alias("_lon"),
        F.when(columns, cell(5)).alias("depth_text"),
    )
    placed = named.select(
        "page_id", "url", "position", slug(F.col("name")).alias("id"), "name",
        decimal_degrees(F.col("_lat"), -1).alias("latitude"),
        decimal_degrees(F.col("_lon"), 1).alias("longitude"),
        "depth_text",
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    first = F.min_by(F.struct(*placed.columns), F.struct("page_id", "position")).alias("row")
    return placed.groupBy(F.col("latitude").alias("_a"), F.col("longitude").alias("_b")).agg(first).select("row.*")


def link_rows(pages: DataFrame) -> DataFrame:
    """Linked list items: target, text and slug, first per (page, target)."""
    item = html_elements(pages, "li").select(
        "page_id", "position",
        F.regexp_extract("inner", r"(?is)<a\b[^>]*href=\"([^\"]*)\"", 1).alias("href"),
        markup_text(F.col("inner")).alias("name"),
    ).where(F.col("href") != "")
    first = F.min_by(F.struct("position", "name"), "position").alias("row")
    kept = item.groupBy("page_id", "href").agg(first)
    return kept.select("page_id", "href", "row.position", "row.name", slug(F.col("row.name")).alias("id"))
