"""Queries of sources, sinks, catalogue and serving (S*, W11, Q*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUDIT_STATUS, AUDIT_WARNING
from ..operators import hotspots as hs
from ..operators.metrics import confidence_tier
from ..schemas import text_schema
from ..sources import landed, published, tabular
from ..session import shared_folder
from .alignment import points, training
from .cleaning import END, ENTRIES, PARSED, START, published_entries
from .expressions import haversine_sql
from .fixtures import view
from .registry import query
from .scoring import RATED, rated


@query("s1_text_csv", "fx_occurrence", """
SELECT CAST(seq AS VARCHAR) AS seq, species_id, nullif(lat_text, '') AS lat_text, nullif(event_date_text, '') AS event_date_text FROM fx_occurrence""")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as CSV text and read back with an all-text schema; blanks are NULL."""
    rows = view(spark, sf, "fx_occurrence").select(F.to_csv(F.struct("seq", "species_id", "lat_text", "event_date_text")).alias("line"))
    return tabular.parse_csv_lines(rows, "line", text_schema("seq", "species_id", "lat_text", "event_date_text"))


@query("s2_table_types", "fx_training", "SELECT row_id, depth_m, CASE WHEN current_speed > 1.8e0 THEN NULL ELSE current_speed END AS current_speed FROM fx_training")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and infinities become NULL on reading."""
    odd = F.when(F.col("current_speed") > 1.8, F.lit(float("nan"))).otherwise(F.col("current_speed"))
    depth = F.coalesce("depth_m", F.lit(float("inf")))
    return tabular.nan_to_null(view(spark, sf, "fx_training").select("row_id", depth.alias("depth_m"), odd.alias("current_speed")))


def record_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences as landed JSON pages of at most a hundred records."""
    rows = view(spark, sf, "fx_occurrence")
    record = F.struct(
        F.col("seq").cast("string").alias("occurrenceID"), F.col("lat_text").alias("decimalLatitude"), F.col("lon_text").alias("decimalLongitude"),
        F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("event_date_text")).alias("eventDate"),
        F.when(F.col("seq") % 3 == 0, F.col("event_date_text")).alias("date_mid"),
    )
    pages = rows.groupBy("species_id", "source", F.floor(F.col("seq") / 100)).agg(F.collect_list(record).alias("results"))
    return pages.select("species_id", "source", F.to_json(F.struct("results")).alias("text"))


DATED = PARSED + """, picked AS (SELECT CAST(seq AS VARCHAR) AS "occurrenceID", species_id, source, nullif(event_date_text, '') AS event_date_text, d FROM parsed)
"""


@query("s3_landed_records_first_run", "fx_occurrence", DATED + f"""
SELECT "occurrenceID", species_id, source, event_date_text FROM picked WHERE d IS NULL OR d BETWEEN DATE '{START}' AND DATE '{END}'""")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    rows = landed.occurrence_records(record_pages(spark, sf), START, END, keep_undated=True)
    return rows.select("occurrenceID", "species_id", "source", "event_date_text")


@query("s3_landed_records_extended", "fx_occurrence", DATED + f"""
SELECT "occurrenceID", species_id, source, event_date_text FROM picked WHERE d BETWEEN DATE '{START}' AND DATE '{END}'""")
def s3b(spark: SparkSession, sf: str) -> DataFrame:
    rows = landed.occurrence_records(record_pages(spark, sf), START, END, keep_undated=False, with_end=True)
    return rows.select("occurrenceID", "species_id", "source", "event_date_text")


@query("s5_geojson_rows", "fx_poi", """
SELECT CASE WHEN poi_id % 4 = 0 THEN lat + 1 ELSE lat END AS lat, lon, CAST(poi_id AS VARCHAR) AS id, name, poi_type FROM fx_poi WHERE poi_id % 7 <> 0 OR poi_id % 4 = 0""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """Collections where some positions come from properties and some features have none."""
    p = view(spark, sf, "fx_poi")
    in_props = F.col("poi_id") % 4 == 0
    props = F.create_map(
        F.lit("id"), F.col("poi_id").cast("string"), F.lit("name"), F.col("name"), F.lit("poi_type"), F.col("poi_type"),
        F.lit("lat"), F.when(in_props, (F.col("lat") + 1).cast("string")), F.lit("lon"), F.when(in_props, F.col("lon").cast("string")),
    )
    coordinates = F.when((F.col("poi_id") % 7 != 0) | in_props, F.array("lon", "lat"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    docs = p.groupBy("poi_type", F.floor(F.col("poi_id") / 50)).agg(F.collect_list(feature).alias("features"))
    text = docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("text"))
    return landed.geojson_rows(text, ["id", "name", "poi_type"])


@query("s8_html_links", "", """
items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), 1) AS p FROM pages),
cells AS (SELECT page_id, p - 1 AS position, regexp_extract(item, '(?is)<a\\b[^>]*href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(item, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM items),
named AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS j FROM cells WHERE href <> '')
SELECT page_id, href, CAST(position AS INTEGER) AS position, name, substr(regexp_replace(j, '^_+|_+$', '', 'g'), 1, 80) AS id FROM named QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY position) = 1""")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    return landed.link_rows(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))


@query("s8_html_coordinates", "fx_poi", """
p AS (SELECT *, floor(abs(lat)) AS a, floor(lon) AS b, round((abs(lat) - a) * 60, 3) AS am, round((lon - b) * 60, 3) AS bm FROM fx_poi WHERE poi_type <> 'canyon'),
placed AS (SELECT poi_id, CASE WHEN poi_type = 'seamount' THEN 'Port ' || name ELSE name END AS name, CASE WHEN poi_type = 'seamount' THEN 'port_' ELSE '' END || lower(replace(name, '#', '_')) AS id, round(-(a + am / 60e0), 6) AS latitude, round(b + bm / 60e0, 6) AS longitude FROM p)
SELECT id, name, latitude, longitude FROM placed QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY poi_id) = 1""")
def s8b(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with degree and minute cells or positions in the text, entities, duplicate rows and rows
    without a position."""
    p = view(spark, sf, "fx_poi")

    def cell(value: str, hemisphere: str):
        whole = F.floor(F.abs(F.col(value)))
        minutes = F.round((F.abs(F.col(value)) - whole) * 60, 3)
        return F.concat(whole.cast("string"), F.lit("&deg; "), F.format_string("%06.3f", minutes), F.lit("&#39;" + hemisphere))

    empty = F.col("poi_type") == "canyon"
    row = F.concat(
        F.lit("<tr class=\"r\"><td><b>"), "name", F.lit("</b></td><td>"), F.when(empty, "").otherwise(cell("lat", "")), F.lit("</td><td>"),
        F.when(empty, "").otherwise(cell("lon", "")), F.lit("</td><td>x</td><td>"), F.col("poi_id").cast("string"), F.lit("</td></tr>"),
    )
    coded = F.replace("name", F.lit("#"), F.lit("&#x23;"))
    text_row = F.concat(
        F.lit("<tr><td>"), F.when(F.col("poi_type") == "seamount", F.concat(F.col("poi_id").cast("string"), F.lit("</td><td>Port "), coded)).otherwise(F.concat(coded, F.lit("</td><td>x"))),
        F.lit("</td><td>"), cell("lat", " S"), F.lit(" "), cell("lon", " E"), F.lit("</td></tr>"))
    row = F.when(F.col("poi_type").isin("seamount", "current_edge"), text_row).otherwise(row)
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Lat</th></tr>"), row, F.lit("\n"), row, F.lit("</table>"))
    pages = p.select(F.col("poi_id").alias("page_id"), F.lit("inline").alias("url"), html.alias("html"))
    return landed.coordinate_rows(pages).select("id", "name", "latitude", "longitude")


@query("s9_hourly_rows", "fx_hourly", """
SELECT weather_lat, weather_lon, date_trunc('minute', ts) AS ts, day_date AS date, round(surface_pressure, 6) AS surface_pressure, wind_speed, wind_direction, precipitation FROM fx_hourly""")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of at most 24 observations with parallel arrays, exploded again."""
    h = view(spark, sf, "fx_hourly")
    row = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), "surface_pressure", "wind_speed", "wind_direction", "precipitation"
    )
    packed = h.groupBy("weather_lat", "weather_lon", "day_date", F.floor(F.col("obs_id") / 24)).agg(F.collect_list(row).alias("r"))
    hourly = F.struct(
        F.col("r.time").alias("time"), F.col("r.surface_pressure").alias("surface_pressure"), F.col("r.wind_speed").alias("wind_speed_10m"),
        F.col("r.wind_direction").alias("wind_direction_10m"), F.col("r.precipitation").alias("precipitation"),
    )
    doc = F.struct(F.col("weather_lat").alias("latitude"), F.col("weather_lon").alias("longitude"), hourly.alias("hourly"))
    rows = landed.hourly_rows(packed.select(F.to_json(doc).alias("text")))
    return rows.drop("pressure_msl").withColumns({
        "surface_pressure": F.round("surface_pressure", 6), "ts": F.col("ts").cast("timestamp_ntz"),
    })


@query("s10_partitioned_write", "fx_training", """
SELECT day_date AS date, count(*) AS rows, sum(CAST(row_id AS BIGINT))::BIGINT AS row_ids FROM fx_training GROUP BY 1""")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written by year into the shared folder and read back under their schema."""
    rows = training(spark, sf).select("row_id", "date", F.year("date").alias("year"))
    path = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}.parquet"
    tabular.write_table(rows, path, ["year"])
    back = tabular.read_table(spark, path, rows.schema)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("row_ids"))


@query("s11_geojson_sink", "fx_scored", """
SELECT lat, lon, species_id, CASE WHEN sst_c IS NULL THEN NULL ELSE CAST(round(sst_c * 10) AS BIGINT) END AS tenths FROM fx_scored""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Features written as lines and parsed again; NaN went out as null."""
    cells = view(spark, sf, "fx_scored").withColumn("sst_c", F.coalesce("sst_c", F.lit(float("nan"))))
    lines = published.geojson_lines(cells, ["species_id", "sst_c"])
    wrapped = lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("text"))
    rows = landed.geojson_rows(wrapped, ["species_id", "sst_c"])
    return rows.select("lat", "lon", "species_id", F.round(F.col("sst_c").try_cast("double") * 10).cast("long").alias("tenths"))


@query("s12_provenance", "fx_occurrence", """
SELECT 'clean_' || species_id AS dataset_name, source AS source_name, min(event_date_text) FILTER (event_date_text <> '') || ' to ' || max(event_date_text) AS time_range, CAST(count(*) AS VARCHAR) AS variables, '' AS notes, '2026-01-01' AS download_date FROM fx_occurrence GROUP BY species_id, source""")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    dated = F.when(F.col("event_date_text") != "", F.col("event_date_text"))
    entries = view(spark, sf, "fx_occurrence").groupBy("species_id", "source").agg(
        F.concat(F.min(dated), F.lit(" to "), F.max("event_date_text")).alias("time_range"), F.count(F.lit(1)).alias("variables")
    ).withColumns({"dataset_name": F.concat(F.lit("clean_"), "species_id"), "source_name": F.col("source"), "download_date": F.lit("2026-01-01")})
    return published.provenance_rows(entries).select("dataset_name", "source_name", "time_range", "variables", "notes", "download_date")


@query("s13_catalogue", "fx_training", ENTRIES + """
SELECT species_id, model_source, array_to_string(list_sort(list(CAST(date AS VARCHAR))), ',') AS available_dates, max(date) AS prediction_date FROM entries GROUP BY 1, 2""")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    found = published.catalogue(published_entries(spark, sf))
    return found.withColumn("available_dates", F.concat_ws(",", F.col("available_dates").cast("array<string>")))


@query("s13_availability", "fx_training", ENTRIES + """
, wanted AS (SELECT DISTINCT species_id FROM entries UNION SELECT 'unseen' AS species_id)
SELECT w.species_id, max(date) IS NOT NULL AS available, max(date) AS prediction_date, max(date) AS target_date, CASE WHEN max(date) IS NULL THEN 'trained prediction file is missing' END AS reason,
 CASE WHEN max(date) IS NULL THEN 'unavailable' ELSE 'trained_under_audit' END AS audit_status FROM wanted w LEFT JOIN entries e USING (species_id) GROUP BY 1""")
def s13b(spark: SparkSession, sf: str) -> DataFrame:
    entries = published_entries(spark, sf)
    wanted = entries.select("species_id").distinct().union(spark.createDataFrame([("unseen",)], "species_id string"))
    return published.availability(published.catalogue(entries), wanted)


@query("s14_manifest_update", "fx_training", ENTRIES + f"""
, m AS (SELECT species_id, model_source, max(date) > DATE '2001-07-25' AS available, CASE WHEN model_source = 'deep_learning' THEN '{AUDIT_WARNING} older' ELSE 'relative only' END AS notes FROM entries GROUP BY 1, 2)
SELECT species_id, model_source, available, CASE WHEN available THEN '{AUDIT_STATUS}' END AS audit_status, CASE WHEN available THEN '{AUDIT_WARNING}' END AS warning,
 CASE WHEN available AND NOT contains(notes, '{AUDIT_WARNING}') THEN '{AUDIT_WARNING} ' || notes ELSE notes END AS notes FROM m""")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """Applied twice: the warning is put in once."""
    found = published.catalogue(published_entries(spark, sf))
    notes = F.when(F.col("model_source") == "deep_learning", f"{AUDIT_WARNING} older").otherwise("relative only")
    manifest = found.select(
        "species_id", "model_source", (F.col("prediction_date") > F.to_date(F.lit("2001-07-25"))).alias("available"),
        F.lit(None).cast("string").alias("audit_status"), F.lit(None).cast("string").alias("warning"), notes.alias("notes"),
    )
    return published.mark_under_audit(published.mark_under_audit(manifest))


@query("s15_serving_scan", "fx_scored", """
u AS (SELECT species_id, day_date AS date, cell_id, lat, lon, raw_score * 95 AS score, CASE WHEN model_source = 'F' AND yr % 2 = 0 THEN 0 WHEN yr % 3 = 0 THEN 1 ELSE 2 END AS src FROM fx_scored),
best AS (SELECT species_id, date, min(src) AS b FROM u GROUP BY 1, 2)
SELECT species_id, date, cell_id, CASE WHEN cell_id % 6 = 0 THEN NULL ELSE round(score, 6) END AS score, CASE WHEN cell_id % 6 = 0 THEN 'Low' WHEN score >= 95 THEN 'Prime' WHEN score >= 85 THEN 'Good' WHEN score >= 60 THEN 'Possible' ELSE 'Low' END AS rating, CAST(src AS INTEGER) AS source_rank
FROM u JOIN best USING (species_id, date) WHERE src = b AND cell_id % 5 <> 0""")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Text numbers with the usual bad values, from three ranked sources."""
    score = F.when(F.col("cell_id") % 6 == 0, F.lit("None")).otherwise((F.col("raw_score") * 95).cast("string"))
    lat = F.when(F.col("cell_id") % 5 == 0, F.lit("nan")).otherwise(F.col("lat").cast("string"))
    rows = view(spark, sf, "fx_scored").select(
        "species_id", F.col("day_date").alias("date"), "cell_id", lat.alias("lat"), F.col("lon").cast("string").alias("lon"), score.alias("score"),
        F.when((F.col("model_source") == "F") & (F.col("yr") % 2 == 0), 0).when(F.col("yr") % 3 == 0, 1).otherwise(2).alias("_src"),
    )
    sources = [rows.where(F.col("_src") == i).drop("_src") for i in range(3)]
    out = published.serving_scan(sources, ["species_id", "date"], ["lat", "lon", "score"])
    return out.select("species_id", "date", "cell_id", F.round("score", 6).alias("score"), "rating", "source_rank")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows as a published table: display scores by species, model and year end."""
    source = F.when(F.col("model_source") == "F", "scikit_learn").otherwise("deep_learning")
    return rated(spark, sf).withColumns({
        "model_source": source, "date": F.to_date(F.concat(F.col("yr").cast("string"), F.lit("-12-31"))),
    })


PUBLISHED = RATED + """, pub AS (SELECT * REPLACE (CASE WHEN model_source = 'F' THEN 'scikit_learn' ELSE 'deep_learning' END AS model_source), make_date(yr, 12, 31) AS date FROM rated)
"""


@query("q1_prediction_lookup", "fx_scored", PUBLISHED + """
SELECT cell_id, species_id, model_source, date, score, rating FROM pub WHERE species_id = 'A' AND model_source = 'scikit_learn' AND date = (SELECT max(date) FROM pub WHERE species_id = 'A' AND model_source = 'scikit_learn')""")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    """An unknown day falls back to the latest one."""
    rows = hs.prediction_rows(predictions(spark, sf), "A", "1960-01-01")
    return rows.select("cell_id", "species_id", "model_source", "date", "score", "rating")


@query("q1_prediction_metadata", "fx_scored", PUBLISHED + """
, c AS (SELECT species_id, model_source, date, rating, count(*) AS n FROM pub GROUP BY 1, 2, 3, 4), t AS (SELECT *, round(n * 100e0 / sum(n) OVER (PARTITION BY species_id, model_source, date), 4) AS pct FROM c)
SELECT species_id, model_source, date, CAST(sum(n) AS BIGINT) AS feature_count, string_agg(rating || ':' || n || ':' || printf('%.2f', pct), ',' ORDER BY rating) AS rating_distribution, CASE WHEN model_source = 'deep_learning' THEN 'Experimental' ELSE 'Low' END AS model_confidence FROM t GROUP BY 1, 2, 3""")
def q1b(spark: SparkSession, sf: str) -> DataFrame:
    meta = hs.prediction_metadata(predictions(spark, sf))
    shown = F.transform(
        "rating_distribution",
        lambda r: F.concat_ws(":", r["rating"], r["count"].cast("string"), F.format_string("%.2f", F.round(r["percent"], 4))),
    )
    return meta.withColumn("rating_distribution", F.concat_ws(",", shown))


CONTRACT_SQL = f"""
, m AS (SELECT species_id, count(*) FILTER (label = 1) AS n, max(raw_score) AS roc, avg(raw_score) AS hit FROM fx_scored GROUP BY 1),
entry AS (SELECT species_id, CASE WHEN n < 100 THEN 'Rule-based only' WHEN n >= 1000 AND roc >= 0.75e0 AND hit >= 0.5e0 THEN 'High' WHEN n >= 300 AND roc >= 0.65e0 AND hit >= 0.35e0 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM m WHERE species_id <> 'N'),
days AS (SELECT species_id, model_source, date, CASE WHEN date >= DATE '1996-01-01' THEN 'current' ELSE 'demo' END AS mode, count(*) AS feature_count FROM pub GROUP BY 1, 2, 3),
listed AS (SELECT species_id, model_source, mode, array_to_string(list_sort(list(CAST(date AS VARCHAR))), ',') AS available_dates FROM days GROUP BY 1, 2, 3)
SELECT mode, species_id, model_source, date AS prediction_date, date AS target_date, available_dates, CASE WHEN model_source = 'deep_learning' THEN 'Experimental' ELSE confidence END AS model_confidence,
  CASE WHEN model_source = 'deep_learning' THEN '{hs.DEEP_FEATURES}' ELSE 'no_coordinates' END AS feature_set_name, CASE WHEN model_source = 'deep_learning' THEN '{hs.DEEP_EXPLANATION}' ELSE 'Relative score.' END AS score_explanation,
  '{AUDIT_STATUS}' AS audit_status, '{AUDIT_WARNING}' AS warning, '{AUDIT_WARNING} relative only' AS notes, feature_count
FROM days JOIN listed USING (species_id, model_source, mode) JOIN entry USING (species_id)"""


def manifest_of(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the published species; one of them is not available."""
    facts = view(spark, sf, "fx_scored").groupBy("species_id").agg(
        F.count_if(F.col("label") == 1).alias("presence_count"), F.max("raw_score").alias("validation_roc_auc"), F.avg("raw_score").alias("validation_top_10_hit_rate"))
    none = F.lit(None).cast("string")
    return facts.select(
        "species_id", (F.col("species_id") != "N").alias("available"), confidence_tier().alias("model_confidence"), F.lit("no_coordinates").alias("feature_set_name"),
        F.lit("Relative score.").alias("score_explanation"), none.alias("audit_status"), none.alias("warning"), F.lit("relative only").alias("notes"))


@query("q1_serving_contract", "fx_scored", PUBLISHED + CONTRACT_SQL)
def q1c(spark: SparkSession, sf: str) -> DataFrame:
    """What is said of every day that may be served, from the current version of the manifest."""
    root = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    manifest = manifest_of(spark, sf)
    published.write_manifest(manifest, root)
    published.write_manifest(published.mark_under_audit(published.read_manifest(spark, root)), root)
    out = hs.serving_contract(predictions(spark, sf), published.read_manifest(spark, root), "1996-01-01")
    return out.withColumn("available_dates", F.concat_ws(",", F.col("available_dates").cast("array<string>"))).drop("rating_distribution")


@query("q4_availability", "fx_scored", PUBLISHED + """
SELECT CASE WHEN date >= DATE '2000-12-31' THEN 'current' ELSE 'demo' END AS mode, species_id, max(date) AS prediction_date, count(DISTINCT date) AS date_count FROM pub GROUP BY 1, 2""")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    return hs.availability_by_mode(predictions(spark, sf), "2000-12-31")


@query("q5_latest_predictions", "fx_scored", PUBLISHED + """
SELECT cell_id, species_id, date, score FROM pub p WHERE date = (SELECT max(date) FROM pub q WHERE q.species_id = p.species_id)""")
def q5(spark: SparkSession, sf: str) -> DataFrame:
    return hs.latest_predictions(predictions(spark, sf)).select("cell_id", "species_id", "date", "score")


SPOT_KEYS = ["species_id", "model_source", "date"]


BAND_SQL = "CASE WHEN distance_to_coast_km <= 20 THEN 'nearshore' WHEN distance_to_coast_km <= 50 THEN 'midshore' ELSE 'offshore' END"
SEGMENT_SQL = "coalesce(CAST(trunc(least(7e0, greatest(0e0, (lat + 36.5e0) / 4.5e0 * 8))) AS BIGINT), 0)"
PICK_SQL = "STRUCT(neg DOUBLE, row_id BIGINT, lat DOUBLE, lon DOUBLE, band VARCHAR, segment BIGINT)"


def spots_sql(cells: str, limit: int, apart: float, radius: int) -> str:
    """CTEs ending in ``spots``: the plain greedy as a recursion over the schedule of its attempts.

    Each step gives every key the best cell that its attempt allows and that lies far enough from
    the picks so far.
    """
    quota = "CASE band " + " ".join(f"WHEN '{b}' THEN {q}" for b, q in hs.band_quotas(limit).items()) + " END"
    return f"""
sched AS (SELECT row_number() OVER (ORDER BY phase, i, band_no, a) - 1 AS step, band, CASE WHEN phase = 1 THEN a END AS segment, floor, {quota} AS quota FROM (
  SELECT 1 AS phase, i, band_no, unnest(range(8)) AS a, band, floor FROM (VALUES (0, 95e0), (1, 85e0), (2, 75e0)) f(i, floor), (VALUES (0, 'nearshore'), (1, 'midshore')) b(band_no, band)
  UNION ALL SELECT 2, i, band_no, unnest(range({quota})), band, floor FROM (VALUES (0, 85e0), (1, 60e0)) f(i, floor), (VALUES (0, 'nearshore'), (1, 'midshore'), (2, 'offshore')) b(band_no, band)
  UNION ALL SELECT 3, 0, 0, unnest(range({limit})), NULL, CAST('-infinity' AS DOUBLE)) t),
cand AS MATERIALIZED (SELECT species_id, model_source, date, cell_id, lat, lon, score, {BAND_SQL} AS band, {SEGMENT_SQL} AS segment FROM {cells} WHERE score IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL),
greedy AS (
  SELECT species_id, model_source, date, CAST(0 AS BIGINT) AS step, CAST([] AS {PICK_SQL}[]) AS picks FROM (SELECT DISTINCT species_id, model_source, date FROM cand) k
  UNION ALL
  SELECT g.species_id, g.model_source, g.date, g.step + 1, CASE WHEN count(c.cell_id) = 0 THEN any_value(g.picks) ELSE list_append(any_value(g.picks),
    min(CASE WHEN c.cell_id IS NOT NULL THEN CAST(struct_pack(neg := -c.score, row_id := c.cell_id, lat := c.lat, lon := c.lon, band := c.band, segment := c.segment) AS {PICK_SQL}) END)) END
  FROM greedy g JOIN sched s ON s.step = g.step LEFT JOIN cand c ON c.species_id = g.species_id AND c.model_source = g.model_source AND c.date = g.date
    AND coalesce(c.band = s.band, TRUE) AND coalesce(c.segment = s.segment, TRUE) AND c.score >= s.floor AND len(g.picks) < {limit}
    AND coalesce(len(list_filter(g.picks, lambda p: p.band = s.band)) < s.quota, TRUE)
    AND (s.segment IS NULL OR len(list_filter(g.picks, lambda p: p.band = s.band AND p.segment = s.segment)) = 0)
    AND len(list_filter(g.picks, lambda p: CASE WHEN abs(p.lat - c.lat) * 111 > {apart} THEN FALSE ELSE {haversine_sql('p.lat', 'p.lon', 'c.lat', 'c.lon')} < {apart} END)) = 0
  GROUP BY g.species_id, g.model_source, g.date, g.step),
taken AS (SELECT species_id, model_source, date, unnest(picks) AS p, generate_subscripts(picks, 1) AS nth FROM greedy WHERE step = (SELECT max(step) + 1 FROM sched)),
spots AS (SELECT species_id, model_source, date, p.row_id AS cell_id, p.lat AS lat, p.lon AS lon, -p.neg AS score, p.band AS coast_priority_band, p.segment AS coast_segment,
  row_number() OVER (PARTITION BY species_id, model_source, date ORDER BY p.neg, nth) AS spot_rank, CAST({radius} AS BIGINT) AS recommendation_radius_m FROM taken)"""


@query("w11_spaced_hotspots", "fx_scored", "RECURSIVE " + PUBLISHED + ", " + spots_sql("pub", 30, 4.0, 500) + """
SELECT * FROM spots""")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy spaced selection over every key at once."""
    return hs.spaced_spots(predictions(spark, sf), SPOT_KEYS, "cell_id")


@query("q2_described_hotspots", "fx_scored fx_poi", "RECURSIVE " + PUBLISHED + """
, newest AS (SELECT * FROM pub p WHERE date = (SELECT max(date) FROM pub q WHERE q.species_id = p.species_id)), """ + spots_sql("newest", 20, 6.0, 1000) + f"""
, full_ AS (SELECT s.*, n.sst_c, n.sst_front_strength, n.current_speed, n.depth_m, n.distance_to_coast_km FROM spots s JOIN newest n USING (species_id, model_source, date, cell_id)),
near AS (SELECT f.*, p.name AS poi_name, p.poi_type AS poi_poi_type, round({haversine_sql('f.lat', 'f.lon', 'p.lat', 'p.lon')}, 6) AS poi_km
  FROM full_ f, fx_poi p QUALIFY row_number() OVER (PARTITION BY species_id, model_source, date, cell_id ORDER BY poi_km, p.poi_id) = 1)
SELECT *, concat_ws('; ', CASE WHEN sst_c IS NOT NULL THEN printf('SST %.1fC', sst_c) END, CASE WHEN sst_front_strength IS NOT NULL THEN printf('SST front proxy %.3f', sst_front_strength) END,
  CASE WHEN current_speed IS NOT NULL THEN printf('Current %.2fm/s', current_speed) END, CASE WHEN depth_m IS NOT NULL THEN printf('Depth %.0fm', depth_m) END,
  CASE WHEN distance_to_coast_km IS NOT NULL THEN printf('%.1fkm from coast', distance_to_coast_km) END) AS top_drivers,
  CASE WHEN poi_km IS NULL THEN 'No nearby POI context available.' ELSE printf('Nearest known/demo offshore feature: %s (%s), about %.2f km away.', poi_name, poi_poi_type, round(poi_km, 2)) END AS poi_context FROM near""")
def q2(spark: SparkSession, sf: str) -> DataFrame:
    """Hotspots of each species' latest day with drivers and nearest point."""
    cells = hs.latest_predictions(predictions(spark, sf))
    spots = hs.spaced_spots(cells, SPOT_KEYS, "cell_id", limit=20, separation_km=6.0, radius_m=1000)
    described = hs.described_spots(spots, cells, points(spark, sf), SPOT_KEYS, "cell_id")
    return described.withColumn("top_drivers", F.concat_ws("; ", "top_drivers"))
