"""Views that give the given star-schema tables the shapes of the study data.

Each text runs unchanged in Spark and in DuckDB. All work grows with the tables: no row is
left out, and pseudo-random parts are integer arithmetic over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # raw occurrences with every rejection reason
    "fx_occurrence": """
SELECT event_id AS seq, event_type AS species_id,
  CASE WHEN event_id % 2 = 0 THEN 'OBIS' ELSE 'GBIF' END AS source,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN '999'
       WHEN event_id % 107 = 0 THEN 'nan'
       ELSE CAST(round(-40 + ((event_id*7919 + user_id*1047) % 60) * 0.25e0 + (event_id % 3) * 0.03e0, 2) AS STRING) END AS lat_text,
  CASE WHEN event_id % 103 = 0 THEN 'abc'
       ELSE CAST(round(147 + ((event_id*6151 + user_id*3571) % 52) * 0.25e0 + (user_id % 3) * 0.04e0, 2) AS STRING) END AS lon_text,
  CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN '2024'
       ELSE CAST(CAST(ts AS DATE) AS STRING) END AS event_date_text,
  round(value * 100e0, 2) AS uncertainty_m
FROM events""",
    # averaged observations per (day, cell) on a 0.25 degree lattice: cells without one are gaps
    "fx_field": """
SELECT day_date, iy, ix, -39 + iy * 0.25e0 AS lat, 148.5e0 + ix * 0.25e0 AS lon,
  CASE WHEN units % 41 = 0 THEN NULL
       ELSE 17.5e0 + iy * 0.12e0 + ix * 0.08e0 + units * 0.05e0 / n END AS sst_c
FROM (
  SELECT DATE '2024-01-01' + CAST((l_partkey*7 + l_orderkey*3 + l_linenumber) % 30 AS INT) AS day_date,
    (l_orderkey + l_suppkey*11) % 49 AS iy, (l_partkey + l_linenumber*5) % 41 AS ix,
    CAST(sum(CAST(round(l_tax * 100e0) AS BIGINT) + l_linenumber) AS BIGINT) AS units, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3) g""",
    # points of interest
    "fx_poi": """
SELECT s_suppkey AS poi_id, s_name AS name,
  CASE s_nationkey % 5 WHEN 0 THEN 'fad_demo' WHEN 1 THEN 'canyon' WHEN 2 THEN 'shelf_break'
       WHEN 3 THEN 'seamount' ELSE 'current_edge' END AS poi_type,
  CASE s_nationkey % 4 WHEN 0 THEN 'shelf' WHEN 1 THEN 'shelf_break' WHEN 2 THEN 'deep' ELSE 'very_deep' END AS depth_class,
  -36.5e0 + ((s_suppkey*37 + s_nationkey*5) % 90) * 0.05e0 AS lat,
  150.5e0 + ((s_suppkey*53 + s_nationkey*3) % 80) * 0.05e0 AS lon
FROM supplier""",
    # static cells: depth, slope inputs and an ocean flag
    "fx_static": """
SELECT iy, ix, -39 + iy * 0.25e0 AS lat, 148.5e0 + ix * 0.25e0 AS lon,
  CASE WHEN n % 7 = 0 THEN NULL ELSE units * 0.25e0 / n - 150e0 END AS depth_m,
  CASE WHEN n % 11 = 0 THEN NULL WHEN units % 9 = 0 THEN FALSE ELSE TRUE END AS ocean_mask
FROM (
  SELECT c_custkey * 5 % 49 AS iy, (c_custkey * 3 + c_nationkey) % 41 AS ix,
    CAST(sum(CAST(floor(c_acctbal) AS BIGINT) + 1000) AS BIGINT) AS units, count(*) AS n
  FROM customer GROUP BY 1, 2) g""",
    # physics samples before regridding: two depth levels
    "fx_physics": """
SELECT DATE '2024-01-01' + CAST((o_orderkey*5 + o_custkey) % 30 AS INT) AS day_date,
  o_orderkey % 2 AS level_idx,
  -39e0 + (o_custkey * 7 % 49) * 0.25e0 + (o_orderkey % 3) * 0.01e0 AS lat,
  148.5e0 + (o_custkey * 3 % 41) * 0.25e0 + (o_orderkey % 5) * 0.01e0 AS lon,
  (o_orderkey % 61 - 30) * 0.02e0 AS uo, (o_custkey % 53 - 26) * 0.02e0 AS vo,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_custkey % 31) * 0.01e0 END AS zos
FROM orders""",
    # hourly weather observations
    "fx_hourly": """
SELECT event_id AS obs_id, ts, CAST(ts AS DATE) AS day_date,
  -36.5e0 + (user_id % 10) * 0.5e0 AS weather_lat, 150.5e0 + (user_id % 8) * 0.5e0 AS weather_lon,
  1000e0 + value / 10e0 AS surface_pressure, CAST((event_id*37) % 360 AS DOUBLE) AS wind_direction,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS wind_speed,
  (event_id % 7) * 0.5e0 AS precipitation
FROM events""",
    # scored, labelled candidates with ties
    "fx_scored": """
SELECT ((l_orderkey*10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS cell_id, l_returnflag AS species_id, l_linestatus AS model_source,
  CAST(l_shipdate AS DATE) AS day_date, CAST(year(l_shipdate) AS BIGINT) AS yr,
  floor(l_extendedprice / 1e2) / 1e3 AS raw_score,
  CASE WHEN l_discount >= 0.08e0 THEN 1 ELSE 0 END AS label,
  -36.5e0 + ((l_partkey*13 + l_orderkey*7) % 901) * 0.005e0 AS lat,
  150.5e0 + ((l_suppkey*29 + l_orderkey*11) % 801) * 0.005e0 AS lon,
  CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 60e0 END AS depth_m,
  l_tax * 1e3 + (l_partkey % 70) AS distance_to_coast_km,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE 17e0 + (l_partkey % 90) * 0.1e0 END AS sst_c,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE (l_suppkey % 50) * 0.01e0 END AS sst_front_strength,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_orderkey % 40) * 0.02e0 END AS current_speed,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE (l_partkey % 60) * 1e0 END AS distance_to_shelf_break,
  CASE WHEN l_partkey % 17 = 0 THEN FALSE ELSE TRUE END AS ocean_mask
FROM lineitem""",
    # multi-year presence / background rows
    "fx_training": """
SELECT o_orderkey AS row_id, o_orderpriority AS species_id, CAST(o_orderdate AS DATE) AS day_date,
  CASE WHEN (o_orderkey*7 + o_custkey) % 11 = 0 THEN 1 ELSE 0 END AS label,
  -39e0 + ((o_custkey*17) % 240) * 0.05e0 AS grid_lat,
  148.5e0 + ((o_custkey*23) % 200) * 0.05e0 AS grid_lon,
  floor(o_totalprice / 1e2) / 1e2 AS sst_c,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS sst_gradient,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 97) * 12e0 END AS depth_m,
  CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE (o_orderkey % 211) * 1e0 END AS distance_to_shelf_break,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 37) * 0.05e0 END AS current_speed,
  CASE WHEN o_orderkey % 23 = 0 THEN 'low' ELSE 'high' END AS source_quality,
  o_orderkey % 41 = 0 AS high_match_distance
FROM orders""",
}

def _tables_of(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the parquet tables (no global temp views)."""
    text = VIEWS[name]
    frames = {}
    for table in _tables_of(text):
        text = re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", text)
        frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text, **frames)


def oracle(views: str, body: str) -> str:
    """DuckDB text: the named fixtures as CTEs, then ``body`` (more CTEs or a SELECT), which says
    RECURSIVE first if a CTE of its own recurses."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in views.split()]
    body = body.strip()
    start = "WITH "
    if body.startswith("RECURSIVE"):
        start, body = "WITH RECURSIVE ", body.removeprefix("RECURSIVE").strip()
    if body.upper().startswith("SELECT"):
        return (start + ",\n".join(parts) + "\n" if parts else "") + body
    return start + ",\n".join([*parts, body])
