"""Queries of occurrence cleaning, duplicates, summaries and dates (P3-P6, D*, A1-A3, S4, X1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as c
from ..sources import published
from .fixtures import view
from .registry import query

PARSED = """
parsed AS (SELECT *, TRY_CAST(lat_text AS DOUBLE) AS lat, TRY_CAST(lon_text AS DOUBLE) AS lon,
   coalesce(CAST(try_strptime(substr(event_date_text, 1, 10), '%Y-%m-%d') AS DATE), CAST(try_strptime(substr(event_date_text, 1, 7), '%Y-%m') AS DATE),
     CAST(try_strptime(substr(event_date_text, 1, 4), '%Y') AS DATE)) AS d FROM fx_occurrence),
flagged AS (SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coords'
   WHEN isnan(lat) OR isnan(lon) OR NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'invalid_coordinates'
   WHEN d IS NULL THEN 'missing_date' WHEN d < DATE '2024-01-04' THEN 'before_start' WHEN d > DATE '2024-01-27' THEN 'after_end'
   WHEN NOT (lat BETWEEN -39 AND -27 AND lon BETWEEN 148.5e0 AND 158.5e0) THEN 'outside_bbox'
   WHEN uncertainty_m > 10000 THEN 'high_uncertainty' END AS first_reason FROM parsed),
labelled AS (SELECT *, CASE WHEN first_reason IS NOT NULL THEN first_reason
   WHEN row_number() OVER (PARTITION BY species_id, source, d, round(lat, 4), round(lon, 4), first_reason IS NULL ORDER BY seq) > 1 THEN 'duplicates' END AS reason FROM flagged)
"""
CLEAN = PARSED + """, clean AS (SELECT *, lat BETWEEN -36.5e0 AND -32e0 AND lon BETWEEN 150.5e0 AND 154.5e0 AS inside FROM labelled WHERE reason IS NULL)
"""
START, END = "2024-01-04", "2024-01-27"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return c.with_reason(view(spark, sf, "fx_occurrence"), START, END)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return c.accepted(flagged(spark, sf))


@query("p3_rejection_waterfall", "fx_occurrence", PARSED + "SELECT seq, species_id, source, reason FROM labelled")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return c.label_rejections(flagged(spark, sf)).select("seq", "species_id", "source", "reason")


@query("p4_quality_tier", "fx_occurrence", CLEAN + """
SELECT seq, uncertainty_m, CASE WHEN uncertainty_m <= 1000 THEN 'high' WHEN uncertainty_m IS NULL OR uncertainty_m <= 10000 THEN 'medium' ELSE 'low' END AS source_quality FROM clean""")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).select("seq", "uncertainty_m", "source_quality")


@query("p5_eligibility", "fx_occurrence", CLEAN + """
SELECT species_id, source, count(*) AS records, CASE WHEN count(*) >= 300 THEN 'trainable' WHEN count(*) >= 100 THEN 'trainable but low confidence'
  ELSE 'insufficient for ML, use rule-based for now' END AS training_eligibility FROM clean GROUP BY 1, 2""")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    counts = clean(spark, sf).groupBy("species_id", "source").agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("training_eligibility", c.eligibility_tier("records"))


@query("p6_verified_fields", "fx_field", """
tagged AS (SELECT *, CASE WHEN iy * 31 + ix * 7 + day(day_date) * 13 = 1999 THEN 'Synthetic fill' ELSE 'MUR v4.1' END AS sst_source FROM fx_field)
SELECT day_date AS date, iy, ix, sst_source FROM tagged WHERE day_date NOT IN (SELECT day_date FROM tagged WHERE lower(sst_source) LIKE '%synthetic%')""")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("iy") * 31 + F.col("ix") * 7 + F.day("date") * 13 == 1999
    tagged = view(spark, sf, "fx_field").withColumnRenamed("day_date", "date").withColumn(
        "sst_source", F.when(odd, "Synthetic fill").otherwise("MUR v4.1")
    )
    return c.verified_fields(tagged).select("date", "iy", "ix", "sst_source")


FIRST_IN_SOURCE = "SELECT seq, species_id, source, d AS date, round(lat, 4) AS rounded_lat, round(lon, 4) AS rounded_lon FROM clean"


@query("d1_first_in_source", "fx_occurrence", CLEAN + FIRST_IN_SOURCE)
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).select("seq", "species_id", "source", "date", "rounded_lat", "rounded_lon")


@query("d2_cross_source", "fx_occurrence", CLEAN + """
SELECT seq, species_id, source, d AS date FROM clean
QUALIFY row_number() OVER (PARTITION BY species_id, d, round(lat, 4), round(lon, 4) ORDER BY source, seq) = 1""")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return c.merge_sources(clean(spark, sf)).select("seq", "species_id", "source", "date")


@query("d3_priority_merge", "fx_occurrence", CLEAN + """
, sets AS (SELECT *, CASE WHEN uncertainty_m > 5000 THEN 0 WHEN source = 'GBIF' THEN 1 ELSE 2 END AS p FROM clean)
SELECT seq, species_id, source, CAST(p AS BIGINT) AS priority FROM sets
QUALIFY row_number() OVER (PARTITION BY species_id, d, round(lat, 4), round(lon, 4) ORDER BY p, source, seq) = 1""")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean(spark, sf)
    rough = F.col("uncertainty_m") > 5000
    sets = [rows.where(rough), rows.where(~rough & (F.col("source") == "GBIF")), rows.where(~rough & (F.col("source") != "GBIF"))]
    return c.merge_by_priority(sets).select("seq", "species_id", "source", "priority")


@query("d4_union_columns", "fx_training fx_occurrence", """
SELECT row_id, species_id, day_date AS date, CAST(label AS BIGINT) AS label, grid_lat, NULL::VARCHAR AS source FROM fx_training
UNION ALL SELECT seq AS row_id, species_id, NULL::DATE AS date, NULL::BIGINT AS label, NULL::DOUBLE AS grid_lat, source FROM fx_occurrence""")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "fx_training").select(
        "row_id", "species_id", F.col("day_date").alias("date"), F.col("label").cast("long").alias("label"), "grid_lat"
    )
    b = view(spark, sf, "fx_occurrence").select(F.col("seq").alias("row_id"), "species_id", "source")
    return a.unionByName(b, allowMissingColumns=True)


def published_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One published file per (date, species, model) of the training rows."""
    deep = F.when(F.col("row_id") % 4 == 0, "_deep").otherwise("")
    name = F.concat(
        F.lit("predictions/"), F.col("day_date").cast("string"), F.lit("_"), F.lower(F.regexp_replace("species_id", "[^A-Za-z]+", "")),
        F.lit("_500m"), deep, F.lit("_heatmap_top.geojson.gz"),
    )
    names = view(spark, sf, "fx_training").select(name.alias("file_name")).distinct()
    return published.file_entries(names)


ENTRIES = """
entries AS (SELECT DISTINCT day_date AS date, lower(regexp_replace(species_id, '[^A-Za-z]+', '', 'g')) AS species_id,
  CASE WHEN row_id % 4 = 0 THEN 'deep_learning' ELSE 'scikit_learn' END AS model_source FROM fx_training)
"""


@query("d5_common_dates", "fx_training", ENTRIES + """
SELECT date FROM entries WHERE species_id IN ('low', 'high', 'medium') GROUP BY date HAVING count(DISTINCT species_id) = 3""")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return published.common_dates(published_entries(spark, sf), ["low", "high", "medium"])


@query("d5_chosen_dates", "fx_training", ENTRIES + """
, common AS (SELECT max(date) AS d FROM (SELECT date FROM entries WHERE species_id IN ('low', 'high', 'medium') GROUP BY date HAVING count(DISTINCT species_id) = 3) t)
SELECT species_id, coalesce((SELECT d FROM common), max(date)) AS date FROM entries WHERE species_id IN ('low', 'high', 'medium') GROUP BY species_id""")
def d5b(spark: SparkSession, sf: str) -> DataFrame:
    return published.chosen_dates(published_entries(spark, sf), ["low", "high", "medium"], preferred="1960-01-01")


@query("d6_dates_subset", "fx_training", """
SELECT b.species_id, count(*) AS background_only_dates FROM (SELECT DISTINCT species_id, day_date FROM fx_training WHERE label = 0) b
LEFT JOIN (SELECT DISTINCT species_id, day_date FROM fx_training WHERE label = 1) p ON p.species_id = b.species_id AND p.day_date = b.day_date
WHERE p.day_date IS NULL GROUP BY 1""")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "fx_training")
    days = t.groupBy("species_id", "day_date").agg(
        F.bool_or(F.col("label") == 1).alias("p"), F.bool_or(F.col("label") == 0).alias("b")
    )
    return days.where("b and not p").groupBy("species_id").agg(F.count(F.lit(1)).alias("background_only_dates"))


@query("d7_distinct_dates", "fx_occurrence", CLEAN + "SELECT DISTINCT d AS date FROM clean")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return c.distinct_dates(clean(spark, sf))


@query("a1_waterfall_counts", "fx_occurrence", PARSED + "SELECT species_id, source, count(*) AS raw_count, "
       + ", ".join(f"count(*) FILTER (reason = '{r}') AS removed_{r}" for r in c.REASONS)
       + ", count(*) FILTER (reason IS NULL) AS cleaned_count FROM labelled GROUP BY 1, 2")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return c.waterfall_counts(flagged(spark, sf))


@query("a2_species_summary", "fx_occurrence", CLEAN + """
SELECT species_id, count(*) AS records, CAST(min(year(d)) AS BIGINT) AS year_min, CAST(max(year(d)) AS BIGINT) AS year_max, count(DISTINCT d) AS unique_dates,
  count(*) FILTER (inside) AS records_in_prediction_bbox, CASE WHEN count(*) >= 300 THEN 'trainable' WHEN count(*) >= 100 THEN 'trainable but low confidence'
  ELSE 'insufficient for ML, use rule-based for now' END AS training_eligibility FROM clean GROUP BY 1""")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return c.species_summary(clean(spark, sf))


@query("a3_dates_per_year", "fx_training", """
SELECT species_id, CAST(year(day_date) AS BIGINT) AS year, count(DISTINCT day_date) AS unique_dates FROM fx_training GROUP BY 1, 2""")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "fx_training").select("species_id", F.col("day_date").alias("date"), F.year("day_date").cast("long").alias("year"))
    return c.dates_per_year(t)


@query("s4_arrival_cap", "fx_occurrence", """
SELECT seq, species_id, row_number() OVER (PARTITION BY species_id ORDER BY seq) AS arrival FROM fx_occurrence""")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its place in the order of arrival, which a cap would go by."""
    return c.capped_by_arrival(view(spark, sf, "fx_occurrence")).select("seq", "species_id", "arrival")


@query("x1_training_dates", "fx_training", """
SELECT DISTINCT species_id, day_date AS date, CAST(year(day_date) AS BIGINT) AS year, CAST(month(day_date) AS BIGINT) AS month FROM fx_training""")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "fx_training").select(
        "species_id", F.col("day_date").alias("date"), F.year("day_date").cast("long").alias("year"), F.month("day_date").cast("long").alias("month")
    )
    return c.training_dates(t)


@query("j9_rows_on_dates", "fx_physics fx_occurrence", CLEAN + """
SELECT day_date AS date, count(*) AS n FROM fx_physics WHERE day_date IN (SELECT d FROM clean) GROUP BY 1""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    samples = view(spark, sf, "fx_physics").withColumnRenamed("day_date", "date")
    return c.rows_on_dates(samples, clean(spark, sf)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
