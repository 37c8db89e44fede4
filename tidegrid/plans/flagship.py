"""The flagship question: how much usable presence data does each species have?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import eligibility_tier
from .alignment import MATCH, matched
from .registry import query


@query("flagship_presence_summary", "fx_occurrence fx_field fx_static", MATCH + """
SELECT species_id, count(*) AS clean_records, count(*) FILTER (drop_reason IS NULL) AS matched, count(*) FILTER (drop_reason = 'no_such_cell') AS no_such_cell,
  count(*) FILTER (drop_reason = 'missing_sst') AS missing_sst, count(*) FILTER (drop_reason = 'land_cell') AS land_cell, count(DISTINCT date) FILTER (drop_reason IS NULL) AS matched_dates,
  round(avg(sst_c) FILTER (drop_reason IS NULL), 6) AS mean_sst_c, CASE WHEN count(*) FILTER (drop_reason IS NULL) >= 300 THEN 'trainable' WHEN count(*) FILTER (drop_reason IS NULL) >= 100 THEN 'trainable but low confidence'
  ELSE 'insufficient for ML, use rule-based for now' END AS training_eligibility FROM matched GROUP BY 1""")
def presence_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, snap, match against the daily grid, and summarise per species."""
    ok = F.col("drop_reason").isNull()
    out = matched(spark, sf).groupBy("species_id").agg(
        F.count(F.lit(1)).alias("clean_records"),
        F.count_if(ok).alias("matched"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in ("no_such_cell", "missing_sst", "land_cell")],
        F.count_distinct(F.when(ok, F.col("date"))).alias("matched_dates"),
        F.round(F.avg(F.when(ok, F.col("sst_c"))), 6).alias("mean_sst_c"),
    )
    return out.withColumn("training_eligibility", eligibility_tier("matched"))
