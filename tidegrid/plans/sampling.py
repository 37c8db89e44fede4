"""Queries of background sampling and splits (X2-X9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_name
from ..operators import sampling as sm
from ..operators.alignment import matched_only
from ..session import cut
from .alignment import MATCH, field, matched, simple_grid, training
from .expressions import bins_sql
from .registry import query

CUTS = {"train_until": "1998-12-31", "validation_until": "2000-12-31"}
TIME_SQL = "CASE WHEN day_date <= DATE '1998-12-31' THEN 'train' WHEN day_date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END"


def presence(spark: SparkSession, sf: str) -> DataFrame:
    """Matched presences, written once: sampling reads them several times."""
    return cut(matched_only(matched(spark, sf)))


PRESENCE = MATCH + """
, pres AS (SELECT species_id, date, printf('%.4f_%.4f', grid_lat, grid_lon) AS grid_id FROM matched WHERE drop_reason IS NULL),
cells AS (SELECT day_date AS date, printf('%.4f_%.4f', lat, lon) AS grid_id, lon, sst_c, ocean_mask FROM grid)
"""


@query("x2_same_day_background", "fx_occurrence fx_field fx_static", PRESENCE + """
, need AS (SELECT species_id, date, count(*) * 10 AS need FROM pres GROUP BY 1, 2),
pool AS (SELECT n.species_id, n.date, c.grid_id, n.need FROM need n JOIN cells c ON c.date = n.date ANTI JOIN pres p ON p.species_id = n.species_id AND p.date = n.date AND p.grid_id = c.grid_id
  WHERE c.sst_c IS NOT NULL AND coalesce(c.ocean_mask, TRUE)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY species_id, date ORDER BY md5(concat_ws('|', '42', species_id, CAST(date AS VARCHAR), grid_id))) AS r, count(*) OVER (PARTITION BY species_id, date) AS n FROM pool)
SELECT species_id, date, grid_id, unnest(range(r - 1, need, n)) AS pick, need > n AS short_of_cells FROM ranked WHERE r <= need""")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    cells = simple_grid(spark, sf).withColumn("grid_id", cell_name("lat", "lon"))
    drawn = sm.same_day_background(presence(spark, sf), cells)
    return drawn.select("species_id", "date", "grid_id", "pick", "short_of_cells")


@query("x3_downsample", "fx_training", """
p AS (SELECT species_id, count(*) FILTER (label = 1) AS p FROM fx_training GROUP BY 1),
b AS (SELECT row_id, species_id, row_number() OVER (PARTITION BY species_id ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR)))) AS r FROM fx_training WHERE label = 0)
SELECT row_id, CAST(1 AS BIGINT) AS label FROM fx_training WHERE label = 1 UNION ALL SELECT row_id, CAST(0 AS BIGINT) AS label FROM b JOIN p USING (species_id) WHERE r <= p * 5""")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return sm.downsample_background(training(spark, sf), 5, ["species_id"], "row_id").select("row_id", "label")


POOLS = f"""
bg AS (SELECT *, coalesce({bins_sql('depth_m', (-1, 50, 100, 200, 500, 1000, 5000))}, -1) AS db, coalesce({bins_sql('distance_to_shelf_break', (-1, 5, 20, 50, 100, 200, 10000))}, -1) AS sb FROM fx_training WHERE label = 0),
pr AS (SELECT * FROM fx_training WHERE label = 1),
quota AS (SELECT species_id, greatest(1, (SELECT count(*) FROM pr WHERE pr.species_id = b.species_id) // count(DISTINCT (db, sb))) AS q FROM bg b GROUP BY 1),
strat AS (SELECT *, row_number() OVER (PARTITION BY species_id, db, sb ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR)))) AS r FROM bg),
pools AS (SELECT species_id, row_id, 'random_ocean_background' AS strategy FROM bg
 UNION ALL SELECT species_id, row_id, 'offshore_constrained_background' FROM bg WHERE depth_m >= 50
 UNION ALL SELECT s.species_id, pr.row_id, 'target_group_background' FROM pr JOIN (SELECT DISTINCT species_id FROM fx_training) s ON s.species_id <> pr.species_id WHERE pr.depth_m >= 50
 UNION ALL SELECT species_id, row_id, 'environment_stratified_background' FROM strat JOIN quota USING (species_id) WHERE r <= q
 UNION ALL SELECT species_id, row_id, 'spatial_buffered_background' FROM bg b WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.species_id = b.species_id AND pr.day_date = b.day_date AND round(pr.grid_lat, 2) = round(b.grid_lat, 2) AND round(pr.grid_lon, 2) = round(b.grid_lon, 2)))
"""


@query("x4_strategy_pools", "fx_training", POOLS + "SELECT species_id, row_id, strategy FROM pools")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return sm.strategy_pools(training(spark, sf)).select("species_id", "row_id", F.col("audit_background_strategy").alias("strategy"))


@query("x4_strategy_samples", "fx_training", POOLS + """
, ratios AS (SELECT unnest([3, 5, 10]) AS ratio), counts AS (SELECT species_id, count(*) AS p FROM pr GROUP BY 1),
drawn AS (SELECT species_id, strategy, ratio, row_id, row_number() OVER (PARTITION BY species_id, strategy, ratio ORDER BY md5(concat_ws('|', 'ratio', CAST(100 + ratio AS VARCHAR), CAST(row_id AS VARCHAR)))) AS r FROM pools, ratios)
SELECT d.species_id, d.strategy, CAST(ratio AS BIGINT) AS ratio, row_id, CAST(0 AS BIGINT) AS label FROM drawn d JOIN counts USING (species_id) WHERE r <= p * ratio
UNION ALL SELECT pr.species_id, s.strategy, CAST(ratio AS BIGINT) AS ratio, row_id, CAST(1 AS BIGINT) AS label FROM pr, ratios, (SELECT DISTINCT strategy FROM pools) s""")
def x4_samples(spark: SparkSession, sf: str) -> DataFrame:
    return sm.strategy_samples(training(spark, sf)).select(
        "species_id", F.col("audit_background_strategy").alias("strategy"),
        F.col("audit_background_ratio").cast("long").alias("ratio"), "row_id", "label",
    )


@query("x5_temporal_split", "fx_training", f"""
t AS (SELECT row_id, species_id, label, {TIME_SQL} AS split FROM fx_training),
ok AS (SELECT species_id FROM (SELECT species_id, split FROM t GROUP BY 1, 2 HAVING count(DISTINCT label) = 2) c GROUP BY 1 HAVING count(*) = 3)
SELECT row_id, split, 'time_split' AS split_strategy FROM t WHERE species_id IN (SELECT species_id FROM ok)""")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return sm.assign_splits(training(spark, sf), "row_id", **CUTS).select("row_id", "split", "split_strategy")


@query("x6_stratified_split", "fx_training", """
r AS (SELECT row_id, (row_number() OVER (PARTITION BY species_id, label ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR)))) - 1) / CAST(greatest(count(*) OVER (PARTITION BY species_id, label) - 1, 1) AS DOUBLE) AS share FROM fx_training)
SELECT row_id, CASE WHEN share < 0.7e0 THEN 'train' WHEN share < 0.85e0 THEN 'validation' ELSE 'test' END AS split, 'stratified_random_low_data' AS split_strategy FROM r""")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    """Default cut years leave every row in train, so the random split is taken."""
    return sm.assign_splits(training(spark, sf), "row_id").select("row_id", "split", "split_strategy")


@query("x6_whole_days_split", "fx_training", """
u AS (SELECT DISTINCT species_id, day_date FROM fx_training),
r AS (SELECT *, (row_number() OVER (PARTITION BY species_id ORDER BY md5(concat_ws('|', '42', species_id, CAST(day_date AS VARCHAR)))) - 1) / CAST(greatest(count(*) OVER (PARTITION BY species_id) - 1, 1) AS DOUBLE) AS share FROM u)
SELECT row_id, CASE WHEN share < 0.7e0 THEN 'train' WHEN share < 0.85e0 THEN 'validation' ELSE 'test' END AS split FROM fx_training JOIN r USING (species_id, day_date)""")
def x6_days(spark: SparkSession, sf: str) -> DataFrame:
    return sm.random_part(training(spark, sf), "row_id", ["species_id"], group_by="date").select("row_id", "split")


BLOCKS = f"""
named AS (SELECT row_id, species_id, depth_m, {TIME_SQL} AS time_split, printf('%.1f_%.1f', floor(grid_lat), floor(grid_lon)) AS block_id FROM fx_training),
ranked AS (SELECT species_id, block_id, (row_number() OVER (PARTITION BY species_id ORDER BY block_id) - 1) % 5 AS place, count(*) OVER (PARTITION BY species_id) AS n FROM (SELECT DISTINCT species_id, block_id FROM named) b),
blocked AS (SELECT row_id, depth_m, block_id, time_split, CASE WHEN n >= 3 THEN CASE place WHEN 0 THEN 'validation' WHEN 2 THEN 'test' ELSE 'train' END END AS spatial_split FROM named JOIN ranked USING (species_id, block_id))
"""


def split_columns(spark: SparkSession, sf: str) -> DataFrame:
    data = training(spark, sf).withColumn("time_split", sm.temporal_part(**CUTS))
    blocked = sm.spatial_block_split(data)
    return blocked.withColumns({
        "spatial_temporal_split": sm.spatial_temporal_part("spatial_split", "time_split"),
        "offshore_time_split": F.when(F.col("depth_m") >= 100, F.col("time_split")),
    })


@query("x7_spatial_block_split", "fx_training", BLOCKS + "SELECT row_id, block_id, spatial_split FROM blocked")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return split_columns(spark, sf).select("row_id", "block_id", "spatial_split")


@query("x8_spatial_temporal_split", "fx_training", BLOCKS + """
SELECT row_id, CASE WHEN spatial_split = time_split THEN spatial_split END AS spatial_temporal_split, CASE WHEN depth_m >= 100 THEN time_split END AS offshore_time_split FROM blocked""")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return split_columns(spark, sf).select("row_id", "spatial_temporal_split", "offshore_time_split")


@query("x9_candidate_cells", "fx_occurrence fx_field fx_static", PRESENCE + """
, held AS (SELECT DISTINCT date, grid_id FROM pres), n AS (SELECT date, count(*) AS held FROM held GROUP BY 1),
o AS (SELECT c.date, c.grid_id, row_number() OVER (PARTITION BY c.date ORDER BY md5(concat_ws('|', '42', CAST(c.date AS VARCHAR), c.grid_id))) AS r
  FROM cells c WHERE c.lon > 150 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.date = c.date AND h.grid_id = c.grid_id))
SELECT date, grid_id, TRUE AS is_presence_cell FROM held UNION ALL SELECT o.date, o.grid_id, FALSE AS is_presence_cell FROM o LEFT JOIN n USING (date) WHERE r <= 90 - coalesce(held, 0)""")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    cells = field(spark, sf).select("date", "lat", "lon", cell_name("lat", "lon").alias("grid_id"))
    made = sm.candidate_cells(cells, presence(spark, sf), 90, east_of=150.0)
    return made.select("date", "grid_id", "is_presence_cell")
