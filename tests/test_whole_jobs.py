"""Queries that once stopped at a cap, and work that once grew by copies."""

from pyspark.sql import functions as F

from tidegrid.operators.cleaning import capped_by_arrival
from tidegrid.operators.display import stratified_export
from tidegrid.plans import QUERIES


def test_every_arrival_is_kept_and_numbered(spark):
    rows = spark.range(900).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("species_id"))
    got = {(r["species_id"], r["arrival"]): r["seq"] for r in capped_by_arrival(rows).collect()}
    assert len(got) == 900 and got["s1", 1] == 1 and got["s1", 300] == 898 and got[None, 300] == 897
    few = capped_by_arrival(rows, 200).collect()
    assert len(few) == 600 and max(r["arrival"] for r in few) == 200


def test_every_rated_cell_is_exported_with_its_draw(spark):
    cells = spark.range(400).select(F.col("id").alias("cell_id"), F.lit("a").alias("g"), F.lit("Prime").alias("rating"), F.lit(1.0).alias("score"))
    assert sorted(r["draw"] for r in stratified_export(cells, ["g"], "cell_id").collect()) == list(range(1, 401))
    assert sorted(r["draw"] for r in stratified_export(cells, ["g"], "cell_id", {"Prime": 7}).collect()) == list(range(1, 8))


def test_queries_keep_what_lies_beyond_the_old_caps(spark, tmp_path):
    spark.range(1500).select(
        F.col("id").alias("event_id"), F.lit("one").alias("event_type"), (F.col("id") % 50).alias("user_id"),
        F.lit("2024-01-05 00:00:00").cast("timestamp").alias("ts"), F.lit(1.5).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20_500).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2).alias("l_partkey"), F.lit(3).alias("l_suppkey"),
        F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit("1995-03-01").cast("date").alias("l_shipdate"),
        F.lit(900.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.lit(9.0).alias("l_quantity"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["s4_arrival_cap"](spark, str(tmp_path)).count() == 1500
    assert QUERIES["t3_stratified_export"](spark, str(tmp_path)).count() == 20_500
