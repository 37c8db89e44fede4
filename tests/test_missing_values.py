"""Missing values: a NULL input is no best value, and no row is lost for it."""

import datetime

from pyspark.sql import functions as F

from tidegrid.functions.geo import coast_segment, haversine_km, world_pixel
from tidegrid.functions.numbers import clamp
from tidegrid.operators.display import front_cells, stratified_export, thinned_vectors
from tidegrid.operators.metrics import evaluate
from tidegrid.operators.sampling import assign_splits, downsample_background


def test_null_stays_null(spark):
    x, y = world_pixel(F.col("v"), F.lit(151.0), 8)
    row = spark.createDataFrame([(None,)], "v double").select(
        clamp("v").alias("c"), haversine_km("v", F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("km"), coast_segment("v").alias("seg"),
        y.alias("y")).first()
    assert (row["c"], row["km"], row["seg"], row["y"]) == (None, None, 0, None)


def test_rows_without_score_are_not_ranked(spark):
    rows = [(i, i % 2, i / 10) for i in range(1, 9)]
    shape = "id long, label long, s double"
    full = evaluate(spark.createDataFrame(rows, shape).withColumn("g", F.lit(1)), ["g"], "label", "s", "id").first()
    more = spark.createDataFrame(rows + [(90, 0, None), (91, 1, None)], shape).withColumn("g", F.lit(1))
    assert evaluate(more, ["g"], "label", "s", "id").first() == full


def test_splits_keep_undated_rows_and_null_groups(spark):
    day = datetime.date
    parts = [day(1990, 1, 1), day(1999, 6, 1), day(2005, 1, 1), None]
    rows = [(n, s, parts[n % 4], (n // 4) % 2) for n, s in enumerate(["a", None] * 20)]
    rows += [(100 + n, "b", parts[n % 2], (n // 2) % 2) for n in range(20)]
    df = spark.createDataFrame(rows, "row_id long, species_id string, date date, label long")
    out = assign_splits(df, "row_id", train_until="1998-12-31", validation_until="2000-12-31").collect()
    assert sorted(r["row_id"] for r in out) == sorted(r[0] for r in rows)
    assert all(r["split"] is not None for r in out)
    assert {r["split"] for r in out if r["split_strategy"] == "time_split" and r["date"] is None} <= {"train"}


def test_downsampling_keeps_null_groups(spark):
    rows = [(n, None, int(n < 2)) for n in range(12)]
    df = spark.createDataFrame(rows, "row_id long, species_id string, label long")
    out = downsample_background(df, 2, ["species_id"], "row_id").collect()
    assert sum(r["label"] for r in out) == 2 and len(out) == 6


def test_limits_are_the_callers_choice(spark):
    df = spark.range(500).select(
        F.col("id").alias("cell_id"), F.lit(1).alias("g"), F.lit(0.5).alias("sst_gradient"), F.lit(1.0).alias("current_speed"),
        F.col("id").cast("double").alias("score"), F.when(F.col("id") % 2 == 0, "Prime").otherwise("Masked").alias("rating"))
    assert front_cells(df, [F.col("cell_id")]).count() == 500 and front_cells(df, [F.col("cell_id")], limit=3).count() == 3
    assert thinned_vectors(df, ["g"], "cell_id", 10).count() == 12 and thinned_vectors(df, ["g"], "cell_id", 10, limit=5).count() == 5
    assert stratified_export(df, ["g"], "cell_id").count() == 500
    drawn = stratified_export(df, ["g"], "cell_id", {"Prime": 7})
    assert {r["rating"]: r["count"] for r in drawn.groupBy("rating").count().collect()} == {"Prime": 7, "Masked": 250}
    assert stratified_export(df, ["g"], "cell_id", total=9).count() == 9
