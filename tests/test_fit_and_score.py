"""Samples by hash without ranking every row, scoring beside the blocks, first steps of trees looked up."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_keyed_models import COLUMNS, EFFORT, made, sets
from tidegrid.operators import keyed_models as km
from tidegrid.operators import trees
from tidegrid.operators.ranking import hash_firsts, hash_key, hash_ranks
from tidegrid.operators.sampling import downsample_background, downsample_unshuffled


@pytest.mark.parametrize("depth", [5, 6, 14])
def test_first_steps_are_looked_up(depth):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1500, 5))
    x[:, 3] = x[:, 3] > 0
    bins, y = trees.binned(x, trees.bin_edges(x)), (x[:, 0] * x[:, 1] + x[:, 3] > 0.5).astype(float)
    if depth == 14:
        found, _ = trees.forest(bins, y, np.ones(1500), trees=5, depth=depth, leaf=1, seed=3)
    else:
        found, _, _ = trees.booster(bins, y, np.ones(1500), rounds=5, depth=depth, leaf=1, rate=0.1, l2=0.0)
    want = np.zeros(1500)
    for row in range(1500):
        for at in found.roots:
            while found.left[at] >= 0:
                at = found.left[at] + (bins[row, found.feature[at]] > found.bin[at])
            want[row] += found.value[at]
    assert np.array_equal(found.sums(bins), want) and found.made is not None
    masks, nodes, ended = found.made
    assert masks.dtype == (np.uint32 if depth == 5 else np.uint64) and ended.all() == (depth < 14)


def test_first_rows_by_hash_equal_the_ranks(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    order = hash_key("id", seed=9)
    limit = F.when(F.col("g").isNull(), 20).when(F.col("g") == 0, 0).when(F.col("g") == 1, F.col("_size")).otherwise(700)
    got = hash_firsts(rows, ["g"], order, lambda sizes: sizes.withColumn("_limit", limit)).collect()
    want = hash_ranks(rows, ["g"], order, "_rank", "_size").where(F.col("_rank") <= limit).select("id", "g").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in want) and len(got) == 20 + 700 + sum(r["g"] == 1 for r in want)


def test_rows_that_come_twice_count_twice(spark):
    rows = spark.range(300).select(F.floor(F.col("id") / 2).alias("id"), F.lit("x").alias("g"))
    assert hash_firsts(rows, ["g"], hash_key("id"), lambda sizes: sizes.withColumn("_limit", F.lit(101))).count() == 101


def test_downsampled_rows_are_the_same(spark):
    rows = spark.createDataFrame(made()).withColumn("species_id", F.when(F.col("row_id") % 5 > 0, F.col("species_id")))
    rows = rows.unionByName(rows.where("label = 0").withColumns({"species_id": F.lit("none"), "row_id": F.col("row_id") + 10_000}))
    want, got = (sorted(r["row_id"] for r in draw(rows, 2, ["species_id"], "row_id").collect()) for draw in (downsample_background, downsample_unshuffled))
    assert got == want and len(got) > 900 - sum(made().label)


def test_large_groups_are_drawn_alike_with_and_without_logistic_models(spark, monkeypatch):
    rows, keyed = spark.createDataFrame(made()), sets(spark)
    ranked = rows.withColumn("_h", hash_key("row_id", seed="fit")).withColumns({
        "_n": F.count("*").over(Window.partitionBy("species_id")),
        "_size": F.count("*").over(Window.partitionBy("species_id", "label")),
        "_rank": F.row_number().over(Window.partitionBy("species_id", "label").orderBy("_h"))})
    want = {r["row_id"] for r in ranked.where("_rank <= ceil(_size * least(1d, 200d / _n))").collect()}
    drawn = []
    real = km.fitting_rows

    def spy(*args):
        found = real(*args)
        drawn.append({r["row_id"] for r in found.collect()})
        return found

    monkeypatch.setattr(km, "fitting_rows", spy)
    booster = [e for e in km.BASELINES if e.kind == "booster"]
    for estimators in (booster, [km.BASELINES[0], *booster]):
        km.fit_models(rows, keyed, COLUMNS, tuple(estimators), "row_id", EFFORT, fit_rows=200).count()
    assert drawn == [want, want] and 400 <= len(want) <= 408


def test_few_models_meet_blocks_without_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame(made())
    models = km.fit_models(rows, sets(spark, ((0, 1, 2),)), COLUMNS, (km.BASELINES[2],), "row_id", EFFORT)
    beside = km.score_rows(rows, models, COLUMNS, ["row_id"], salts=(16, 1))
    plan = beside._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(km, "BESIDE_BYTES", 0)
    dealt = km.score_rows(rows, models, COLUMNS, ["row_id"], salts=(16, 1))
    assert sorted(beside.collect()) == sorted(dealt.collect()) and beside.count() == 900
