"""Trees are fitted on every row of a group, in blocks that change no tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_keyed_models import COLUMNS, EFFORT, made, sets
from tidegrid.operators import keyed_models as km
from tidegrid.operators import trees


def _rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("x").alias("species_id"), F.lit("g").alias("grp"), (F.xxhash64("id") % 1000).alias("a"), (F.xxhash64(F.col("id") + n) % 1000).alias("b"),
        F.lit(None).cast("double").alias("c")).withColumn("label", (F.col("a") + F.col("b") / 10 > 0).cast("int"))


@pytest.mark.parametrize("estimator", [km.Estimator("t", "booster", depth=1, leaf=14_000, rate=0.1), km.Estimator("t", "forest", depth=1, leaf=12_000)])
def test_no_row_of_a_large_group_is_left_out(spark, estimator):
    # a node keeps so many rows only where all 30,000 are fitted
    rows = _rows(spark, 30_000)
    for estimators in ((estimator,), (km.BASELINES[0], estimator)):
        model = km.fit_models(rows, sets(spark, ((0, 1),)), COLUMNS, estimators, "row_id", km.Effort(trees=4, boosts=1)).where("name = 't'").first()
        assert (np.frombuffer(model["left"], dtype=km._TYPES["left"]) >= 0).any()


def test_a_group_is_packed_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(km, "FIT_BLOCK_ROWS", 70)
    pdf = made()
    rows = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)
    ready = km.ready_rows(rows, km.preprocessing(rows, COLUMNS, "row_id"), COLUMNS, "row_id")
    blocks = km._packed_groups(ready, 3, "row_id").orderBy("part").collect()
    kept = {(r["species_id"], r["row_id"]): (r["x"], r["label"]) for r in ready.collect()}
    for species in "xy":
        mine = [b for b in blocks if b["species_id"] == species]
        x, y = (np.array(v) for v in zip(*[kept[k] for k in sorted(kept) if k[0] == species]))
        edges = trees.bin_edges(x)
        assert len(mine) == -(-len(x) // 70) and {b["edges"] for b in mine} == {edges.tobytes()}
        got = np.concatenate([np.frombuffer(b["bins"], dtype=np.uint8).reshape(3, -1) for b in mine], axis=1)
        assert np.array_equal(got.T, trees.binned(x, edges)) and np.array_equal(np.concatenate([np.frombuffer(b["y"]) for b in mine]), y)


def test_rows_without_an_id_are_packed_last(spark):
    pdf = made()
    rows = spark.createDataFrame(pdf).withColumn("row_id", F.when(F.col("label") == 0, F.col("row_id")))
    ready = km.ready_rows(rows, km.preprocessing(rows, COLUMNS, "row_id"), COLUMNS, "row_id")
    for block in km._packed_groups(ready, 3, "row_id").collect():
        y = np.frombuffer(block["y"])
        assert len(y) == (pdf.species_id == block["species_id"]).sum() and np.array_equal(y, np.sort(y)) and 0 < y.sum() < len(y)


def test_blocks_and_shares_change_no_model(spark, monkeypatch):
    rows = spark.createDataFrame(made())
    packed = ("edges", "feature", "bin", "left", "value", "roots", "importance")

    def fitted():
        found = km.fit_models(rows, sets(spark), COLUMNS, km.BASELINES, "row_id", EFFORT).where("kind <> 'logistic'").collect()
        return {(r["species_id"], r["set_name"], r["name"]): [r[c] for c in packed] for r in found}

    want = fitted()
    monkeypatch.setattr(km, "FIT_BLOCK_ROWS", 70)
    assert fitted() == want and len(want) == 8


@pytest.mark.parametrize("depth", [4, 20])
def test_trees_grow_alike_in_blocks_of_rows_and_nodes(monkeypatch, depth):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 5))
    bins, y = trees.binned(x, trees.bin_edges(x)), (x[:, 0] * x[:, 1] > draw.normal(size=3000)).astype(float)

    def both():
        return trees.forest(bins, y, np.ones(3000), trees=3, depth=depth, leaf=1, seed=3)[0], trees.booster(bins, y, np.ones(3000), rounds=3, depth=4, leaf=2, rate=0.1, l2=0.0)[0]

    want = both()
    # whole numbers and few rows: sums of blocks are exact in the forest
    monkeypatch.setattr(trees, "_BLOCK", 100)
    monkeypatch.setattr(trees, "_NODES", 3)
    got = both()
    for k in ("feature", "bin", "left", "value"):
        assert np.array_equal(getattr(got[0], k), getattr(want[0], k))
    assert np.allclose(got[1].sums(bins), want[1].sums(bins), atol=1e-9)
