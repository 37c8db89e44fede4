"""Training and scoring do no work twice: equal sets, blocks of rows, features that are not tried."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_keyed_models import COLUMNS, EFFORT, made, sets
from tidegrid.operators import keyed_models as km
from tidegrid.operators import models, trees
from tidegrid.plans import modelling


@pytest.fixture(scope="module")
def fitted(spark):
    same = sets(spark, ((0, 1, 2), (0, 1, 2), (1, 2))).withColumn("tuned", F.col("set_name") == "set1")
    return km.fit_models(spark.createDataFrame(made()), same, COLUMNS, (*km.BASELINES[:1], km.Estimator("f", "forest", depth=4, leaf=5, tuned=True)), "row_id", EFFORT)


def test_sets_of_the_same_columns_share_a_model(fitted):
    got = {(r["species_id"], r["set_name"], r["name"]): r for r in fitted.collect()}
    assert {k[1:] for k in got} == {*((f"set{i}", "logistic_regression_balanced") for i in range(3)), ("set1", "f")} and len(got) == 8
    a, b = (got["x", s, "logistic_regression_balanced"] for s in ("set0", "set1"))
    assert a["coefficients"] == b["coefficients"] and a["prefix"] == "set0" and b["prefix"] == "set1"


def test_equal_models_are_scored_once(spark, fitted, monkeypatch):
    scored, real = [], models.score_rows

    def spy(rows, found, *args, **kw):
        scored.append(found.count())
        return real(rows, found, *args, **kw)

    monkeypatch.setattr(models, "score_rows", spy)
    rows = spark.createDataFrame(made(seed=8)).withColumn("split", F.lit("validation"))
    found = {(r["species_id"], r["candidate_id"]): r["roc_auc"] for r in models.split_metrics(rows, fitted, COLUMNS, "row_id").collect()}
    assert scored == [6] and len(found) == 8
    assert found["x", "set0__logistic_regression_balanced"] == found["x", "set1__logistic_regression_balanced"]


def test_salts_change_no_score(spark, fitted, monkeypatch):
    monkeypatch.setattr(km, "PACK_ROWS", 300)
    monkeypatch.setattr(km, "BLOCK_ROWS", 70)
    rows = spark.createDataFrame(made())
    every = [sorted(km.score_rows(rows, fitted, COLUMNS, ["row_id"], salts=s).collect()) for s in ((1, 16), (16, 1), (3, 2))]
    assert len(every[0]) == 4 * 900 and len({len(e) for e in every}) == 1
    for e in every[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12 for a, b in zip(every[0], e))


def test_baselines_train_without_the_grid(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(modelling, "held_samples", lambda *_: spark.range(1))
    monkeypatch.setattr(models, "train_all", lambda data, row_id, **kw: asked.append(kw) or kw)
    monkeypatch.setattr(modelling, "_MADE", {})
    modelling.baselines(spark, "nowhere")
    assert asked == [{"tuned": False}]


def test_blocks_of_one_model_a_key_are_not_copied(spark, monkeypatch):
    salts, real = [], models.score_rows

    def spy(*args, **kw):
        salts.append(kw["salts"])
        return real(*args, **kw)

    monkeypatch.setattr(models, "score_rows", spy)
    rows = spark.createDataFrame(made().rename(columns={"a": "sst_c", "b": "depth_m", "c": "zos"}).drop(columns="grp"))
    rows = rows.withColumn("s1", F.when(F.col("row_id") % 3 == 0, "validation").otherwise("train"))
    found = models.split_validation(rows, "row_id", {"one": "s1"}, ("sst_c", "depth_m", "zos"), EFFORT).collect()
    assert {r["status"] for r in found} == {"evaluated"} and len(salts) == 2
    assert all(by_model == 1 for _, by_model in salts)


def test_a_walk_equals_steps_node_by_node():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 4))
    edges = trees.bin_edges(x)
    bins, y = trees.binned(x, edges), (x[:, 0] * x[:, 1] > 0).astype(float)
    found, _ = trees.forest(bins, y, np.ones(400), trees=7, depth=12, leaf=2, seed=3)
    want = np.zeros(400)
    for row in range(400):
        for at in found.roots:
            while found.left[at] >= 0:
                at = found.left[at] + (bins[row, found.feature[at]] > found.bin[at])
            want[row] += found.value[at]
    assert np.allclose(found.sums(bins), want, atol=1e-12) and len(found.sums(bins[:0])) == 0
    # equal rows have equal sums, in a block of any size
    whole = found.sums(bins)
    assert all(np.array_equal(found.sums(bins[:n]), whole[:n]) for n in (1, 3, 50, 399))
