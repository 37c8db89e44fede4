"""Keyed training against plain versions, one species at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import keyed_models as km
from tidegrid.operators import metrics, models

COLUMNS = ["a", "b", "c"]
EFFORT = km.Effort(trees=8, boosts=10)


def made(n=900, seed=3):
    draw = np.random.default_rng(seed)
    pdf = pd.DataFrame(draw.normal(size=(n, 3)), columns=COLUMNS)
    pdf["species_id"] = draw.choice(["x", "y"], n)
    strength = np.where(pdf.species_id == "x", 2 * pdf.a, -2 * pdf.b)
    pdf["label"] = (strength + draw.normal(size=n) > 0.8).astype(int)
    pdf["row_id"] = np.arange(n)
    pdf["grp"] = "g"
    pdf.loc[::7, "c"] = np.nan
    return pdf


def sets(spark, features=((0, 1, 2), (1, 2))):
    rows = [(s, "g", f"set{i}", f"set{i}", 5, False, list(f)) for s in "xy" for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "species_id string, grp string, set_name string, prefix string, ratio long, tuned boolean, features array<int>")


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(made())
    return km.fit_models(rows, sets(spark), COLUMNS, km.BASELINES, "row_id", EFFORT)


def standard(pdf):
    x = pdf[COLUMNS].fillna(pdf[COLUMNS].median())
    return ((x - x.mean()) / x.std()).to_numpy()


def test_logistic_equals_newton_alone(fitted):
    pdf = made()
    for model in fitted.where("kind = 'logistic'").collect():
        mine = pdf[pdf.species_id == model["species_id"]]
        used = list(model["features"])
        x = np.append(standard(mine)[:, used], np.ones((len(mine), 1)), axis=1)
        y = mine.label.to_numpy()
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        ridge, a = np.append(np.full(len(used), km.RIDGE), 1e-9), np.zeros(len(used) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ a))
            a += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * a)
        assert np.allclose(np.array(model["coefficients"])[[*used, 3]], a, atol=1e-6)
        assert all(model["coefficients"][k] == 0 for k in range(3) if k not in used)


def walked(model, x):
    """The score of one standardised row, node by node."""
    array = {k: np.frombuffer(model[k], dtype=km._TYPES[k]) for k in km._PACKED}
    edges = array["edges"].reshape(-1, km.BINS - 1)
    total = 0.0
    for at in array["roots"]:
        while array["left"][at] >= 0:
            feature = model["features"][array["feature"][at]]
            at = array["left"][at] + (x[feature] > edges[feature][array["bin"][at]])
        total += array["value"][at]
    return total if model["kind"] == "forest" else 1 / (1 + np.exp(-(model["base"] + total)))


def test_rows_meet_the_models_of_their_species(spark, fitted):
    pdf = made()
    rows = spark.createDataFrame(pdf)
    got = {(r["row_id"], r["candidate_id"]): r["raw_score"] for r in km.score_rows(rows, fitted, COLUMNS, ["row_id", "label"]).collect()}
    assert len(got) == 6 * len(pdf)
    ready = {s: dict(zip(pdf[pdf.species_id == s].row_id, standard(pdf[pdf.species_id == s]))) for s in "xy"}
    for model in fitted.collect():
        for row_id, x in list(ready[model["species_id"]].items())[::9]:
            if model["kind"] == "logistic":
                want = 1 / (1 + np.exp(-(x @ np.array(model["coefficients"][:3]) + model["coefficients"][3])))
            else:
                want = walked(model, x)
            assert abs(got[row_id, f"{model['prefix']}__{model['name']}"] - want) < 1e-9


def test_models_rank_and_name_what_matters(spark, fitted):
    rows = spark.createDataFrame(made(seed=8)).withColumn("split", F.lit("validation"))
    found = models.split_metrics(rows, fitted, COLUMNS, "row_id").where("candidate_id LIKE 'set0%'").collect()
    assert len(found) == 6 and all(r["roc_auc"] > 0.8 for r in found)
    own = fitted.where("prefix = 'set0' AND kind = 'booster'")
    lost = km.permutation_importance(rows, own, COLUMNS, "row_id", metrics.evaluate)
    lost = {(r["species_id"], r["feature"]): r["importance"] for r in lost.collect()}
    assert len(lost) == 6 and lost["x", "a"] > 0.2 > 0.05 > abs(lost["x", "b"]) and lost["y", "b"] > 0.2 > 0.05 > abs(lost["y", "a"])


def test_trees_take_a_bounded_sample(spark):
    rows = spark.createDataFrame(made())
    ready = km.ready_rows(rows, km.preprocessing(rows, COLUMNS, "row_id"), COLUMNS, "row_id")
    whole, some = (km._packed_groups(ready, 3, "row_id", n).collect() for n in (10_000, 100))
    assert sum(len(r["y"]) // 8 for r in whole) == 900
    for r in some:
        y = np.frombuffer(r["y"])
        assert 100 <= len(y) <= 102 and 0.1 < y.mean() < 0.6


def test_odd_groups(spark):
    pdf = made(120)
    pdf.loc[:9, "species_id"] = None
    pdf["a"] = np.nan
    pdf.loc[pdf.species_id == "y", "label"] = 0  # one class: no model
    rows = spark.createDataFrame(pdf).withColumn("a", F.lit(None).cast("double"))
    found = km.fit_models(rows, sets(spark), COLUMNS, km.BASELINES, "row_id", EFFORT)
    assert {r["species_id"] for r in found.collect()} == {"x"}
    scored = km.score_rows(rows.drop("b"), found, COLUMNS, ["row_id"])
    assert scored.count() == 6 * (pdf.species_id == "x").sum() and scored.where("raw_score IS NULL OR isnan(raw_score)").isEmpty()
    empty = rows.limit(0)
    assert km.fit_models(empty, sets(spark), COLUMNS, km.BASELINES, "row_id", EFFORT).isEmpty()
    assert km.score_rows(empty, found, COLUMNS, ["row_id"]).isEmpty()


def test_species_without_models_have_reasons(spark):
    pdf = made(900)
    pdf["split"] = np.where(pdf.row_id % 3 == 0, "validation", "train")
    pdf.loc[pdf.index[pdf.species_id == "y"][:-60], "label"] = 0
    rows = spark.createDataFrame(pdf.rename(columns={"a": "sst_c", "b": "depth_m", "c": "zos"}).drop(columns="grp"))
    run = models.train_all(rows, "row_id", EFFORT, ratios=(10,), tuned=False, sets={"one": ("sst_c", "depth_m", "zos")})
    got = {r["species_id"]: (r["status"], r["reason"]) for r in run.candidates.collect()}
    assert got["x"] == ("trained", "") and got["y"] == ("not_trained", "fewer than 100 presence records; rule-based only")
    assert run.candidates.where("species_id = 'x'").count() == 3
    few = models.train_all(rows.drop("zos"), "row_id", EFFORT, ratios=(10,), tuned=False, sets={"one": ("sst_c", "depth_m", "zos")})
    assert {r["reason"] for r in few.candidates.where("species_id = 'x'").collect()} == {"no usable environmental feature columns"}
