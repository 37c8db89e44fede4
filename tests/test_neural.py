"""The perceptron trained over blocks of rows: MLlib's net, whatever partitions the rows come in."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegrid.operators import models, neural

NAMES = ["a", "b"]


def net(steps=20):
    return MultilayerPerceptronClassifier(layers=[2, 8, 4, 2], maxIter=steps, seed=42, labelCol="label", featuresCol="features")


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 2))
    return spark.createDataFrame([(float(a), float(b), int(a + 0.5 * b > 0.1 + 0.4 * np.sin(7 * i)), i) for i, (a, b) in enumerate(x)], "a double, b double, label long, row_id long")


def test_the_gradient_is_the_slope_of_the_loss():
    draw = np.random.default_rng(1)
    layers, x, y = [3, 5, 4, 2], draw.normal(size=(40, 3)), draw.integers(0, 2, 40)
    w = draw.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 2 + 2)
    _, gradient = neural.loss_and_gradient(w, layers, x, y)
    for k in range(0, len(w), 5):
        step = np.zeros(len(w))
        step[k] = 1e-5
        slope = (neural.loss_and_gradient(w + step, layers, x, y)[0] - neural.loss_and_gradient(w - step, layers, x, y)[0]) / 2e-5
        assert abs(slope - gradient[k]) < 1e-5


def test_it_is_mllibs_net_and_as_good(spark, rows):
    ours = neural.fit(rows, NAMES, net())
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    loss = {}
    for name, model in (("ours", ours), ("mllib", net().fit(vectors)), ("first", neural.with_weights(spark, net()))):
        p = vector_to_array("probability")[F.col("label").cast("int")]
        loss[name] = model.transform(vectors).select(F.avg(-F.log(p))).first()[0]
    x, y = (np.array(v) for v in zip(*[((r["a"], r["b"]), r["label"]) for r in rows.collect()]))
    mine = neural.loss_and_gradient(ours.weights.toArray(), [2, 8, 4, 2], x, y)[0] / len(y)
    assert abs(mine - loss["ours"]) < 1e-9  # the weights stand where MLlib reads them
    assert loss["ours"] < 0.7 * loss["first"] and abs(loss["ours"] - loss["mllib"]) < 0.05


def test_rows_are_dealt_evenly(spark, rows, monkeypatch):
    monkeypatch.setattr(neural, "LEAST_ROWS", 100)
    monkeypatch.setattr(neural, "BLOCK_ROWS", 64)
    blocks = neural.packed(rows.coalesce(1), NAMES, 3000)
    sizes = [r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("y")).alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 3000 and max(sizes) - min(sizes) <= len(sizes)
    whole = neural.mean_loss(neural.packed(rows.coalesce(1), NAMES, 1), [2, 8, 4, 2], 3000)
    w = neural.with_weights(spark, net()).weights.toArray()
    assert np.allclose(neural.mean_loss(blocks, [2, 8, 4, 2], 3000)(w)[1], whole(w)[1], atol=1e-12)


def test_many_rows_are_trained_so_and_few_by_mllib(spark, rows, monkeypatch):
    asked, real = [], neural.fit
    monkeypatch.setattr(neural, "fit", lambda *args: asked.append(args[1]) or real(*args))
    models.fit_candidate(rows, NAMES, net(2), "row_id")
    assert asked == []
    monkeypatch.setattr(neural, "MLLIB_ROWS", 2999)
    scores = models.fit_candidate(rows, NAMES, net(2), "row_id").score(rows, keep=["row_id"]).collect()
    assert asked == [NAMES] and len(scores) == 3000 and all(0 <= r["raw_score"] <= 1 for r in scores)
    assert real(rows.limit(0), NAMES, net()).weights == neural.with_weights(spark, net()).weights


def test_mllibs_weights_hang_on_the_partitions(rows):
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    one, three = (net().fit(vectors.repartition(n)).weights.toArray() for n in (1, 3))
    assert np.abs(one - three).max() > 1e-6
