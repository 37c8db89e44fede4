"""Distributed ranks against pandas, with hot groups, heavy ties, gaps and constants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import ranking
from tidegrid.operators.metrics import evaluate


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 6000
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str))
    value = np.where(rng.random(n) < 0.5, 1.0, np.round(rng.normal(size=n), 2))
    value = np.where(rng.random(n) < 0.1, np.nan, value)
    value[group == "3"] = 4.0
    return pd.DataFrame({
        "id": rng.permutation(n).astype("int64"), "g": group, "v": value,
        "label": (rng.random(n) < 0.2).astype("int64"),
    })


@pytest.fixture(scope="module")
def frame(spark, table):
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "id long, g string, v double, label long")
    return df.repartition(5)


def back(df, column):
    return df.toPandas().set_index("id")[column].sort_index().astype(float)


def test_average_rank(table, frame):
    want = table.set_index("id").groupby("g").v.rank(method="average", pct=True).sort_index() * 100
    got = back(ranking.average_rank_percentile(frame, ["g"], "v", "o", "id"), "o")
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_first_rank_and_relative(table, frame):
    t = table.sort_values(["v", "id"]).set_index("id")
    place = t[t.v.notna()].groupby("g").cumcount()
    size = t[t.v.notna()].groupby("g").v.transform("count")
    flat = t[t.v.notna()].groupby("g").v.transform(lambda s: s.max() - s.min()) < 1e-12
    first = ((place + 1) / size * 100).where(~flat, 50.0).reindex(t.index).sort_index()
    relative = (place / (size - 1).clip(lower=1) * 100).where(~flat, 50.0).reindex(t.index).sort_index()
    got = back(ranking.first_rank_percentile(frame, ["g"], "v", "id", "o"), "o")
    pd.testing.assert_series_equal(got, first, check_names=False)
    got = back(ranking.relative_score(frame, ["g"], "v", "id", "o"), "o")
    pd.testing.assert_series_equal(got, relative, check_names=False)


def test_quantiles(table, frame):
    shares = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.99, "e": 1.0}
    got = ranking.exact_quantiles(frame, ["g"], "v", shares, "id").toPandas().set_index("g").sort_index()
    for name, p in shares.items():
        want = table.groupby("g").v.quantile(p).sort_index()
        np.testing.assert_allclose(got[name], want, rtol=0, atol=1e-12)


def test_no_bucket_holds_a_hot_group(frame):
    ranked = ranking.bucketed(frame, ["g"], "v", "id")
    largest = ranked.rows.groupBy(*ranked.bucket).count().agg(F.max("count")).first()[0]
    assert largest < 0.12 * frame.count()


def test_top_n_and_hash_ranks(spark, table, frame):
    got = ranking.top_n(frame, ["g"], [F.desc_nulls_last("v"), F.col("id")], 7).toPandas()
    want = table.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(7)
    assert set(got.id) == set(want.id)
    ranks = {}
    for parts in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = ranking.hash_ranks(frame, ["g"], ranking.hash_key("id"), "r", "n").toPandas()
        ranks[parts] = out.set_index("id").sort_index()[["r", "n"]]
        assert (out.groupby("g").r.apply(lambda s: sorted(s) == list(range(1, len(s) + 1)))).all()
    pd.testing.assert_frame_equal(ranks["3"], ranks["8"])


def naive_metrics(y, s, ids):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    ap = np.mean([y[s >= p].sum() / (s >= p).sum() for p in pos])
    order = np.lexsort((ids, -s))
    top = order[: int(np.ceil(len(y) * 0.1))]
    return auc, ap, y[top].sum() / y.sum()


def test_metrics(table, frame):
    scored = frame.where("v is not null").withColumn("p", F.try_divide(F.lit(1.0), 1 + F.exp(-F.col("v"))))
    got = evaluate(scored, ["g"], "label", "p", "id").toPandas().set_index("g")
    for g, part in table[table.v.notna()].groupby("g"):
        y, s = part.label.to_numpy(), (1 / (1 + np.exp(-part.v))).round(12).to_numpy()
        if 0 < y.sum() < len(y):
            auc, ap, hit = naive_metrics(y, s, part.id.to_numpy())
            row = got.loc[g]
            assert (row.roc_auc, row.pr_auc, row.top_10_hit_rate) == pytest.approx((auc, ap, hit), abs=1e-9)
        else:
            assert np.isnan(got.loc[g].roc_auc)


@pytest.mark.parametrize("few, buckets", [(100_000, 4096), (4, 3)])
def test_quantiles_of_columns_by_ranges(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(ranking, "FEW_ROWS", few)
    monkeypatch.setattr(ranking, "RANGE_BUCKETS", buckets)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 400), "x": rng.normal(size=400) ** 5, "y": rng.integers(0, 3, 400) * 1.0, "z": np.exp(rng.normal(size=400) * 9)})
    pdf.loc[::6, "x"] = np.nan
    pdf.loc[pdf.g == "b", "y"] = 7.0
    rows = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "xyz"}).withColumn("none", F.lit(None).cast("double"))
    for share in (0.5, 0.0, 0.9, 1.0):
        got = {(r["g"], r["column"]): r["value"] for r in ranking.column_quantiles(rows, ["g"], ["x", "y", "z", "none"], share).collect()}
        want = {(None if pd.isna(g) else g, i): part[c].dropna().quantile(share) for g, part in pdf.groupby("g", dropna=False) for i, c in enumerate("xyz")}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert ranking.column_quantiles(rows.limit(0), ["g"], ["x"]).isEmpty()
    assert [tuple(r) for r in ranking.column_quantiles(rows, [], ["y"]).collect()] == [(0, pdf.y.median())]
