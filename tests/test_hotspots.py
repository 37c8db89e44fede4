"""Spaced selection against a plain one-pass greedy, and the nearest point against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators.hotspots import band_quotas, spaced_spots
from tidegrid.operators.nearest import nearest_point, nearest_points


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def plain_greedy(rows, limit, apart):
    """One pass over all rows, straight from the description of the operator."""
    rows = sorted(rows, key=lambda r: (-r["score"], r["row_id"]))
    quotas, picked = band_quotas(limit), []

    def band(r):
        d = r["distance_to_coast_km"]
        return "nearshore" if d <= 20 else "midshore" if d <= 50 else "offshore"

    def segment(r):
        return max(0, min(7, int((r["lat"] + 36.5) / 4.5 * 8)))

    def best(test):
        for r in rows:
            if test(r) and all(km((r["lat"], r["lon"]), (s["lat"], s["lon"])) >= apart for s in picked) and r not in picked:
                return r
        return None

    def held(b, s=None):
        return sum(band(r) == b and (s is None or segment(r) == s) for r in picked)

    for floor in (95, 85, 75):
        for b in ("nearshore", "midshore"):
            for s in range(8):
                if held(b) < quotas[b] and held(b, s) == 0 and len(picked) < limit:
                    r = best(lambda r: band(r) == b and segment(r) == s and r["score"] >= floor)
                    picked += [r] if r else []
    for floor in (85, 60):
        for b in ("nearshore", "midshore", "offshore"):
            while held(b) < quotas[b] and len(picked) < limit:
                r = best(lambda r: band(r) == b and r["score"] >= floor)
                if not r:
                    break
                picked.append(r)
    while len(picked) < limit and (r := best(lambda r: True)):
        picked.append(r)
    return [r["row_id"] for r in picked]


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(3)
    n = 1500
    t = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, "hot", "cold"), "row_id": np.arange(n),
        "lat": -36.5 + rng.random(n) ** 2 * 4.5, "lon": 150.5 + rng.random(n) ** 3 * 4,
        "score": np.round(rng.random(n) * 100, 0),
    })
    t["distance_to_coast_km"] = (t.lon - 150.5) * 40
    return t


@pytest.mark.parametrize("limit, apart, pool", [(30, 4.0, 1000), (30, 20.0, 3), (50, 9.0, 5), (1, 4.0, 1), (7, 15.0, 2)])
def test_same_as_plain_greedy(spark, cells, limit, apart, pool):
    got = spaced_spots(spark.createDataFrame(cells), ["k"], "row_id", limit, apart, pool_size=pool).toPandas()
    for key, part in cells.groupby("k"):
        want = plain_greedy(part.to_dict("records"), limit, apart)
        mine = got[got.k == key].sort_values("spot_rank")
        assert sorted(mine.row_id) == sorted(want)
        assert list(mine.score) == sorted(mine.score, reverse=True)
        spots = list(zip(mine.lat, mine.lon))
        assert all(km(a, b) >= apart for i, a in enumerate(spots) for b in spots[:i])


def test_request_bounds(spark, cells):
    with pytest.raises(ValueError):
        spaced_spots(spark.createDataFrame(cells), ["k"], "row_id", limit=51)


@pytest.mark.parametrize("points", ["spread", "cluster", "far", "none"])
def test_nearest_is_exact(spark, points):
    rng = np.random.default_rng(11)
    q = pd.DataFrame({"id": np.arange(300), "lat": rng.uniform(-37, 2, 300), "lon": rng.uniform(-3, 155, 300)})
    n = {"spread": 200, "cluster": 150, "far": 3, "none": 0}[points]
    centre = {"spread": (-20, 100, 20, 60), "cluster": (-33, 151, 0.05, 0.05), "far": (60, -170, 3, 3), "none": (0, 0, 1, 1)}[points]
    p = pd.DataFrame({
        "poi_id": np.arange(n), "lat": centre[0] + rng.uniform(-1, 1, n) * centre[2],
        "lon": centre[1] + rng.uniform(-1, 1, n) * centre[3], "kind": [f"k{i % 4}" for i in range(n)],
    })
    sp = spark.createDataFrame(p.values.tolist(), "poi_id long, lat double, lon double, kind string")
    got = nearest_point(spark.createDataFrame(q), sp, ["poi_id", "kind"]).toPandas().set_index("id")
    assert len(got) == 300
    for r in q.itertuples():
        row = got.loc[r.id]
        if n == 0:
            assert np.isnan(row.nearest_km)
            continue
        distances = [km((r.lat, r.lon), (x.lat, x.lon)) for x in p.itertuples()]
        assert row.nearest_km == pytest.approx(min(distances), abs=1e-5)


@pytest.mark.parametrize("where", ["north", "date line", "poles", "ties"])
def test_nearest_on_the_whole_sphere(spark, where):
    rng = np.random.default_rng(5)
    lat, lon = {"north": (85 + rng.uniform(-4, 4.9, 260), rng.uniform(-180, 180, 260)), "date line": (rng.uniform(-3, 3, 260), 180 + rng.uniform(-3, 3, 260)),
                "poles": (rng.choice([-1, 1], 260) * (90 - rng.exponential(0.5, 260)), rng.uniform(-180, 180, 260)),
                "ties": (rng.integers(-3, 3, 260) * 1.0, 178 + rng.integers(0, 5, 260) * 1.0)}[where]
    lon = (lon + 180) % 360 - 180
    q, p = list(zip(range(100), lat[:100].tolist(), lon[:100].tolist())), list(zip(range(160), lat[100:].tolist(), lon[100:].tolist()))
    q += [(100, None, 3.0), (101, float("nan"), 3.0), (102, 0.0, float("inf")), (103, 95.0, 0.0)]
    rows, points = spark.createDataFrame(q, "id long, lat double, lon double"), spark.createDataFrame(p + [(900, None, None)], "poi_id long, lat double, lon double")
    one = {r["id"]: (r["nearest_poi_id"], r["nearest_km"]) for r in nearest_point(rows, points, ["poi_id"]).collect()}
    five = {}
    for r in nearest_points(rows, points, ["poi_id"], 5).collect():
        five.setdefault(r["id"], {})[r["nearest_rank"]] = (r["nearest_poi_id"], r["nearest_km"])
    assert set(one) == set(range(104)) and set(five) == set(range(100))
    assert all(one[i] == (None, None) for i in range(100, 104))
    for i, y, x in q[:100]:
        want = sorted((round(km((y, x), (b, a)), 6), j) for j, b, a in p)[:5]
        got = [five[i][n + 1] for n in range(5)]
        assert got[0] == one[i]
        assert [d for _, d in got] == pytest.approx([d for d, _ in want], abs=2e-6)
        if where == "ties":
            assert [j for j, _ in got] == [j for _, j in want]


def test_fewer_points_than_asked_for(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    points = spark.createDataFrame([(5, 1.0, 0.0), (6, 1.0, 0.0), (7, 0.0, 3.0)], "poi_id long, lat double, lon double")
    got = nearest_points(rows, points, ["poi_id"], 9).orderBy("nearest_rank").select("nearest_rank", "nearest_poi_id")
    assert [tuple(r) for r in got.collect()] == [(1, 5), (2, 6), (3, 7)]
