"""Invariants and small fixtures of cleaning, scores, sampling, fields and sources."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import TRAIN_BOX, PREDICT_BOX
from tidegrid.functions import dates, geo, suitability
from tidegrid.functions.numbers import number
from tidegrid.operators import alignment, cleaning, display, fields, hotspots, sampling
from tidegrid.schemas import text_schema
from tidegrid.sources import landed, published, tabular


@pytest.mark.parametrize("text, want, precision", [
    ("2015-01-05T10:00", dt.date(2015, 1, 5), "day"), ("2015-1-5", dt.date(2015, 1, 5), "day"),
    ("2015-03", dt.date(2015, 3, 1), "month"), ("2015", dt.date(2015, 1, 1), "year"),
    ("2015/01/05", dt.date(2015, 1, 1), "year"), ("2015-02-30", dt.date(2015, 2, 1), "month"), ("", None, None),
])
def test_lenient_dates(spark, text, want, precision):
    row = spark.createDataFrame([(text,)], "t string").select(dates.lenient_date("t"), dates.date_precision("t")).first()
    assert tuple(row) == (want, precision)


@pytest.mark.parametrize("text, want", [("", None), ("nan", None), ("inf", None), ("None", None), ("1e3", 1000.0), (" 7 ", 7.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(number("t")).first()[0] == want


def test_lattice_by_integer_index(spark):
    assert geo.lattice_size(PREDICT_BOX, 0.005) == (901, 801)
    cells = geo.lattice(spark, PREDICT_BOX, 0.05).toPandas()
    assert len(cells) == 91 * 81 and cells.lat.max() == -32.0 and cells.lon.max() == 154.5


def rule(spark, species, **context):
    row = {"sst_c": 20.0, "gradient_strength": 0.0, "current_speed_m_s": 0.4, "poi_type": "canyon", "depth_class": "deep",
           "eddy_signal": False, "data_confidence": "mock", "month": 4, **context}
    profile = suitability.profiles(spark).where(F.col("species_id") == species)
    joined = profile.select("*", *[F.lit(v).alias(k) for k, v in row.items()])
    return suitability.rule_score(joined).first()


def test_rule_scores(spark):
    ideal = rule(spark, "yellowfin_tuna", sst_c=22.0, gradient_strength=1.6, current_speed_m_s=0.8, month=4)
    poor = rule(spark, "yellowfin_tuna", sst_c=15.0, gradient_strength=0.1, current_speed_m_s=0.2, poi_type="harbour_departure", depth_class="shallow", month=8)
    assert 0 <= poor["score"] < ideal["score"] <= 100
    fad = rule(spark, "mahi_mahi", sst_c=24.0, poi_type="fad_demo", month=2)
    bare = rule(spark, "mahi_mahi", sst_c=17.0, poi_type="current_edge", depth_class="shallow", month=7)
    assert fad["score"] > bare["score"]
    assert len(ideal["key_drivers"]) == 4 and poor["limiting_factor"] is not None
    assert suitability.profiles(spark).count() == 7


def test_waterfall_adds_up(spark):
    rows = [(i, "a", "OBIS", lat, lon, day, unc) for i, (lat, lon, day, unc) in enumerate([
        ("-33", "152", "2020-01-01", "10"), ("-33", "152", "2020-01-01", "10"), ("", "152", "2020-01-01", "10"),
        ("nan", "152", "2020-01-01", "10"), ("-33", "999", "2020-01-01", "10"), ("-33", "152", "", "10"),
        ("-33", "152", "2001-01-01", "10"), ("-33", "152", "2027-01-01", "10"), ("-20", "152", "2020-01-01", "10"),
        ("-33", "152", "2020-01-02", "20000"), ("-33", "152", "2020-01-03", None), ("-33", "152", "2020-01-04", "nan"),
    ])]
    raw = spark.createDataFrame(rows, "seq long, species_id string, source string, lat_text string, lon_text string, event_date_text string, uncertainty_m string")
    flagged = cleaning.with_reason(raw)
    counts = cleaning.waterfall_counts(flagged).first().asDict()
    assert counts["raw_count"] == 12 and counts["cleaned_count"] == 3
    assert sum(v for k, v in counts.items() if k.startswith("removed_")) == 9
    assert counts["removed_invalid_coordinates"] == 2 and counts["removed_missing_coords"] == 1
    labelled = cleaning.label_rejections(flagged).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in labelled}[None] == 3
    tiers = {r["seq"]: r["source_quality"] for r in cleaning.accepted(flagged).collect()}
    assert tiers == {0: "high", 10: "medium", 11: "low"}


def numpy_gradient(grid):
    gy, gx = np.gradient(grid)
    return np.hypot(gx, gy)


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(9, 7))
    grid[rng.random(grid.shape) < 0.15] = np.nan
    rows = [(0, int(y) * 5, int(x) * 2, None if np.isnan(grid[y, x]) else float(grid[y, x])) for y in range(9) for x in range(7)]
    field = spark.createDataFrame(rows, "date int, iy int, ix int, v double")
    got = fields.grid_gradient(field, "v", "g").toPandas()
    want = numpy_gradient(grid)
    for r in got.itertuples():
        w = want[r.iy // 5, r.ix // 2]
        assert (np.isnan(w) and (r.g is None or np.isnan(r.g))) or r.g == pytest.approx(w, abs=1e-12)


def presence_and_grid(spark, cells=6):
    grid = spark.createDataFrame(
        [(dt.date(2020, 1, d), f"c{i}", 20.0 if i else None, True) for d in (1, 2, 3) for i in range(cells)],
        "date date, grid_id string, sst_c double, ocean_mask boolean",
    )
    presence = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), "c1"), ("a", dt.date(2020, 1, 2), "c2"), ("b", dt.date(2020, 1, 1), "c3"), ("b", dt.date(2020, 1, 9), "c3")],
        "species_id string, date date, grid_id string",
    )
    return presence, grid


def test_background_draw(spark):
    presence, grid = presence_and_grid(spark)
    drawn = sampling.same_day_background(presence, grid, ratio=10).toPandas()
    assert len(drawn) == 30 and drawn.short_of_cells.all()
    held = {(r.species_id, r.date, r.grid_id) for r in presence.collect()}
    assert not held & set(zip(drawn.species_id, drawn.date, drawn.grid_id))
    assert (drawn.groupby(["species_id", "date"]).grid_id.value_counts() >= 2).all()  # replacement is even
    few = sampling.same_day_background(presence, grid, ratio=3).toPandas()
    assert not few.short_of_cells.any() and not few.duplicated(["species_id", "date", "grid_id"]).any()
    capped = sampling.same_day_background(presence, grid, ratio=3, cap=4).toPandas()
    assert capped.groupby("species_id").size().to_dict() == {"a": 4, "b": 3}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = sampling.same_day_background(presence, grid, ratio=3).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = ["species_id", "date", "grid_id", "pick"]
    pd.testing.assert_frame_equal(few[key].sort_values(key, ignore_index=True), again[key].sort_values(key, ignore_index=True))


def test_splits_cover_and_guard(spark):
    rows = [(i, "big", dt.date(2018 + i % 7, 1, 1 + i % 25), int(i % 3 == 0)) for i in range(300)]
    rows += [(1000 + i, "one_class", dt.date(2020, 1, 1), 0) for i in range(30)]
    rows += [(2000 + i, "old", dt.date(2010, 1, 1 + i % 20), int(i % 4 == 0)) for i in range(100)]
    data = spark.createDataFrame(rows, "row_id long, species_id string, date date, label int")
    out = sampling.assign_splits(data, "row_id").toPandas()
    assert len(out) == 430 and out.split.notna().all()
    kinds = out.groupby("species_id").split_strategy.first().to_dict()
    assert kinds == {"big": "time_split", "one_class": "insufficient_for_split", "old": "stratified_random_low_data"}
    assert out[out.species_id == "old"].split.value_counts().to_dict() == pytest.approx({"train": 70, "validation": 15, "test": 15}, abs=2)
    whole = sampling.assign_splits(data, "row_id", group_by="date").toPandas()
    assert (whole[whole.species_id == "old"].groupby("date").split.nunique() == 1).all()


def test_as_of_directions(spark):
    def days(*values):
        return spark.createDataFrame([(dt.date(2020, 1, v),) for v in values], "date date")

    back = {r["date"].day: r["source_date"] and r["source_date"].day for r in alignment.as_of_dates(days(1, 5, 20), days(2, 5, 6), max_age_days=10).collect()}
    assert back == {1: None, 5: 5, 20: None}
    near = {r["date"].day: r["source_date"] and r["source_date"].day for r in alignment.as_of_dates(days(1, 4, 20), days(2, 6), max_age_days=3, direction="nearest").collect()}
    assert near == {1: 2, 4: 2, 20: None}


def test_contrast_score_bounds_and_nulls(spark):
    rows = [(i, "a", None if i % 9 == 0 else (i * 37 % 100) / 100, None if i % 7 == 0 else float(i * 13 % 3000), None if i % 11 == 0 else float(i % 150), (i * 17 % 90) / 100) for i in range(400)]
    cells = spark.createDataFrame(rows, "cell_id long, species_id string, raw_score double, depth_m double, distance_to_coast_km double, sst_front_strength double")
    out = display.contrast_score(cells, ["species_id"], "cell_id").toPandas()
    assert len(out) == 400 and out.score.between(0, 100).all()


def test_html_tables(spark):
    page = """<TABLE><tr><th>Name</th><th>Lat</th></tr>
    <tr><td>(1A) <b>Port  Point</b></td><td>33&deg; 45.5'</td><td>151&deg; 30.0'</td><td>x</td><td>90</td></tr>
    <tr><td>no position</td><td>-</td><td>-</td><td>x</td><td>1</td></tr>
    <tr><td>Copy</td><td>33 45.5</td><td>151 30.0</td><td>x</td><td>91</td></tr>
    <tr><td>Bay FAD</td><td>at 34 15.0 S, 152 06.0 E</td></tr></TABLE>"""
    rows = landed.coordinate_rows(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    found = {(r["id"], r["latitude"], r["longitude"]) for r in rows}
    assert found == {("port_point", -33.758333, 151.5), ("bay_fad", -34.25, 152.1)}


def test_files_round_trip(spark, tmp_path):
    schema = text_schema("a", "b")
    assert tabular.read_text_csv(spark, str(tmp_path / "absent.csv"), schema).count() == 0
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in tabular.read_text_csv(spark, str(tmp_path / "t.csv"), schema).collect()] == [("1", "x"), ("2", None)]
    assert tabular.read_table(spark, str(tmp_path / "t.csv"), schema).count() == 2
    cells = spark.createDataFrame([(1.5, -33.0, 152.0, dt.date(2020, 1, 1)), (float("nan"), -34.0, 153.0, dt.date(2020, 1, 2))], "score double, lat double, lon double, date date")
    tabular.write_table(cells, str(tmp_path / "p.parquet"), ["date"], csv=str(tmp_path / "p.csv"))
    read = tabular.read_table(spark, str(tmp_path / "p"), cells.schema)
    assert sorted((r["score"] is None, r["lat"]) for r in read.collect()) == [(False, -33.0), (True, -34.0)]
    published.write_geojson(cells, str(tmp_path / "g"), ["score"])
    lines = spark.read.text(str(tmp_path / "g"))
    docs = lines.select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("text"))
    assert landed.geojson_rows(docs, ["score"]).count() == 2
    for name in ("x", "y"):
        published.append_provenance(spark, str(tmp_path / "prov"), dataset_name=name)
    log = spark.read.parquet(str(tmp_path / "prov")).collect()
    assert len(log) == 2 and all(len(r) == 14 and r["download_date"] for r in log)


def test_new_days_only(spark, tmp_path):
    def days(*values):
        return spark.createDataFrame([(dt.date(2020, 1, v), v) for v in values], "date date, n int")

    path = str(tmp_path / "days")
    tabular.write_new_days(days(1, 2), path)
    tabular.write_new_days(days(2, 3), path, spark.read.parquet(path))
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_file_names(spark):
    names = ["p/2025-08-16_mahi_mahi_500m_heatmap_top.geojson", "p/2025-08-17_mahi_mahi_500m_deep_heatmap_top.geojson.gz", "p/readme.txt"]
    rows = published.file_entries(spark.createDataFrame([(n,) for n in names], "file_name string")).collect()
    assert {(str(r[0]), r[1], r[2]) for r in rows} == {("2025-08-16", "mahi_mahi", "scikit_learn"), ("2025-08-17", "mahi_mahi", "deep_learning")}


def test_banned_day(spark):
    day = dt.date(2020, 1, 1)
    rows = [(day, 1.0, 2.0, 3.0, "MUR"), (day, 1.0, 2.0, 3.0, "proxy field"), (dt.date(2020, 1, 2), 1.0, 2.0, 3.0, "MUR")]
    field = spark.createDataFrame(rows, "date date, lat double, lon double, sst_c double, sst_source string")
    assert cleaning.verified_fields(field).count() == 1
    with pytest.raises(ValueError):
        cleaning.verified_fields(field.drop("sst_c"))


def test_rule_hotspot_lists(spark):
    points = spark.createDataFrame(
        [(i, "fad_demo", "deep", -34.0 + i / 10, 151.0 + i / 10, 22.0, 1.0) for i in range(9)],
        "poi_id long, poi_type string, depth_class string, lat double, lon double, sst_c double, gradient_strength double",
    )
    context = hotspots.rule_context(points, month=2)
    assert hotspots.rule_hotspots(context).count() == 35
    assert hotspots.rule_hotspots(context, species_id="mahi_mahi").count() == 9
    assert geo.box_wkt(TRAIN_BOX).startswith("POLYGON((148.5 -39.0")
