"""Entities, name rule, as-of chain, notes and caps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import suitability as suit
from tidegrid.operators import alignment, hotspots
from tidegrid.sources import landed, published


@pytest.mark.parametrize("text, want", [
    ("a &amp;lt; b &lt;", "a &lt; b <"), ("34&deg; 5&#39; &#x53; &#8242;", "34° 5' S ′"), ("&nope; &#xD800; &#0; &", "&nope; &#xD800; &#0; &"),
    ("&#38;#38; &#38;", "&#38; &"), ("plain", "plain"), ("", ""), (None, None), ("&#128031;", "\U0001f41f"),
])
def test_entities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(landed.unescaped(F.col("t"))).first()[0] == want


def test_names_of_rows_without_columns(spark):
    row = "<tr><td>7</td><td>{}</td><td>34° 10.5' S, 151° 20' E</td></tr>"
    html = row.format("off Port Kembla").replace("34", "35") + row.format("nowhere") + "<tr><td>FAD 1</td><td>33° 1' S 152° 2' E</td></tr>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = {(r["name"], r["latitude"], r["longitude"]) for r in landed.coordinate_rows(pages).collect()}
    assert got == {("off Port Kembla", -35.175, 151.333333), ("7", -34.175, 151.333333), ("FAD 1", -33.016667, 152.033333)}


def test_as_of_chain(spark):
    days = lambda *ds: spark.createDataFrame([(dt.date(2024, 1, d),) for d in ds], "date date")
    got = alignment.as_of_chain(days(1, 5, 9, 30), days(4, 8), {"near": {"max_age_days": 3}, "any": {}})
    rows = {r["date"].day: (r["source_date"] and r["source_date"].day, r["offset_days"], r["method"]) for r in got.collect()}
    assert rows == {1: (None, None, None), 5: (4, 1, "near"), 9: (8, 1, "near"), 30: (8, 22, "any")}


def test_notes_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([(20.5, 60.0, 5.0, None), (None, 60.0, 5.0, 1.0), (18.0, 90.0, 2.0, 0.25)],
                               "sst_c double, depth_m double, distance_to_coast_km double, current_speed double")
    got = [tuple(r) for r in df.select(suit.cell_sentence(), F.concat_ws(",", suit.feature_notes(("sst_c", "month_sin"))[0])).collect()]
    assert got == [("SST 20.5C; depth about 60m; 5.0km from coast proxy.", "sst_c,seasonality"), (None, "seasonality"),
                   ("SST 18.0C; depth about 90m; 2.0km from coast proxy; current speed 0.25m/s", "sst_c,seasonality")]
    assert df.select(F.concat_ws(",", suit.feature_notes(())[1])).first()[0] == "Relative suitability estimated from available environmental predictors."


def test_a_failed_update_leaves_the_old_manifest(spark, tmp_path):
    root = str(tmp_path / "manifest")
    first = spark.createDataFrame([("a", True)], "species_id string, available boolean")
    published.write_manifest(first, root)
    published.write_manifest(published.read_manifest(spark, root).withColumn("available", F.lit(False)), root)
    assert [tuple(r) for r in published.read_manifest(spark, root).collect()] == [("a", False)]
    broken = first.withColumn("available", F.raise_error(F.lit("no")).cast("boolean"))
    with pytest.raises(Exception, match="no"):
        published.write_manifest(broken, root)
    assert [tuple(r) for r in published.read_manifest(spark, root).collect()] == [("a", False)]


def test_serving_contract_gates_and_dates(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [(1, "a", "scikit_learn", day(1), "Good"), (2, "a", "scikit_learn", day(5), "Low"), (3, "a", "deep_learning", day(5), "Low"), (4, "b", "scikit_learn", day(5), "Low"), (5, "c", "scikit_learn", day(5), "Low")]
    predictions = spark.createDataFrame(rows, "cell_id long, species_id string, model_source string, date date, rating string")
    entries = [(s, ok, "Medium", "set", "text", "audited", "careful", None) for s, ok in (("a", True), ("b", False))]
    manifest = spark.createDataFrame(entries, "species_id string, available boolean, model_confidence string, feature_set_name string, score_explanation string, audit_status string, warning string, notes string")
    got = {(r["species_id"], r["model_source"], r["mode"]): r for r in hotspots.serving_contract(predictions, manifest, "2024-01-03").collect()}
    assert set(got) == {("a", "scikit_learn", "demo"), ("a", "scikit_learn", "current"), ("a", "deep_learning", "current")}
    assert got["a", "scikit_learn", "demo"]["available_dates"] == [day(1)] and got["a", "scikit_learn", "demo"]["model_confidence"] == "Medium"
    deep = got["a", "deep_learning", "current"]
    assert (deep["model_confidence"], deep["feature_set_name"], deep["warning"]) == ("Experimental", hotspots.DEEP_FEATURES, "careful")
