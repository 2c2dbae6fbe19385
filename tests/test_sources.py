"""Readers and sinks: schemas, rejects, replacement."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from furrow.sources import readers as R
from furrow.sources import sinks as W


def test_panel_requires_columns_and_normalises_nan(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("unit,year,y\na,2019,1.5\nb,2019,NaN\nc,2019,\n")
    with pytest.raises(R.MissingColumns, match="treat"):
        R.read_panel(spark, str(p), "unit string, year int, y double", ["unit", "treat"])
    got = {r.unit: r.y for r in R.read_panel(spark, str(p), "unit string, year int, y double", ["unit", "y"]).collect()}
    assert got == {"a": 1.5, "b": None, "c": None}


def test_track_reader_drops_units_row_and_blanks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("SID,SEASON,NAME,LAT,WMO_WIND\n ,Year, ,degrees,kts\nS1,2019,FANI,19.5, \nS1,2019,FANI,20.0,95\nS2,2020,AMPHAN,x,100\n")
    t = R.read_tracks(spark, str(p), ["LAT", "WMO_WIND"], ["SID", "SEASON", "NAME", "LAT", "WMO_WIND", "USA_WIND"])
    assert [(r.SID, r.SEASON, r.LAT, r.WMO_WIND) for r in t.orderBy("SID", "LAT").collect()] == [("S1", 2019, 19.5, None), ("S1", 2019, 20.0, 95.0), ("S2", 2020, None, 100.0)]


def test_feature_reader(spark, tmp_path):
    p = tmp_path / "f.json"
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}}]}
    p.write_text(json.dumps(doc, indent=1))
    r = R.read_features(spark, str(p), ["NAME", "ZONE"]).first()
    assert r.NAME == "A" and r.ZONE is None and r.geom_type == "Polygon" and json.loads(r.coordinates) == [[[1, 2], [3, 4], [1, 2]]]


def test_units_and_rejects(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "unit string, v double")
    good, bad = W.write_units(df, str(tmp_path / "o"), "unit", F.col("v") > 0)
    assert spark.read.parquet(good).count() == 2 and spark.read.parquet(bad).first().unit == "b"


def test_refresh_is_idempotent(spark):
    cur = spark.createDataFrame([("a", 2019, 1.0), ("a", 2020, 2.0)], "u string, year int, f double")
    new = spark.createDataFrame([("a", 2019, 9.0), ("a", 2020, 5.0)], "u string, year int, f double")
    once = W.refresh(cur, new, F.col("year") == 2020, ["year"])
    twice = W.refresh(once, new, F.col("year") == 2020, ["year"])
    assert [r.f for r in once.collect()] == [1.0, 5.0] == [r.f for r in twice.collect()]


def test_track_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [(86.0, 20.0), (86.5, 20.5)])], "sid long, part int, line array<struct<lon:double,lat:double>>")
    W.write_track_lines(df, str(tmp_path / "l"), ["sid", "part"])
    r = W.read_track_lines(spark, str(tmp_path / "l"), "sid:long,part:int").first()
    assert r.geometry.type == "LineString" and r.geometry.coordinates == [[86.0, 20.0], [86.5, 20.5]]
