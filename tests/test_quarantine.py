import json

import pytest

from yieldnorm.sources import read_county_rings, read_fips, tables

SQ = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]


def aside(spark, folder):
    return sorted((r.raw, r.reason) for r in spark.read.parquet(folder).collect())


def test_fips_lines(spark, tmp_path):
    p, q = tmp_path / "fips.csv", str(tmp_path / "q")
    p.write_text('fips,name,state\n1001,Autauga County,AL\nabc,Bad Code,AL\n1003,Short\n1005,Long,AL,x\n1007,"Quoted, Name",AL\nNA,,\n')
    good = read_fips(spark, str(p), quarantine=q)
    assert sorted((r.fips or 0, r.name, r.state) for r in good.collect()) == [
        (0, None, None), (1001, "Autauga County", "AL"), (1007, "Quoted, Name", "AL")]
    assert aside(spark, q) == [("1003,Short", "not 3 fields"), ("1005,Long,AL,x", "not 3 fields"),
                               ("abc,Bad Code,AL", "fips is no whole number")]
    assert all(r.file.endswith("fips.csv") for r in spark.read.parquet(q).collect())
    with pytest.raises(Exception):
        read_fips(spark, str(p)).collect()  # strict without a quarantine
    read_fips(spark, str(p), quarantine=q)
    assert len(aside(spark, q)) == 6  # appended


def test_feature_lines(spark, tmp_path):
    def feature(name, geometry):
        return json.dumps({"type": "Feature", "properties": {"STATEFP": "1", "COUNTYFP": "2", "NAME": name}, "geometry": geometry})

    lines = [feature("A", {"type": "Polygon", "coordinates": SQ}), '{"type": "Feature", "properties": {"NAME": "cut',
             feature("B", {"type": "Polygon", "coordinates": [[[0, 0], [1, None], [1, 1]]]}), "", "[1, 2]",
             feature("C", {"type": "Point", "coordinates": [0, 0]}), feature("D", None),
             feature("E", {"type": "MultiPolygon", "coordinates": [SQ, SQ]})]
    p, q = tmp_path / "lines.json", str(tmp_path / "q")
    p.write_text("\n".join(lines) + "\n")
    rings = read_county_rings(spark, str(p), lines=True, quarantine=q).orderBy("ord", "poly_no").collect()
    assert [(r.county_name, r.poly_no) for r in rings] == [("A", 0), ("E", 0), ("E", 1)]
    got = aside(spark, q)
    assert sorted(r for _, r in got) == ["bad coordinates", "no feature", "no feature"]
    assert any(lines[1] == raw for raw, _ in got) and any('"NAME":"B"' in raw for raw, _ in got)
    with pytest.raises(ValueError):
        read_county_rings(spark, str(p), quarantine=q)


def test_weather_text(spark, tmp_path):
    q = str(tmp_path / "q")
    rows = [("1.5", 2.0, "2020-01-05", "3", None, 1.0, " ", 0.0), ("x", 2.0, "2020-13-05", "3", 1.0, 1.0, "1", 0.0),
            ("1.5", 2.0, "2020-01-06", "n/a", 1.0, 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, "latitude string, longitude double, date string, precipitation string, temp_max double, "
                                     "temp_min double, snow_depth string, snowfall double")
    good = tables.weather(spark, df, quarantine=q)
    assert [f.dataType.simpleString() for f in good.schema] == ["double", "double", "date", "double", "double", "double", "double", "double"]
    assert [(r.latitude, str(r.date), r.precipitation, r.snow_depth) for r in good.collect()] == [(1.5, "2020-01-05", 3.0, None)]
    assert sorted(reason for _, reason in aside(spark, q)) == ["latitude is no double, date is no date", "precipitation is no double"]
    df.write.parquet(str(tmp_path / "w.parquet"))
    again = str(tmp_path / "again")
    assert tables.weather(spark, str(tmp_path / "w.parquet"), quarantine=again).count() == 1
    assert all("w.parquet" in r.file for r in spark.read.parquet(again).collect()) and len(aside(spark, again)) == 2
    typed = good.select(*good.columns)
    assert tables.weather(spark, typed, quarantine=str(tmp_path / "none")).count() == 1
    assert not (tmp_path / "none").exists()
