import pytest

from yieldnorm import sinks
from yieldnorm.operators import quality
from yieldnorm.sources import fixtures, read_fips, tables

from .conftest import SF0001


def test_fips_csv_reader(spark, tmp_path):
    p = tmp_path / "fips.csv"
    p.write_text("fips,name,state\n1000,Alabama,NA\n1001,Autauga County,AL\n22057,Lafourche Parish,LA\n1003,,AL\n")
    df = read_fips(spark, str(p))
    rows = df.orderBy("fips").collect()
    assert [(r.fips, r.name, r.state) for r in rows] == [(1000, "Alabama", None), (1001, "Autauga County", "AL"),
                                                        (1003, None, "AL"), (22057, "Lafourche Parish", "LA")]


def test_fips_fixture_roundtrip_through_csv(spark, tmp_path):
    fips = fixtures.fips_master(spark, SF0001)
    sinks.save_csv(fips, str(tmp_path / "out"))
    back = read_fips(spark, str(tmp_path / "out"))
    key = lambda r: (r.fips, r.name, r.state)
    assert sorted(map(key, back.collect())) == sorted(map(key, fips.collect()))
    assert back.na.drop(subset=["state"]).count() == 23


def test_weather_reader_checks_and_prunes(spark, tmp_path):
    w = fixtures.weather_daily(spark, SF0001).withColumn("station", fixtures.F.lit("x"))
    path = str(tmp_path / "w.parquet")
    sinks.save_parquet(w, path, partition_by=None)
    df = tables.weather(spark, path)
    assert df.columns == list(tables.WEATHER_COLUMNS)
    with pytest.raises(ValueError, match="snowfall"):
        tables.weather(spark, w.drop("snowfall"))


def test_save_table_overwrites_schema(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.save_table(a, "yn_test_tbl")
    b = spark.createDataFrame([(2.0,)], "c double")
    sinks.save_table(b, "yn_test_tbl", partition_by=None)
    assert spark.table("yn_test_tbl").columns == ["c"]
    spark.sql("DROP TABLE yn_test_tbl")


def test_quality_helpers(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3.0, None), (None, None, "b")], "x int, y double, `a b` string")
    nc = quality.null_counts(df).first()
    assert (nc["x"], nc["y"], nc["a b"]) == (1, 2, 1)
    assert quality.row_count(df).first().row_count == 3
    rep = quality.schema_report(df).collect()
    assert [(r.column_name, r.data_type) for r in rep] == [("x", "int"), ("y", "double"), ("a b", "string")]
    assert [r.x for r in quality.preview(df, 2, ["x"]).collect()] == [None, 1]
    filled = quality.fill_mean(df, ["y"]).collect()
    assert sorted(r.y for r in filled) == [3.0, 3.0, 3.0]
    by = spark.createDataFrame([("g", 1.0), ("g", None), ("h", 5.0), ("h", None)], "k string, v double")
    assert sorted((r.k, r.v) for r in quality.fill_mean(by, ["v"], by=["k"]).collect()) == [
        ("g", 1.0), ("g", 1.0), ("h", 5.0), ("h", 5.0)]
    empty = spark.createDataFrame([], "fips string")
    assert quality.match_rate(empty, "fips").first().match_pct is None


def test_fill_mean_null_group(spark):
    by = spark.createDataFrame([(None, 2.0), (None, None), ("g", None), ("g", 4.0)], "k string, v double")
    got = sorted((r.k or "", r.v) for r in quality.fill_mean(by, ["v"], by=["k"]).collect())
    assert got == [("", 2.0), ("", 2.0), ("g", 4.0), ("g", 4.0)]
    assert quality.fill_mean(by, ["v"], by=["k"]).columns == ["k", "v"]
