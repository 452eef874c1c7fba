import json

from yieldnorm.__main__ import run
from yieldnorm.sources import fixtures

from .conftest import SF0001


def test_enrichment_cli(spark, tmp_path):
    fixtures.flagged_anomalies(spark, SF0001).write.parquet(str(tmp_path / "anom"))
    fixtures.county_summary(spark, SF0001).write.parquet(str(tmp_path / "summ"))
    fixtures.fips_master(spark, SF0001).write.option("header", True).option("nullValue", "NA").csv(str(tmp_path / "fips"))
    written = run(spark, ["enrichment", "--anomalies", str(tmp_path / "anom"), "--summary", str(tmp_path / "summ"),
                          "--fips", str(tmp_path / "fips"), "--out-prefix", "cli_"])
    assert spark.table(written["anomalies_geo"]).count() == 11
    assert spark.table(written["summary_geo"]).count() == 10


def test_training_cli(spark, tmp_path):
    fixtures.weather_daily(spark, SF0001).write.parquet(str(tmp_path / "w"))
    fixtures.county_yields(spark, SF0001).write.parquet(str(tmp_path / "y"))
    feats = [r.asDict(recursive=True) for r in fixtures.county_features(spark, SF0001).orderBy("ord").collect()]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": f["properties"],
         "geometry": {"type": f["geometry"]["type"], "coordinates": json.loads(f["geometry"]["coordinates"])}}
        for f in feats]}
    (tmp_path / "c.geojson").write_text(json.dumps(doc))
    written = run(spark, ["training", "--weather", str(tmp_path / "w"), "--yields", str(tmp_path / "y"),
                          "--counties", str(tmp_path / "c.geojson"), "--params", '{"maxIter": 2, "maxDepth": 2}',
                          "--out-prefix", "cli_"])
    assert spark.table(written["predictions"]).count() == 29
    assert spark.table(written["fact"]).count() == 136


def test_correlation_cli_takes_crops_and_years(spark, tmp_path):
    fixtures.weather_daily(spark, SF0001).write.parquet(str(tmp_path / "w"))
    fixtures.county_yields(spark, SF0001).write.parquet(str(tmp_path / "y"))
    feats = [r.asDict(recursive=True) for r in fixtures.county_features(spark, SF0001).orderBy("ord").collect()]
    (tmp_path / "c.geojsonl").write_text("\n".join(json.dumps(
        {"type": "Feature", "properties": f["properties"],
         "geometry": {"type": f["geometry"]["type"], "coordinates": json.loads(f["geometry"]["coordinates"])}}) for f in feats))
    args = ["correlation", "--weather", str(tmp_path / "w"), "--yields", str(tmp_path / "y"),
            "--counties", str(tmp_path / "c.geojsonl"), "--counties-lines"]
    every = run(spark, [*args, "--crops", "all", "--years", "1996,1997", "--out-prefix", "all_"])
    two = run(spark, [*args, "--out-prefix", "two_"])
    crops = lambda t: {r[0] for r in spark.table(t).select("commodity_name").distinct().collect()}
    assert crops(two["pearson"]) == {" Corn", " Soybeans"} < crops(every["pearson"])
    assert {r[0] for r in spark.table(every["fact"]).select("year").distinct().collect()} <= {1996, 1997}
