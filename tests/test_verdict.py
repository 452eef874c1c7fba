"""Unmatched counties, repeated practices, malformed GeoJSON, empty inputs, scratch folders."""

import json

import pytest
from pyspark.sql import functions as F

from yieldnorm import session
from yieldnorm.operators import enrich, geo, model, rank
from yieldnorm.plans import queries as Q
from yieldnorm.plans.sizing import materialize, path_exists, run_folder
from yieldnorm.sources import fixtures, read_county_rings

from .conftest import SF0001


def test_unmatched_counties_are_no_county(spark):
    df = spark.createDataFrame([("00000", 1997, 5), ("00000", 1997, 6), ("01001", 1997, None), ("01001", 1998, 2), (None, 1998, 1)],
                               "fips string, year int, v int")
    assert [tuple(r) for r in rank.top_counties(df, "v", 5, agg="count").collect()] == [("01001", 1)]
    assert sorted(tuple(r) for r in enrich.map_table(df).collect()) == [("01001", 1997, 1), ("01001", 1998, 1)]
    # a metric is used with count as well: its non-null values
    got = enrich.map_table(df, "v", "count").orderBy("year").collect()
    assert [(r.count_v, r.n_rows) for r in got] == [(0, 1), (1, 1)]
    with pytest.raises(ValueError, match="needs a metric"):
        enrich.map_table(df, agg="sum")
    for name in ("top10_counties", "anomaly_map", "anomaly_map_year"):
        out = Q.QUERIES[name](spark, SF0001)
        assert out.filter("fips = '00000'").count() == 0 and out.count() > 0


def test_a_year_counts_once_however_many_practices(spark):
    rows = [("01", "001", "Corn", 2000, p, r) for p, r in (("F", 4.0), ("O", -2.0))] + [("01", "001", "Corn", 2001, "F", -3.0),
            ("01", "001", "Corn", 2002, "F", None)]
    df = spark.createDataFrame(rows, "state_code string, county_code string, commodity_name string, year int, p string, residual double")
    r = rank.consistency(df, threshold=0.5).first()
    assert (r.n_years, r.mean_residual, r.share_positive, r.min_residual, r.max_residual) == (2, -1.0, 0.5, -3.0, 1.0)
    years = Q._linear(spark, SF0001).select("year").distinct().count()
    assert Q.q_residual_consistency(spark, SF0001).agg(F.max("n_years")).first()[0] <= years


SQUARE = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]


def feature(coords, kind="Polygon"):
    return {"type": "Feature", "properties": {"STATE": "1", "COUNTY": "2", "NAME": "X"}, "geometry": {"type": kind, "coordinates": coords}}


def written(tmp_path, features, lines):
    path = tmp_path / "c.geojson"
    if lines:
        path.write_text("\n".join(json.dumps(f) for f in features))
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


@pytest.mark.parametrize("lines", [False, True])
@pytest.mark.parametrize("bad", [[[[0, 0], [1, "x"], [1, 1]]], [[[0, 0], [1, None], [1, 1]]], [[[0, 0], [1], [1, 1]]], [None], None, "text"])
def test_bad_coordinates_raise_and_name_the_feature(spark, tmp_path, lines, bad):
    path = written(tmp_path, [feature([SQUARE]), feature(bad)], lines)
    with pytest.raises(Exception, match='bad coordinates in feature .*"NAME":"X"'):
        read_county_rings(spark, path, lines).collect()


@pytest.mark.parametrize("lines", [False, True])
def test_cut_off_files_raise(spark, tmp_path, lines):
    path = written(tmp_path, [feature([SQUARE]), feature([SQUARE])], lines)
    whole = open(path).read()
    open(path, "w").write(whole[:-30])
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_county_rings(spark, path, lines).collect()


def test_other_geometries_are_skipped_and_an_empty_collection_has_no_rings(spark, tmp_path):
    other = [feature([0.5, 0.5], "Point"), {"type": "Feature", "properties": {}, "geometry": None}, feature([SQUARE])]
    assert read_county_rings(spark, written(tmp_path, other, False)).count() == 1
    assert read_county_rings(spark, written(tmp_path, [], False)).count() == 0
    (tmp_path / "c.geojson").write_text("{}")
    with pytest.raises(Exception, match="not a FeatureCollection"):
        read_county_rings(spark, str(tmp_path / "c.geojson")).collect()


def test_the_fixture_tells_hole_rules_parts_and_overlaps_apart(spark):
    rings = Q._rings(spark, SF0001)
    points = spark.createDataFrame([(0.5, 1.5), (5.2, 3.5), (0.5, 2.2), (0.5, 0.5)], "latitude double, longitude double")
    of = {holes: {(r.latitude, r.longitude): r.geo_county_code for r in geo.assign(points, rings, holes=holes).collect()}
          for holes in ("fill", "subtract")}
    assert of["fill"] == {(0.5, 1.5): "001", (5.2, 3.5): "003", (0.5, 2.2): "001", (0.5, 0.5): "000"}
    assert of["subtract"] == of["fill"] | {(0.5, 1.5): "-1"}
    assert Q.q_fips_duplicates(spark, SF0001).count() == 2


def test_empty_tables_are_refused_where_the_fit_happens(spark):
    ml = Q._corn_ml(spark, SF0001)
    for act in (lambda: model.fit(ml.limit(0)), lambda: model.grid(ml.limit(0)), lambda: model.split_by_year(ml, [1800])):
        with pytest.raises(ValueError, match="empty"):
            act()


def test_prediction_keys_identify_rows(spark):
    ml = Q._corn_ml(spark, SF0001)
    assert ml.select(*rank.KEYS).distinct().count() == ml.count()


def test_checkpoint_folder_is_never_guessed(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, _):
            raise AssertionError("set")

    class Session:
        sparkContext, conf = Context(), Conf()

    session.local_checkpoints(Session())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_scratch_tables_lie_in_the_run_folder(spark):
    df = materialize(spark.range(3), "t")
    assert all(run_folder(spark) in f.replace("file:///", "file:/") for f in df.inputFiles())
    assert path_exists(spark, run_folder(spark))


def test_sessions_of_one_application_keep_their_settings(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert fixtures.table(other, SF0001, "nation").sparkSession is not fixtures.table(spark, SF0001, "nation").sparkSession
