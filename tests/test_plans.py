"""Plan-shape checks for the scale properties the design relies on."""

import contextlib
import io

from yieldnorm.operators import geo, weather
from yieldnorm.plans import queries as Q
from yieldnorm.plans.sizing import materialize
from yieldnorm.sources import county_rings, fixtures

from .conftest import SF0001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_station_years_is_partially_aggregated_and_pruned(spark):
    p = plan(weather.station_years(fixtures.weather_daily(spark, SF0001)))
    assert "partial_sum" in p and "partial_count" in p  # map-side combine before the shuffle
    li = [ln for ln in p.splitlines() if ln.startswith("ReadSchema: struct<l_")][0]
    assert "l_orderkey" not in li and "l_tax" not in li  # only the used columns are read


def test_point_in_polygon_has_no_nested_loop_or_cartesian(spark):
    w = fixtures.weather_daily(spark, SF0001)
    rings = materialize(county_rings(fixtures.county_features(spark, SF0001)), "rings")
    for keep in (True, False):
        for refine in ("bands", "ring"):
            p = plan(geo.assign(w, rings, keep_unknown=keep, refine=refine))
            assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
            # the coordinates are read once (before the plan, where unmatched points are joined back)
            assert p.count("lineitem.parquet") == (0 if keep else 1)
            # only that last join keeps unmatched rows: no null ring id reaches a join
            assert p.count("Join LeftOuter (") == (1 if keep else 0)
            assert "nation.parquet" not in p  # the rings are parsed before, once


def test_attach_broadcasts_the_checked_mapping(spark):
    p = plan(Q.q_weather_with_county(spark, SF0001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "Not(EqualTo(geo_state_code,-1))" in p  # F1 reaches the mapping's scan


def test_year_range_reaches_the_scan(spark, tmp_path):
    w = fixtures.weather_daily(spark, SF0001)
    path = str(tmp_path / "w")
    w.write.parquet(path)
    from yieldnorm.plans import flows
    p = plan(flows.in_years(spark.read.parquet(path), (1996, 2000)))
    pushed = [ln for ln in p.splitlines() if ln.startswith("PushedFilters")][0]
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    p = plan(Q.q_top5_abs_residual_by_crop(spark, SF0001))
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_statistics_are_not_windows_over_a_crop(spark):
    for q in (Q.q_crop_zscore, Q.q_pearson, Q.q_linear_predictions):
        p = plan(q(spark, SF0001))
        assert "Window (" not in p


def test_broadcast_check_falls_back_to_shuffle_join(spark):
    from yieldnorm.plans.sizing import broadcast_if_small, materialize
    w = fixtures.weather_daily(spark, SF0001)
    rings = county_rings(fixtures.county_features(spark, SF0001))
    mapping = materialize(geo.known(geo.assign(w, rings, cell=0.5)), "test_mapping")
    small, hinted = broadcast_if_small(mapping, row_bytes=96, max_bytes=1 << 20)
    big, not_hinted = broadcast_if_small(mapping, row_bytes=96, max_bytes=1)
    assert hinted and not not_hinted
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = geo.attach(w, big)
        p = plan(joined)
        assert "SortMergeJoin" in p or "ShuffledHashJoin" in p
        assert joined.count() == geo.attach(w, small).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_year_range_on_text_dates(spark):
    from yieldnorm.plans import flows
    df = spark.createDataFrame([("1995-12-31",), ("1996-01-01",), ("2000-12-31",), ("2001-01-01",), ("bad",)], "date string")
    assert sorted(r.date for r in flows.in_years(df, (1996, 2000)).collect()) == ["1996-01-01", "2000-12-31"]


def test_broadcast_threshold_parsing(spark):
    from yieldnorm.plans.sizing import broadcast_if_small, broadcast_threshold
    df = spark.range(3)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for v, want in (("10MB", 10 << 20), ("10m", 10 << 20), ("512k", 512 << 10), ("2g", 2 << 30), ("1048576", 1 << 20),
                        ("1048576b", 1 << 20), ("-1", -1)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", v)
            assert broadcast_threshold(df) == want, v
        assert broadcast_if_small(df, 8, max_bytes=1 << 20) == (df, False)  # disabled stays disabled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
