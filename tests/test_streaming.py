import pytest

from pyspark.sql import functions as F

from yieldnorm.operators import weather
from yieldnorm.plans import flows
from yieldnorm.plans.sizing import materialize, scratch_path
from yieldnorm.sources import county_rings, fixtures
from yieldnorm.streaming import annual

from .conftest import SF0001


@pytest.fixture(scope="module")
def daily(spark):
    return materialize(fixtures.weather_daily(spark, SF0001), "daily"), materialize(
        county_rings(fixtures.county_features(spark, SF0001)), "rings")


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def stream_of(spark, src, w):
    return spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(src)


@pytest.mark.parametrize("stat", ["sum", "avg"])
def test_stream_equals_batch_though_stations_appear_late(spark, daily, stat):
    w, rings = daily
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream_src", "stream_out", "stream_ckpt"))
    w.filter("longitude < 2").coalesce(1).write.mode("append").parquet(src)
    first = annual.run_to_completion(stream_of(spark, src, w), rings, out, ckpt, stat)
    seen = first.agg(F.sum("observation_count")).first()[0]
    # later files bring stations that no file had before, and more rows of known ones
    w.filter("longitude >= 2").coalesce(1).write.mode("append").parquet(src)
    w.filter("longitude < 4").coalesce(1).write.mode("append").parquet(src)
    got = annual.run_to_completion(stream_of(spark, src, w), rings, out, ckpt, stat)
    want = flows.annual_weather(w.unionByName(w.filter("longitude < 4")), rings, stat, fill_avg=False)
    assert rows(got, want.columns) == rows(want, want.columns)
    assert got.agg(F.sum("observation_count")).first()[0] > seen
    # a restart without new files keeps the result
    again = annual.run_to_completion(stream_of(spark, src, w), rings, out, ckpt, stat)
    assert rows(again, want.columns) == rows(want, want.columns)


def test_a_batch_that_runs_again_counts_once_and_half_epochs_are_not_read(spark, daily):
    w, rings = daily
    out = scratch_path(spark, "stream_out")
    a, b = w.filter("longitude < 3"), w.filter("longitude >= 3")
    annual.merge_batch(a, rings, out, 0)
    weather.station_years(b).write.parquet(f"{out}/epoch=1/station_years")  # died before its marker was written
    want = flows.annual_weather(a, rings, "sum")
    assert rows(annual.result(spark, out), want.columns) == rows(want, want.columns)
    annual.merge_batch(b, rings, out, 1)
    annual.merge_batch(b, rings, out, 1)
    want = flows.annual_weather(w, rings, "sum")
    assert rows(annual.result(spark, out), want.columns) == rows(want, want.columns)
    with pytest.raises(ValueError, match="no complete epoch"):
        annual.result(spark, scratch_path(spark, "nothing"))
