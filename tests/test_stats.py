import math

import numpy as np
import pytest

from yieldnorm.operators import stats

SCHEMA = "crop string, a double, b double, y double"
ROWS = [("c", 1.0, 5.0, 2.0), ("c", 2.0, None, 4.1), ("c", 3.0, 5.0, 6.3), ("c", None, 5.0, 7.0), ("c", 5.0, 5.0, None),
        ("d", 1.0, 2.0, 1.0), ("d", 2.0, 1.0, 3.0), ("d", 4.0, 0.0, 2.0)]


def np_corr(xs, ys):
    if len(xs) < 2:
        return None
    x, y = np.array(xs), np.array(ys)
    sx, sy = x.std(ddof=1), y.std(ddof=1)
    if sx * sy == 0:
        return None
    return float(np.cov(x, y, ddof=1)[0, 1] / (sx * sy))


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("mode", ["zero", "pairwise"])
def test_pearson_against_numpy(spark, mode):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.crop, r.measure): (r.pearson, r.n_pairs) for r in stats.pearson(df, ["a", "b"], "y", "crop", mode).collect()}
    for crop in ("c", "d"):
        for m, i in (("a", 1), ("b", 2)):
            sel = [r for r in ROWS if r[0] == crop]
            if mode == "zero":
                xs = [r[i] if r[i] is not None else 0.0 for r in sel]
                ys = [r[3] if r[3] is not None else 0.0 for r in sel]
            else:
                pairs = [(r[i], r[3]) for r in sel if r[i] is not None and r[3] is not None]
                xs, ys = [p[0] for p in pairs], [p[1] for p in pairs]
            r, n = got[(crop, m)]
            assert close(r, np_corr(xs, ys)), (crop, m, r, np_corr(xs, ys))
            assert n == len(xs)


def test_constant_column_gives_null_not_error(spark):
    # ANSI division by zero would raise; the guarded form returns null
    df = spark.createDataFrame([("c", 5.0, 5.0, 1.0), ("c", 6.0, 5.0, 2.0)], SCHEMA)
    got = {r.measure: r.pearson for r in stats.pearson(df, ["a", "b"], "y", "crop", "pairwise").collect()}
    assert got["b"] is None and close(got["a"], 1.0)


def test_zscore_per_group_and_global(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = stats.zscore(df, ["a"], by="crop").collect()
    for crop in ("c", "d"):
        xs = np.array([r[1] for r in ROWS if r[0] == crop and r[1] is not None])
        mu, sd = xs.mean(), xs.std(ddof=1)
        for r in out:
            if r.crop == crop:
                want = None if r.a is None else (r.a - mu) / sd
                assert close(r.a_normalized, want)
    glob = stats.zscore(df, ["a"], by=None).collect()
    xs = np.array([r[1] for r in ROWS if r[1] is not None])
    for r in glob:
        assert close(r.a_normalized, None if r.a is None else (r.a - xs.mean()) / xs.std(ddof=1))
    # single-row group: stddev undefined -> null
    one = spark.createDataFrame([("e", 1.0, 1.0, 1.0)], SCHEMA)
    assert stats.zscore(one, ["a"], by="crop").first().a_normalized is None


def test_moments(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = {x.crop: x for x in stats.moments(df, ["a"], "crop").collect()}
    assert close(r["d"].a_mean, 7 / 3) and close(r["d"].a_stddev, float(np.std([1, 2, 4], ddof=1)))


def test_zero_mode_equals_dataframe_stat_corr(spark):
    rows = [("c", 1.0, 2.0), ("c", 2.0, None), ("c", None, 6.3), ("c", 4.0, 7.0), ("c", 5.0, 9.5), ("c", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "crop string, a double, y double")
    ours = stats.pearson(df, ["a"], "y", "crop", "zero").first().pearson
    assert close(ours, df.stat.corr("a", "y"))
    assert not close(stats.pearson(df, ["a"], "y", "crop", "pairwise").first().pearson, ours)
