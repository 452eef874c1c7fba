import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator

from yieldnorm.operators import model, quality, rank
from yieldnorm.plans import flows

from .conftest import SF0001

SMALL = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.2}


@pytest.fixture(scope="module")
def ml(spark):
    t = model.ml_table(flows.fixture_fact(spark, SF0001), "Corn")
    return model.prepare_for_fit(t)


def test_require_lists_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b, c"):
        quality.require(df, ["a", "b", "c"])


def test_empty_input_refused(spark):
    df = spark.createDataFrame([], "state_code string, county_code string, year int, commodity_name string, "
                                   "yield_amount double, total_precipitation bigint")
    with pytest.raises(ValueError):
        model.prepare_for_fit(df)


def test_ml_table_shape(ml):
    assert ml.count() == 29
    assert ml.columns == ["state_code", "county_code", "year", "commodity_name", "irrigation_practice_code", "yield_amount",
                          *model.FEATURES]
    assert ml.filter("total_temp_max is null or yield_amount is null").count() == 0


def test_fit_is_deterministic_and_layout_invariants(ml):
    a = model.predict(model.fit(ml, SMALL), ml)
    b = model.predict(model.fit(ml, SMALL), ml)
    key = ["state_code", "county_code", "year", "yield_amount", *model.FEATURES]
    ra = sorted((tuple(r[k] for k in key), r.predicted_yield) for r in a.collect())
    rb = sorted((tuple(r[k] for k in key), r.predicted_yield) for r in b.collect())
    assert ra == rb
    out = rank.layout(a)
    assert out.columns == list(rank.PREDICTION_COLUMNS)
    for r in out.collect():
        assert math.isclose(r.residual, r.yield_amount - r.predicted_yield, abs_tol=1e-9)
    top = [abs(r.residual) for r in rank.largest_abs(out, 10).collect()]
    assert top == sorted(top, reverse=True)


def test_metrics_match_evaluator(ml):
    pred = model.predict(model.fit(ml, SMALL), ml)
    m = model.metrics(pred).first()
    ev = lambda name: RegressionEvaluator(labelCol="yield_amount", predictionCol="predicted_yield",
                                          metricName=name).evaluate(pred)
    assert math.isclose(m.rmse, ev("rmse"), rel_tol=1e-9)
    assert math.isclose(m.r2, ev("r2"), rel_tol=1e-9)


def test_grid_prefix_equals_separate_fit(ml):
    g = {(r.maxIter, r.maxDepth, r.stepSize): r for r in
         model.grid(ml, {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.2]}).collect()}
    sep = model.metrics(model.predict(model.fit(ml, {"maxIter": 1, "maxDepth": 2, "stepSize": 0.2}), ml)).first()
    assert math.isclose(g[(1, 2, 0.2)].rmse, sep.rmse, rel_tol=1e-9)
    assert math.isclose(g[(1, 2, 0.2)].r2, sep.r2, rel_tol=1e-9)
    assert g[(3, 2, 0.2)].rmse <= g[(1, 2, 0.2)].rmse + 1e-12
    best = model.best(model.grid(ml, {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.2]})).first()
    assert best.maxIter == 3


def test_a_fit_has_tasks_by_rows_not_by_files(ml, monkeypatch):
    many = ml.repartition(9)
    assert many.rdd.getNumPartitions() == 9 and model.gathered(many).rdd.getNumPartitions() == 1
    assert model.gathered(many, rows=10).rdd.getNumPartitions() == 3 and model.gathered(many.limit(0)).count() == 0
    seen = []

    def watched(df, rows=model.FIT_ROWS, whole=model.gathered):
        seen.append(whole(df, rows))
        return seen[-1]

    monkeypatch.setattr(model, "gathered", watched)
    model.fit(many, SMALL)
    model.grid(many, {"maxIter": [2], "maxDepth": [2], "stepSize": [0.2]})
    assert [x.rdd.getNumPartitions() for x in seen] == [1, 1] and [x.count() for x in seen] == [ml.count()] * 2


def test_importances(ml):
    imp = model.importances(model.fit(ml, SMALL)).collect()
    assert len(imp) == 6 and math.isclose(sum(r.importance for r in imp), 1.0, rel_tol=1e-9)
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)


def test_linear_baseline_against_numpy(spark):
    rows = [("c", 1.0, 2.0), ("c", 2.0, 4.5), ("c", 3.0, 5.5), ("d", 1.0, 1.0), ("d", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "commodity_name string, total_precipitation double, yield_amount double")
    out = model.linear_baseline(df).collect()
    for crop in ("c", "d"):
        xs = [r[1] for r in rows if r[0] == crop]
        ys = [r[2] for r in rows if r[0] == crop]
        slope, icpt = np.polyfit(xs, ys, 1)
        for r in out:
            if r.commodity_name == crop:
                assert math.isclose(r.predicted_yield, icpt + slope * r.total_precipitation, rel_tol=1e-9)


def test_fit_by_crop(spark):
    f = flows.fixture_fact(spark, SF0001)
    out = model.fit_by_crop(f, ["Corn", "Soybeans"], SMALL)
    crops = {r.commodity_name.strip() for r in out.select("commodity_name").distinct().collect()}
    assert crops == {"Corn", "Soybeans"}


def test_holdout_split_and_parity_view(spark, ml):
    train, test = model.split_by_year(ml, [1999])
    assert train.count() + test.count() == ml.count()
    assert test.filter("year != 1999").count() == 0
    pred = model.predict(model.fit(train, SMALL), test)
    assert rank.layout(pred, with_state=False).columns == list(rank.PARITY_COLUMNS)
    assert len(rank.PARITY_COLUMNS) == 12
