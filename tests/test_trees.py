"""The fitted trees as a relation, against the fitted model."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from yieldnorm.operators import model, trees

PARAMS = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.2}


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    cols = [F.round(F.rand(i) * 40).alias(c) for i, c in enumerate(model.FEATURES)]
    df = spark.range(400).select("id", *cols).withColumn(
        "yield_amount", F.col(model.FEATURES[0]) * 2 + F.col(model.FEATURES[1]) * F.col(model.FEATURES[2]) / 10 + F.rand(9))
    path = str(tmp_path_factory.mktemp("model") / "m")
    model.fit(df, PARAMS).write().save(path)
    return df, PipelineModel.load(path), trees.nodes(spark, path)


def test_scores_equal_the_model(fitted):
    df, m, table = fitted
    odd = df.limit(5).withColumn(model.FEATURES[0], F.lit(float("nan")))
    scored = trees.score(model.predict(m, df.unionByName(odd)), table)
    worst = scored.agg(F.max(F.abs(trees.first_trees(F.col("parts")) - F.col("predicted_yield"))), F.count(F.lit(1))).first()
    assert worst[0] < 1e-9 and worst[1] == 405


def test_join_path_equals_the_packed_one(fitted, monkeypatch):
    df, _, table = fitted
    one = {r.id: (r.parts, r.leaves) for r in trees.score(df, table).collect()}
    monkeypatch.setattr(trees, "MODEL_BYTES", 0)
    two = {r.id: (r.parts, r.leaves) for r in trees.score(df, table, depth=4).collect()}
    assert one == two


def test_fewer_iterations_are_prefixes(fitted):
    df, m, table = fitted
    got = {r.maxIter: r.rmse for r in trees.rmse_by_iterations(trees.score(df, table), [1, 5, 12]).collect()}
    full = m.stages[0].transform(df)
    loss = m.stages[-1].evaluateEachIteration(full, "squared")
    assert got == {k: pytest.approx(loss[k - 1] ** 0.5, rel=1e-9) for k in (1, 5, 12)}


def test_first_tree_has_means(fitted):
    df, _, table = fitted
    leaves = trees.leaf_means(trees.score(df, table), table).collect()
    assert sum(r.n for r in leaves) == 400
    assert all(r.value == pytest.approx(r["mean"], rel=1e-9) for r in leaves)


def test_scoring_reads_rows_once_without_shuffle(fitted):
    df, _, table = fitted
    from yieldnorm.plans.sizing import materialize

    plan = trees.score(materialize(df), table, depth=4)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main and "Python" not in main
