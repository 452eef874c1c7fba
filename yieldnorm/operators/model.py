"""M1-M8, P14, P24, F2, F4, F11, A14, A15, T-4, T-5: predict yield from weather.

Spark ML fits are already distributed (each tree level is one aggregation over the data). The
model table is small (one row per county-year-practice of one crop) but sits behind a full
scan of the daily table, and a fit runs hundreds of jobs over it, so it is materialised once in
the shared checkpoint folder before fitting (``plans.sizing.materialize``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import ensure_not_empty, fill

# The six model features, the label, the parameters of the single fit and the
# parameter grid searched in the original.
FEATURES = ("total_precipitation", "total_temp_max", "total_temp_min", "total_snow_depth", "total_snowfall",
            "observation_count")
LABEL = "yield_amount"
PREDICTION = "predicted_yield"
DEFAULT_PARAMS = {"maxIter": 100, "maxDepth": 7, "stepSize": 0.2}
PARAM_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1, 0.2]}
SEED = 42
#: Rows of a partition that a fit reads, at least.
FIT_ROWS = 20_000


def ml_table(fact: DataFrame, crop: str = "Corn", features: Sequence[str] = FEATURES, label: str = LABEL,
             keep_state: bool = True) -> DataFrame:
    """P24 + F2 + F4 + P14: one crop (name compared after trim), labelled rows only, null
    features filled with 0.0 (the original's choice; inspect ``quality.null_counts`` first)."""
    keys = (["state_code"] if keep_state else []) + ["county_code", "year", "commodity_name", "irrigation_practice_code"]
    t = (fact.filter(F.trim(F.col("commodity_name")) == F.lit(crop))
         .select(*keys, label, *features)
         .filter(F.col(label).isNotNull()))
    return fill(t, {c: 0.0 for c in features})


def pipeline(params: Mapping[str, object] | None = None, features: Sequence[str] = FEATURES, label: str = LABEL,
             seed: int = SEED) -> Pipeline:
    """M1 + M2: assemble features (invalid values kept as NaN) and a boosted-tree regressor.
    The seed is fixed: PySpark's default seed differs between Python processes."""
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol=PREDICTION, seed=seed, **p)
    return Pipeline(stages=[assembler, gbt])


def prepare_for_fit(ml: DataFrame, materialized: bool = True) -> DataFrame:
    """Lineage cut + F11: continue from the table written in the checkpoint folder, and refuse an
    empty one (checked on the written table, so the lineage behind it runs once)."""
    if materialized:
        from ..plans.sizing import materialize
        ml = materialize(ml, "model_table")
    ensure_not_empty(ml, "model table")
    return ml


def gathered(ml: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``ml`` in as many partitions as its rows ask for, not as its files came out: a fit runs some hundred jobs, and
    each has two tasks for every partition, however few rows it holds."""
    return ml.coalesce(max(1, -(-ml.count() // rows)))


def split_by_year(ml: DataFrame, test_years: Iterable[int], col: str = "year") -> tuple[DataFrame, DataFrame]:
    """An optional hold-out by year (train on the other years, score on ``test_years``);
    the default scoring stays in-sample like the original."""
    years = list(test_years)
    is_test = F.col(col).isin(years)
    train, test = ml.filter(~is_test), ml.filter(is_test)
    ensure_not_empty(train, "training part")
    ensure_not_empty(test, "held-out part")
    return train, test


def fit(ml: DataFrame, params: Mapping[str, object] | None = None, features: Sequence[str] = FEATURES,
        label: str = LABEL, seed: int = SEED) -> PipelineModel:
    """M3 (+F11: an empty table raises)."""
    ensure_not_empty(ml, "table to fit")
    return pipeline(params, features, label, seed).fit(gathered(ml))


def predict(model: PipelineModel, df: DataFrame, label: str = LABEL) -> DataFrame:
    """M4 + P16: append the prediction and the residual (actual - predicted)."""
    out = model.transform(df).drop("features")
    return out.withColumn("residual", F.col(label) - F.col(PREDICTION))


def metrics(pred: DataFrame, label: str = LABEL, prediction: str = PREDICTION,
            by: Sequence[str] | None = None) -> DataFrame:
    """A14 + A15 (M5): RMSE and R^2 in one aggregate; R^2 is null when the label is constant."""
    err = F.col(label) - F.col(prediction)
    g = pred.groupBy(*by) if by else pred
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.avg(err * err) / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"),
    )


def importances(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """T-4: feature importances, largest first (one row per feature: a model attribute, not data)."""
    gbt = model.stages[-1]
    rows = [(f, float(v)) for f, v in zip(features, gbt.featureImportances.toArray())]
    from pyspark.sql import SparkSession
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def grid(ml: DataFrame, param_grid: Mapping[str, Sequence] = PARAM_GRID, features: Sequence[str] = FEATURES,
         label: str = LABEL, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """M6: RMSE and R^2 for every point of the grid, in grid (product) order.

    Boosting is sequential and deterministic, so a model with k trees is the first k trees of
    a longer model: one fit per (maxDepth, stepSize) at the largest maxIter, and the shorter
    runs are read from ``evaluateEachIteration``. 9 fits instead of 27. The fits are submitted
    from ``parallelism`` driver threads (as ``CrossValidator(parallelism=...)`` does), so their
    small jobs share the cluster instead of queueing one after another.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import SparkSession
    ensure_not_empty(ml, "table to fit")
    spark = SparkSession.getActiveSession()
    names = list(param_grid)
    iters = sorted(param_grid["maxIter"])
    others = [k for k in names if k != "maxIter"]
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(gathered(ml))
    var = assembled.agg(F.var_pop(label).alias("v")).first()["v"]
    combos = list(itertools.product(*[param_grid[k] for k in others]))

    def run(combo):
        gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol=PREDICTION, seed=seed,
                           maxIter=max(iters), **dict(zip(others, combo)))
        return combo, gbt.fit(assembled).evaluateEachIteration(assembled, "squared")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(combos)))) as pool:
        per_combo = dict(pool.map(run, combos))
    losses = {(it, *combo): per_iter[it - 1] for combo, per_iter in per_combo.items() for it in iters}
    rows = []
    for pos, combo in enumerate(itertools.product(*[param_grid[k] for k in names])):
        p = dict(zip(names, combo))
        mse = losses[(p["maxIter"], *[p[k] for k in others])]
        r2 = None if not var else 1.0 - mse / var
        rows.append((pos, int(p["maxIter"]), int(p["maxDepth"]), float(p["stepSize"]), float(mse) ** 0.5, r2))
    return spark.createDataFrame(
        rows, "grid_pos int, maxIter int, maxDepth int, stepSize double, rmse double, r2 double")


def best(results: DataFrame) -> DataFrame:
    """T-5: least RMSE; the earliest grid point wins a tie (a stable sort in the original)."""
    return results.orderBy(F.col("rmse").asc_nulls_last(), F.col("grid_pos")).limit(1)


def fit_by_crop(fact: DataFrame, crops: Iterable[str], params: Mapping[str, object] | None = None,
                materialized: bool = True, parallelism: int = 4) -> DataFrame:
    """M7: one model per crop; predictions of all crops in one frame. Each fit is distributed;
    the crops (a handful, not data) are fitted from ``parallelism`` driver threads."""
    from concurrent.futures import ThreadPoolExecutor

    crops = list(crops)

    def run(crop):
        ml = prepare_for_fit(ml_table(fact, crop), materialized)
        return predict(fit(ml, params), ml)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(crops)))) as pool:
        preds = list(pool.map(run, crops))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out


def linear_baseline(df: DataFrame, x: str = "total_precipitation", label: str = LABEL,
                    by: Sequence[str] | None = ("commodity_name",)) -> DataFrame:
    """M8: least-squares line of ``label`` on one feature per group; a predictor whose every
    number has an exact SQL twin (regr_slope / regr_intercept), for the ranking operators."""
    keys = list(by or [])
    coef = df.groupBy(*keys).agg(F.regr_slope(label, x).alias("__slope"), F.regr_intercept(label, x).alias("__icpt"))
    if keys:
        coef = coef.select(*[F.col(k).alias(f"__g_{k}") for k in keys], "__slope", "__icpt")
        j = df.join(coef, [df[k].eqNullSafe(coef[f"__g_{k}"]) for k in keys], "left")
    else:
        one = coef.select(F.struct("__slope", "__icpt").alias("c")).scalar()
        j = df.withColumn("__coef", one).withColumns(
            {"__slope": F.col("__coef.__slope"), "__icpt": F.col("__coef.__icpt")}).drop("__coef")
    j = j.withColumn(PREDICTION, F.col("__icpt") + F.col("__slope") * F.col(x))
    j = j.withColumn("residual", F.col(label) - F.col(PREDICTION))
    return j.drop("__slope", "__icpt", *[f"__g_{k}" for k in keys])
