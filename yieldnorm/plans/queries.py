"""

Each query takes (spark, sf_dir) and returns a DataFrame. Floating results are rounded to
``DIGITS`` decimals so that the DuckDB twin in ``plans.oracle`` can be compared value by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import enrich, fact, geo, model, quality, rank, stats, trees, weather, yields
from .. import sinks
from ..sources import county_rings, fixtures, read_county_rings, read_fips, tables
from ..streaming import annual as streaming_annual
from . import flows
from .sizing import broadcast_if_small, materialize, path_exists, run_folder, scratch_path

DIGITS = 6
# The registered model queries run the original's fit and grid (tests put smaller ones here).
GBT_PARAMS = dict(model.DEFAULT_PARAMS)
GBT_GRID = dict(model.PARAM_GRID)
GBT_THREADS = 9  # fits submitted at a time
MAP_YEAR = 1997
CONSISTENCY_SHARE = 0.75
SIGN_ALPHA = 0.3  # the test tables have seven years
CELL = flows.FIXTURE_CELL
HOLDOUT_YEARS = (2000, 2001)
# The coordinate mapping has one row per distinct station location (2 doubles + 3 short codes);
# it is broadcast up to this size, checked by counting its materialised rows.
MAPPING_BROADCAST_BYTES = 64 << 20
LINEAR_X = "total_precipitation"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in dbl}) if dbl else df


# ---------------------------------------------------------------- sources

def q_src_weather(spark, d):
    return tables.weather(spark, fixtures.weather_daily(spark, d))


def q_src_weather_checked(spark, d):
    """S1 with a quarantine: precipitation as text, unreadable at some temperatures; good rows and rows put aside,
    counted by date."""
    w = fixtures.weather_daily(spark, d)
    text = F.when(F.col("temp_max") % 50 == 7, F.concat(F.lit("?"), F.col("precipitation"))).otherwise(F.col("precipitation").cast("string"))
    folder = scratch_path(spark, "quarantine")
    good = tables.weather(spark, w.withColumn("precipitation", text), quarantine=folder)
    bad = spark.read.parquet(folder).select(
        F.get_json_object("raw", "$.date").cast("date").alias("date"), F.lit(None).cast("double").alias("precipitation"), "reason")
    both = good.select("date", "precipitation", F.lit(None).cast("string").alias("reason")).unionByName(bad)
    return both.groupBy("date").agg(F.count_if(F.col("reason").isNull()).alias("n_good"), F.sum("precipitation").alias("precipitation"),
                                    F.count_if(F.col("reason") == "precipitation is no double").alias("n_bad"))


def q_src_yields(spark, d):
    return tables.yields(spark, fixtures.county_yields(spark, d))


def q_src_county_rings(spark, d):
    return _ring_report(county_rings(fixtures.county_features(spark, d)), "ord")


def q_src_fips(spark, d):
    return fixtures.fips_master(spark, d)


def q_src_fips_csv(spark, d):
    """K4 -> S4: the FIPS list written as CSV part files (nulls as NA) and read back with the
    explicit-schema reader."""
    path = scratch_path(spark, "fips_csv")
    sinks.save_csv(fixtures.fips_master(spark, d), path, null_value="NA")
    return read_fips(spark, path)


def q_src_anomalies(spark, d):
    return tables.anomalies(spark, fixtures.flagged_anomalies(spark, d))


def q_src_county_summary(spark, d):
    return tables.county_summary(spark, fixtures.county_summary(spark, d))


# ---------------------------------------------------------------- geocoding and weather

def _rings(spark, d):
    return flows.fixture_rings(spark, d)


def _written_features(spark, d, lines):
    """The county features written as GeoJSON text: a FeatureCollection document, or a Feature per line."""
    props, geom = F.to_json("properties"), F.concat(
        F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geom, F.lit("}"))
    feats = fixtures.county_features(spark, d).select("ord", feature.alias("f"))
    path = scratch_path(spark, "geojson")
    if lines:
        feats.orderBy("ord").select("f").write.text(path)
    else:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "f"))), lambda x: x["f"]), ",")
        whole = feats.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("f"))
        whole.coalesce(1).write.text(path)
    return path


def _ring_report(r, *first):
    return r.select(*first, "state_code", "county_code", "county_name", "poly_no", "ring_no",
                    F.size("ring").alias("n_points"), "x0", "y0", "x1", "y1")


def q_src_county_rings_file(spark, d):
    """S5 from a FeatureCollection file."""
    rings = read_county_rings(spark, _written_features(spark, d, lines=False))
    by_key = fixtures.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    # positions in the file count the features; report the county's key like the in-memory source
    rings = rings.join(by_key, rings["county_name"] == by_key["n_name"]).withColumn("ord", F.col("k"))
    return _ring_report(rings, "ord")


def q_src_county_rings_lines(spark, d):
    """S5 from line-delimited features."""
    return _ring_report(read_county_rings(spark, _written_features(spark, d, lines=True), lines=True))


def q_geo_mapping(spark, d):
    return geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True, cell=CELL)


def q_geo_mapping_subtract(spark, d):
    """J1 with holes subtracted (even-odd parity over the rings of each polygon)."""
    return geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True, holes="subtract",
                      cell=CELL)


def q_geo_mapping_bands(spark, d):
    """J1 refined against the edges of the point's latitude band, over rings read from a file."""
    rings = materialize(read_county_rings(spark, _written_features(spark, d, lines=False)), "rings")
    return geo.assign(fixtures.weather_daily(spark, d), rings, keep_unknown=True, refine="bands", cell=CELL)


def q_geo_mapping_auto(spark, d):
    """J1 with the library's default cell size (the median ring extent)."""
    return geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True)


def q_geo_mapping_ring(spark, d):
    """J1 refined against whole rings (the alternative to the default edge-band index)."""
    return geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True, refine="ring",
                      cell=CELL)


def q_geo_mapping_quadtree(spark, d):
    """J1 by the adaptive cover of every ring instead of a grid."""
    return geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True, refine="quadtree")


def q_geo_mapping_known(spark, d):
    return geo.known(geo.assign(fixtures.weather_daily(spark, d), _rings(spark, d), keep_unknown=True, cell=CELL))


def q_weather_with_county(spark, d):
    w = fixtures.weather_daily(spark, d)
    # only matched coordinates are needed for the inner attach
    mapping = materialize(geo.assign(w, _rings(spark, d), keep_unknown=False, cell=CELL), "mapping")
    m, _ = broadcast_if_small(mapping, row_bytes=96, max_bytes=MAPPING_BROADCAST_BYTES)
    return weather.with_year(geo.attach(w, m))


def q_annual_sum_direct(spark, d):
    """A1 in the original's order: attach every row, then aggregate."""
    w = fixtures.weather_daily(spark, d)
    mapping = geo.assign(w, _rings(spark, d), keep_unknown=True, cell=CELL)
    return weather.annual(weather.with_year(geo.attach(w, mapping)), "sum")


def q_annual_sum(spark, d):
    w, r, _ = flows.fixture_inputs(spark, d)
    return flows.annual_weather(w, r, "sum", cell=CELL, share_rings=False)


def q_annual_avg(spark, d):
    w, r, _ = flows.fixture_inputs(spark, d)
    return rounded(flows.annual_weather(w, r, "avg", cell=CELL, share_rings=False))


def q_streaming_annual_sum(spark, d):
    """A1 kept up to date over a stream of the given daily rows (read in place, no copy)."""
    li = spark.readStream.schema(fixtures.table(spark, d, "lineitem").schema).parquet(f"{d.rstrip('/')}/lineitem.parquet*")
    stream = fixtures.weather_daily(spark, d, li)
    return streaming_annual.run_to_completion(stream, _rings(spark, d), scratch_path(spark, "annual_stream"),
                                              scratch_path(spark, "annual_stream_ckpt"), "sum", cell=CELL)


def q_annual_avg_unfilled(spark, d):
    """A2 without P13: county-years whose measure is never observed keep a null average."""
    w, r, _ = flows.fixture_inputs(spark, d)
    return rounded(flows.annual_weather(w, r, "avg", cell=CELL, share_rings=False, fill_avg=False))


def q_yields_prepared(spark, d):
    return yields.prepare(fixtures.county_yields(spark, d))


def q_fact_sum(spark, d):
    return flows.fixture_fact(spark, d, "sum", shared=False)


def q_fact_avg(spark, d):
    return rounded(flows.fixture_fact(spark, d, "avg", shared=False))


def q_fact_null_counts(spark, d):
    return quality.null_counts(flows.fixture_fact(spark, d, "sum", shared=False))


def q_fact_row_count(spark, d):
    return quality.row_count(flows.fixture_fact(spark, d, "sum", shared=False))


def q_fact_preview(spark, d):
    """K6: bounded, ordered preview of the fact table."""
    f = flows.fixture_fact(spark, d, "sum", shared=False)
    return quality.preview(f, 20, ["state_code", "county_code", "year", "commodity_code", "irrigation_practice_code"])


def q_annual_sum_years(spark, d):
    """F13 pushed to the scan: only 1996-2000 observations are aggregated."""
    w, r, _ = flows.fixture_inputs(spark, d)
    return flows.annual_weather(w, r, "sum", cell=CELL, share_rings=False, years=(1996, 2000))


def q_fact_years(spark, d):
    return fact.years(flows.fixture_fact(spark, d, "sum", shared=False), 1996, 2000)


# ---------------------------------------------------------------- correlation

def q_crop_moments(spark, d):
    return rounded(stats.moments(flows.fixture_fact(spark, d, "avg", shared=False), stats.AVG_MEASURES))


def q_crop_zscore(spark, d):
    return rounded(stats.zscore(flows.fixture_fact(spark, d, "avg")))


def q_corn_zscore(spark, d):
    corn = fact.crop(flows.fixture_fact(spark, d, "avg"), " Corn", trim=False)
    return rounded(stats.zscore(corn, by=None))


def q_pearson(spark, d):
    return rounded(stats.pearson(flows.fixture_fact(spark, d, "avg", shared=False), nulls="zero"))


def q_pearson_pairwise(spark, d):
    return rounded(stats.pearson(flows.fixture_fact(spark, d, "avg", shared=False), nulls="pairwise"))


# ---------------------------------------------------------------- model table and residuals

def q_ml_table(spark, d):
    return model.ml_table(flows.fixture_fact(spark, d, "sum", shared=False), "Corn")


def q_ml_fill_mean(spark, d):
    f = flows.fixture_fact(spark, d, "sum")
    t = (fact.crop(f, "Corn").select("state_code", "county_code", "year", "commodity_name", "yield_amount",
                                     *model.FEATURES).filter(F.col("yield_amount").isNotNull()))
    return rounded(quality.fill_mean(t, ["total_temp_max", "total_temp_min"]))


def _linear(spark, d):
    f = flows.fixture_fact(spark, d, "sum").filter(F.col("yield_amount").isNotNull())
    return model.linear_baseline(f, x=LINEAR_X, by=["commodity_name"])


def _pred_cols(df):
    return df.select(*rank.PREDICTION_COLUMNS)


def q_linear_predictions(spark, d):
    return rounded(_pred_cols(_linear(spark, d)))


def q_top50_abs_residual(spark, d):
    return rounded(rank.largest_abs(_pred_cols(_linear(spark, d)), 50))


def q_underperformers(spark, d):
    return rounded(rank.underperformers(_pred_cols(_linear(spark, d)), 20))


def q_overperformers(spark, d):
    return rounded(rank.overperformers(_pred_cols(_linear(spark, d)), 20))


def q_top5_abs_residual_by_crop(spark, d):
    return rounded(rank.largest_abs(_pred_cols(_linear(spark, d)), 5, by=["commodity_name"]))


def q_linear_metrics(spark, d):
    return rounded(model.metrics(_linear(spark, d), by=["commodity_name"]))


def q_residual_class(spark, d):
    return rounded(rank.classify(_pred_cols(_linear(spark, d)), tol=5.0))


def q_residual_consistency(spark, d):
    return rounded(rank.consistency(_linear(spark, d)))


def q_residual_patterns(spark, d):
    """R2 with labels: consistent out-/under-performers at a 0.75 share of positive residuals."""
    return rounded(rank.consistency(_linear(spark, d), threshold=CONSISTENCY_SHARE))


def q_residual_sign_test(spark, d):
    """R2 by an exact sign test over the years. Nine digits: chances are multiples of 1/128, ties at the sixth digit."""
    return rounded(rank.sign_test(_linear(spark, d), alpha=SIGN_ALPHA), 9)


# ---------------------------------------------------------------- FIPS enrichment

def _fips(spark, d):
    return fixtures.fips_master(spark, d)


def _anom(spark, d):
    return fixtures.flagged_anomalies(spark, d)


def q_fips_clean(spark, d):
    return enrich.clean_fips(_fips(spark, d))


def q_fips_duplicates(spark, d):
    return enrich.duplicate_keys(enrich.clean_fips(_fips(spark, d))).select("county", "state_abbr", "n")


def q_anomalies_geo(spark, d):
    return enrich.anomalies_geo(_anom(spark, d), _fips(spark, d))


def q_anomalies_match_rate(spark, d):
    return rounded(quality.match_rate(enrich.anomalies_enriched(_anom(spark, d), _fips(spark, d))))


def q_anomalies_unmatched(spark, d):
    return quality.unmatched(enrich.anomalies_enriched(_anom(spark, d), _fips(spark, d)))


def q_state_lookup(spark, d):
    return enrich.state_lookup(enrich.anomalies_enriched(_anom(spark, d), _fips(spark, d)))


def q_county_summary_geo(spark, d):
    return enrich.summary_geo(fixtures.county_summary(spark, d), _anom(spark, d), _fips(spark, d))


def q_summary_match_rate(spark, d):
    s = enrich.summary_enriched(fixtures.county_summary(spark, d), _anom(spark, d), _fips(spark, d))
    return rounded(quality.match_rate(s))


def q_anomaly_map(spark, d):
    return enrich.map_table(enrich.anomalies_geo(_anom(spark, d), _fips(spark, d)))


def q_anomaly_map_year(spark, d):
    return rank.for_year(enrich.map_table(enrich.anomalies_geo(_anom(spark, d), _fips(spark, d))), MAP_YEAR)


def q_top10_counties(spark, d):
    g = enrich.anomalies_geo(_anom(spark, d), _fips(spark, d))
    return rank.top_counties(g, "c_custkey", 10, key=("fips",), agg="count")


# ---------------------------------------------------------------- sinks: written, then read back

def _sink_name(spark, name):
    return f"yieldnorm_sink_{name}_{spark.sparkContext.applicationId.replace('-', '_')}"


def q_sink_table(spark, d):
    """K1/K2/K5: a table written by name and read by name."""
    name = _sink_name(spark, "fact")
    sinks.save_table(flows.fixture_fact(spark, d, "sum", shared=False), name, partition_by=["year"],
                     path=scratch_path(spark, "sink"))
    back = spark.table(name)
    return back.select(*fact.columns("sum"))


def q_sink_table_replaced(spark, d):
    """K1/K2/K5: a second write with another schema replaces the table."""
    name = _sink_name(spark, "replaced")
    sinks.save_table(fixtures.flagged_anomalies(spark, d), name, path=scratch_path(spark, "sink"))
    sinks.save_table(q_county_summary_geo(spark, d), name, path=scratch_path(spark, "sink"))
    return spark.table(name)


def q_sink_parquet(spark, d):
    """K3: a parquet folder, overwritten and read back."""
    path = scratch_path(spark, "sink")
    f = flows.fixture_fact(spark, d, "sum")
    sinks.save_parquet(f, path)
    sinks.save_parquet(fact.years(f, 1996, 2000), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- boosted trees

def _key(d, *parts):
    return hashlib.sha1(repr((d.rstrip("/"), parts)).encode()).hexdigest()[:16]


def _corn_ml(spark, d):
    """The model table, written once per run and data folder."""
    path = f"{run_folder(spark)}/model-table-{_key(d)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        # the fact table has one consumer here; the model table itself is read by many jobs
        table = model.ml_table(flows.fixture_fact(spark, d, "sum", shared=False), "Corn")
        table.write.mode("overwrite").parquet(path)
    ml = spark.read.parquet(path)
    quality.ensure_not_empty(ml, "model table")
    return ml


def _corn_model_path(spark, d):
    return f"{run_folder(spark)}/model-{_key(d, GBT_PARAMS)}"


def _corn_model(spark, d):
    """(model table, fitted pipeline): the fit is stored once per run and read by its queries."""
    ml, path = _corn_ml(spark, d), _corn_model_path(spark, d)
    if not path_exists(spark, f"{path}-done/_SUCCESS"):
        model.fit(ml, GBT_PARAMS).write().overwrite().save(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
    return ml, PipelineModel.load(path)


def _corn_predictions(spark, d):
    ml, fitted = _corn_model(spark, d)
    return model.predict(fitted, ml)


def _corn_grid(spark, d):
    path = f"{run_folder(spark)}/grid-{_key(d, GBT_GRID)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        model.grid(_corn_ml(spark, d), GBT_GRID, parallelism=GBT_THREADS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _crop_predictions(spark, d):
    path = f"{run_folder(spark)}/by-crop-{_key(d, GBT_PARAMS)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        f = flows.fixture_fact(spark, d, "sum")
        crops = [r[0] for r in f.select(F.trim("commodity_name")).distinct().orderBy(F.trim("commodity_name")).collect()]
        pred = model.fit_by_crop(f, crops, GBT_PARAMS, parallelism=GBT_THREADS)
        rank.layout(pred).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def q_gbt_predictions(spark, d):
    return rounded(rank.layout(_corn_predictions(spark, d)))


def _prediction_rows(pred):
    """Key and label of each prediction, whether it has a value, and whether the residual is the difference."""
    near = F.abs(F.col("residual") - (F.col("yield_amount") - F.col("predicted_yield"))) < 1e-9
    return rounded(pred.select(*rank.KEYS, "yield_amount", (F.abs("predicted_yield") < float("inf")).alias("predicted"),
                               near.alias("residual_is_difference")))


def q_gbt_prediction_rows(spark, d):
    return _prediction_rows(_corn_predictions(spark, d))


def _corn_scored(spark, d):
    """(rows with their fitted prediction and every tree's part of it, the trees), scored by descent over the tree table."""
    pred = _corn_predictions(spark, d)
    table = trees.nodes(spark, _corn_model_path(spark, d))
    return trees.score(pred, table, depth=GBT_PARAMS["maxDepth"]), table


def _near(a, b, within=1e-9):
    return F.abs(a - b) <= within * F.greatest(F.lit(1.0), F.abs(b))


def q_gbt_tree_scores(spark, d):
    """M4: descent over the tree table gives the fitted model's prediction of every row."""
    scored, _ = _corn_scored(spark, d)
    return rounded(scored.select(*rank.KEYS, "yield_amount", _near(trees.first_trees(F.col("parts")), F.col("predicted_yield"))
                                 .alias("scores_equal")))


def q_gbt_first_leaves(spark, d):
    """M2/M3: each leaf of the first tree holds the mean of the labels that reach it."""
    leaves = trees.leaf_means(*_corn_scored(spark, d))
    return rounded(leaves.agg(F.sum("n").alias("n_rows"), F.bool_and(F.coalesce(_near(F.col("value"), F.col("mean")), F.lit(False)))
                              .alias("leaves_are_means"), F.sum(F.col("n") * F.col("value")).alias("total_yield")))


def q_gbt_prefix_rmse(spark, d):
    """M6: sums over the first trees of one fit give the grid's errors for fewer iterations."""
    scored, _ = _corn_scored(spark, d)
    mine = [k for k in GBT_GRID["maxIter"] if k <= GBT_PARAMS["maxIter"]]
    same = (F.col("maxDepth") == GBT_PARAMS["maxDepth"]) & (F.col("stepSize") == GBT_PARAMS["stepSize"])
    grid = _corn_grid(spark, d).filter(same).select("maxIter", F.col("rmse").alias("grid_rmse"))
    got = trees.rmse_by_iterations(scored, mine).join(grid, "maxIter", "left")
    return got.select("maxIter", "n", F.coalesce(_near(F.col("rmse"), F.col("grid_rmse")), F.lit(False)).alias("rmse_equals_grid"))


def q_gbt_predictions_view(spark, d):
    """The original's 12-column prediction table, largest |residual| first (top 50)."""
    return rounded(rank.largest_abs(rank.layout(_corn_predictions(spark, d), with_state=False), 50))


def q_gbt_holdout_metrics(spark, d):
    """Train on every year but the last two, score the held-out years."""
    train, test = model.split_by_year(_corn_ml(spark, d), HOLDOUT_YEARS)
    return rounded(model.metrics(model.predict(model.fit(train, GBT_PARAMS), test)))


def q_gbt_metrics(spark, d):
    return rounded(model.metrics(_corn_predictions(spark, d)))


def q_gbt_importances(spark, d):
    return rounded(model.importances(_corn_model(spark, d)[1]))


def q_gbt_importance_sum(spark, d):
    imp = model.importances(_corn_model(spark, d)[1])
    return rounded(imp.agg(F.count(F.lit(1)).alias("n_features"), F.bool_and(F.col("importance").between(0, 1)).alias("all_between_0_and_1"),
                           F.sum("importance").alias("total")))


def q_gbt_grid(spark, d):
    return rounded(_corn_grid(spark, d))


def q_gbt_grid_points(spark, d):
    """The grid in product order; in-sample RMSE never rises with more trees of the same kind."""
    same = Window.partitionBy("maxDepth", "stepSize").orderBy("maxIter")
    fewer = F.coalesce(F.lag("rmse").over(same), F.lit(float("inf")))
    return _corn_grid(spark, d).select("grid_pos", "maxIter", "maxDepth", "stepSize",
                                       (F.col("rmse") <= fewer + 1e-9).alias("rmse_not_above_fewer_trees"))


def q_gbt_best(spark, d):
    return rounded(model.best(_corn_grid(spark, d)))


def q_gbt_best_is_least(spark, d):
    g = _corn_grid(spark, d)
    least = g.agg(F.min("rmse").alias("least"))
    return model.best(g).crossJoin(least).agg(F.count(F.lit(1)).alias("n_best"), F.bool_and(F.col("rmse") == F.col("least")).alias("least_rmse"))


def q_gbt_by_crop(spark, d):
    """M7: one fit per crop of the table."""
    return rounded(_crop_predictions(spark, d))


def q_gbt_by_crop_rows(spark, d):
    return _prediction_rows(_crop_predictions(spark, d))


def q_schema_report(spark, d):
    """S8 over the schema of the fact table, from the analysed plan (no job runs)."""
    w, r, y = flows.fixture_inputs(spark, d)
    return quality.schema_report(flows.fact_table(w, r, y, "sum", cell=CELL, checkpoint=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
