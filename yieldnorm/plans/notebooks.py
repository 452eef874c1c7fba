"""The three analyses of the original, end to end, as functions returning DataFrames.

Each returns a dict of named, lazy (or materialised) DataFrames; nothing is collected. Writing
the result tables is optional and goes through ``sinks``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .. import sinks
from ..operators import enrich, model, quality, rank, stats
from . import flows
from .sizing import materialize


def training(weather_df: DataFrame, rings: DataFrame, yields_df: DataFrame, crop: str = "Corn",
             params: Mapping[str, object] | None = None, top_n: int = 50, tail_n: int = 20,
             years: tuple[int, int] | None = None, save_predictions_as: str | None = None,
             table_format: str = "parquet") -> dict[str, DataFrame]:
    """Annual sums -> fact table -> boosted-tree model for one crop -> residual rankings."""
    f = flows.fact_table(weather_df, rings, yields_df, "sum", years=years)
    ml = model.prepare_for_fit(model.ml_table(f, crop))
    m = model.fit(ml, params)
    pred = materialize(rank.layout(model.predict(m, ml)), "predictions")  # scored once for all outputs
    out = {
        "fact": f,
        "fact_null_counts": quality.null_counts(f),
        "model_table": ml,
        "predictions": pred,
        "metrics": model.metrics(pred),
        "largest_residuals": rank.largest_abs(pred, top_n),
        "underperformers": rank.underperformers(pred, tail_n),
        "overperformers": rank.overperformers(pred, tail_n),
        "importances": model.importances(m),
        "consistency": rank.consistency(pred),
    }
    if save_predictions_as:
        sinks.save_table(pred, save_predictions_as, fmt=table_format)
    return out


def correlation(weather_df: DataFrame, rings: DataFrame, yields_df: DataFrame,
                crops: Sequence[str] | None = (" Corn", " Soybeans"), nulls: str = "zero",
                years: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Annual averages -> fact table -> per-crop z-scores and Pearson correlations, of the given
    crops (None: all) and years."""
    f = flows.fact_table(weather_df, rings, yields_df, "avg", years=years)
    sel = f
    if crops:
        from pyspark.sql import functions as F
        sel = f.filter(F.col("commodity_name").isin(list(crops)))
    return {
        "fact": f,
        "normalized": stats.zscore(sel),
        "pearson": stats.pearson(sel, nulls=nulls),
        "moments": stats.moments(sel, stats.AVG_MEASURES),
    }


def enrichment(anomalies: DataFrame, summary: DataFrame, fips: DataFrame, save: bool = False,
               table_format: str = "parquet", anomalies_table: str = "flagged_anomalies_geo",
               summary_table: str = "county_summary_geo") -> dict[str, DataFrame]:
    """FIPS codes for the anomaly and county-summary tables, with match reports."""
    a = materialize(enrich.anomalies_enriched(anomalies, fips), "anomalies")  # joined once for all outputs
    s = materialize(enrich.summary_enriched(summary, anomalies, fips), "summary")
    a_geo, s_geo = enrich.pad(a), enrich.pad(s)
    out = {
        "anomalies_geo": a_geo,
        "anomalies_match_rate": quality.match_rate(a),
        "anomalies_unmatched": quality.unmatched(a),
        "summary_geo": s_geo,
        "summary_match_rate": quality.match_rate(s),
        "fips_duplicates": enrich.duplicate_keys(enrich.clean_fips(fips)),
        "map": enrich.map_table(a_geo),
    }
    if save:
        sinks.save_table(a_geo, anomalies_table, fmt=table_format)
        sinks.save_table(s_geo, summary_table, fmt=table_format)
    return out


__all__ = ["training", "correlation", "enrichment"]
