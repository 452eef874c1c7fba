"""Shared flows of the analyses, with their materialisation points.

* ``in_years``         the year range as a date predicate that reaches the scan
* ``station_years``    the one scan of the daily table, pre-aggregated and materialised
* ``annual_weather``   geocode stations, aggregate weather per county-year (sum or avg)
* ``fact_table``       annual weather x prepared yields, 17-column layout

``plans.notebooks`` composes these with the statistics, model and enrichment operators into the
three analyses of the original.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators import fact, geo, weather, yields
from ..operators.quality import fill
from ..sources import fixtures
from .sizing import materialize, path_exists, run_folder


def in_years(weather_df: DataFrame, years: tuple[int, int] | None, date_col: str = "date") -> DataFrame:
    """F13 on the daily table, as a date range so that it reaches the parquet scan (row-group
    skipping, partition pruning) instead of filtering after the aggregate."""
    if not years:
        return weather_df
    lo, hi = years
    d = F.col(date_col)
    start, end = F.lit(f"{lo:04d}-01-01"), F.lit(f"{hi + 1:04d}-01-01")
    if not isinstance(weather_df.schema[date_col].dataType, StringType):
        start, end = start.cast("date"), end.cast("date")
    # ISO date text compares correctly as text, so that form is pushed down as is (no cast)
    return weather_df.filter((d >= start) & (d < end))


def station_years(weather_df: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Station-year partial sums of the daily table, materialised so that the geocoding branch
    and the aggregation branch share one scan of the daily table."""
    sy = weather.station_years(weather_df)
    return materialize(sy, "station_years") if checkpoint else sy


def annual_weather(weather_df: DataFrame, rings: DataFrame, stat: str = "sum", cell: float | str = "auto",
                   holes: str = "fill", fill_avg: bool = True, checkpoint: bool = True,
                   years: tuple[int, int] | None = None, refine: str = "bands", share_rings: bool = True) -> DataFrame:
    """A1 (sum) / A2 (avg, with P13's 0.0 fill when ``fill_avg``) per county-year. ``share_rings`` writes the rings before
    they are joined: for rings parsed from a document, which each branch would parse again."""
    sy = station_years(in_years(weather_df, years), checkpoint)
    if checkpoint and share_rings:  # parsed once; J1 reads the rings in several branches, joined on stable ids
        rings = materialize(rings, "rings")
    mapping = geo.assign(sy, rings, cell=cell, keep_unknown=False, holes=holes, refine=refine)
    ann = weather.annual_from_station_years(sy, mapping, stat)
    if stat == "avg" and fill_avg:
        ann = fill(ann, {weather.out_name("avg", m): 0.0 for m in weather.MEASURES})
    return ann


def fact_table(weather_df: DataFrame, rings: DataFrame, yields_df: DataFrame, stat: str = "sum",
               cell: float | str = "auto", checkpoint: bool = True, years: tuple[int, int] | None = None,
               shared: bool = True, share_rings: bool = True) -> DataFrame:
    """The 17-column fact table.

    ``shared=True`` writes it once to the shared folder, for consumers that read it in more
    than one branch (statistics joined back, scalar subqueries, model fits): they then read that
    small table instead of re-running geocoding and the yields derivation per branch. A single
    consumer (one aggregate, one projection) gains nothing from the extra write.
    """
    ann = annual_weather(weather_df, rings, stat, cell=cell, checkpoint=checkpoint, years=years, share_rings=share_rings)
    f = fact.build(ann, yields.prepare(yields_df), stat)
    return materialize(f, f"fact_{stat}") if (checkpoint and shared) else f


# ---- the same plans over the test tables (FIXTURES.md) ----

# The test geography is in degrees with county-sized polygons: a fixed 0.5-degree grid (the
FIXTURE_CELL = 0.5


def fixture_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county rings, written once per run and data folder: reference data with a row per ring, whose derivation takes
    longer than the joins that read it."""
    name = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    path = f"{run_folder(spark)}/rings-{name}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fixtures.county_ring_table(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fixture_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (fixtures.weather_daily(spark, sf_dir),
            fixture_rings(spark, sf_dir),
            fixtures.county_yields(spark, sf_dir))


def fixture_fact(spark: SparkSession, sf_dir: str, stat: str = "sum", shared: bool = True) -> DataFrame:
    w, r, y = fixture_inputs(spark, sf_dir)
    return fact_table(w, r, y, stat, cell=FIXTURE_CELL, shared=shared, share_rings=False)
