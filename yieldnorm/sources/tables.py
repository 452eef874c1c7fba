"""Readers for the input tables (catalog name or parquet path), pruned to the columns used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import require
from .quarantine import cast_text

# Input column names of the weather, yields and anomaly tables.
WEATHER_COLUMNS = ("latitude", "longitude", "date", "precipitation", "temp_max", "temp_min",
                   "snow_depth", "snowfall")
WEATHER_TYPES = {c: "date" if c == "date" else "double" for c in WEATHER_COLUMNS}
YIELD_COLUMNS = ("State Code", "State Name", "State Abbreviation", "County Code", "County Name",
                 "Yield Year", "Commodity Code", "Commodity Name", "Irrigation Practice Code",
                 "Irrigation Practice Name", "Yield Amount")
ANOMALY_COLUMNS = ("county", "state_abbr", "state")
SUMMARY_COLUMNS = ("county", "state")


def _is_path(ref: str, fmt: str = "parquet") -> bool:
    return "/" in ref or ref.endswith("." + fmt)


def load(spark: SparkSession, ref: str | DataFrame, fmt: str = "parquet") -> DataFrame:
    """A DataFrame as is, a catalog table by (possibly 3-part) name, or files by path."""
    if isinstance(ref, DataFrame):
        return ref
    if _is_path(ref, fmt):
        return spark.read.format(fmt).load(ref)
    return spark.table(ref)


def weather(spark: SparkSession, ref: str | DataFrame, quarantine: str | None = None) -> DataFrame:
    """Daily weather observations, only the eight columns the pipeline reads. Text that is no date or number counts as
    missing later on; with a ``quarantine`` folder such rows go there and text columns become dates and doubles."""
    df = load(spark, ref)
    require(df, WEATHER_COLUMNS)
    df = df.select(*WEATHER_COLUMNS)
    if quarantine is None:
        return df
    # a row's file for files, the table's name for a table (it may be a view over a join, which has no one file)
    file = None if isinstance(ref, DataFrame) else F.input_file_name() if _is_path(ref) else F.lit(ref)
    return cast_text(df, WEATHER_TYPES, quarantine, file)


def yields(spark: SparkSession, ref: str | DataFrame) -> DataFrame:
    """County yields report (column names contain blanks)."""
    df = load(spark, ref)
    require(df, YIELD_COLUMNS)
    return df


def anomalies(spark: SparkSession, ref: str | DataFrame) -> DataFrame:
    """S3: flagged anomalies; needs county, state_abbr, state (other columns pass through)."""
    df = load(spark, ref)
    require(df, ANOMALY_COLUMNS)
    return df


def county_summary(spark: SparkSession, ref: str | DataFrame) -> DataFrame:
    """S3: county summary; needs county, state (other columns pass through)."""
    df = load(spark, ref)
    require(df, SUMMARY_COLUMNS)
    return df
