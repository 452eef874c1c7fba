"""A1/A2: annual weather per county, as a sum or an average of five daily measures.

At scale the daily table is by far the largest input, so the county-level aggregate is
computed in two steps: observations are first reduced per (latitude, longitude, year) with a
map-side partial aggregate (one scan, a shuffle of at most stations x years rows, immune to a
hot station), then the small station-year table is joined to the coordinate mapping and
re-aggregated per county-year. Sums of sums, sums of counts and their ratio give exactly the
per-county sum, count and average of the one-step form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from .geo import attach, known

# The five daily measures and the grain of the annual table.
MEASURES = ("precipitation", "temp_max", "temp_min", "snow_depth", "snowfall")
GRAIN = ("geo_state_code", "geo_county_code", "geo_county_name", "year")
STATS = ("sum", "avg")


def out_name(stat: str, m: str) -> str:
    return f"{'total' if stat == 'sum' else 'avg'}_{m}"


def year_of(df: DataFrame, date_col: str = "date"):
    """Calendar year of a date, timestamp, or date string (malformed strings give null)."""
    t = df.schema[date_col].dataType
    c = F.col(date_col)
    if isinstance(t, StringType):
        c = F.try_to_date(c)
    elif not isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"{date_col} must be a date, timestamp or string, not {t.simpleString()}")
    return F.year(c)


def with_year(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("year", year_of(df, date_col))


def measure(df: DataFrame, m: str):
    """A measure column as a number: numeric types as they are; text (as daily feeds often
    deliver it) through ``try_cast`` to double, so a malformed value counts as missing."""
    t = df.schema[m].dataType
    c = F.col(m)
    return c.try_cast("double") if isinstance(t, StringType) else c


def annual(df: DataFrame, stat: str = "sum") -> DataFrame:
    """A1/A2 in one step, on rows that already carry their county (output of ``geo.attach``)."""
    if stat not in STATS:
        raise ValueError(f"stat must be one of {STATS}")
    agg = F.sum if stat == "sum" else F.avg
    d = df if "year" in df.columns else with_year(df)
    d = d.withColumns({m: measure(d, m) for m in MEASURES})
    return d.groupBy(*GRAIN).agg(
        *[agg(m).alias(out_name(stat, m)) for m in MEASURES],
        F.count(F.lit(1)).alias("observation_count"),
    )


def station_years(weather: DataFrame) -> DataFrame:
    """Per (latitude, longitude, year): sum and non-null count of each measure, row count."""
    d = weather.select("latitude", "longitude", year_of(weather).alias("year"),
                       *[measure(weather, m).alias(m) for m in MEASURES])
    return d.groupBy("latitude", "longitude", "year").agg(
        *[F.sum(m).alias(f"s_{m}") for m in MEASURES],
        *[F.count(m).alias(f"c_{m}") for m in MEASURES],
        F.count(F.lit(1)).alias("n"),
    )


def merge_station_years(sy: DataFrame) -> DataFrame:
    """Station-years of several parts (same columns, repeated keys) summed to one row per key."""
    parts = [c for c in sy.columns if c not in ("latitude", "longitude", "year")]
    return sy.groupBy("latitude", "longitude", "year").agg(*[F.sum(c).alias(c) for c in parts])


def annual_from_station_years(sy: DataFrame, mapping: DataFrame, stat: str = "sum") -> DataFrame:
    """Second step: attach counties to station-years and re-aggregate per county-year."""
    if stat not in STATS:
        raise ValueError(f"stat must be one of {STATS}")
    j = attach(sy, known(mapping))
    if stat == "sum":
        aggs = [F.sum(f"s_{m}").alias(out_name(stat, m)) for m in MEASURES]
    else:
        aggs = [F.try_divide(F.sum(f"s_{m}").cast("double"), F.sum(f"c_{m}")).alias(out_name(stat, m))
                for m in MEASURES]
    return j.groupBy(*GRAIN).agg(*aggs, F.sum("n").alias("observation_count"))
