"""FIPS enrichment of county tables: F5, P9-P12, P22, P26, J4-J6, A10, R3.

The original moves both tables to pandas and merges there; here the two tables stay
distributed and are joined on normalised (county, state_abbr). pandas' merge matches a null
key with a null key, so the keys are compared with ``<=>``, which Spark still plans as an
equi-join. A FIPS list with a repeated key fans rows out exactly like the merge does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import fips5, norm_abbr, norm_county

JOIN_KEYS = ("county", "state_abbr")
# Fixed value: the padded code of rows that matched no county.
UNMATCHED = "00000"


def clean_fips(fips: DataFrame) -> DataFrame:
    """F5 + P9 + P11: drop state-level rows (null state), derive the join keys."""
    return fips.na.drop(subset=["state"]).withColumns({
        "county": norm_county("name", strip_suffix=True),
        "state_abbr": norm_abbr("state"),
    })


def normalize_places(df: DataFrame) -> DataFrame:
    """P10 (+P11 when the table has ``state_abbr``): normalise the data table's keys."""
    cols = {"county": norm_county("county", strip_suffix=False)}
    if "state_abbr" in df.columns:
        cols["state_abbr"] = norm_abbr("state_abbr")
    return df.withColumns(cols)


def duplicate_keys(fips_clean: DataFrame) -> DataFrame:
    """T9 report: FIPS keys that occur more than once after normalisation (they fan out rows)."""
    return (fips_clean.groupBy(*JOIN_KEYS)
            .agg(F.count(F.lit(1)).alias("n"), F.min("fips").alias("min_fips"), F.max("fips").alias("max_fips"))
            .filter(F.col("n") > 1))


def with_fips(df: DataFrame, fips_clean: DataFrame, keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    """J4/J5 (+P26): left join on the keys, null-safe; appends ``fips`` (null when unmatched).
    An existing ``fips`` column of ``df`` is replaced."""
    if "fips" in df.columns:
        df = df.drop("fips")
    right = fips_clean.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("fips"))
    cond = [df[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    return df.join(right, cond, "left").drop(*[f"__r_{k}" for k in keys])


def pad(df: DataFrame, col: str = "fips") -> DataFrame:
    """FIPS as 5 characters; '00000' marks unmatched rows."""
    return df.withColumn(col, fips5(col))


def matched(df: DataFrame, key: Sequence[str] = ("fips",)) -> DataFrame:
    """Rows that belong to a county: every key column is set and is not the unmatched code."""
    for k in key:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != UNMATCHED))
    return df


def state_lookup(df: DataFrame) -> DataFrame:
    """A10: state -> state_abbr from the enriched rows. A state with two abbreviations raises
    when the lookup is evaluated (inside the plan, no separate job)."""
    pairs = df.select("state", "state_abbr").distinct()
    g = pairs.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("state_abbr").alias("abbr"))
    msg = F.concat(F.lit("state '"), F.coalesce(F.col("state"), F.lit("null")), F.lit("' has "),
                   F.col("n").cast("string"), F.lit(" abbreviations"))
    return g.select("state", F.when(F.col("n") > 1, F.raise_error(msg)).otherwise(F.col("abbr")).alias("state_abbr"))


def with_state_abbr(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Set ``state_abbr`` by state name (null-safe, like a pandas ``map``); an existing
    ``state_abbr`` column is replaced, as the assignment in the original does."""
    base = df.drop("state_abbr") if "state_abbr" in df.columns else df
    right = lookup.select(F.col("state").alias("__r_state"), "state_abbr")
    return base.join(right, base["state"].eqNullSafe(right["__r_state"]), "left").drop("__r_state")


def anomalies_geo(anomalies: DataFrame, fips: DataFrame) -> DataFrame:
    """``flagged_anomalies_geo``: anomalies with a 5-character FIPS code."""
    return pad(with_fips(normalize_places(anomalies), clean_fips(fips)))


def anomalies_enriched(anomalies: DataFrame, fips: DataFrame) -> DataFrame:
    """Anomalies joined to FIPS before padding (null fips = unmatched): input of A9 / A11."""
    return with_fips(normalize_places(anomalies), clean_fips(fips))


def summary_geo(summary: DataFrame, anomalies: DataFrame, fips: DataFrame) -> DataFrame:
    """``county_summary_geo``: the summary gets its state_abbr from the enriched anomalies, then
    its FIPS code."""
    lookup = state_lookup(anomalies_enriched(anomalies, fips))
    s = with_state_abbr(normalize_places(summary), lookup)
    return pad(with_fips(s, clean_fips(fips)))


def summary_enriched(summary: DataFrame, anomalies: DataFrame, fips: DataFrame) -> DataFrame:
    lookup = state_lookup(anomalies_enriched(anomalies, fips))
    return with_fips(with_state_abbr(normalize_places(summary), lookup), clean_fips(fips))


def map_table(df: DataFrame, metric: str | None = None, agg: str = "count",
              keys: Sequence[str] = ("fips", "year")) -> DataFrame:
    """One row per 5-character FIPS and year, ready for a choropleth. Unmatched rows are left
    out (A11 reports them). With a ``metric``, ``agg`` is applied to it (``count``: non-null
    values); without one the rows are counted."""
    df = matched(df, [k for k in keys if k == "fips"])
    if metric is None:
        if agg != "count":
            raise ValueError(f"agg={agg!r} needs a metric")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "count": F.count}[agg]
    return df.groupBy(*keys).agg(fn(metric).alias(f"{agg}_{metric}"), F.count(F.lit(1)).alias("n_rows"))
