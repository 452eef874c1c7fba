"""Residual ranking and reporting: P16/P17/P25, T-1..T-3, T-6, R1, R2, F12.

Every ordering ends with the key columns, so ties come out the same in every run and engine.
Per-group top-k uses ``row_number() <= k``; Spark plans it with a partial group limit before the
shuffle, so each map task ships at most k rows per group even for a group holding most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import half_tail
from .enrich import matched
from .model import FEATURES

# The row key of a prediction, and the prediction layout (state_code added in front).
KEYS = ("state_code", "county_code", "year", "commodity_name", "irrigation_practice_code")
PREDICTION_COLUMNS = (*KEYS, "yield_amount", "predicted_yield", "residual", *FEATURES)
# the original's 12 columns: no state, no practice
PARITY_COLUMNS = tuple(c for c in PREDICTION_COLUMNS if c not in ("state_code", "irrigation_practice_code"))


def layout(df: DataFrame, with_state: bool = True) -> DataFrame:
    """P25: the prediction table layout, one row per ``KEYS``; ``with_state=False`` gives the
    """
    return df.select(*(PREDICTION_COLUMNS if with_state else PARITY_COLUMNS))


def _top(df: DataFrame, order, n: int, by: Sequence[str] | None, keys: Sequence[str] | None) -> DataFrame:
    # tie-break on the given keys, or on every column (a total order, so the result is unique)
    tie = [F.col(k).asc_nulls_last() for k in (keys if keys is not None else df.columns) if k in df.columns]
    if not by:
        return df.orderBy(*order, *tie).limit(n)
    w = Window.partitionBy(*by).orderBy(*order, *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def largest_abs(df: DataFrame, n: int = 50, by: Sequence[str] | None = None, col: str = "residual",
                keys: Sequence[str] | None = None) -> DataFrame:
    """T-1: the n rows of largest |residual| (per group when ``by`` is given)."""
    return _top(df, [F.abs(F.col(col)).desc_nulls_last()], n, by, keys)


def underperformers(df: DataFrame, n: int = 20, by: Sequence[str] | None = None, col: str = "residual",
                    keys: Sequence[str] | None = None) -> DataFrame:
    """T-2: most negative residuals first."""
    return _top(df, [F.col(col).asc_nulls_last()], n, by, keys)


def overperformers(df: DataFrame, n: int = 20, by: Sequence[str] | None = None, col: str = "residual",
                   keys: Sequence[str] | None = None) -> DataFrame:
    """T-3: most positive residuals first."""
    return _top(df, [F.col(col).desc_nulls_last()], n, by, keys)


def classify(df: DataFrame, tol: float = 0.0, col: str = "residual") -> DataFrame:
    """R1: 'outperform' above +tol, 'underperform' below -tol, else 'aligned' (null stays null)."""
    r = F.col(col)
    return df.withColumn(
        "performance",
        F.when(r > tol, "outperform").when(r < -tol, "underperform").when(r.isNotNull(), "aligned"),
    )


def consistency(df: DataFrame, by: Sequence[str] = ("state_code", "county_code", "commodity_name"),
                col: str = "residual", threshold: float | None = None, year: str = "year") -> DataFrame:
    """R2: per county and crop, how steadily it beats or trails the weather-based expectation. A
    year counts once: its residual is the mean over the rows (irrigation practices) of that year.

    With ``threshold`` (e.g. 0.8) a ``pattern`` column labels groups whose share of positive
    residuals is at least the threshold 'consistent outperformer', at most 1 - threshold
    'consistent underperformer', else 'mixed' (null without residuals).
    """
    r = F.col(col)
    per_year = df.groupBy(*by, year).agg(F.avg(r).alias(col))
    out = per_year.groupBy(*by).agg(
        F.count(r).alias("n_years"),
        F.avg(r).alias("mean_residual"),
        F.stddev_samp(r).alias("stddev_residual"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("share_positive"),
        F.min(r).alias("min_residual"),
        F.max(r).alias("max_residual"),
    )
    if threshold is None:
        return out
    share = F.col("share_positive")
    return out.withColumn(
        "pattern",
        F.when(share >= threshold, "consistent outperformer")
        .when(share <= 1 - threshold, "consistent underperformer")
        .when(share.isNotNull(), "mixed"),
    )


def sign_test(df: DataFrame, by: Sequence[str] = ("state_code", "county_code", "commodity_name"),
              col: str = "residual", alpha: float = 0.05, year: str = "year") -> DataFrame:
    """R2 with evidence: is a group above (or below) its expectation in more years than chance would have it?

    A year counts once, by the sign of its mean residual; years at exactly 0, null or NaN have no sign. ``p_above`` is the
    exact chance of at least ``n_above`` of ``n_signed`` years above when both signs are equally likely, ``p_below``
    likewise of at least ``n_signed - n_above`` years below. ``pattern`` says 'consistent outperformer' or 'consistent
    underperformer' when twice that chance is at most ``alpha`` (two-sided), else 'not shown'; so few years prove
    nothing: at 0.05 it takes six of six. A group without a signed year has chances 1 and is 'not shown'.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    r = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    per_year = df.groupBy(*by, year).agg(F.avg(r).alias("__r"))
    out = per_year.groupBy(*by).agg(F.count_if(F.col("__r") != 0).alias("n_signed"), F.count_if(F.col("__r") > 0).alias("n_above"))
    n, k = F.col("n_signed"), F.col("n_above")
    out = out.withColumns({"p_above": half_tail(n, k), "p_below": half_tail(n, n - k)})
    return out.withColumn("pattern", F.when(F.col("p_above") * 2 <= alpha, "consistent outperformer")
                          .when(F.col("p_below") * 2 <= alpha, "consistent underperformer").otherwise("not shown"))


def for_year(df: DataFrame, year: int, col: str = "year") -> DataFrame:
    """the year filter parameter of the reporting notebook."""
    return df.filter(F.col(col) == F.lit(year))


def top_counties(df: DataFrame, metric: str, n: int = 10, key: Sequence[str] = ("fips",),
                 agg: str = "sum") -> DataFrame:
    """T-6: the n counties with the largest aggregated ``metric`` (ties by key). Rows without a
    county (null key, or the code that marks unmatched rows) are no county and don't rank."""
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "count": F.count}[agg]
    per = matched(df, key).groupBy(*key).agg(fn(metric).alias(f"{agg}_{metric}"))
    return per.orderBy(F.col(f"{agg}_{metric}").desc_nulls_last(), *[F.col(k).asc() for k in key]).limit(n)
