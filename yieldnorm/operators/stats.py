"""Per-crop statistics of the weather measures against yield.

The original computes mean and standard deviation on the driver and re-injects them as
literals, then runs one ``stat.corr`` job per measure and crop. Here every crop and measure is
done by one grouped aggregate (map-side partial aggregation, so a crop holding most rows costs
no more than any other), and the statistics are joined back on the group key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The averaged measures used by the correlation analysis.
AVG_MEASURES = ("avg_precipitation", "avg_temp_max", "avg_temp_min", "avg_snow_depth", "avg_snowfall")


def _keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def moments(df: DataFrame, cols: Iterable[str], by: str | Sequence[str] | None = "commodity_name") -> DataFrame:
    """Mean and sample standard deviation of every column, per group."""
    keys = _keys(by)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_stddev")]
    return df.groupBy(*keys).agg(*aggs)


def zscore(df: DataFrame, cols: Sequence[str] = AVG_MEASURES, by: str | Sequence[str] | None = "commodity_name",
           suffix: str = "_normalized") -> DataFrame:
    """Append ``(x - mean) / stddev`` per column, statistics taken within the row's group.

    A zero or undefined standard deviation gives null. The per-group statistics are a small
    aggregate joined back on the group keys (null keys match, as in a filter on the group).
    """
    keys = _keys(by)
    st = moments(df, cols, keys)
    if keys:
        st = st.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in st.columns if c not in keys])
        cond = [df[k].eqNullSafe(st[f"__g_{k}"]) for k in keys]
        j = df.join(st, cond, "left")
    else:
        # one global row: all statistics enter the plan as one struct-valued scalar subquery
        names = [f"{c}_{s}" for c in cols for s in ("mean", "stddev")]
        one = st.select(F.struct(*names).alias("s")).scalar()
        # bound to one column first, so the subquery is planned (and run) once
        j = df.withColumn("__stats", one).withColumns({n: F.col("__stats").getField(n) for n in names}).drop("__stats")
    out = j.withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_stddev"), F.lit(0.0))
        for c in cols
    })
    drop = [f"{c}_{s}" for c in cols for s in ("mean", "stddev")] + [f"__g_{k}" for k in keys]
    return out.drop(*drop)


def _pearson(x: Column, y: Column) -> Column:
    # covar / (sx * sy) with the zero-variance case as null (ANSI would raise on x / 0).
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def pearson(df: DataFrame, cols: Sequence[str] = AVG_MEASURES, target: str = "yield_amount",
            by: str | Sequence[str] | None = "commodity_name", nulls: str = "zero") -> DataFrame:
    """Pearson correlation of each column with ``target``, per group, in one aggregate.

    ``nulls="zero"`` reproduces ``DataFrame.stat.corr`` (a null is read as 0.0);
    ``nulls="pairwise"`` uses only rows where both values are present.
    Output (long form): group keys, measure, pearson, n_pairs.
    """
    if nulls not in ("zero", "pairwise"):
        raise ValueError("nulls must be 'zero' or 'pairwise'")
    keys = _keys(by)
    aggs = []
    y0 = F.col(target).cast("double")
    for c in cols:
        x0 = F.col(c).cast("double")
        if nulls == "zero":
            x, y = F.coalesce(x0, F.lit(0.0)), F.coalesce(y0, F.lit(0.0))
            n = F.count(F.lit(1))
        else:
            both = x0.isNotNull() & y0.isNotNull()
            x, y = F.when(both, x0), F.when(both, y0)
            n = F.count_if(both)
        aggs += [_pearson(x, y).alias(f"{c}__r"), n.alias(f"{c}__n")]
    wide = df.groupBy(*keys).agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"{c}__r").alias("pearson"), F.col(f"{c}__n").alias("n_pairs"))
        for c in cols
    ])).alias("s")
    return wide.select(*keys, stacked).select(*keys, "s.measure", "s.pearson", "s.n_pairs")
