"""Data-quality operators: column checks, counts, null profiles, fills, match rates, previews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, cols: Iterable[str]) -> None:
    """raise ``ValueError`` naming every required column that is missing."""
    present = set(df.columns)
    missing = [c for c in cols if c not in present]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))


def ensure_not_empty(df: DataFrame, what: str = "input") -> None:
    """one cheap action (stops at the first row) instead of a full count."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")


def schema_report(df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type, nullable); built from metadata only."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def row_count(df: DataFrame) -> DataFrame:
    """A4: one-row count (partial counts per partition, one tiny final step)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_counts(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """A5: number of nulls per column, all columns in one pass; one row, one column per input."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls (and NaN in floating columns) per column; column types are kept."""
    return df.na.fill(dict(values))


def fill_mean(df: DataFrame, cols: Iterable[str], by: Iterable[str] | None = None) -> DataFrame:
    """Replace nulls by the column mean (of the whole frame, or per ``by`` group).

    The means come from an aggregate, never from the driver: without ``by`` all means are one
    struct-valued scalar subquery (one partially aggregated job whose single row enters the
    plan); with ``by`` the per-group means are joined back on the group keys (null keys match,
    like the group they form).
    """
    cols = list(cols)
    if not by:
        means = df.select(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
        # bound to one column first, so the subquery is planned (and run) once
        out = df.withColumn("__means", means)
        return out.withColumns({c: F.coalesce(F.col(c), F.col("__means").getField(c)) for c in cols}).drop("__means")
    by = list(by)
    means = df.groupBy(*[F.col(k).alias(f"__g_{k}") for k in by]).agg(
        *[F.avg(c).alias(f"__mean_{c}") for c in cols])
    out = df.join(means, [df[k].eqNullSafe(means[f"__g_{k}"]) for k in by], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__mean_{c}")) for c in cols}).drop(
        *[f"__mean_{c}" for c in cols], *[f"__g_{k}" for k in by])


def match_rate(df: DataFrame, col: str = "fips") -> DataFrame:
    """Matched (non-null ``col``), total, and percent matched (null on empty input)."""
    return df.agg(
        F.count(col).alias("matched"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("match_pct", F.try_divide(F.col("matched") * 100.0, F.col("total")))


def unmatched(df: DataFrame, col: str = "fips", keys: Iterable[str] = ("state_abbr", "county")) -> DataFrame:
    """Distinct keys of the rows left without a match."""
    return df.filter(F.col(col).isNull()).select(*keys).distinct()


def preview(df: DataFrame, n: int, order_by: Iterable[str] | None = None) -> DataFrame:
    """K6: a bounded, deterministic preview (ordered first, then limited); the remaining columns
    break ties, so the rows shown do not depend on partitioning."""
    first = list(order_by or [])
    cols = first + [c for c in df.columns if c not in first]
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in cols]).limit(n)
