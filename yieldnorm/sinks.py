"""K1-K5: writing results. Delta is not on the classpath here, so the table format is a parameter (``parquet`` by default).

An overwrite is staged: the rows go to a fresh folder first, and only when that job has succeeded the catalog entry is
pointed at it. A write that fails leaves the old table as it was, schema and rows; the new one may have another schema, as
the original asks of Delta with ``overwriteSchema``. Between dropping the old entry and creating the new one (catalog calls
only, when the schema or the partitioning changes) a reader may miss the table; with the same schema the location is
swapped in one call.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.sizing import _hadoop

#: Name of the folders that hold a table's versions, below its location or the warehouse.
VERSIONS = "v-"


def balanced(df: DataFrame, partition_by: Sequence[str] | None) -> DataFrame:
    """Rows of one partition value together before the write, so that files per value don't grow with the number of tasks;
    adaptive execution splits a value with many rows."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df


def _location(spark: SparkSession, name: str) -> str | None:
    """Where an existing table's files lie."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def save_table(df: DataFrame, name: str, fmt: str = "parquet", overwrite_schema: bool = True,
               partition_by: Sequence[str] | None = None, path: str | None = None) -> None:
    """K1/K2/K5: overwrite a catalog table (optionally partitioned, e.g. by year; with ``path`` its files lie below it
    instead of the warehouse). Delta tables are overwritten by their own transaction."""
    spark = df.sparkSession
    if fmt == "delta":
        w = balanced(df, partition_by).write.format(fmt).mode("overwrite").option("overwriteSchema", str(overwrite_schema).lower())
        w = w.option("path", path) if path is not None else w
        (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
        return
    exists = spark.catalog.tableExists(name)
    old = _location(spark, name) if exists else None
    if exists and not overwrite_schema and spark.table(name).schema != df.schema:
        raise ValueError(f"the schema of {name} differs from the rows'")
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('`', '')}.versions"
    staged = f"{root.rstrip('/')}/{VERSIONS}{uuid.uuid4().hex}"
    w = balanced(df, partition_by).write.format(fmt).mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).save(staged)
    _publish(spark, name, fmt, staged, partition_by, exists, df)
    if old and old.rstrip("/").split("/")[-1].startswith(VERSIONS):
        fs, p = _hadoop(spark, old)
        fs.delete(p, True)


def _publish(spark: SparkSession, name: str, fmt: str, staged: str, partition_by: Sequence[str] | None, exists: bool,
             df: DataFrame) -> None:
    at = staged.replace("'", "\\'")
    if exists and not partition_by and [(f.name, f.dataType) for f in spark.table(name).schema] == [
            (f.name, f.dataType) for f in df.schema] and not _partitioned(spark, name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{at}'")
    else:
        if exists:
            spark.sql(f"DROP TABLE {name}")
        by = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
        last = [c for c in df.columns if c not in (partition_by or ())] + list(partition_by or ())
        columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in last)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING {fmt}{by} LOCATION '{at}'")
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)


def _partitioned(spark: SparkSession, name: str) -> bool:
    return any(c.isPartition for c in spark.catalog.listColumns(name))


def save_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """K3: overwrite a parquet directory."""
    w = balanced(df, partition_by).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_csv(df: DataFrame, path: str, single_file: bool = False, header: bool = True,
             null_value: str | None = None) -> None:
    """K4: CSV with a header. ``single_file`` funnels the rows through one task (only for small
    reports); by default every partition writes its own part file."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite").option("header", header)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)
