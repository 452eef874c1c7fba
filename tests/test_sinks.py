"""Staged overwrites: a failed write keeps the old table, files of a partitioned write are bounded."""

import os

import pytest
from pyspark.sql import functions as F

from yieldnorm import sinks


@pytest.fixture
def name(spark):
    n = f"staged_{os.urandom(4).hex()}"
    yield n
    spark.sql(f"DROP TABLE IF EXISTS {n}")


def _broken(df):
    return df.withColumn("x", F.when(df["id"] == 7, F.raise_error(F.lit("half-way"))).otherwise(F.lit(1)).cast("int"))


@pytest.mark.parametrize("other", [False, True])
def test_failed_overwrite_keeps_the_old_rows(spark, name, other):
    df = spark.range(5).withColumn("x", F.lit(1))
    sinks.save_table(df, name)
    new = _broken(spark.range(20))
    with pytest.raises(Exception, match="half-way"):
        sinks.save_table(new.withColumn("y", F.lit("z")) if other else new, name)
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(i, 1) for i in range(5)]


def test_overwrite_replaces_rows_schema_and_partitioning(spark, name, tmp_path):
    for path in (None, str(tmp_path / "t")):
        sinks.save_table(spark.range(3), name, path=path)
        sinks.save_table(spark.range(4), name, path=path)
        assert spark.table(name).count() == 4
        sinks.save_table(spark.range(6).withColumn("year", F.col("id") % 2), name, partition_by=["year"], path=path)
        sinks.save_table(spark.range(8).withColumn("year", F.col("id") % 3), name, partition_by=["year"], path=path)
        assert spark.table(name).count() == 8 and spark.table(name).filter("year = 2").count() == 2
        sinks.save_table(spark.range(2).withColumn("a b", F.lit("q")), name, path=path)
        assert spark.table(name).columns == ["id", "a b"] and spark.table(name).count() == 2
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith(sinks.VERSIONS)]) == 1


def test_other_schema_refused_when_asked(spark, name):
    sinks.save_table(spark.range(3), name)
    with pytest.raises(ValueError, match="schema"):
        sinks.save_table(spark.range(3).withColumn("y", F.lit(1)), name, overwrite_schema=False)
    assert spark.table(name).count() == 3


def test_files_per_year_are_bounded(spark, tmp_path):
    df = spark.range(0, 20000, 1, 40).withColumn("year", F.lit(2000) + F.col("id") % 5)
    sinks.save_parquet(df, str(tmp_path / "p"), partition_by=["year"])
    files = [len([f for f in os.listdir(tmp_path / "p" / d) if f.endswith(".parquet")]) for d in os.listdir(tmp_path / "p") if "=" in d]
    assert len(files) == 5 and max(files) <= 2
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20000
