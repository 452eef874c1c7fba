"""The FIPS reference list (CSV with header: fips, name, state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import quarantine as aside

FIPS_SCHEMA = StructType([
    StructField("fips", LongType(), True),
    StructField("name", StringType(), True),
    StructField("state", StringType(), True),
])


def read_fips(spark: SparkSession, path: str, null_value: str = "NA", quarantine: str | None = None) -> DataFrame:
    """Read the list with an explicit schema (no inference pass over the file).

    The pandas reader of the original treats empty fields and ``NA`` as missing; Spark's CSV
    reader treats empty fields as null and ``nullValue`` as null too. A line with another number of
    fields, or a code that is no whole number, stops the job, or goes to the ``quarantine`` folder.
    """
    if quarantine is not None:
        r = spark.read.schema(aside.permissive(FIPS_SCHEMA)).options(header=True, nullValue=null_value, **aside.options())
        code = F.trim(F.split(aside.RAW, ",")[0])
        reason = F.when(F.col(aside.RAW).isNotNull(), F.when(
            (code != "") & (code != null_value) & code.try_cast("bigint").isNull(), "fips is no whole number").otherwise("not 3 fields"))
        return aside.put_aside(r.csv(path), F.col(aside.RAW), reason, FIPS_SCHEMA.names, quarantine)
    return (
        spark.read.schema(FIPS_SCHEMA)
        .option("header", True)
        .option("nullValue", null_value)
        .option("mode", "FAILFAST")
        .csv(path)
    )
