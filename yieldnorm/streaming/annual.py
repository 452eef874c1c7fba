"""Incremental annual weather: the A1/A2 aggregate kept up to date as daily files arrive.

The daily observations are read as a file stream. Each micro-batch is reduced to station-year
sums and merged with the sums so far; coordinates that the batch brings for the first time are
geocoded and added to the mapping, so a station may appear in any file. Sums and mapping are
written as a new folder per epoch and a small marker is written last: a reader takes the newest
complete epoch, a batch that is run again after a failure starts from the epoch before it and
overwrites only its own folder, and older epochs are never touched. Both tables stay small (one
row per station and year, one per station), whatever the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import geo, weather
from ..plans.sizing import list_names, path_exists

_SUMS = "station_years"


def _epochs(spark: SparkSession, output_dir: str) -> list[int]:
    """Complete epochs, oldest first."""
    names = [n for n in list_names(spark, output_dir) if n.startswith("epoch=")]
    done = [int(n.split("=")[1]) for n in names if path_exists(spark, f"{output_dir}/{n}/complete/_SUCCESS")]
    return sorted(done)


def _before(spark: SparkSession, output_dir: str, epoch: int) -> int | None:
    return max((e for e in _epochs(spark, output_dir) if e < epoch), default=None)


def merge_batch(batch: DataFrame, rings: DataFrame, output_dir: str, epoch: int, **assign) -> None:
    """Folds one micro-batch of daily rows into the state below ``output_dir``, as epoch ``epoch``."""
    spark = batch.sparkSession
    last, at = _before(spark, output_dir, epoch), f"{output_dir}/epoch={epoch}"
    sums = weather.station_years(batch)
    points = sums.select("latitude", "longitude")
    if last is not None:
        old = f"{output_dir}/epoch={last}"
        known = spark.read.parquet(f"{old}/mapping")
        sums = weather.merge_station_years(sums.unionByName(spark.read.parquet(f"{old}/{_SUMS}")))
        points = points.join(known, ["latitude", "longitude"], "left_anti")
    mapping = geo.assign(points, rings, keep_unknown=True, **assign)
    if last is not None:
        mapping = known.unionByName(mapping)
    sums.write.mode("overwrite").parquet(f"{at}/{_SUMS}")
    mapping.write.mode("overwrite").parquet(f"{at}/mapping")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{at}/complete")


def start(stream: DataFrame, rings: DataFrame, output_dir: str, checkpoint_location: str, available_now: bool = True,
          **assign) -> StreamingQuery:
    """Runs the incremental aggregate of a daily stream into ``output_dir``. Both folders must be on
    shared storage, so that a restarted query resumes where it stopped."""
    w = (stream.writeStream.option("checkpointLocation", checkpoint_location)
         .foreachBatch(lambda batch, epoch: merge_batch(batch, rings, output_dir, epoch, **assign)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def result(spark: SparkSession, output_dir: str, stat: str = "sum") -> DataFrame:
    """The annual aggregate (columns of ``weather.annual``) of the newest complete epoch."""
    epochs = _epochs(spark, output_dir)
    if not epochs:
        raise ValueError(f"no complete epoch in {output_dir}")
    at = f"{output_dir}/epoch={epochs[-1]}"
    mapping = geo.known(spark.read.parquet(f"{at}/mapping"))
    return weather.annual_from_station_years(spark.read.parquet(f"{at}/{_SUMS}"), mapping, stat)


def run_to_completion(stream: DataFrame, rings: DataFrame, output_dir: str, checkpoint_location: str,
                      stat: str = "sum", **assign) -> DataFrame:
    """Processes every file present now, then returns the aggregate."""
    q = start(stream, rings, output_dir, checkpoint_location, **assign)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return result(stream.sparkSession, output_dir, stat)


__all__ = ["merge_batch", "start", "result", "run_to_completion"]
