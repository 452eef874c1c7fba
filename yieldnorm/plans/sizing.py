"""Materialisation and size-checked broadcast."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def materialize(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and continue from it.

    Used for small tables that several later jobs read (station-years, the coordinate mapping,
    the model table): the expensive lineage behind them (a full scan of the daily table) runs
    once, a lost executor re-reads files instead of recomputing that lineage, and the planner
    sees the real file size when it decides between a broadcast and a shuffle join.
    (``Dataset.checkpoint`` would compute its input twice unless cached first.)
    """
    return df.sparkSession.read.parquet(write_table(df, name, compression=compression))


_CLEANED: set[str] = set()  # run folders whose removal at exit is arranged


def run_folder(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder; it goes when Python exits, or
    by ``remove_scratch``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/yieldnorm-tables/{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove_quietly, *_hadoop(spark, path))
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; DataFrames over them can't be read any more."""
    fs, path = _hadoop(spark, run_folder(spark))
    fs.delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _remove_quietly(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM is gone: the folder stays, as after a crash
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_table(df: DataFrame, name: str = "table", max_records_per_file: int | None = None, compression: str | None = None) -> str:
    """Write ``df`` as parquet under the shared checkpoint folder; return the path.
    ``max_records_per_file`` splits each task's output into several files (no shuffle)."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("error")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if compression:
        w = w.option("compression", compression)
    w.parquet(path)
    return path


def broadcast_threshold(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (-1 when broadcasting is disabled)."""
    v = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    num = v.rstrip("bkmgt")
    suffix = v[len(num):].rstrip("b") or "b"
    return int(float(num) * units[suffix[0]])


def broadcast_if_small(df: DataFrame, row_bytes: int, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast-hint ``df`` only if rows x ``row_bytes`` fits the limit: ``max_bytes`` when
    given, else the session's broadcast threshold. A session that disables broadcasting
    (threshold -1) is respected.

    ``df`` should be materialised (or cheap to count): the check runs one count job. Above the
    limit the frame is returned unhinted and the join stays a shuffle join.
    """
    threshold = broadcast_threshold(df)
    if threshold < 0:
        return df, False
    limit = threshold if max_bytes is None else max_bytes
    if limit <= 0:
        return df, False
    rows = df.count()
    if rows * row_bytes <= limit:
        return F.broadcast(df), True
    return df, False
