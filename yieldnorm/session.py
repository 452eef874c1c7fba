"""Session construction and the reliable checkpoint location."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "yieldnorm", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and bench expect.

    On a cluster, build the session with the cluster's own settings instead; the library only
    relies on the configuration keys it reads (``spark.checkpoint.dir``,
    ``spark.sql.autoBroadcastJoinThreshold``).
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    local_checkpoints(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, making sure the SparkContext uses it: ``spark.checkpoint.dir``
    or an already-set context directory. An unset value is an error, because a machine-local folder
    does not survive the loss of an executor; see ``local_checkpoints`` for local sessions."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's configuration names the folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_checkpoints(spark: SparkSession) -> None:
    """Gives a local-mode session (``local``, ``local[...]``) that names no checkpoint folder a private
    temporary one, removed when Python exits. For tests, bench and the driver's entry points."""
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        return
    if sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    folder = tempfile.mkdtemp(prefix="yieldnorm-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
