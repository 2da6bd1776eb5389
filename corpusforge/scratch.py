"""Folders for intermediate tables that every executor can read and write."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can read and write.

    The setting is read from the session; only where it is unset and the master is local (tests) a folder of the machine is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "corpusforge-checkpoints")
        os.makedirs(base, exist_ok=True)
    return f"{base.rstrip('/')}/cf-{uuid.uuid4().hex}"


def keep(spark: SparkSession, folder: str) -> None:
    """Delete the folder when the driver's Python ends, if nothing does before."""
    _kept[folder] = spark


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by :func:`shared_dir`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _kept.pop(folder, None)


@atexit.register
def _remove_kept() -> None:
    for folder, spark in list(_kept.items()):
        with contextlib.suppress(Exception):  # Spark may have ended
            remove(spark, folder)
