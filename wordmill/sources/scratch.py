"""Folders for outputs that a query writes and reads back."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name below ``spark.checkpoint.dir``; it is removed when the driver ends. Where that is
    not set and all runs on one machine, a temporary folder takes its place."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/wordmill-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the gateway may be gone already
            return
