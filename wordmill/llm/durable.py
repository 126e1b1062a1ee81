"""Lineage cuts and files that every executor can reach.

Everything goes to the folder that the session names in ``spark.checkpoint.dir``.
Only where that setting is absent and all runs on one machine (as in tests) a folder of our
own is made; on a cluster other machines could not read it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark can write to."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wordmill_")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/wordmill/{label}-{uuid.uuid4().hex}"
    _TO_REMOVE.append((spark, path))
    return path


_TO_REMOVE: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote below the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _TO_REMOVE:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the gateway may be gone already; the folder then stays with the checkpoints
            return


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back: lost executors cost a re-read only."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
