"""The grid of run settings and which of them make sense."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings to try.
PROCESSES = [2, 4, 8, 16]
THREADS = [10]
READ_THREADS = [8, 16]
WRITE_THREADS = [8, 16]
MAP_THREADS = [1, 2, 4]
REDUCE_THREADS = [10]


def config_grid(spark: SparkSession, chunks: list[int]) -> DataFrame:
    """n_chunks, procs, threads, read, write, map, reduce of every setting that can run:
    each reader has a chunk, as many writers as readers, and readers and mappers fit."""
    grid = spark.createDataFrame([(c,) for c in chunks], "n_chunks int")
    for name, values in (("procs", PROCESSES), ("threads", THREADS), ("read", READ_THREADS), ("write", WRITE_THREADS), ("map", MAP_THREADS), ("reduce", REDUCE_THREADS)):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.filter((F.col("procs") * F.col("read") <= F.col("n_chunks")) & (F.col("read") == F.col("write")) & (F.col("read") + F.col("map") <= F.col("threads")))


def chunk_folders(path: str) -> dict[str, str]:
    """Folders named ``file_chunks_<n>`` below ``path``, by what follows the last underscore."""
    return {d.rsplit("_", 1)[-1]: d for d in sorted(os.listdir(path)) if "file_chunks_" in d and os.path.isdir(os.path.join(path, d))}
