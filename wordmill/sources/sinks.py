"""Text outputs of a word count, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions.words import count_row
from wordmill.sources.scratch import remove


def write_counts(counts: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int | None = None) -> None:
    """``word count`` rows, one file per task, or several where ``rows_per_file`` is reached.

    Not CSV: that would quote words. ``mode="ignore"`` leaves a finished output alone.
    """
    writer = counts.select(count_row(F.col("word"), F.col("cnt")).alias("value")).write.mode(mode)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).text(path, lineSep="\n")


def write_partitioned(counts: DataFrame, path: str, buckets: Column | list[Column], names: list[str], mode: str = "errorifexists", rows_per_file: int | None = None) -> None:
    """A folder for each bucket; every word lies in exactly one. A new file is begun after ``rows_per_file`` rows."""
    columns = buckets if isinstance(buckets, list) else [buckets]
    rows = counts.select(count_row(F.col("word"), F.col("cnt")).alias("value"), *[c.alias(n) for c, n in zip(columns, names)])
    writer = rows.repartition(*names).write.mode(mode).partitionBy(*names)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).text(path, lineSep="\n")


def merge_outputs(spark: SparkSession, parts: str, path: str, mode: str = "errorifexists") -> None:
    """One file with the rows of all files below ``parts``, which go. One task copies lines; nothing is computed there."""
    spark.read.option("recursiveFileLookup", "true").text(parts, lineSep="\n").coalesce(1).write.mode(mode).text(path, lineSep="\n")
    remove(spark, parts)


def parse_counts(rows: DataFrame) -> DataFrame:
    """Column ``value`` of ``word count`` rows → word, cnt, split at the last space; other columns stay."""
    pattern = r"(?s)\A(.*) ([0-9]+)\z"
    others = [c for c in rows.columns if c != "value"]
    return rows.select(*others, F.regexp_extract("value", pattern, 1).alias("word"), F.regexp_extract("value", pattern, 2).cast("long").alias("cnt"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(spark.read.text(path, lineSep="\n"))
