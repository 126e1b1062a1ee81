"""Text lines from files or from a table's column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions.words import byte_view


def read_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Column ``value``: lines of text files. Only ``\\n`` ends a line."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep="\n")


def read_chunks(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """Lines of ``folder/0.txt`` to ``folder/<n-1>.txt`` with their chunk's name in ``file``; a missing one is an error."""
    return read_lines(spark, [f"{folder}/{i}.txt" for i in range(n)]).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]+[.]txt)(?:/[^/]*)?$", 1))


def write_chunks(lines: DataFrame, folder: str, n: int) -> None:
    """Lines (``value``, ``chunk`` from 0 to n-1, ``place`` inside it) as ``folder/<chunk>.txt``; a
    chunk without lines is an empty one. Each is written by one task and named when it is whole."""
    lines.repartition(n, "chunk").sortWithinPartitions("chunk", "place").select("value", "chunk").write.partitionBy("chunk").text(folder, lineSep="\n")
    spark = lines.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, name)
    for i in range(n):
        if store.exists(path(f"chunk={i}")):
            store.rename(path(f"chunk={i}"), path(f"{i}.txt"))
        else:
            store.mkdirs(path(f"{i}.txt"))


def column_lines(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """Lines of a text column: kept columns, ``line_no`` from 0, ``value``. Null text has no line."""
    return table.select(*keep, F.posexplode(F.split(table[text], "\n", -1)).alias("line_no", "value"))


def nonblank(lines: DataFrame) -> DataFrame:
    """Without empty lines; a line of spaces or a lone carriage return stays."""
    return lines.filter(F.col("value") != "")


def cut_lines(value: Column, limit: int) -> Column:
    """Array of byte-view rows that a reader with a buffer of ``limit`` bytes would see.

    A line and its ``\\n`` are cut together, so a left-over of just ``\\n`` becomes an empty
    row, which ``nonblank`` drops.
    """
    v = byte_view(value)
    cuts = F.sequence(F.lit(0), F.floor(F.length(v) / limit).cast("int"))
    return F.transform(cuts, lambda i: F.substring(v, i * limit + 1, F.lit(limit)))


def first_lines(lines: DataFrame, order: list[str], cap: int = 50) -> DataFrame:
    """The first ``cap`` lines in an order: a reader whose queue is never emptied."""
    return lines.orderBy(*order).limit(cap)


def chunk_of(lines: DataFrame, order: list[str], chunks: int, parts: int = 64) -> DataFrame:
    """Each line with ``chunk``: equal runs of lines, all that is left over in the last.

    Lines get their number in two levels, so that no task sees all of them: inside one of
    ``parts`` ranges of the first order column (a number), plus the lines of the ranges
    before, a table of at most ``parts`` rows.
    """
    bounds = sorted(set(lines.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order[0]))) if bounds else F.lit(0)
    dealt = lines.withColumn("__part", part)
    numbered = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__n"))
    each = F.floor(F.col("__n") / chunks)
    chunk = F.when(each == 0, F.lit(chunks - 1)).otherwise(F.least(F.floor((F.col("__start") + F.col("__in")) / each), F.lit(chunks - 1)))
    return numbered.join(F.broadcast(starts), "__part").withColumn("chunk", chunk.cast("int")).select(*lines.columns, "chunk")
