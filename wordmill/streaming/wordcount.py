"""The word count over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordmill.config import CountConfig
from wordmill.operators.counting import count_words


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(folder)


def count_stream(lines: DataFrame, config: CountConfig = CountConfig()) -> DataFrame:
    """Running counts; the state has one row per distinct word."""
    return count_words(lines, config)


def start_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``path`` at the newest counts: every batch writes the whole result to a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
