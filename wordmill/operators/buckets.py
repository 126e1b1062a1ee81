"""Views of how words fall into buckets, and what a shuffle by buckets would hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions.hashing import bucket, two_level, word_hash


def bucket_histogram(counts: DataFrame, sizes: list[int]) -> DataFrame:
    """buckets, bucket, words, tokens for each number of buckets. Words are hashed once."""
    by_hash = counts.groupBy(word_hash(F.col("word")).alias("h")).agg(F.count(F.lit(1)).alias("words"), F.sum("cnt").alias("tokens"))
    each = by_hash.withColumn("buckets", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return each.groupBy("buckets", (F.col("h") % F.col("buckets")).alias("bucket")).agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))


def two_level_histogram(counts: DataFrame, processes: int, threads: int) -> DataFrame:
    pid, tid = two_level(F.col("word"), processes, threads)
    return counts.groupBy(pid.alias("pid"), tid.alias("tid")).agg(F.count(F.lit(1)).alias("words"), F.sum("cnt").alias("tokens"))


def bucket_dump(counts: DataFrame, buckets: int) -> DataFrame:
    """bucket, line: ``H[i]`` and its `` {word,cnt} `` items in word order, or `` NULL ``.

    A debugging view: a bucket's words stand in one row, as the format asks.
    """
    # Every bucket has a row without a word. All are dealt out first: lists that grow in one task need not be merged.
    words = counts.select(bucket(F.col("word"), buckets).cast("long").alias("bucket"), F.struct("word", "cnt").alias("item"))
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(None).cast(words.schema["item"].dataType).alias("item"))
    held = words.union(every).repartition("bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(F.lit(" {"), x["word"], F.lit(","), x["cnt"].cast("string"), F.lit("} "))), "")
    return held.select("bucket", F.concat(F.lit("H["), F.col("bucket").cast("string"), F.lit("]"), F.when(F.size("items") > 0, text).otherwise(" NULL ")).alias("line"))


def shuffle_manifest(partials: DataFrame, buckets: int, rows_per_file: int = 5000) -> DataFrame:
    """mapper, bucket, n_files: files a mapper fills for a bucket when it starts a new one
    every ``rows_per_file`` rows. ``partials`` has one row per mapper and word."""
    return partials.groupBy("mapper", bucket(F.col("word"), buckets).alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("long").alias("n_files"))
