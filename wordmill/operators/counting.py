"""Word counts: from lines to words, partial counts and their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.config import CountConfig
from wordmill.functions.words import byte_view, fits, from_byte_view, normalize, tokens
from wordmill.sources.text import column_lines, cut_lines, nonblank


def split_words(lines: DataFrame, *keep: str) -> DataFrame:
    """Kept columns and ``token``: the non-empty pieces of non-blank lines."""
    return nonblank(lines).select(*keep, F.explode(tokens(F.col("value"))).alias("token")).filter(F.col("token") != "")


def words_of(lines: DataFrame, *keep: str, config: CountConfig = CountConfig()) -> DataFrame:
    """Kept columns and ``word``: normalised words within the length guard.

    With a line limit, or stripping once, bytes count; ``word`` is then binary, since a cut
    may leave part of a character.
    """
    by_bytes = config.line_limit is not None or config.strip == "once"
    if config.line_limit is not None:
        lines = lines.select(*keep, F.explode(cut_lines(F.col("value"), config.line_limit)).alias("value"))
    elif by_bytes:
        lines = lines.select(*keep, byte_view(F.col("value")).alias("value"))
    found = split_words(lines, *keep).select(*keep, "token", normalize(F.col("token"), config.strip).alias("word"))
    if config.max_bytes is not None:
        found = found.filter(F.length("word") <= config.max_bytes if by_bytes else fits(F.col("token"), F.col("word"), config.max_bytes))
    return found.select(*keep, from_byte_view(F.col("word")).alias("word") if by_bytes else "word")


def _counted(lines: DataFrame, keep: list[str], config: CountConfig) -> DataFrame:
    """Counts by ``keep`` and word. Tokens are counted as they stand and only distinct ones are
    normalised: a second, small shuffle for far fewer regular expressions. A stream, which can
    be aggregated once only, is normalised first, and so is what is counted by bytes."""
    if lines.isStreaming or config.line_limit is not None or config.strip == "once":
        return words_of(lines, *keep, config=config).groupBy(*keep, "word").agg(F.count(F.lit(1)).alias("cnt"))
    found = split_words(lines, *keep).groupBy(*keep, "token").agg(F.count(F.lit(1)).alias("cnt"))
    words = found.select(*keep, "token", normalize(F.col("token"), config.strip).alias("word"), "cnt")
    if config.max_bytes is not None:
        words = words.filter(fits(F.col("token"), F.col("word"), config.max_bytes))
    return words.groupBy(*keep, "word").agg(F.sum("cnt").alias("cnt"))


def count_words(lines: DataFrame, config: CountConfig = CountConfig()) -> DataFrame:
    """word, cnt. Spark counts inside each task before it shuffles."""
    return _counted(lines, [], config)


def count_column(table: DataFrame, text: str, config: CountConfig = CountConfig()) -> DataFrame:
    return count_words(column_lines(table, text), config)


def partial_counts(lines: DataFrame, mapper: str, config: CountConfig = CountConfig()) -> DataFrame:
    """mapper, word, cnt: what each mapper would send on."""
    return _counted(lines, [mapper], config).withColumnRenamed(mapper, "mapper")


def merge_counts(partials: DataFrame) -> DataFrame:
    """word, cnt: sums of partial counts."""
    return partials.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def row_counters(lines: DataFrame, config: CountConfig = CountConfig()) -> DataFrame:
    """One row: lines, blank lines, tokens, words kept, words dropped by the length guard, in one pass."""
    limit = config.max_bytes if config.max_bytes is not None else (1 << 31) - 1
    pieces = F.filter(tokens(F.col("value")), lambda t: t != "")
    n = F.when(F.col("value") == "", 0).otherwise(F.size(pieces))
    long_ = F.when(F.col("value") == "", 0).otherwise(F.size(F.filter(pieces, lambda t: (F.octet_length(t) > limit) & (F.octet_length(normalize(t)) > limit))))
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value") == "").alias("blank_lines"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(n - long_), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum(long_), F.lit(0)).cast("long").alias("dropped"),
    )
