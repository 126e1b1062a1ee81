"""The 8-bit word hash and the bucket numbers made from it.

The hash only names buckets in results; Spark partitions by its own, which is not limited
to 256 values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_hash(word: Column) -> Column:
    """0..255: fold over a word's UTF-8 bytes, h ← (16·h xor h xor byte) mod 256."""
    digits = F.hex(word.cast("binary"))
    places = F.sequence(F.lit(1), F.octet_length(word))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    fold = F.aggregate(places, F.lit(0), lambda h, i: F.shiftleft(h, 4).bitwiseXOR(h).bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)))
    return F.when(F.octet_length(word) > 0, fold).otherwise(F.lit(0))


def bucket(word: Column, buckets: int) -> Column:
    return word_hash(word) % buckets


def two_level(word: Column, processes: int, threads: int) -> tuple[Column, Column]:
    """(process, thread inside it); process 0 has a single thread."""
    h = word_hash(word)
    pid = h % processes
    return pid, F.when(pid == 0, F.lit(0)).otherwise((F.floor(h / processes) % threads).cast("int"))
