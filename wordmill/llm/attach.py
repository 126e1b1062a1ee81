"""Giving rows the answer of their group when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one group are dealt into.
SALTS = 256


def salt_of(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def attach(rows: DataFrame, answers: DataFrame, keys: list[str], deal_by: str) -> DataFrame:
    """``rows`` inner-joined with ``answers``, which has one row for each value of ``keys``.

    An answer is repeated only for the salts that its group really has, so a hot group
    spreads over ``SALTS`` tasks and a group of one row still costs one row. Keys must not
    be null; rows are dealt by a hash of ``deal_by``.
    """
    dealt = rows.withColumn("__salt", salt_of(deal_by))
    parts = dealt.select(*keys, "__salt").distinct()
    return dealt.join(parts.join(answers, keys), [*keys, "__salt"]).drop("__salt")
