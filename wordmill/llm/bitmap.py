"""Bitmaps of keys: most rows without a partner are told before a join shuffles them.

Each key sets one bit, so a row whose bit is not set has no partner; one whose bit is set may
have one, which the join then decides. With more than ``MOST_BITS`` keys there is no bitmap and
every row goes to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.wordhash import mixed

#: 16 MB; each Python worker holds one bitmap at a time.
MOST_BITS = 1 << 27
_BITS_A_KEY = 16


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return mixed(keys.view(np.uint64)) & np.uint64(bits - 1)


def bitmap(keys: DataFrame) -> Broadcast | None:
    """A bitmap of ``keys`` (one column of longs, none null), or None if there are too many."""
    n = keys.count()
    if n > MOST_BITS:
        return None
    bits = min(MOST_BITS, 1 << max(10, (_BITS_A_KEY * n - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    found = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("value")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for longs that are none of the bitmap's keys."""
    at = _places(keys, 64 * len(words))
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def likely_rows(rows: DataFrame, key: str, keys: Broadcast | None) -> DataFrame:
    """``rows`` without most of those whose ``key``, a long, is none of the bitmap's or null."""
    if keys is None:
        return rows

    @F.arrow_udf("boolean")
    def likely(v: pa.Array) -> pa.Array:
        return pa.array(may_hold(keys.value, v.fill_null(0).to_numpy()))

    return rows.filter(F.col(key).isNotNull() & likely(F.col(key)))
