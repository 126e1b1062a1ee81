"""Cutting Arrow batches into slices with a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that one slice aims at; a single longer text is a slice of its own.
SLICE_BYTES = 12_000_000


#: Rows of an Arrow batch where rows may hold long texts: a batch lies in memory twice, in
#: the executor's JVM and in its Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _cut(batches: Iterable[pa.RecordBatch], column: int | str, limit: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start), int(ends[stop - 1]) - base
            start = stop


def slices(batches: Iterable[pa.RecordBatch], column: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that each holds about ``limit`` bytes of text, in the same order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece, n in _cut(batches, column, limit):
        if held and size + n > limit:
            yield _joined(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield _joined(held)


def _joined(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pieces[0] if len(pieces) == 1 else pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
