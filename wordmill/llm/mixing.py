"""Mixing sources to target weights along a time-varying curriculum.

Only DataFrame functions. Texts are read once, to count their words; all later steps see
rows of (id, source, size).

1. *Targets.* Sources share the budget by weight; no source gets more than
   ``max_repeats`` times its own size, and what is cut off is shared again by weight.
   That is water filling: with caps sorted by cap/weight the common level is the first
   ``(budget - caps before) / (weights from here on)`` that does not exceed its own
   ratio. Later ones can only be lower, so it is the largest such value and no loop is
   needed.
2. *Order inside a source.* Documents are ordered by the MD5 of their id. The running
   sum is taken in two levels, (source, first hex digits of the MD5) and the rows inside
   such a cell, so one source with a third of all rows spreads over ``16**CELL_DIGITS``
   cells.
3. *Positions.* A source's weight schedule is piecewise linear over training time 0..1.
   Its integral, scaled to the target, is the cumulative token demand; a copy of a document
   stands where the demand equals the tokens that precede its middle. Inside a segment
   that is the root of a quadratic.
4. *Output order.* ``in_training_order`` range-sorts copies by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.durable import durable
from wordmill.llm.names import column, unused

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the MD5 that name a cell: 4096 cells for each source.
CELL_DIGITS = 3
#: (time, multiple of the base weight) knots, by the source's base weight: heavy sources
#: first, light ones towards the end. The driver may pass others.
SCHEDULES: dict[int, list[tuple[float, float]]] = {
    5: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)],
    2: [(0.0, 1.0), (1.0, 1.0)],
    1: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
}


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """source, source_size → source, source_size, weight, target.

    One row per source. Weights repeat over the sources in code point order, null last.
    A source of size 0 has target 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    # The level is sought over caps sorted by cap/weight, ties by name.
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    base = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", base.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    levels = (
        caps.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")).cast("double") / F.col("left"))
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.coalesce(F.col("common"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, width, demand before, weight at start, slope) with the whole integral scaled to 1."""
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(b[0] <= a[0] or min(a[1], b[1]) < 0 for a, b in zip(knots, knots[1:])):
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of at least 0")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    found, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        found.append((t0, t1 - t0, before, w0 / area, (w1 - w0) / (t1 - t0) / area))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return found


def position(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which ``share`` (0..1) of a source's demand has been met."""
    at: Column | None = None
    for t0, width, before, w0, slope in reversed(_segments(knots)):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        # w0*x + slope/2*x^2 = rest, in the form that stays exact for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.when(rest == 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root))
        t = F.lit(t0) + F.least(x, F.lit(width))
        at = t if at is None else F.when(share < F.lit(before_next), t).otherwise(at)
        before_next = before
    return at


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    schedules: dict[int, list[tuple[float, float]]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, copies, positions.

    ``copies`` says how often the mix takes the row (none to ``max_repeats``), ``positions``
    holds a training position for each, ``taken`` is copies times size. A copy is taken while its middle
    lies below the source's target, so a source misses its target by at most half of
    one document.

    Null text has size 0; a row of size 0 is taken once (it costs nothing) where its source
    has a target or no words at all. Null sources form one source, last in order. Repeated
    ids are separate rows in the order of their size. Other columns are ignored. No rows
    in, no rows out.
    """
    schedules = SCHEDULES if schedules is None else schedules
    words = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")))
    sizes = durable(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words.alias("size"), digest.alias("order")), "sizes")
    cell = F.substring("order", 1, CELL_DIGITS)
    cells = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_repeats)
    starts = cells.withColumn("cell_start", before)
    per_cell = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = sizes.withColumn("cell", cell)
    joined = rows.join(per_cell, rows["source"].eqNullSafe(per_cell["source"]) & (rows["cell"] == per_cell["cell"])).drop(per_cell["source"]).drop(per_cell["cell"])
    within = Window.partitionBy("source", "cell").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("cell_start") + F.sum("size").over(within) - F.col("size") / 2
    placed = joined.withColumn("middle", middle)
    offsets = [F.col("middle") + k * F.col("source_size") for k in range(max_repeats)]
    wanted = sum((F.when(o < F.col("target"), 1).otherwise(0) for o in offsets[1:]), F.when(offsets[0] < F.col("target"), 1).otherwise(0))
    # Rows of size 0 cost nothing: once, where their source has any place at all.
    copies = F.when(F.col("source_size") == 0, 1).when(F.col("size") == 0, F.least(wanted, F.lit(1))).otherwise(wanted)

    def at(o: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least(o / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        flat = position(share, [(0.0, 1.0), (1.0, 1.0)])
        for w, knots in schedules.items():
            flat = F.when(F.col("weight") == w, position(share, knots)).otherwise(flat)
        return flat

    return (
        placed.withColumn("copies", copies.cast("int"))
        .withColumn("positions", F.slice(F.array(*[at(o) for o in offsets]), F.lit(1), F.col("copies")))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "positions")
    )


def in_training_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """The documents that the mix takes, one row per copy, range-sorted by training position.

    ``mixed`` is what ``mix`` returned for ``docs``. The position is added as ``position_col``,
    a name that ``docs`` must not have. Rows that repeat an id can't be told apart, so each
    of them is taken as often as all of them together. No rows in, no rows out.
    """
    if position_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs already has a column {position_col}")
    (taken_id,) = unused(docs, "taken_id")
    copies = mixed.filter("copies > 0").select(column(id_col).alias(taken_id), F.explode("positions").alias(position_col))
    joined = docs.join(copies, column(id_col).eqNullSafe(F.col(taken_id)))
    return joined.repartitionByRange(column(position_col), column(id_col)).sortWithinPartitions(column(position_col), column(id_col)).select(*map(column, [*docs.columns, position_col]))
