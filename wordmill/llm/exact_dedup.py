"""Exact dedup: 128-bit content hash, stable id to keep, byte comparison inside groups.

Only DataFrame functions. Three shuffles matter:

* texts travel once, as the second key of ``groupBy(hash, text)``: the aggregation
  compares whole byte strings, so two texts that share the 128-bit hash stay apart, and
  the map side sends each distinct text of a task once, however often it occurs;
* rows travel as (id, 16-byte hash, 32-byte digest), never with their text;
* a group's answer goes back over (hash, digest, salt), see ``attach``, so a group with a
  third of all rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm.attach import attach
from wordmill.llm.names import column


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest": which id of a group of equal texts stays.

    Null text counts as empty text; all such rows form one group. A null id never wins
    against another id; where a group has only null ids one of its rows stays. Rows that
    repeat both id and text are copies of each other: exactly one of them is kept. Other
    columns of ``docs`` are ignored, whatever their names. No rows in, no rows out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    body = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(docs[id_col].alias("id"), body.alias("body")).select("id", "body", F.unhex(F.md5("body")).alias("h"))

    classes = (
        keyed.groupBy("h", "body")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("body", 256)).alias("s"), "keep_id", "group_size")
    )
    rows = (
        keyed.select("id", "h", F.unhex(F.sha2("body", 256)).alias("s"))
        .groupBy("id", "h", "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        attach(rows, classes, ["h", "s"], deal_by="id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("s")).alias("text_sha256"),
        )
    )


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, whole and unchanged: one of each group of equal texts.

    Which one is as in ``exact_dedup``. Of rows that repeat that id too, the one with the
    smallest hash of all columns but maps stays, so reruns agree; null text and empty text
    are one group. No rows in, no rows out. Other columns may have any names.

    One shuffle: a whole row travels with its text as the group's best so far, and the map side
    sends one row for each distinct text of a task.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    others = [f.name for f in docs.schema if f.name != text_col]
    tie = F.xxhash64(*[column(f.name) for f in docs.schema if f.name != text_col and _hashable(f.dataType)], column(text_col).isNull())
    rows = docs.select(
        F.coalesce(column(text_col), F.lit("")).alias("body"), column(id_col).alias("id"), tie.alias("tie"),
        F.struct(F.struct(*map(column, others)).alias("row"), column(text_col).isNull().alias("no_text")).alias("rest"),
    )
    best = F.min_by("rest", F.struct(F.col("id").isNull(), "id", "tie")) if keep == "smallest" else F.max_by("rest", F.struct(F.col("id").isNotNull(), "id", "tie"))
    kept = rows.groupBy(F.unhex(F.md5("body")).alias("h"), "body").agg(best.alias("rest"))
    text = F.when(~F.col("rest.no_text"), F.col("body")).alias(text_col)
    return kept.select(*(text if c == text_col else F.col("rest.row")[c].alias(c) for c in docs.columns))
