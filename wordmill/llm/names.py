"""Column names that get along with a caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of exactly this name, whatever dots or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, in any case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add(name.lower())
        found.append(name)
    return found
