"""Connected components of a link table, distributed.

Each vertex holds the smallest vertex it has heard of. A round takes the smallest label
among a vertex and its neighbours and then jumps to that label's own label, so the number
of rounds grows with the logarithm of a component's diameter. Labels are written to the
shared folder after every round; a round's joins read written tables on both sides, which
lets adaptive execution split a vertex with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.durable import durable


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links (a long, b long) → (v long, component long) for every vertex that has a link.

    ``component`` is the smallest vertex reachable. Repeated links, loops and either
    direction are fine; links with a null end are ignored; no links, no rows.
    """
    known = links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = durable(known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    labels = durable(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("c")), f"{label}-0")
    n = 0
    while True:
        n += 1
        news = both.join(labels.select(F.col("a").alias("b"), "c"), "b").select("a", "c", F.lit(None).cast("long").alias("old"))
        heard = news.union(labels.select("a", "c", F.col("c").alias("old"))).groupBy("a").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        heard = durable(heard, f"{label}-{n}h")
        if not heard.filter("c <> old").limit(1).count():
            return labels.select(F.col("a").alias("v"), F.col("c").alias("component"))
        own = labels.select(F.col("a").alias("c"), F.col("c").alias("further"))
        labels = durable(heard.join(own, "c", "left").select("a", F.coalesce("further", "c").alias("c")), f"{label}-{n}")
