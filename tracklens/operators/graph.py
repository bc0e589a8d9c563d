"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges (Kiveris et al., SoCC 2014); no neighbourhood is gathered, so
a vertex with very many edges only makes a skewed join, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.sources.durable import dropped, stored


def star_forest(edges: DataFrame, most_rounds: int = 60, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """From (src, dst) to (id, component): each vertex of an edge with the smallest vertex that it reaches.

    Null ends and loops are left out; repeated edges count once. Raises if ``most_rounds`` don't suffice.
    """
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src IS NOT NULL AND dst IS NOT NULL AND u <> v").distinct()
    now = keep(now, "edges")
    for _ in range(most_rounds):
        # Stars around smallest vertices: no vertex has two smaller neighbours, or a smaller and a larger one.
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = keep(linked.distinct(), "edges")
        dropped(now)
        now = after
    else:
        raise RuntimeError(f"components aren't whole after {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
