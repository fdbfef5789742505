"""Connected components of an edge table by alternating star contractions.

Each round hangs the larger neighbours of every node on its least neighbour
and then the smaller ones (Kiveris et al. 2014, large-star and small-star).
All rounds are joins and sums of DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Stash


def components(edges: DataFrame, stash: Stash, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge; ``root`` is the least node it is connected with.

    Self-loops, repeated edges and nulls are ignored.
    """
    e = stash.put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        # every edge is (u, v) with v < u: hang larger neighbours on the least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stash.put(large.distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = stash.put(new.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # done when each node hangs on one root that hangs on nothing
        open_ = new.groupBy("u").count().where("count > 1").limit(1).count() or new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        stash.drop(e, large)
        e = new
        if not open_:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
