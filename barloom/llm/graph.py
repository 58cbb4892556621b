"""Connected components of a link table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is
    one aggregate (a minimum for each node, combined before the shuffle) and
    one equi-join. No neighbour list is ever gathered. Nulls, loops and
    repeated links are ignored; an empty table gives an empty one.
    """
    now = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_min, "u")
        after = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small_min.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(after, "links")
        discard(now)
        # settled when every node points at one node that points nowhere
        open_ = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not open_ and not after.join(after.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").limit(1).count():
            break
        now = after
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
