"""Connected components of links between long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, one, stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Each node sends its larger (large star) or smaller (small star) neighbours to its least neighbour."""
    e = e.select("u", "v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(least, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node that a link names. Links may repeat and run either way.

    A hub's links are spread by the joins' keys and split where they are many; each round is stored in the shared
    folder. Ends when a round changes nothing.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "links")
    sign = None
    while True:
        old, e = e, stored(_star(_star(e, True), False), "stars")
        forget(old)
        new = one(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.countDistinct("u")))
        if new == sign or new[0] == new[2] and not one(e.alias("x").join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").agg(F.count(F.lit(1))))[0]:
            break  # every node has one link, to a node that has none: stars
        sign = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
