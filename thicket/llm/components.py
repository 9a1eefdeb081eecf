"""Connected components of a link table by alternating large-star and small-star passes.

Every pass is two shuffled aggregations over links; nothing is gathered to the
driver but one count per pass, and each pass's links are checkpointed so a lost
executor costs one pass at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _towards_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links every neighbour of a node to the least of the node and its neighbours.

    larger_only: only neighbours above the node move (large star); else only those
    at or below it (small star).
    """
    around = links if not larger_only else links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, most_passes: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    Self links and nulls are ignored; repeated links count once.  An empty table
    gives an empty result.
    """
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    sign = F.xxhash64("u", "v").cast("decimal(38,0)")
    before = None
    for _ in range(most_passes):
        large = _towards_least(now, True)
        now = _towards_least(large, False).checkpoint()
        seen = now.agg(F.count("*"), F.sum(sign)).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
