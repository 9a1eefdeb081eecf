"""Blocks of objects: cuts, their support, and mean squares of unit groups by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.members import edge_id
from ..session import checkpointed, small_frame
from ..sources import matrix as M
from . import tree
from .running import running_sum


def cut_blocks(spark, linkage: list[dict], labels: list[str], k: int, prefix: str = "block") -> DataFrame:
    """(object, block)."""
    return small_frame(spark, [(o, f"{prefix}{b}") for o, b in tree.cut(linkage, labels, k).items()], "object string, block string")


def assess(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, n, edge_id, au): the support of the cluster that is exactly the block, null where there is none."""
    sets = blocks.groupBy("block").agg(F.collect_set("object").alias("members"))
    own = sets.select("block", F.size("members").alias("n"), edge_id(F.col("members")).alias("edge_id"))
    return own.join(edges.select("edge_id", "au"), "edge_id", "left").select("block", "n", "edge_id", "au").orderBy(F.desc("n"), "block")


def unit_scores(long: DataFrame, blocks: DataFrame) -> DataFrame:
    """(unit_id, block, score): the mean of a unit over a block's objects."""
    return long.join(F.broadcast(blocks) if blocks.count() < 100_000 else blocks, "object").groupBy("unit_id", "block").agg(F.avg("value").alias("score"))


def unit_groups(long: DataFrame, blocks: DataFrame, k: int, method_dist: str = "euclidean", method_hclust: str = "ward.D2") -> DataFrame:
    """(unit_id, unit_group): units clustered by their block scores; the units must be few enough for a tree."""
    from ..plans.support import tree_of

    scores = unit_scores(long, blocks).select(F.col("block").alias("unit_id"), F.col("unit_id").alias("object"), F.col("score").alias("value"))
    vectors, labels = M.long_to_vectors(scores)
    groups = tree.cut(tree_of(vectors, labels, method_dist, method_hclust), labels, k)
    return small_frame(long.sparkSession, list(groups.items()), "unit_id string, unit_group int")


def squares(long: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(unit_group, block, n_units, n_objects, mean_z) of z-scored values."""
    z = M.zscore(long).join(blocks, "object").join(groups, "unit_id")
    return z.groupBy("unit_group", "block").agg(F.count_distinct("unit_id").alias("n_units"), F.count_distinct("object").alias("n_objects"), F.avg("value").alias("mean_z"))


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row (limit): the quantile between order statistics, from running counts of distinct values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").cast("double").alias("c"))
    ranked = checkpointed(running_sum(counted, [], "x", "c", "upto"))
    at = ranked.agg(F.max("upto").alias("n")).select(((F.col("n") - 1) * q).alias("h"))
    both = ranked.crossJoin(at).agg(F.min(F.when(F.col("upto") > F.floor("h"), F.col("x"))).alias("lo"), F.min(F.when(F.col("upto") > F.ceil("h"), F.col("x"))).alias("hi"), F.first("h").alias("h"))
    return both.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))).alias("limit"))


def two_way(long: DataFrame, object_order: DataFrame, unit_order: DataFrame) -> DataFrame:
    """(row, col, unit_id, object, z): a z-scored matrix in drawing order, clipped at its 99th percentile.

    object_order: object, col; unit_order: unit_id, row.
    """
    z = M.zscore(long)
    limit = quantile(z.withColumn("value", F.abs("value")), "value", 0.99)
    placed = z.join(object_order, "object").join(unit_order, "unit_id").crossJoin(limit)
    return placed.select("row", "col", "unit_id", "object", F.least(F.greatest("value", -F.col("limit")), F.col("limit")).alias("z"))


def sampled_units(long: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` units, those of least hash with the seed: as many rows as a figure can show."""
    units = long.select("unit_id").distinct().orderBy(F.xxhash64("unit_id", F.lit(seed)), "unit_id").limit(most)
    return long.join(units, "unit_id", "left_semi")


def block_order(long: DataFrame, blocks: DataFrame, method_dist: str = "euclidean", method_hclust: str = "ward.D2") -> DataFrame:
    """(object, block, place): blocks from the largest, and in each the order of its own tree.

    Blocks of one or two objects, and those whose distances aren't all defined, are in order of their labels.
    """
    from ..plans.support import tree_of

    spark, rows, place = long.sparkSession, [], 0
    members: dict[str, list[str]] = {}
    for r in blocks.select("object", "block").orderBy("object").collect():  # a row per object of a tree
        members.setdefault(r["block"], []).append(r["object"])
    for block, own in sorted(members.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        if len(own) > 2:
            vectors, labels = M.long_to_vectors(long.join(small_frame(spark, [(x,) for x in own], "object string"), "object", "left_semi"))
            try:
                made = tree_of(vectors, labels, method_dist, method_hclust)
                own = [labels[k] for k in tree.leaf_order(made, len(labels))]
            except ValueError:  # a distance isn't defined
                pass
        rows += [(x, block, place + k) for k, x in enumerate(own)]
        place += len(own)
    return small_frame(spark, rows, "object string, block string, place int")
