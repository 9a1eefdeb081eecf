"""Several projects together: shared features, pooled counts, pooled support, consensus."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import msfit, stats, tree


def union(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to pool")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shared_vocabulary(vocabularies: list[DataFrame]) -> DataFrame:
    """(feature), sorted: those that every project has."""
    marked = union([v.select("feature").distinct().withColumn("p", F.lit(k)) for k, v in enumerate(vocabularies)])
    return marked.groupBy("feature").agg(F.count("*").alias("k")).where(F.col("k") == len(vocabularies)).select("feature").orderBy("feature")


def federated_tree(parts: list[DataFrame], labels: list[str], method_dist: str = "correlation", method_hclust: str = "average") -> tuple[DataFrame, list[dict], DataFrame]:
    """Distances, tree and catalogue of pooled statistics: those of the projects' rows put together."""
    d = stats.distance(stats.pool_stats(parts), method_dist)
    made = tree.linkage(stats.matrix(d, labels), method_hclust)
    return d, made, tree.edges_frame(parts[0].sparkSession, made, labels)


def pool_counts(counts: DataFrame, rescale: bool = True) -> DataFrame:
    """(edge_id, size, r, nboot, count, projects) of (project, edge_id, r, n, nboot, count).

    Scales are re-expressed as whole sizes over the units of all projects, and grouped by
    those sizes, never by a rounded ratio.  rescale=False keeps each scale's ratio (size
    is then over a million).
    """
    if rescale:
        total = counts.select("project", "n").distinct().agg(F.sum("n").alias("total"))
        rows = counts.crossJoin(total).withColumn("size", F.bround(F.col("r") * F.col("n")).cast("long"))
    else:
        rows = counts.withColumn("total", F.lit(1_000_000)).withColumn("size", F.bround(F.col("r") * 1_000_000).cast("long"))
    by = rows.groupBy("edge_id", "size").agg(F.first("total").alias("total"), F.sum("nboot").alias("nboot"), F.sum("count").alias("count"))
    cover = rows.groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_set("project")), ";").alias("projects"))
    return by.join(cover, "edge_id").select("edge_id", "size", (F.col("size") / F.col("total")).alias("r"), "nboot", "count", "projects")


def federated_support(pooled: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The catalogue's clusters with the fits of their pooled counts, best supported first."""
    cover = pooled.groupBy("edge_id").agg(F.sum("nboot").alias("total_nboot"), F.size(F.split(F.first("projects"), ";")).alias("n_projects"))
    spread = cover.agg(F.min("n_projects").alias("lo"), F.max("n_projects").alias("hi")).first()
    if spread["lo"] != spread["hi"]:
        warnings.warn(f"some clusters were measured by {spread['lo']} projects, others by {spread['hi']}", stacklevel=2)
    fits = checkpointed(msfit.fit(pooled).join(cover, "edge_id"))  # a row per cluster, read again and again
    return fits.join(catalogue.select("edge_id", "members", "n_members"), "edge_id", "left").orderBy(F.desc("au"), "edge_id")


def consensus(edges: DataFrame, alpha: float = 0.95, use: str = "au") -> DataFrame:
    """Greedily, from the best supported: clusters that are disjoint from or nested with all taken before.

    Sequential by nature, over at most one cluster per object and tree: one ordered fold.
    """
    known = edges.where(F.size("members") > 0)
    top = known.select(F.explode("members").alias("m")).agg(F.count_distinct("m").alias("p"))
    passing = known.crossJoin(top).where((F.size("members") < F.col("p")) & (F.col(use) >= alpha))
    ordered = passing.agg(F.array_sort(F.collect_list(F.struct((-F.col(use)).alias("k"), "edge_id", "members"))).alias("all"))
    fits = "forall(t, y -> not arrays_overlap(x.members, y.members) or size(array_except(x.members, y.members)) = 0 or size(array_except(y.members, x.members)) = 0)"
    taken = ordered.select(F.explode(F.expr(f"aggregate(all, slice(all, 1, 0), (t, x) -> if({fits}, concat(t, array(x)), t))")).alias("e"))
    return taken.select("e.edge_id", "e.members", (-F.col("e.k")).alias(use))
