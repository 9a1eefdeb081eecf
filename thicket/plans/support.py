"""Supported clusters of one table: tree, bootstrap counts, fits and selection."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap, msfit, stats, tree
from ..session import checkpointed, small_frame
from ..sources import matrix as M


@dataclass
class SupportTree:
    """edges: edge_id, members, n_members, height, merge_order and the fit's fields; counts: edge_id, size, r, nboot, count."""

    edges: DataFrame
    counts: DataFrame
    linkage: list[dict]
    labels: list[str]
    n: int
    settings: dict = field(default_factory=dict)

    @property
    def linkage_table(self) -> DataFrame:
        return tree.linkage_frame(self.edges.sparkSession, self.linkage)

    def skipped(self) -> bool:
        """Whether some replicate gave no tree."""
        return self.counts.where("skipped > 0").limit(1).count() > 0


def tree_of(vectors: DataFrame, labels: list[str], method_dist: str = "correlation", method_hclust: str = "average") -> list[dict]:
    sums = stats.listwise_stats(vectors, labels) if method_dist.lower() == "uncentered" else stats.gram_stats(vectors, labels)
    return tree.linkage(stats.matrix(stats.distance(sums, method_dist), labels), method_hclust)


def support_tree(vectors: DataFrame, labels: list[str], method_dist: str = "correlation", method_hclust: str = "average", nboot: int = 1000, r: list[float] | None = None, seed: int = 42, cluster: str = "columns", cluster_fn=None) -> SupportTree:
    """The tree of the objects (columns of ``vectors``) and the support of each of its clusters.

    cluster='rows' clusters the units instead; units are rarely independent, so that
    support is too high.
    """
    if cluster == "rows":
        warnings.warn("support of clusters of units is too high: units aren't a sample of features", stacklevel=2)
        long = vectors.select("unit_id", F.posexplode("values").alias("at", "value")).select(F.array(*[F.lit(x) for x in labels])[F.col("at")].alias("object"), "unit_id", "value")
        vectors, labels = M.long_to_vectors(M.orient(long, "rows"))
    labels = M.check_labels(labels)
    spark = vectors.sparkSession
    vectors = vectors.persist()  # read for the tree, the size and the draws
    made = tree_of(vectors, labels, method_dist, method_hclust)
    edges = tree.edges_frame(spark, made, labels)
    sets = tree.member_sets(made, labels)
    counts = bootstrap.count_candidates(vectors, labels, sets, nboot, r, seed, method_dist, method_hclust, cluster_fn)
    ids = edges.select("edge_id", (F.col("merge_order") - 1).alias("candidate"))
    counts = counts.join(F.broadcast(ids), "candidate").select("edge_id", "size", "r", "nboot", "count", "skipped")
    fitted = checkpointed(edges.join(msfit.fit(counts), "edge_id"))  # a row per cluster, read again and again
    n = vectors.count()
    vectors.unpersist()
    return SupportTree(fitted, counts, made, labels, n, {"cluster": cluster, "distance": method_dist, "linkage": method_hclust, "nboot": nboot, "seed": seed})


def pick(edges: DataFrame, alpha: float = 0.95, use: str = "au", max_only: bool = True) -> DataFrame:
    """Clusters other than the whole with support of at least ``alpha``; of nested ones the largest, unless max_only is off.

    edges are those of one tree: edge_id, members, n_members, merge_order and ``use``.
    """
    size = edges.agg(F.max("n_members")).first()[0]
    passing = edges.where((F.col("n_members") < F.lit(size)) & (F.col(use) >= alpha))
    if max_only:
        later = passing.select(F.col("merge_order").alias("o"), F.col("members").alias("m"))
        passing = passing.join(later, (F.col("o") > F.col("merge_order")) & F.arrays_overlap("m", "members"), "left_anti")
    return passing.orderBy("merge_order")


def count_edges(vectors: DataFrame, labels: list[str], catalogue: DataFrame, **settings) -> DataFrame:
    """(edge_id, size, r, n, nboot, count) of supplied clusters (edge_id, members), whether or not this table's tree has them."""
    rows = [(r["edge_id"], list(r["members"])) for r in catalogue.select("edge_id", "members").collect()]  # at most one cluster per object
    counts = bootstrap.count_candidates(vectors, labels, [m for _, m in rows], **settings)
    ids = small_frame(vectors.sparkSession, [(k, e) for k, (e, _) in enumerate(rows)], "candidate int, edge_id string")
    return counts.join(F.broadcast(ids), "candidate").select("edge_id", "size", "r", F.lit(vectors.count()).alias("n"), "nboot", "count")
