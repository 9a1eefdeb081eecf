"""The engine's verbs, from tables and files to results: what a project or a coordinator runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, blocks, federate, profiles, stats, tree
from ..operators.association import confounding
from ..session import small_frame
from ..sources import matrix as M
from . import support, workflows
from .support import SupportTree

#: Defaults of the verbs; the functions in ``support`` have their own (correlation, average).
DISTANCE, LINKAGE = "minkowski", "ward.D2"


def guess_technical(columns: list[str]) -> list[str]:
    """Annotation columns that by their names record how units were measured."""
    return [c for c in columns if re.search(r"batch|plate|run|site|centre|center|lot|chip|lane|operator|date", c, re.IGNORECASE)]


def prepare(long: DataFrame, annotations: DataFrame | None = None, batch: str | None = None, protect: list[str] | None = None, method: str = "none", scale: str = "none", shared: DataFrame | None = None, top_variable: int | None = None) -> DataFrame:
    """Features restricted, batches corrected ('none', 'linear', 'combat'), the most variable kept, then scaled ('none', 'zscore')."""
    if shared is not None and top_variable is not None:
        raise ValueError("a shared vocabulary and a number of variable features exclude each other")
    if shared is not None:
        long = M.restrict(long, shared)
    if method != "none":
        if annotations is None or batch is None:
            raise ValueError("correction needs annotations and a batch column")
        long = long.join(annotations.select("unit_id").distinct(), "unit_id", "left_semi")
        own = annotations.select("unit_id", F.col(batch).alias("batch"))
        kept = annotations.select("unit_id", *protect) if protect else None
        long = {"linear": adjust.linear, "combat": adjust.combat}[method](long, own, kept)
    if top_variable is not None:
        long = M.top_variable(long, top_variable)
    if scale not in ("none", "zscore"):
        raise ValueError("scale is 'none' or 'zscore'")
    return M.zscore(long) if scale == "zscore" else long


def batch_report(annotations: DataFrame, batch: str) -> DataFrame:
    """How far each annotation goes with the batch."""
    return confounding(annotations.select("unit_id", F.col(batch).alias("batch")), annotations.drop(batch))


def support_tree(long: DataFrame, nboot: int = 1000, cluster: str = "columns", method_dist: str = DISTANCE, method_hclust: str = LINKAGE, seed: int = 42) -> SupportTree:
    vectors, labels = M.long_to_vectors(long)
    return support.support_tree(vectors, labels, method_dist, method_hclust, nboot, seed=seed, cluster=cluster)


def vocabulary(long: DataFrame, project: str) -> DataFrame:
    return M.vocabulary(long, project)


def shared_vocabulary(vocabularies: list[DataFrame]) -> DataFrame:
    return federate.shared_vocabulary(vocabularies)


def sufficient_stats(long: DataFrame, method_dist: str = DISTANCE, min_n: int = 20) -> DataFrame:
    """What a project releases for the pooled tree; refused for very few units."""
    vectors, labels = M.long_to_vectors(long)
    stats.disclosure_check(vectors.count(), len(labels), min_n)
    return stats.listwise_stats(vectors, labels) if method_dist.lower() == "uncentered" else stats.gram_stats(vectors, labels)


def catalogue(parts: list[DataFrame], method_dist: str = DISTANCE, method_hclust: str = LINKAGE) -> DataFrame:
    """The clusters of the pooled tree, against which every project counts."""
    labels = sorted(r[0] for r in parts[0].select("obj_i").distinct().collect())
    return federate.federated_tree(parts, labels, method_dist, method_hclust)[2]


def count_candidates(long: DataFrame, project: str, clusters: DataFrame, nboot: int = 1000, method_dist: str = DISTANCE, method_hclust: str = LINKAGE, seed: int = 42) -> DataFrame:
    vectors, labels = M.long_to_vectors(long)
    counts = support.count_edges(vectors, labels, clusters, nboot=nboot, seed=seed, method_dist=method_dist, method_hclust=method_hclust)
    return counts.withColumn("project", F.lit(project))


def federated_support(counts: list[DataFrame], clusters: DataFrame) -> DataFrame:
    return federate.federated_support(federate.pool_counts(federate.union(counts)), clusters)


def apply_back(long: DataFrame, federated: DataFrame, alpha: float = 0.95, nboot: int = 1000) -> dict:
    vectors, labels = M.long_to_vectors(long)
    return workflows.apply_back(vectors, labels, federated, alpha, nboot, method_dist=DISTANCE, method_hclust=LINKAGE)


def diagnose(long: DataFrame, annotations: DataFrame, batch_like: list[str] | None = None, k: int | None = None, nboot: int = 200):
    names = guess_technical(annotations.columns) if batch_like is None else batch_like
    return workflows.diagnose(long, annotations, names, k, nboot)


def two_way_layout(long: DataFrame, method_dist: str = "euclidean", method_hclust: str = LINKAGE, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """The z-scored matrix with rows and columns in the order of their trees; of ``max_rows`` units, drawn by the seed, if there are more."""
    spark = long.sparkSession
    if max_rows is not None:
        long = blocks.sampled_units(long, max_rows, seed)

    def order(table: DataFrame, name: str, place: str) -> DataFrame:
        vectors, labels = M.long_to_vectors(table)
        made = support.tree_of(vectors, labels, method_dist, method_hclust)
        return small_frame(spark, [(labels[k], i) for i, k in enumerate(tree.leaf_order(made, len(labels)))], f"{name} string, {place} int")

    return blocks.two_way(long, order(long, "object", "col"), order(M.orient(long, "rows"), "unit_id", "row"))


def release_profiles(long: DataFrame, assignment: DataFrame, project: str, min_cluster: int = 10, annotations: DataFrame | None = None) -> dict[str, DataFrame]:
    return profiles.release(long, assignment, project, min_cluster, annotations)


def cluster_and_release(long: DataFrame, project: str, alpha: float = 0.95, min_cluster: int = 10, annotations: DataFrame | None = None, nboot: int = 1000, method_dist: str = DISTANCE, method_hclust: str = LINKAGE, seed: int = 42) -> dict[str, DataFrame]:
    """Units clustered, the supported clusters picked, and what they release.

    Beside ``release_profiles``' tables: assignment (unit_id, cluster), which stays at home,
    and unassigned (unit_id), the units in no picked cluster, which aren't released.
    """
    found = support_tree(long, nboot, "rows", method_dist, method_hclust, seed)
    picked = [r["members"] for r in support.pick(found.edges, alpha).collect()]  # clusters of one tree
    if not picked:
        raise ValueError(f"no cluster of units has support of {alpha}: nothing to release")
    assignment = small_frame(long.sparkSession, [(u, k) for k, own in enumerate(picked) for u in own], "unit_id string, cluster int")
    inside = long.join(assignment, "unit_id", "left_semi")
    out = release_profiles(inside, assignment, project, min_cluster, annotations)
    return out | {"assignment": assignment, "unassigned": long.select("unit_id").distinct().join(assignment, "unit_id", "left_anti")}


def aggregate(labels: list[str], parts: list[DataFrame] | None = None, counts: list[DataFrame] | None = None, method_dist: str = DISTANCE, method_hclust: str = LINKAGE, alpha: float = 0.95) -> dict[str, DataFrame]:
    """Projects' statistics, counts or both, for the objects in ``labels``: distance and catalogue, edges and consensus."""
    if not parts and not counts:
        raise ValueError("give statistics, counts or both")
    labels, out, known = M.check_labels(labels), {}, None
    if parts:
        for k, part in enumerate(parts, 1):
            own = sorted(r[0] for r in part.select("obj_i").distinct().limit(len(labels) + 1).collect())
            if own != sorted(labels):
                raise ValueError(f"statistics {k} are not of the objects in labels")
        d, _, known = federate.federated_tree(parts, labels, method_dist, method_hclust)
        out |= {"distance": d, "catalogue": known}
    if counts:
        pooled = federate.pool_counts(federate.union(counts))
        if known is None:
            both = federate.union([c.select("edge_id", "members") for c in counts if "members" in c.columns]) if any("members" in c.columns for c in counts) else None
            if both is None:
                raise ValueError("counts without statistics need their members")
            known = both.dropDuplicates(["edge_id"]).withColumn("n_members", F.size("members"))
        edges = federate.federated_support(pooled, known)
        out |= {"edges": edges, "consensus": federate.consensus(edges, alpha)}
    return out


def match_profiles(released: DataFrame, nboot: int = 1000, alpha: float = 0.95, seed: int = 42) -> dict[str, DataFrame]:
    """Profiles (profile_id, project, feature, mean) of two projects or more, centred and clustered together.

    edges: the tree of profiles with its support; similarity: correlations across projects;
    replication: each profile's smallest cluster that spans projects.
    """
    if released.select("project").distinct().limit(2).count() < 2:
        raise ValueError("profiles of two projects are needed")
    centred = profiles.centred(released)
    vectors, labels = M.long_to_vectors(centred.select(F.col("feature").alias("unit_id"), F.col("profile_id").alias("object"), F.col("mean").alias("value")))
    found = support.support_tree(vectors, labels, nboot=nboot, seed=seed)
    return {"edges": found.edges, "similarity": profiles.similarity(released), "replication": profiles.replication(found.edges, alpha)}


def read_project(spark: SparkSession, path: str, **kind) -> DataFrame:
    """A matrix file in long form."""
    return M.read_matrix(spark, path, **kind)
