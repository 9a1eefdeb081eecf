"""Workflows over projects: applying pooled support at home, and diagnosing units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.members import within
from ..operators import association, msfit, tree
from ..session import small_frame
from ..sources import matrix as M
from . import support


def modules(edges: DataFrame, labels: list[str], alpha: float = 0.95) -> DataFrame:
    """(module, object): small supported clusters that don't overlap, from the smallest, then the objects left over alone."""
    passing = edges.where((F.col("au") >= alpha) & (F.size("members") >= 2) & (F.size("members") < len(labels)))
    ordered = passing.agg(F.array_sort(F.collect_list(F.struct(F.size("members").alias("n"), (-F.col("au")).alias("k"), "edge_id", "members"))).alias("all"))
    fold = "aggregate(all, slice(all, 1, 0), (t, x) -> if(exists(t, y -> arrays_overlap(x.members, y.members)), t, concat(t, array(x))))"
    taken = ordered.select(F.posexplode(F.expr(fold)).alias("at", "e")).select(F.concat(F.lit("module_"), F.col("at") + 1).alias("module"), F.explode("e.members").alias("object"))
    alone = small_frame(edges.sparkSession, [(x,) for x in labels], "object string").join(taken, "object", "left_anti")
    return taken.unionByName(alone.select(F.col("object").alias("module"), "object"))


def module_scores(long: DataFrame, table: DataFrame) -> DataFrame:
    """(unit_id, module, score): the mean over a module's observed members."""
    return long.join(table, "object").groupBy("unit_id", "module").agg(F.avg("value").alias("score"))


def apply_back(vectors: DataFrame, labels: list[str], federated: DataFrame, alpha: float = 0.95, nboot: int = 1000, **settings) -> dict:
    """What pooled clusters (edge_id, members, au) are worth in one project.

    support: edge_id, members, au_federated, au_local, bp_local, se_au_local, in_solo_tree, gain;
    agreement: a row of measures, among them how many modules there are, how many objects lie in one, and how many dimensions scores have; modules, scores; solo: the project's own tree; local_tree_with_federated_support.
    """
    spark = vectors.sparkSession
    usable = federated.where(F.size(F.array_except("members", F.array(*[F.lit(x) for x in labels]))) == 0)
    if not usable.limit(1).count():
        raise ValueError("no cluster's members are all here")
    solo = support.support_tree(vectors, labels, nboot=nboot, **settings)
    counts = support.count_edges(vectors, labels, usable, nboot=nboot, **settings)
    local = msfit.fit(counts).select("edge_id", F.col("au").alias("au_local"), F.col("bp").alias("bp_local"), F.col("se_au").alias("se_au_local"))
    mine = solo.edges.select("edge_id", F.lit(True).alias("in_solo_tree"))
    table = usable.select("edge_id", "members", F.col("au").alias("au_federated")).join(local, "edge_id").join(mine, "edge_id", "left").withColumn("in_solo_tree", F.coalesce("in_solo_tree", F.lit(False)))
    table = table.withColumn("gain", F.col("au_federated") - F.col("au_local")).orderBy(F.desc("gain"), "edge_id")
    n_local = support.pick(solo.edges, alpha, max_only=False).count()
    parts = tree.cut(solo.linkage, labels, max(2, n_local))
    cut = small_frame(spark, list(parts.items()), "object string, solo int")
    each = usable.where(F.size("members") < len(labels)).select("edge_id", F.size("members").alias("n"), F.explode("members").alias("object"))
    smallest = each.groupBy("object").agg(F.min(F.struct("n", "edge_id"))["edge_id"].alias("fed"))  # the smallest covering cluster
    same = association.contingency(cut.join(smallest, "object"), "solo", "fed").select("adjusted_rand")
    found = table.agg(F.count("*").alias("evaluated"), F.count_if("in_solo_tree").alias("recovered"), F.avg(F.col("in_solo_tree").cast("double")).alias("fraction"), F.count_if(F.col("au_local") >= alpha).alias("n_local"), F.count_if(F.col("au_federated") >= alpha).alias("n_federated"), F.percentile("gain", F.lit(0.5)).alias("median_gain"))
    groups = modules(usable, labels, alpha)
    sizes = groups.groupBy("module").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_modules"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_grouped"), F.count("*").alias("n_dimensions"))
    long = vectors.select("unit_id", F.posexplode("values").alias("at", "value")).select("unit_id", F.array(*[F.lit(x) for x in labels])[F.col("at")].alias("object"), "value")
    tree_with = solo.edges.select("edge_id", "members", "n_members", "height", "merge_order").join(usable.select("edge_id", F.col("au").alias("au_federated")), "edge_id", "left")
    return {"support": table, "agreement": found.crossJoin(same).crossJoin(sizes), "modules": groups, "scores": module_scores(long, groups), "solo": solo, "local_tree_with_federated_support": tree_with}


def cluster_labels(result: support.SupportTree, k: int | None = None, alpha: float = 0.95) -> DataFrame:
    """(unit_id, cluster) of a tree: k clusters, or as many as are supported (two at least)."""
    k = k or max(2, support.pick(result.edges, alpha).count())
    return small_frame(result.edges.sparkSession, list(tree.cut(result.linkage, result.labels, k).items()), "unit_id string, cluster int")


def diagnose(long: DataFrame, annotations: DataFrame, batch_like: list[str], k: int | None = None, nboot: int = 200, **settings) -> tuple[DataFrame, DataFrame, str]:
    """Clusters of units, what they are associated with, and a verdict."""
    vectors, labels = M.long_to_vectors(M.orient(long, "rows"))
    result = support.support_tree(vectors, labels, nboot=nboot, **settings)
    assigned = cluster_labels(result, k)
    table = association.association(assigned, annotations)
    return assigned, table, association.report(table, batch_like, assigned.select("cluster").distinct().count())


def containing(edges: DataFrame, objects: list[str]) -> DataFrame:
    """Clusters that hold all the objects, smallest first."""
    return edges.where(within(F.array(*[F.lit(x) for x in objects]), F.col("members"))).orderBy("n_members")
