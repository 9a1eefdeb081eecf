"""Profiles of groups of units that may be released: means, counts and demographics with a floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.members import within


class SuppressedError(ValueError):
    """A partition with too small a cluster, none of which is released."""


def release(long: DataFrame, assignment: DataFrame, project: str, min_cluster: int = 10, annotations: DataFrame | None = None) -> dict[str, DataFrame]:
    """profiles (profile_id, project, cluster, feature, mean), counts (cluster, n_units, project) and
    demographics (cluster, variable, level, n, project; cells below the floor left out).

    assignment: unit_id, cluster.  One cluster below ``min_cluster`` withholds everything;
    so does a unit without a cluster.
    """
    units = long.select("unit_id").distinct().join(assignment.select("unit_id", "cluster"), "unit_id", "left")
    sizes = units.groupBy("cluster").agg(F.count("*").alias("n_units"))
    bad = sizes.where(F.col("cluster").isNull()).limit(1).count()
    if bad:
        raise ValueError("some units have no cluster")
    if sizes.where(F.col("n_units") < min_cluster).limit(1).count():
        raise SuppressedError(f"a cluster has fewer than {min_cluster} units; nothing is released")
    own = F.concat(F.lit(f"{project}:c"), F.col("cluster").cast("string")).alias("profile_id")
    means = long.join(units, "unit_id").groupBy("cluster", F.col("object").alias("feature")).agg(F.avg("value").alias("mean"))
    out = {"profiles": means.select(own, F.lit(project).alias("project"), "cluster", "feature", "mean"), "counts": sizes.withColumn("project", F.lit(project))}
    if annotations is not None:
        names = [c for c in annotations.columns if c != "unit_id"]
        cells = units.join(annotations.select("unit_id", *[F.col(c).cast("string").alias(c) for c in names]), "unit_id").unpivot("cluster", names, "variable", "level")
        cells = cells.where("level is not null").groupBy("cluster", "variable", "level").agg(F.count("*").alias("n"))
        out["demographics"] = cells.where(F.col("n") >= min_cluster).withColumn("project", F.lit(project))
    return out


def centred(profiles: DataFrame) -> DataFrame:
    """Means less the project's own mean of the feature, over the features all projects share."""
    projects = profiles.agg(F.count_distinct("project").alias("all"))
    shared = profiles.groupBy("feature").agg(F.count_distinct("project").alias("k")).crossJoin(projects).where("k = all").select("feature")
    w = Window.partitionBy("project", "feature")
    return profiles.join(shared, "feature", "left_semi").withColumn("mean", F.col("mean") - F.avg("mean").over(w))


def similarity(profiles: DataFrame) -> DataFrame:
    """(profile_a, profile_b, r): correlations of centred profiles of different projects."""
    c = centred(profiles)
    a = c.select(F.col("profile_id").alias("profile_a"), F.col("project").alias("pa"), "feature", F.col("mean").alias("x"))
    b = c.select(F.col("profile_id").alias("profile_b"), F.col("project").alias("pb"), "feature", F.col("mean").alias("y"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    top = n * F.sum(F.col("x") * F.col("y")) - sx * sy
    low = F.sqrt((n * F.sum(F.col("x") * F.col("x")) - sx * sx) * (n * F.sum(F.col("y") * F.col("y")) - sy * sy))
    return a.join(b, "feature").where("pa < pb").groupBy("profile_a", "profile_b").agg(F.try_divide(top, low).alias("r"))


def replication(edges: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(profile_id, edge_id, au, size, partners, replicated): each profile's smallest cluster that spans two projects.

    Members are profile ids, 'project:cluster'.
    """
    spans = F.size(F.array_distinct(F.transform("members", lambda m: F.substring_index(m, ":", 1)))) >= 2
    each = edges.where(spans).select("edge_id", "au", "n_members", "members", F.explode("members").alias("profile_id"))
    best = each.groupBy("profile_id").agg(F.min(F.struct("n_members", "edge_id", "au", "members")).alias("e"))
    partners = F.array_join(F.array_sort(F.array_except(F.col("e.members"), F.array("profile_id"))), ";")
    return best.select("profile_id", "e.edge_id", "e.au", F.col("e.n_members").alias("size"), partners.alias("partners"), (F.col("e.au") >= alpha).alias("replicated"))


#: Pattern of labels that carry a reagent's number after its symbol: a fixed value.
REAGENT = r"^(.+?)[_ ]\(?(seq[.\d]+|\d+-\d+)\)?$"


def reagent_groups(labels: DataFrame, min_size: int = 2, annotation: str | None = None) -> DataFrame:
    """(name, members, size) of labels (column label) that name one symbol under several reagents.

    annotation: a column by which symbols are told apart further.
    """
    rows = labels.withColumn("name", F.regexp_extract("label", REAGENT, 1)).where("name <> ''")
    if annotation:
        rows = rows.withColumn("name", F.concat_ws(" | ", "name", F.col(annotation)))
    groups = rows.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("members"))
    return groups.withColumn("size", F.size("members")).where(F.col("size") >= min_size)


def cocluster(edges: DataFrame, groups: DataFrame, n_permutations: int = 200, seed: int = 42) -> DataFrame:
    """(name, present, enclosing, edge_id, au, tight, p_value): each group's smallest enclosing cluster.

    Members not in the tree don't count.  p_value: how often as many labels drawn at
    random lie in as small a cluster.
    """
    whole = edges.orderBy(F.desc("n_members")).select("members").first()["members"]
    labels = F.array(*[F.lit(x) for x in whole])
    present = groups.select("name", F.array_intersect("members", labels).alias("g")).withColumn("present", F.size("g")).where("present >= 2")
    e = edges.select("edge_id", "members", "n_members", "au")
    found = present.join(e, within(F.col("g"), F.col("members"))).groupBy("name", "present").agg(F.min(F.struct("n_members", "edge_id", "au")).alias("e"))
    draws = present.select("present").distinct().select("present", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))).alias("k"))
    picked = draws.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(whole) - 1)))).withColumn("h", F.xxhash64("present", "k", "at", F.lit(seed)))
    picked = picked.groupBy("present", "k").agg(F.array_sort(F.collect_list(F.struct("h", "at"))).alias("o"))
    drawn = picked.select("present", "k", F.transform(F.slice("o", F.lit(1), F.col("present")), lambda s: labels[s["at"]]).alias("g"))
    null = drawn.join(e, within(F.col("g"), F.col("members"))).groupBy("present", "k").agg(F.min("n_members").alias("size"))
    both = found.join(null, "present", "left").groupBy("name", "present", "e").agg(F.avg((F.col("size") <= F.col("e.n_members")).cast("double")).alias("p_value"))
    out = both.select("name", "present", F.col("e.n_members").alias("enclosing"), "e.edge_id", "e.au", (F.col("e.n_members") == F.col("present")).alias("tight"), "p_value")
    return out.orderBy(F.desc("tight"), "enclosing", "name")


def cocluster_summary(table: DataFrame, alpha: float = 0.95) -> str:
    n, tight, sure = table.agg(F.count("*"), F.count_if("tight"), F.count_if(F.col("tight") & (F.col("au") >= alpha))).first()
    return f"{tight} of {n} groups form a cluster of their own, {sure} with support of {alpha} or more."
