"""What projects exchange: tables, statistics, and versioned JSON payloads without unit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT, FEDERATED = "thicket/project/1", "thicket/federated/1"


def write_edges(edges: DataFrame, path: str) -> None:
    """CSV with members joined by ';'."""
    edges.withColumn("members", F.array_join("members", ";")).write.csv(path, header=True)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn("members", F.split("members", ";"))


def write_counts(counts: DataFrame, project: str, n: int, path: str) -> None:
    counts.select(F.lit(project).alias("project"), "edge_id", "r", F.lit(n).alias("n"), "nboot", "count").write.csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    """Any result table (support, agreement, scores, modules, similarity, replication) as CSV; arrays are joined by ';'."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, header=True)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def project_payload(result, project: str) -> DataFrame:
    """One row: schema, project, n, settings, labels, and edges with their counts by scale."""
    counts = result.counts.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("size", "r", "nboot", "count"))).alias("counts"))
    edges = result.edges.select("edge_id", "members", "height", "merge_order").join(counts, "edge_id")
    s = result.settings
    settings = F.struct(*[F.lit(s[k]).alias(k) for k in ("cluster", "distance", "linkage", "seed")])
    return edges.agg(F.array_sort(F.collect_list(F.struct("merge_order", "edge_id", "members", "height", "counts"))).alias("edges")).select(F.lit(PROJECT).alias("schema"), F.lit(project).alias("project"), F.lit(result.n).alias("n"), settings.alias("settings"), F.array(*[F.lit(x) for x in result.labels]).alias("labels"), "edges")


def write_payload(payload: DataFrame, path: str) -> None:
    payload.coalesce(1).write.json(path)


def read_payloads(spark: SparkSession, paths: list[str], schema: str = PROJECT) -> DataFrame:
    df = spark.read.json(paths)
    other = [r[0] for r in df.select("schema").distinct().collect() if r[0] != schema] if "schema" in df.columns else ["none"]
    if other:
        raise ValueError(f"not {schema}: {other}")
    return df


def counts_from_payloads(payloads: DataFrame) -> DataFrame:
    """(project, edge_id, members, r, n, nboot, count) of projects with the same settings."""
    kinds = payloads.select("settings.cluster", "settings.distance", "settings.linkage").distinct().count()
    if kinds > 1:
        raise ValueError("payloads differ in how they were clustered")
    e = payloads.select("project", "n", F.explode("edges").alias("e"))
    c = e.select("project", "n", "e.edge_id", "e.members", F.explode("e.counts").alias("c"))
    return c.select("project", "edge_id", "members", "c.r", "n", "c.nboot", "c.count")


def federated_payload(edges: DataFrame, projects: list[str], mode: str = "exact") -> DataFrame:
    rows = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))
    return rows.select(F.lit(FEDERATED).alias("schema"), F.array(*[F.lit(p) for p in projects]).alias("projects"), F.lit(mode).alias("mode"), "edges")
