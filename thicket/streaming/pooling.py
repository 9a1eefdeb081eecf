"""Projects that arrive over time: additive tables pooled by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import STATS


def pooled_stats(stream: DataFrame) -> DataFrame:
    """Running sums of a stream of pair statistics (complete or update mode; state: one row per pair)."""
    return stream.groupBy("obj_i", "obj_j").agg(*[F.sum(c).alias(c) for c in STATS])


def pooled_counts(stream: DataFrame) -> DataFrame:
    """Running sums of a stream of counts by cluster and size (state: one row per cluster and size)."""
    return stream.groupBy("edge_id", "size").agg(F.sum("nboot").alias("nboot"), F.sum("count").alias("count"))
