"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` up to and with each row, in ``order`` within ``by``; orders must be distinct.

    Rows are dealt by range; each range sums its own, and the totals of the ranges before
    (one row per range and group) are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *by, order).withColumn("range_", F.spark_partition_id()))
    own = Window.partitionBy("range_", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("range_", *by).agg(F.sum(value).alias("total_"))
    before = F.coalesce(F.sum("total_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offsets = totals.select("range_", *by, before.alias("before_"))
    summed = dealt.withColumn("own_", F.sum(value).over(own)).join(F.broadcast(offsets) if not by else offsets, ["range_", *by])
    return summed.withColumn(name, F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")
