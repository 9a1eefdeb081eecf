"""Additive sufficient statistics of object pairs, and distances made from them.

Over the units where both objects of an ordered pair (obj_i, obj_j) are observed:
n counts units, s sums x_i, q sums x_i squared, g sums x_i * x_j; n_rows counts all
units.  All are sums over units, so parts of a table, and projects, add up.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ("n_rows", "n", "s", "q", "g")
METHODS = ("correlation", "abscor", "uncentered", "euclidean", "minkowski")
REFUSED = ("manhattan", "canberra", "binary", "maximum")


def pairwise_stats(long: DataFrame) -> DataFrame:
    """(obj_i, obj_j, n_rows, n, s, q, g) of a long table by a join on units: for few objects, or as a check."""
    rows = long.select("unit_id").distinct().agg(F.count("*").alias("n_rows"))
    there = long.where("value is not null")
    a = there.select("unit_id", F.col("object").alias("obj_i"), F.col("value").alias("x"))
    b = there.select("unit_id", F.col("object").alias("obj_j"), F.col("value").alias("y"))
    sums = a.join(b, "unit_id").groupBy("obj_i", "obj_j").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("x") * F.col("y")).alias("g"))
    names = long.select("object").distinct()
    grid = names.select(F.col("object").alias("obj_i")).crossJoin(names.select(F.col("object").alias("obj_j")))
    zero = [F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n", "long"), ("s", "double"), ("q", "double"), ("g", "double"))]
    return grid.join(sums, ["obj_i", "obj_j"], "left").crossJoin(rows).select("obj_i", "obj_j", "n_rows", *zero)


def _partial_gram(p: int, whole: bool):
    """One row per task: the four p x p sums of its units (of those with every value, if ``whole``), and their number."""

    def run(batches):
        total, rows = np.zeros((4, p, p)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
            seen = ~np.isnan(x)
            if whole:
                x, seen = x[seen.all(1)], seen[seen.all(1)]
            m, z = seen.astype(np.float64), np.where(seen, x, 0.0)
            total += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
            rows += len(x)
        at = np.arange(p * p)
        yield pa.RecordBatch.from_arrays([pa.array(at // p, pa.int32()), pa.array(at % p, pa.int32()), pa.array(np.full(p * p, rows)), pa.array(total[0].ravel().astype(np.int64)), *[pa.array(total[k].ravel()) for k in (1, 2, 3)]], names=["i", "j", *STATS])

    return run


def gram_stats(vectors: DataFrame, labels: list[str], whole: bool = False) -> DataFrame:
    """The same table from the vector form: tasks sum small matrices, then p * p groups add them."""
    parts = vectors.select("values").mapInArrow(_partial_gram(len(labels), whole), "i int, j int, n_rows long, n long, s double, q double, g double")
    names = F.array(*[F.lit(x) for x in labels])
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in STATS])
    return sums.select(names[F.col("i")].alias("obj_i"), names[F.col("j")].alias("obj_j"), *STATS)


def listwise_stats(vectors: DataFrame, labels: list[str]) -> DataFrame:
    """The statistics of the units with every value alone."""
    return gram_stats(vectors, labels, whole=True)


def pool_stats(parts: list[DataFrame]) -> DataFrame:
    """The sum of projects' statistics, which must be of the same objects."""
    if not parts:
        raise ValueError("nothing to pool")
    names = [{r[0] for r in p.select("obj_i").distinct().collect()} for p in parts]
    for k, own in enumerate(names[1:], 2):
        if own != names[0]:
            raise ValueError(f"project {k} differs in objects: extra {sorted(own - names[0])[:4]}, missing {sorted(names[0] - own)[:4]}")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("obj_i", "obj_j").agg(*[F.sum(c).alias(c) for c in STATS])


def disclosure_check(n: int, p: int, min_n: int = 20) -> None:
    """Refuses statistics of very few units; warns where units don't outnumber objects."""
    if n < min_n:
        raise ValueError(f"{n} units are fewer than {min_n}")
    if n <= p:
        warnings.warn(f"{n} units for {p} objects: the statistics may reveal single values", stacklevel=2)


def distance(stats: DataFrame, method: str = "correlation") -> DataFrame:
    """(obj_i, obj_j, d).  NULL where a distance isn't defined; 0 on the diagonal.

    'uncentered' takes listwise statistics, the others pairwise ones.
    """
    method = method.lower()
    if method in REFUSED:
        raise ValueError(f"{method} can't be made from sums over units")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {METHODS}")
    back = stats.select(F.col("obj_i").alias("obj_j"), F.col("obj_j").alias("obj_i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    both = stats.join(back, ["obj_i", "obj_j"])
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    if method == "uncentered":
        d = 1 - F.try_divide("g", F.sqrt(F.col("q") * F.col("q2")))
    elif method in ("euclidean", "minkowski"):
        d = F.sqrt(F.greatest(F.col("q") + F.col("q2") - 2 * F.col("g"), F.lit(0.0)) * F.col("n_rows") / n)
    else:
        cov = F.col("g") - F.col("s") * F.col("s2") / n
        spread = (F.col("q") - F.col("s") * F.col("s") / n) * (F.col("q2") - F.col("s2") * F.col("s2") / n)
        rho = F.when(F.col("n") > 1, F.try_divide(cov, F.sqrt(F.when(spread > 0, spread))))
        d = 1 - (F.abs(rho) if method == "abscor" else rho)
    return both.select("obj_i", "obj_j", F.when(F.col("obj_i") == F.col("obj_j"), 0.0).otherwise(d).alias("d"))


def minkowski(long: DataFrame, p: float) -> DataFrame:
    """(obj_i, obj_j, d) over complete pairs of units, scaled up to all units."""
    total = long.select("unit_id").distinct().agg(F.count("*").alias("n_rows"))
    there = long.where("value is not null")
    a = there.select("unit_id", F.col("object").alias("obj_i"), F.col("value").alias("x"))
    b = there.select("unit_id", F.col("object").alias("obj_j"), F.col("value").alias("y"))
    sums = a.join(b, "unit_id").groupBy("obj_i", "obj_j").agg(F.sum(F.pow(F.abs(F.col("x") - F.col("y")), F.lit(p))).alias("t"), F.count("*").alias("n"))
    names = long.select("object").distinct()
    grid = names.select(F.col("object").alias("obj_i")).crossJoin(names.select(F.col("object").alias("obj_j")))
    d = F.pow(F.col("t") * F.col("n_rows") / F.col("n"), F.lit(1.0 / p))
    return grid.join(sums, ["obj_i", "obj_j"], "left").crossJoin(total).select("obj_i", "obj_j", F.when(F.col("obj_i") == F.col("obj_j"), 0.0).otherwise(d).alias("d"))


#: Objects that a matrix on the driver may have (a double each pair: 0.8 GB).
MOST_OBJECTS = 10_000


def matrix(table: DataFrame, labels: list[str], value: str = "d") -> np.ndarray:
    """A table of object pairs as an array (p * p values, which a tree holds anyway); NULL is NaN."""
    if len(labels) > MOST_OBJECTS:
        raise ValueError(f"{len(labels)} objects are more than a tree is made of here ({MOST_OBJECTS})")
    at = pa.array(labels)
    out = np.full((len(labels), len(labels)), np.nan)
    rows = table.select(F.col("obj_i"), F.col("obj_j"), F.col(value).cast("double")).toArrow()
    i, j = (pc.index_in(rows.column(k).combine_chunks(), at).to_numpy() for k in (0, 1))
    out[i, j] = rows.column(2).to_numpy()
    return out


def centred(long: DataFrame, by: list[str]) -> DataFrame:
    """Values less the mean of their object within each of ``by``."""
    means = long.groupBy("object", *by).agg(F.avg("value").alias("mean_"))
    return long.join(means, ["object", *by]).withColumn("value", F.col("value") - F.col("mean_")).drop("mean_")
