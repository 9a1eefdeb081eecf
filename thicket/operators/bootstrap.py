"""Multiscale bootstrap counts of candidate clusters.

Units are numbered by their ids and form blocks of ``BLOCK``.  A replicate's draws are
split among the blocks by a multinomial and then drawn within each block, all as a
function of (seed, scale, replicate, block), so counts don't depend on partitions,
retries, order or on where the matrix lies.  Where it is small it goes to every task and
the replicates are dealt out; where units are many, each task weighs its own blocks, and
the weighted sums of a replicate are added up before its tree is made.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scales import effective_scales
from ..session import checkpointed, small_frame
from . import tree

#: Bytes of a matrix that may be sent to every task; units in a block.
SENT_BYTES, BLOCK = 64 << 20, 4096
#: Bytes of a larger matrix for each task.
PART_BYTES = 32 << 20
#: Replicates handled together at most, and bytes of their sums.
TOGETHER, TOGETHER_BYTES = 32, 64 << 20
#: Bytes of some units' values, weighted for each of the replicates handled together.
WORK_BYTES = 16 << 20
# Fixed values of the integer mixer; all products stay below 2**62.
_M, _K1, _K2 = 1 << 31, 739982445, 695872825


def _shake(v, k):
    return v ^ (v >> k)


def _mix(x):
    x = _shake(x % _M, 15)
    x = _shake(x * _K1 % _M, 12)
    return _shake(x * _K2 % _M, 15)


def replicate_key(seed: int, scale, rep):
    return _mix(_mix(np.asarray(seed * 1000003 + scale * 7919 + 1)) + rep * 104729 + 13)


def draw(key, n: int, size: int) -> np.ndarray:
    """Indices of a replicate: ``size`` draws from n with replacement."""
    return _mix(_mix(key + np.arange(size, dtype=np.int64) * 15485863 % _M) + key) % n


def together(p: int) -> int:
    """Replicates of p objects handled at once: their four sums of p * p numbers, and as much again to work with."""
    return max(1, min(TOGETHER, TOGETHER_BYTES // (64 * p * p)))


def block_sizes(n: int, block: int = BLOCK) -> np.ndarray:
    return np.diff(np.append(np.arange(0, n, block), n))


def block_keys(seed: int, scale: int, rep: int, n: int, size: int, blocks: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some blocks' draws, and how many draws each has."""
    key, sizes = replicate_key(seed, scale, rep), block_sizes(n, block)
    if len(sizes) == 1:
        return np.array([key])[blocks], np.array([size])[blocks]
    shares = np.random.Generator(np.random.Philox(key=[int(key), rep])).multinomial(size, sizes / n)
    return _mix(key + blocks * 32452843 % _M), shares[blocks]


def block_draws(seed: int, scale: int, rep: int, n: int, size: int, blocks: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How often each unit of some blocks is drawn, one block after another."""
    keys, shares = block_keys(seed, scale, rep, n, size, blocks, block)
    parts = [np.bincount(draw(k, m, share), minlength=m) for k, m, share in zip(keys, block_sizes(n, block)[blocks].tolist(), shares.tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def multiplicity_frame(spark: SparkSession, n: int, sizes: list[int], nboot: int, seed: int) -> DataFrame:
    """(scale_idx, rep, unit, times): how often each of n units is drawn, in Spark's own integer arithmetic.

    All n units are one block, as in ``block_draws`` with a ``block`` of n.
    """
    if n > _M:
        raise ValueError(f"draws reach {_M} units")

    def shake(v, k):
        return v.bitwiseXOR(F.shiftright(v, k))

    def mix(x):
        x = shake(x % _M, 15)
        x = shake(x * _K1 % _M, 12)
        return shake(x * _K2 % _M, 15)

    scales = small_frame(spark, list(enumerate(sizes)), "scale_idx long, size long")
    reps = scales.crossJoin(spark.range(nboot).withColumnRenamed("id", "rep"))
    key = mix(mix(F.lit(seed * 1000003).cast("long") + F.col("scale_idx") * 7919 + 1) + F.col("rep") * 104729 + 13)
    draws = reps.withColumn("k", key).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    unit = mix(mix(F.col("k") + F.col("draw") * 15485863 % _M) + F.col("k")) % n
    return draws.select("scale_idx", "rep", unit.alias("unit")).groupBy("scale_idx", "rep", "unit").agg(F.count("*").alias("times"))


def weighted_stats(x: np.ndarray, weights: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """(4, b, p, p): the pair sums of b weightings of the rows of x, added to ``out``, of some rows at a time."""
    b, p, seen = len(weights), x.shape[1], ~np.isnan(x)
    out = np.zeros((4, b, p, p)) if out is None else out
    whole, step = seen.all(), max(1, WORK_BYTES // (8 * b * p))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        w, z = weights[:, part], np.where(seen[part], x[part], 0.0)
        zw = z.T[None] * w[:, None, :]
        out[3] += zw @ z
        if whole:
            out[0] += w.sum(1)[:, None, None]
            out[1] += (w @ z)[:, :, None]
            out[2] += (w @ (z * z))[:, :, None]
        else:
            m = seen[part].astype(np.float64)
            out[0] += (m.T[None] * w[:, None, :]) @ m
            out[1] += zw @ m
            out[2] += ((z * z).T[None] * w[:, None, :]) @ m
    return out


def drawn_stats(x: np.ndarray, first: int, n: int, seed: int, scales: list[int], reps: list[int], sizes: list[int], whole: bool, block: int = BLOCK) -> np.ndarray:
    """(4, b, p, p): the pair sums of b replicates over whole blocks of units, numbered from ``first`` on.

    whole: of units with every value alone.  Draws are made and used by the block, so only a block's are held.
    """
    blocks = np.arange(first // block, -(-(first + len(x)) // block))
    drawn = [block_keys(seed, s, r, n, sizes[s], blocks, block) for s, r in zip(scales, reps, strict=True)]
    out, at = np.zeros((4, len(reps), x.shape[1], x.shape[1])), 0
    for k, m in enumerate(block_sizes(n, block)[blocks].tolist()):
        rows = x[at : at + m]
        weights = np.stack([np.bincount(draw(keys[k], m, int(shares[k])), minlength=m) for keys, shares in drawn]).astype(np.float64)
        if whole:
            keep = ~np.isnan(rows).any(1)
            rows, weights = rows[keep], weights[:, keep]
        weighted_stats(rows, weights, out)
        at += m
    return out


def distances(stats: np.ndarray, n_rows, method: str) -> np.ndarray:
    """(b, p, p) distances; NaN where undefined."""
    n, s, q, g = stats
    s2, q2 = s.transpose(0, 2, 1), q.transpose(0, 2, 1)
    with np.errstate(all="ignore"):
        if method == "uncentered":
            d = 1 - g / np.sqrt(q * q2)
        elif method in ("euclidean", "minkowski"):
            d = np.sqrt(np.maximum(q + q2 - 2 * g, 0) * np.reshape(n_rows, (-1, 1, 1)) / n)
        else:
            spread = (q - s * s / n) * (q2 - s2 * s2 / n)
            rho = (g - s * s2 / n) / np.sqrt(np.where(spread > 0, spread, np.nan))
            rho = np.where(n > 1, rho, np.nan)
            d = 1 - (np.abs(rho) if method == "abscor" else rho)
    at = np.arange(d.shape[1])
    d[:, at, at] = 0
    return np.round(d, 12)


def bit_keys(candidates: list[list[str]], labels: list[str]) -> dict[bytes, int]:
    """Each candidate's member words, to its number; candidates with unknown members can't occur."""
    at, out = {x: k for k, x in enumerate(labels)}, {}
    for c, members in enumerate(candidates):
        if all(m in at for m in members):
            words = np.zeros(-(-len(labels) // 64), np.uint64)
            for m in members:
                words[at[m] // 64] |= np.uint64(1) << np.uint64(at[m] % 64)
            out[words.tobytes()] = c
    return out


class _Tally:
    """Counts by (scale, candidate), and replicates without a tree by scale (candidate -1)."""

    def __init__(self, keys: dict[bytes, int], linkage: str):
        self.keys, self.linkage, self.n = keys, linkage, {}

    def add(self, scale: np.ndarray, d: np.ndarray) -> None:
        fine = np.isfinite(d).all((1, 2))
        for s in scale[~fine].tolist():
            self.n[s, -1] = self.n.get((s, -1), 0) + 1
        if fine.any():
            _, _, members = tree.batch_linkage(d[fine], self.linkage)
            for s, row in zip(scale[fine].tolist(), members, strict=True):
                for words in row:
                    c = self.keys.get(words.tobytes())
                    if c is not None:
                        self.n[s, c] = self.n.get((s, c), 0) + 1

    def batch(self) -> pa.RecordBatch:
        rows = [(s, c, k) for (s, c), k in self.n.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["scale_idx", "candidate", "count"])


def _by_replicate(sent, sizes, nboot, seed, method, linkage, cluster_fn, block):
    def run(batches):
        x, keys, labels = sent.value
        tally, every = _Tally(keys, linkage), np.arange(len(block_sizes(len(x), block)))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), together(x.shape[1])):
                own = ids[at : at + together(x.shape[1])]
                scale, rep = own // nboot, own % nboot
                if cluster_fn is not None:
                    for s, r in zip(scale.tolist(), rep.tolist(), strict=True):
                        found = cluster_fn(np.repeat(x, block_draws(seed, s, r, len(x), sizes[s], every, block), 0))
                        hits = [(s, -1)] if found is None else [(s, c) for f in found for c in [keys.get(frozenset(labels[k] if isinstance(k, int | np.integer) else k for k in f))] if c is not None]
                        for h in hits:
                            tally.n[h] = tally.n.get(h, 0) + 1
                    continue
                sums = drawn_stats(x, 0, len(x), seed, scale.tolist(), rep.tolist(), sizes, method == "uncentered", block)
                tally.add(scale, distances(sums, np.array([sizes[int(s)] for s in scale]), method))
        yield tally.batch()

    return run


def _by_unit(n: int, offsets: dict[int, int], sizes, nboot: int, seed: int, p: int, method: str, block: int):
    """Whole blocks of units, sorted, to the weighted sums of every replicate: (rep, sums), a row per task and replicate.

    offsets: the number of each partition's first unit.  A task holds its own units and
    works on a few replicates at a time.  Sums of units without gaps travel as one number,
    p sums, p sums of squares and p * p products.
    """

    def run(batches):
        from pyspark import TaskContext

        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p) for b in batches if b.num_rows]
        if not parts:
            return
        x, first = np.concatenate(parts), offsets[TaskContext.get().partitionId()]
        del parts
        whole = not np.isnan(x).any()
        for at in range(0, len(sizes) * nboot, together(p)):
            ids = np.arange(at, min(at + together(p), len(sizes) * nboot))
            sums = drawn_stats(x, first, n, seed, (ids // nboot).tolist(), (ids % nboot).tolist(), sizes, method == "uncentered", block)
            if whole or method == "uncentered":
                flat = np.concatenate([sums[0, :, 0, :1], sums[1, :, :, 0], sums[2, :, :, 0], sums[3].reshape(len(ids), -1)], 1)
            else:
                flat = sums.transpose(1, 0, 2, 3).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f.tobytes() for f in flat], pa.binary())], names=["rep", "sums"])

    return run


def _unfolded(raw: bytes, p: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.float64)
    if len(flat) == 4 * p * p:
        return flat.reshape(4, p, p)
    ones = np.ones((1, p))
    return np.stack([flat[0] * ones.T @ ones, flat[1 : p + 1, None] * ones, flat[p + 1 : 2 * p + 1, None] * ones, flat[2 * p + 1 :].reshape(p, p)])


def _trees(keys, sizes, nboot, p, method, linkage):
    """Rows (rep, sums) sorted by rep: adds a replicate's parts, then makes its tree."""

    def run(batches):
        tally, held, ids = _Tally(keys, linkage), [], []

        def settle():
            scale = np.array(ids) // nboot
            tally.add(scale, distances(np.stack(held, 1), np.array([sizes[s] for s in scale]), method))
            held.clear()
            ids.clear()

        for batch in batches:
            for rep, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums = _unfolded(raw.as_py(), p)
                if ids and ids[-1] == rep:
                    held[-1] = held[-1] + sums
                else:
                    if len(ids) >= together(p):
                        settle()
                    ids.append(rep)
                    held.append(sums)
        if ids:
            settle()
        yield tally.batch()

    return run


def _in_blocks(vectors: DataFrame, n: int, p: int, block: int, part_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """Units in order of their ids, whole blocks to a partition, and the number of each partition's first unit.

    Ranges of ids come first; a unit's number is its place in its range and the sizes of those before.
    """
    spark = vectors.sparkSession
    # units in a partition, in whole blocks: few enough to hold, and all cores at work where there are blocks for them
    per = max(1, min(part_bytes // (8 * p * block), -(-n // (block * spark.sparkContext.defaultParallelism)))) * block
    tasks = max(1, math.ceil(n / per))
    ranged = checkpointed(vectors.select("unit_id", "values").repartitionByRange(tasks, "unit_id").withColumn("range_", F.spark_partition_id()))
    counts = {r["range_"]: r["count"] for r in ranged.groupBy("range_").count().collect()}  # a row per task
    before = small_frame(spark, [(k, sum(v for j, v in counts.items() if j < k)) for k in counts], "range_ int, before long")
    place = F.row_number().over(Window.partitionBy("range_").orderBy("unit_id")) - 1 + F.col("before")
    numbered = ranged.join(F.broadcast(before), "range_").withColumn("place", place)
    dealt = numbered.withColumn("task", F.floor(F.col("place") / per).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("place")
    return checkpointed(dealt.select("values")), {k: k * per for k in range(tasks)}


def count_candidates(vectors: DataFrame, labels: list[str], candidates: list[list[str]], nboot: int = 1000, r: list[float] | None = None, seed: int = 42, method_dist: str = "correlation", method_hclust: str = "average", cluster_fn: Callable | None = None, sent_bytes: int = SENT_BYTES, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """(candidate, scale_idx, size, r, nboot, count, skipped) of candidate member sets.

    Counts are the same for any ``sent_bytes``.  A replicate without a tree is skipped but stays in nboot.  ``cluster_fn`` takes a
    resampled array (units x objects) and returns member sets (of labels or column
    numbers), or None.
    """
    spark = vectors.sparkSession
    n, p = vectors.count(), len(labels)
    if n < 3:
        raise ValueError("three units are needed at least")
    if n < 30:
        warnings.warn(f"{n} units are few for a bootstrap", stacklevel=2)
    method = method_dist.lower()
    tree.method_name(method_hclust)
    scales = effective_scales(n, r)
    sizes = [s for s, _ in scales]
    total, deal = len(sizes) * nboot, spark.sparkContext.defaultParallelism
    keys = bit_keys(candidates, labels)
    kind = "scale_idx int, candidate int, count long"
    if n * p * 8 <= sent_bytes or cluster_fn is not None:
        rows = vectors.select("unit_id", "values").orderBy("unit_id").collect()  # n * p * 8 bytes, checked above
        x = np.array([[np.nan if v is None else v for v in row["values"]] for row in rows], np.float64).reshape(n, p)
        if cluster_fn is not None:
            keys = {frozenset(c): k for k, c in enumerate(candidates)}
        sent = spark.sparkContext.broadcast((x, keys, labels))
        slices = max(1, min(4 * deal, math.ceil(total / together(p))))
        counted = spark.range(0, total, 1, slices).mapInArrow(_by_replicate(sent, sizes, nboot, seed, method, method_hclust, cluster_fn, block), kind)
    else:
        placed, offsets = _in_blocks(vectors, n, p, block, part_bytes)
        sums = placed.mapInArrow(_by_unit(n, offsets, sizes, nboot, seed, p, method, block), "rep long, sums binary")
        counted = sums.repartition("rep").sortWithinPartitions("rep").mapInArrow(_trees(keys, sizes, nboot, p, method, method_hclust), kind)
    # few rows that took long to make: later reads must not draw again
    counts = checkpointed(counted.groupBy("scale_idx", "candidate").agg(F.sum("count").alias("count")))
    skipped = counts.where("candidate = -1").select("scale_idx", F.col("count").alias("skipped"))
    scale_rows = small_frame(spark, [(k, s, e, nboot) for k, (s, e) in enumerate(scales)], "scale_idx int, size int, r double, nboot int")
    grid = spark.range(len(candidates)).select(F.col("id").cast("int").alias("candidate")).crossJoin(scale_rows)
    done = grid.join(counts, ["scale_idx", "candidate"], "left").join(skipped, "scale_idx", "left")
    return done.select("candidate", "scale_idx", "size", "r", "nboot", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
