"""Batch correction of long tables: linear, protected linear, and empirical Bayes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of shrinking at most; a batch that takes more stops the run.
ROUNDS = 5000
#: Aggregates by object and batch that may be sent to every task.
SENT_ROWS = 100_000


def _checked(long: DataFrame, batch: DataFrame, min_per_batch: int) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The table with a batch column, the batches in order, and how aggregates by object are joined.

    Few go to every task: a join by object would bring all rows of few objects to as few tasks.
    """
    with_batch = long.join(batch.select("unit_id", F.col("batch").cast("string").alias("batch")), "unit_id", "left")
    units = with_batch.select("unit_id", "batch").distinct()
    sizes = {r["batch"]: r["count"] for r in units.groupBy("batch").count().collect()}  # a row per batch
    if None in sizes:
        raise ValueError(f"{sizes[None]} units have no batch")
    small = sorted(b for b, n in sizes.items() if n < min_per_batch)
    if small and len(sizes) > 1:
        raise ValueError(f"batches of fewer than {min_per_batch} units: {small[:4]}")
    most = SENT_ROWS // len(sizes) if sizes else 0
    few = len(sizes) > 1 and long.select("object").distinct().limit(most + 1).count() <= most
    return with_batch, sorted(sizes), F.broadcast if few else lambda own: own


def linear(long: DataFrame, batch: DataFrame, protect: DataFrame | None = None, scale: bool = False, min_per_batch: int = 3) -> DataFrame:
    """Values without the batches' mean shifts; with ``protect`` (unit_id, label columns), shifts beside those labels'.

    scale also makes batches' deviations equal.  Objects keep their means.  One batch is a
    no-op.  Means and deviations are aggregates by object and batch, joined back; protected
    correction solves one small least-squares problem for all objects, from sums over units.
    """
    rows, batches, sent = _checked(long, batch, min_per_batch)
    if len(batches) < 2:
        return long
    if protect is None:
        whole = rows.groupBy("object").agg(F.avg("value").alias("mean_"))
        own = rows.groupBy("object", "batch").agg(F.avg("value").alias("own_"))
        fixed = rows.join(sent(own), ["object", "batch"]).join(sent(whole), "object").withColumn("y", F.col("value") - F.col("own_") + F.col("mean_")).drop("own_", "mean_")
    else:
        fixed = _protected(rows, batches, protect, sent)
    if scale:
        whole = fixed.groupBy("object").agg(F.stddev_samp("y").alias("sd_"))
        own = fixed.groupBy("object", "batch").agg(F.stddev_samp("y").alias("sd_own_"), F.avg("y").alias("own_"))
        factor = F.when(F.col("sd_own_") > 0, F.col("sd_") / F.col("sd_own_")).otherwise(1.0)
        fixed = fixed.join(sent(own), ["object", "batch"]).join(sent(whole), "object").withColumn("y", F.col("own_") + (F.col("y") - F.col("own_")) * factor).drop("sd_", "sd_own_", "own_")
    shift = fixed.groupBy("object").agg((F.avg("value") - F.avg(F.when(F.col("value").isNotNull(), F.col("y")))).alias("shift_"))
    return fixed.join(sent(shift), "object").select("unit_id", "object", (F.col("y") + F.col("shift_")).alias("value"))


def _protected(rows: DataFrame, batches: list[str], protect: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    names = [c for c in protect.columns if c != "unit_id"]
    labelled = rows.join(protect.select("unit_id", *[F.col(c).cast("string").alias(f"p_{k}") for k, c in enumerate(names)]), "unit_id", "left")
    terms = [F.lit(1.0)] + [F.when(F.col("batch") == b, 1.0).otherwise(0.0) for b in batches[1:]]
    for k in range(len(names)):
        levels = [r[0] for r in labelled.select(f"p_{k}").distinct().orderBy(f"p_{k}").collect()]
        if None in levels:
            raise ValueError(f"{names[k]} is missing for some units")
        alone = labelled.select("batch", f"p_{k}").distinct().groupBy("batch").count().agg(F.max("count")).first()[0]
        if len(levels) > 1 and alone == 1:
            raise ValueError(f"every batch holds one level of {names[k]}: they can't be told apart")
        terms += [F.when(F.col(f"p_{k}") == x, 1.0).otherwise(0.0) for x in levels[1:]]
    m, nb = len(terms), len(batches) - 1
    seen = labelled.where("value is not null").withColumn("t", F.array(*terms))
    parts = [F.sum(F.col("t")[i] * F.col("t")[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(F.col("t")[i] * F.col("value")).alias(f"b{i}") for i in range(m)]
    sums = seen.groupBy("object").agg(*parts)

    def solve(frames):
        import pandas as pd

        for f in frames:
            out = []
            for _, r in f.iterrows():
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
                if np.linalg.matrix_rank(a) < m:
                    raise ValueError("batches and protected labels are collinear")
                beta = np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(m)]))
                out.append((r["object"], [0.0, *beta[1 : 1 + nb].tolist()]))
            yield pd.DataFrame(out, columns=["object", "shift"])

    shifts = sums.mapInPandas(solve, "object string, shift array<double>")
    at = F.array_position(F.array(*[F.lit(b) for b in batches]), F.col("batch"))
    both = labelled.join(sent(shifts), "object").withColumn("off", F.element_at("shift", at.cast("int")))
    return both.withColumn("y", F.col("value") - F.col("off"))


def combat(long: DataFrame, batch: DataFrame, protect: DataFrame | None = None, mean_only: bool = False, ref_batch: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """Parametric empirical-Bayes correction (Johnson, Li and Rabinovic 2007).

    Sums by object and batch are Spark aggregates; what each batch then shrinks is one row
    per object, in a task per batch.  One batch is a no-op.
    """
    rows, batches, sent = _checked(long, batch, 1 if mean_only else 2)
    if len(batches) < 2:
        return long
    if ref_batch is not None and ref_batch not in batches:
        raise ValueError(f"no batch {ref_batch}")
    rows = rows.where("value is not null")
    if protect is not None:
        kept = _protected(rows, batches, protect, sent)
        # what the labels explain is put back at the end
        labels = [c for c in kept.columns if c.startswith("p_")]
        by_label = kept.groupBy("object", *labels).agg(F.avg("y").alias("by_label_"))
        by_object = kept.groupBy("object").agg(F.avg("y").alias("by_object_"))
        rows = kept.join(sent(by_label), ["object", *labels]).join(sent(by_object), "object").withColumn("kept", F.col("by_label_") - F.col("by_object_"))
    else:
        rows = rows.withColumn("kept", F.lit(0.0))
    rows = rows.select("unit_id", "object", "batch", "value", "kept").withColumn("x", F.col("value") - F.col("kept"))
    means = rows.groupBy("object", "batch").agg(F.avg("x").alias("mb"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").cast("double").alias("nb"))
    base = means if ref_batch is None else means.where(F.col("batch") == ref_batch)
    alpha = base.groupBy("object").agg((F.sum(F.col("mb") * F.col("nb")) / F.sum("nb")).alias("alpha"), F.sqrt(F.sum(F.col("q") - F.col("nb") * F.col("mb") * F.col("mb")) / F.sum("nb")).alias("sigma"))
    z = rows.join(sent(alpha), "object").withColumn("z", F.when(F.col("sigma") > 0, (F.col("x") - F.col("alpha")) / F.col("sigma")).otherwise(0.0))
    fits = z.groupBy("batch", "object").agg(F.count("*").cast("double").alias("n"), F.avg("z").alias("g"), F.coalesce(F.var_samp("z"), F.lit(1.0)).alias("d"))

    def shrink(f):
        import pandas as pd

        g, d, n = (f[c].to_numpy() for c in ("g", "d", "n"))
        gbar, t2 = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
        if ref_batch is not None and f["batch"].iloc[0] == ref_batch:
            gs, ds = np.zeros_like(g), np.ones_like(d)
        elif mean_only or len(g) < 2:
            gs, ds = (t2 * n * g + gbar) / (t2 * n + 1), np.ones_like(d)
        else:
            m, s2 = d.mean(), max(d.var(ddof=1), 1e-300)
            lam, theta = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
            gs, ds = g, d
            for _ in range(ROUNDS):
                ng = (t2 * n * g + ds * gbar) / (t2 * n + ds)
                nd = (theta + ((n - 1) * d + n * (g - ng) ** 2) / 2) / (n / 2 + lam - 1)
                off = max(np.max(np.abs(ng - gs) / np.maximum(np.abs(gs), 1e-12)), np.max(np.abs(nd - ds) / ds))
                gs, ds = ng, nd
                if off < tolerance:
                    break
            else:
                raise RuntimeError(f"batch {f['batch'].iloc[0]} did not settle in {ROUNDS} rounds")
        return pd.DataFrame({"batch": f["batch"], "object": f["object"], "gs": gs, "ds": ds})

    star = fits.groupBy("batch").applyInPandas(shrink, "batch string, object string, gs double, ds double")
    done = z.join(sent(star), ["batch", "object"])
    y = F.col("sigma") * (F.col("z") - F.col("gs")) / F.sqrt("ds") + F.col("alpha") + F.col("kept")
    return done.select("unit_id", "object", F.when(F.col("batch") == F.lit(ref_batch or ""), F.col("value")).otherwise(y).alias("value"))
