"""Multiscale fits: approximately unbiased, bootstrap and selective p-values from counts.

One grouped aggregate and Column arithmetic: the weighted least squares of the
normal quantiles on (sqrt r, 1 / sqrt r) has a closed form in five sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, norm_cdf, norm_pdf, norm_ppf

#: Proportions strictly between these enter a fit.
LOW, HIGH = "1.0e-3", "9.99e-1"
FIELDS = ("si", "au", "bp", "se_si", "se_au", "se_bp", "v", "c", "df", "rss", "pchi")


def fit(counts: DataFrame, key: str = "edge_id") -> DataFrame:
    """(key, FIELDS, n_use, n_scales, fitted) of (key, r, nboot, count).

    With fewer than three usable scales, si, au and bp are 0 or 1 as the mean of all
    proportions is below one half or not, and the other fields are 0.
    """
    rows = counts.select(key, F.col("r").cast("double").alias("r"), F.col("nboot").cast("double").alias("nb"), (F.col("count") / F.col("nboot")).cast("double").alias("p"))
    rows = rows.withColumn("use", (F.col("p") > F.expr(LOW)) & (F.col("p") < F.expr(HIGH)))
    rows = rows.withColumn("z", F.when(F.col("use"), -F.expr(norm_ppf("p"))))
    rows = rows.withColumn("w", F.expr(f"pow({norm_pdf('z')}, 2) * nb / ((1.0e0 - p) * p)"))
    sums = rows.groupBy(key).agg(
        F.count_if("use").cast("int").alias("n_use"),
        F.count("*").cast("int").alias("n_scales"),
        F.avg("p").alias("mean"),
        F.sum(F.expr("w * r")).alias("a"),
        F.sum("w").alias("b"),
        F.sum(F.expr("w / r")).alias("d"),
        F.sum(F.expr("w * z * sqrt(r)")).alias("x"),
        F.sum(F.expr("w * z / sqrt(r)")).alias("y"),
        F.collect_list(F.when(F.col("use"), F.struct("w", "z", "r"))).alias("points"),
    )
    out = sums.withColumn("fitted", F.col("n_use") >= 3).withColumn("det", F.when(F.col("fitted"), F.expr("a * d - b * b")))
    out = out.withColumn("v", F.expr("(d * x - b * y) / det")).withColumn("c", F.expr("(a * y - b * x) / det"))
    out = out.withColumn("lo", F.expr("v - c")).withColumn("hi", F.expr("v + c")).withColumn("neg_c", F.expr("-c"))
    out = out.withColumn("up", F.expr(norm_cdf("lo"))).withColumn("d0", F.expr(norm_cdf("neg_c"))).withColumn("den", F.expr(norm_pdf("lo")))
    out = out.withColumn("au_", F.expr(norm_cdf("-lo"))).withColumn("bp_", F.expr(norm_cdf("-hi"))).withColumn("si_", F.expr("least(greatest(1.0e0 - up / nullif(d0, 0.0e0), 0.0e0), 1.0e0)"))
    out = out.withColumn("se_au_", F.expr("den * sqrt((d + 2.0e0 * b + a) / det)")).withColumn("se_bp_", F.expr(f"{norm_pdf('hi')} * sqrt((d - 2.0e0 * b + a) / det)"))
    out = out.withColumn("h1", F.expr("den / nullif(d0, 0.0e0)")).withColumn("h2", F.expr(f"up * {norm_pdf('c')} / nullif(d0 * d0, 0.0e0) - den / nullif(d0, 0.0e0)"))
    out = out.withColumn("se_si_", F.expr("case when si_ > 0.0e0 and si_ < 1.0e0 then sqrt(greatest((d * h1 * h1 - 2.0e0 * b * h1 * h2 + a * h2 * h2) / det, 0.0e0)) else 0.0e0 end"))
    out = out.withColumn("rss_", F.expr("aggregate(points, 0.0e0, (t, q) -> t + q.w * pow(q.z - v * sqrt(q.r) - c / sqrt(q.r), 2))"))
    out = out.withColumn("df_", F.col("n_use") - 2).withColumn("pchi_", F.when(F.col("fitted"), F.expr(chi2_sf("rss_", "df_"))))
    flat = F.when(F.col("mean") < 0.5, 0.0).otherwise(1.0)
    pick = lambda name, other: F.when(F.col("fitted"), F.col(name)).otherwise(other).alias(name.rstrip("_"))
    zero = F.lit(0.0)
    return out.select(key, *[pick(n, flat) for n in ("si_", "au_", "bp_")], *[pick(n, zero) for n in ("se_si_", "se_au_", "se_bp_", "v", "c")], pick("df_", F.lit(0)), pick("rss_", zero), pick("pchi_", zero), "n_use", "n_scales", "fitted")
