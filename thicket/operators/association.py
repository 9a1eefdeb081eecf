"""Association of partitions with annotations: chi-square, Cramer's V, Kruskal-Wallis, Rand index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.special import chi2_sf
from ..session import small_frame
from .running import running_sum

_NAMED = "negligible", "weak", "moderate", "strong"


def band(v: Column) -> Column:
    return F.when(v < 0.10, _NAMED[0]).when(v < 0.30, _NAMED[1]).when(v < 0.50, _NAMED[2]).otherwise(_NAMED[3])


def contingency(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by.., n, r, k, chi2, df, p_value, cramers_v, adjusted_rand) of two categorical columns.

    Chi-square with Yates' correction on two by two tables, Bergsma's corrected V, and the
    adjusted Rand index.  Null pairs are left out.  One shuffled count, then sums over cells.
    """
    by = by or []
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy(*by, "a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(*by, "b").agg(F.sum("o").alias("cb"))
    comb = lambda x: x * (x - 1) / 2
    all_ = cells.groupBy(*by).agg(F.sum("o").alias("n"), F.sum(comb(F.col("o"))).alias("cc"))
    rs = rows.groupBy(*by).agg(F.count("*").cast("double").alias("r"), F.sum(comb(F.col("ra"))).alias("ca"), F.sum(1 / F.col("ra")).alias("ir"))
    cs = cols.groupBy(*by).agg(F.count("*").cast("double").alias("k"), F.sum(comb(F.col("cb"))).alias("cd"), F.sum(1 / F.col("cb")).alias("ic"))

    def on(x, y):
        return x.join(y, by) if by else x.crossJoin(y)  # one row each

    sizes = on(on(all_, rs), cs)
    there = on(cells.join(rows, [*by, "a"]).join(cols, [*by, "b"]), all_.select(*by, "n")).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    off = F.abs(F.col("o") - F.col("e"))
    met = there.groupBy(*by).agg(F.sum(off * off / F.col("e")).alias("met"), F.sum("e").alias("expected"), F.max(off).alias("off"))
    # a cell absent from the table adds its expectation, so only the cells there are looked at;
    # in a two by two table all four are equally far off
    yates = F.pow(F.col("off") - F.least(F.lit(0.5), F.col("off")), 2) * F.col("n") * F.col("ir") * F.col("ic")
    chi = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(F.col("met") + F.greatest(F.col("n") - F.col("expected"), F.lit(0.0)))
    out = on(sizes, met).withColumn("chi2", chi).withColumn("df", ((F.col("r") - 1) * (F.col("k") - 1)).cast("int"))
    out = out.withColumn("p_value", F.when(F.col("df") > 0, F.expr(chi2_sf("chi2", "df"))))
    m = F.col("n") - 1
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("r") - 1) * (F.col("k") - 1) / m)
    least = F.least(F.col("r") - F.pow(F.col("r") - 1, 2) / m, F.col("k") - F.pow(F.col("k") - 1, 2) / m) - 1
    expect = F.col("ca") * F.col("cd") / comb(F.col("n"))
    rest = (F.col("ca") + F.col("cd")) / 2 - expect
    out = out.withColumn("cramers_v", F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0))
    out = out.withColumn("adjusted_rand", F.when(rest == 0, 1.0).otherwise((F.col("cc") - expect) / F.when(rest != 0, rest)))
    return out.select(*by, F.col("n").cast("long").alias("n"), F.col("r").cast("int").alias("r"), F.col("k").cast("int").alias("k"), "chi2", "df", "p_value", "cramers_v", "adjusted_rand")


def kruskal(values: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by.., n, k, h, df, p_value, eta2): the rank test with tie correction.

    Distinct values are counted first; the mid-ranks are running sums over those counts.
    """
    by = by or []
    tied = values.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x"), F.col(group).alias("g")).agg(F.count("*").cast("double").alias("c"))
    ties = tied.groupBy(*by, "x").agg(F.sum("c").alias("t"))
    ranked = running_sum(ties, by, "x", "t", "upto").withColumn("mid", F.col("upto") - (F.col("t") - 1) / 2)
    sums = tied.join(ranked.select(*by, "x", "mid"), [*by, "x"]).groupBy(*by, "g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("mid")).alias("s"))
    h = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    fix = ties.groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    out = h.join(fix, by) if by else h.crossJoin(fix)
    n = F.col("n")
    raw = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = out.withColumn("h", F.greatest(raw, F.lit(0.0))).withColumn("df", (F.col("k") - 1).cast("int"))
    out = out.withColumn("p_value", F.when(F.col("df") > 0, F.expr(chi2_sf("h", "df"))))
    eta = F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / F.nullif(n - F.col("k"), F.lit(0.0)))
    return out.select(*by, n.cast("long").alias("n"), F.col("k").cast("int").alias("k"), "h", "df", "p_value", eta.alias("eta2"))


def association(assignment: DataFrame, annotations: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """(variable, test, n, levels, statistic, p_value, effect, effect_name, adjusted_rand, strength, reason), strongest first.

    assignment: unit_id, cluster.  A column that can't be tested has a row with test
    'skipped' and a reason: fewer than three values, one value alone, or one cluster.
    """
    both = assignment.select("unit_id", "cluster").join(annotations, "unit_id")
    if both.limit(3).count() < 3:
        raise ValueError("fewer than three annotated units")
    names = [c for c in annotations.columns if c != "unit_id"]
    kinds = {f.name: f.dataType for f in annotations.schema}
    numeric = [c for c in names if isinstance(kinds[c], NumericType)] if numeric is None else numeric
    words = [c for c in names if c not in numeric]
    seen = both.select("cluster", *[F.col(c).cast("string").alias(c) for c in names]).unpivot("cluster", names, "variable", "x").where("x is not null and cluster is not null")
    levels = seen.groupBy("variable").agg(F.count("*").alias("values"), F.count_distinct("x").alias("levels"), F.count_distinct("cluster").alias("clusters"))
    every = small_frame(both.sparkSession, [(c,) for c in names], "variable string").join(levels, "variable", "left")
    few = (F.coalesce("values", F.lit(0)) < 3) | (F.col("levels") < 2)
    reason = F.when(few, "constant or too few values").when(F.col("clusters") < 2, "one cluster")
    told = every.withColumn("reason", reason).select("variable", F.coalesce("values", F.lit(0)).alias("n"), F.coalesce("levels", F.lit(0)).cast("int").alias("levels"), "reason")
    fine = told.where("reason is null").select("variable", "levels")
    none = lambda t: F.lit(None).cast(t)
    out = [told.where("reason is not null").select("variable", F.lit("skipped").alias("test"), "n", "levels", none("double").alias("statistic"), none("double").alias("p_value"), none("double").alias("effect"), none("string").alias("effect_name"), none("double").alias("adjusted_rand"), none("string").alias("strength"), "reason")]
    if numeric:
        long = both.select("cluster", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot("cluster", numeric, "variable", "x")
        k = kruskal(long, "cluster", "x", ["variable"]).join(fine, "variable")
        out.append(k.select("variable", F.lit("kruskal-wallis").alias("test"), "n", "levels", F.col("h").alias("statistic"), "p_value", F.col("eta2").alias("effect"), F.lit("eta2").alias("effect_name"), none("double").alias("adjusted_rand"), band(F.sqrt("eta2")).alias("strength"), none("string").alias("reason")))
    if words:
        long = both.select("cluster", *[F.col(c).cast("string").alias(c) for c in words]).unpivot("cluster", words, "variable", "x")
        k = contingency(long, "cluster", "x", ["variable"]).join(fine, "variable")
        out.append(k.select("variable", F.lit("chi-square").alias("test"), "n", "levels", F.col("chi2").alias("statistic"), "p_value", F.col("cramers_v").alias("effect"), F.lit("cramers_v").alias("effect_name"), "adjusted_rand", band(F.col("cramers_v")).alias("strength"), none("string").alias("reason")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.orderBy(F.desc_nulls_last("effect"), "variable")


#: What a verdict of confounding advises: fixed values.
ACTIONS = {"complete": "cannot adjust -- design limitation", "partial": "adjust with protect=", "balanced": "adjust freely"}


def confounding(batch: DataFrame, annotations: DataFrame) -> DataFrame:
    """(variable, p_value, cramers_v, verdict, action): how far each annotation goes with the batch (unit_id, batch).

    An annotation of fewer than three values or one value, or of one batch, is 'skipped' without figures.
    """
    names = [c for c in annotations.columns if c != "unit_id"]
    both = batch.select("unit_id", "batch").join(annotations, "unit_id").select("batch", *[F.col(c).cast("string").alias(c) for c in names]).unpivot("batch", names, "variable", "x").where("batch is not null and x is not null")
    spread = both.groupBy("variable").agg(F.count("*").alias("values"), F.count_distinct("x").alias("levels"), F.count_distinct("batch").alias("batches"))
    per = both.groupBy("variable", "batch").agg(F.count_distinct("x").alias("own")).groupBy("variable").agg(F.max("own").alias("own"))
    every = small_frame(batch.sparkSession, [(c,) for c in names], "variable string")
    t = every.join(spread, "variable", "left").join(per, "variable", "left").join(contingency(both, "batch", "x", ["variable"]), "variable", "left")
    skipped = F.coalesce((F.col("values") < 3) | (F.col("levels") < 2) | (F.col("batches") < 2), F.lit(True))
    verdict = F.when(skipped, "skipped").when(F.col("own") == 1, "complete").when((F.col("p_value") < 0.05) & (F.col("cramers_v") >= 0.10), "partial").otherwise("balanced")
    action = F.coalesce(*[F.when(F.col("verdict") == v, F.lit(a)) for v, a in ACTIONS.items()])
    out = t.withColumn("verdict", verdict).withColumn("skip_", F.col("verdict") == "skipped")
    return out.select("variable", *[F.when(~F.col("skip_"), F.col(c)).alias(c) for c in ("p_value", "cramers_v")], "verdict", action.alias("action")).orderBy("variable")


def report(associations: DataFrame, batch_like: list[str], k: int) -> str:
    """What the partition follows, in words: technical variables apart from others."""
    rows = associations.where("effect >= 0.30 and p_value < 0.05").collect()  # a row per annotation
    mine = [r for r in rows if r["variable"] in batch_like]
    rest = [r for r in rows if r["variable"] not in batch_like]
    tell = lambda x: ", ".join(f"{r['variable']} ({r['effect_name']} {r['effect']:.2f})" for r in x) or "none"
    return f"{k} clusters. Technical variables they follow: {tell(mine)}. Others: {tell(rest)}."
