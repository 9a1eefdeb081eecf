"""The registered queries of the cluster-support engine, each with equivalent SQL where SQL can express it.

The SQL states each result by a formula of its own (built-in correlations, direct
sums over unsplit tables), not by the engine's plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import members as S
from ..functions.scales import scales_frame
from ..functions.special import chi2_sf_duckdb, norm_cdf, norm_pdf, norm_ppf
from ..operators import adjust, association, blocks, federate, msfit, profiles, stats, tree
from ..operators.bootstrap import multiplicity_frame
from ..sources import exchange
from ..sources import matrix as M
from . import support, verbs, workflows

DIMS = [f"d{k:02d}" for k in range(64)]
#: Replicates of each scale, as the operators have by default.
NBOOT = 1000
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0e0)"


def wide(spark: SparkSession, sf_dir: str, holes: int = 0, dims: list[str] = DIMS) -> DataFrame:
    """Embeddings as units by objects; with ``holes``, a value is missing where (unit + object) divides by it."""
    e = table(spark, sf_dir, "embeddings")

    def value(k: int) -> Column:
        v = F.col("embedding")[k].cast("double")
        return (F.when((F.col("vec_id") + k) % holes != 0, v) if holes else v).alias(dims[k])

    return e.select("vec_id", "label", *[value(k) for k in range(len(dims))])


def long_of(spark: SparkSession, sf_dir: str, holes: int = 0) -> DataFrame:
    return M.to_long(wide(spark, sf_dir, holes), "vec_id", DIMS)


def vectors_of(spark: SparkSession, sf_dir: str, holes: int = 0) -> DataFrame:
    return M.to_vectors(wide(spark, sf_dir, holes), "vec_id", DIMS)


_EMB = "emb AS (SELECT vec_id, label, 'd' || lpad(CAST(k AS VARCHAR), 2, '0') AS object, {v} AS value FROM embeddings, range(64) t(k))"
EMB = _EMB.format(v="CAST(embedding[k + 1] AS DOUBLE)")
HOLED = _EMB.format(v="CASE WHEN (vec_id + k) % 101 <> 0 THEN CAST(embedding[k + 1] AS DOUBLE) END")
PAIRED = "pr AS (SELECT a.object AS obj_i, b.object AS obj_j, a.value AS x, b.value AS y FROM emb a JOIN emb b USING (vec_id))"
BOTH = "x IS NOT NULL AND y IS NOT NULL"


# ---------------------------------------------------------------- statistics and distances


def _pair_sql(columns: dict[str, str], source: str) -> str:
    one = "SELECT '{i}' AS obj_i, '{j}' AS obj_j, count(*) AS n_rows, count(CASE WHEN {both} THEN 1 END) AS n, {s} AS s, {q} AS q, {g} AS g FROM {source}"
    out = []
    for i, a in columns.items():
        for j, b in columns.items():
            both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
            part = lambda e, w=both: f"round(coalesce(sum(CASE WHEN {w} THEN {e} END), 0.0e0), 2) + 0.0e0"
            out.append(one.format(i=i, j=j, both=both, s=part(f"({a})"), q=part(f"({a}) * ({a})"), g=part(f"({a}) * ({b})"), source=source))
    return " UNION ALL ".join(out)


_NUMBER_SQL = dict(zip(NUMBERS, ("l_quantity", "l_extendedprice / 1.0e4", "l_discount", "CASE WHEN l_linenumber % 7 <> 0 THEN l_tax END"), strict=True))


@query(_pair_sql(_NUMBER_SQL, "lineitem"))
def pairwise_stats_lineitem(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1e4)
    line = line.withColumn("l_tax", F.when(F.col("l_linenumber") % 7 != 0, F.col("l_tax")))
    return rounded(stats.gram_stats(line.select(F.array(*NUMBERS).alias("values")), NUMBERS), 2)


@query("WITH p AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT DISTINCT event_type AS o FROM events), n AS (SELECT count(DISTINCT user_id) AS n_rows FROM events) "
       "SELECT g1.o AS obj_i, g2.o AS obj_j, any_value(n.n_rows) AS n_rows, count(b.v) AS n, round(coalesce(sum(CASE WHEN b.v IS NOT NULL THEN a.v END), 0.0e0), 4) + 0.0e0 AS s, round(coalesce(sum(CASE WHEN b.v IS NOT NULL THEN a.v * a.v END), 0.0e0), 4) + 0.0e0 AS q, round(coalesce(sum(a.v * b.v), 0.0e0), 4) + 0.0e0 AS g "
       "FROM g g1 CROSS JOIN g g2 CROSS JOIN n LEFT JOIN p a ON a.event_type = g1.o LEFT JOIN p b ON b.event_type = g2.o AND b.user_id = a.user_id GROUP BY 1, 2")  # fmt: skip
def pairwise_stats_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("unit_id"), F.col("event_type").alias("object")).agg(F.avg("value").alias("value"))
    return rounded(stats.pairwise_stats(e), 4)


def _distance_sql(d: str, where: str = BOTH) -> str:
    zero = "CASE WHEN obj_i = obj_j THEN 0.0e0 ELSE " + d + " END"
    return f"WITH {HOLED}, {PAIRED}, nr AS (SELECT count(DISTINCT vec_id) AS nr FROM embeddings) SELECT obj_i, obj_j, {r6(zero)} AS d FROM (SELECT obj_i, obj_j, nr, x, y FROM pr, nr WHERE {where}) GROUP BY obj_i, obj_j, nr"


def _gram_distance(spark, sf_dir, method):
    v = vectors_of(spark, sf_dir, 101)
    s = stats.listwise_stats(v, DIMS) if method == "uncentered" else stats.gram_stats(v, DIMS)
    return rounded(stats.distance(s, method))


@query(_distance_sql("1.0e0 - corr(x, y)"))
def dist_correlation(spark, sf_dir):
    return _gram_distance(spark, sf_dir, "correlation")


@query(_distance_sql("1.0e0 - abs(corr(x, y))"))
def dist_abscor(spark, sf_dir):
    return _gram_distance(spark, sf_dir, "abscor")


@query(_distance_sql("sqrt(sum((x - y) * (x - y)) * nr / count(*))"))
def dist_euclidean(spark, sf_dir):
    return _gram_distance(spark, sf_dir, "euclidean")


@query(f"WITH {HOLED}, whole AS (SELECT vec_id FROM emb GROUP BY vec_id HAVING count(value) = 64), pr AS (SELECT a.object AS obj_i, b.object AS obj_j, a.value AS x, b.value AS y FROM emb a JOIN emb b USING (vec_id) JOIN whole USING (vec_id)) "
       f"SELECT obj_i, obj_j, {r6('CASE WHEN obj_i = obj_j THEN 0.0e0 ELSE 1.0e0 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)) END')} AS d FROM pr GROUP BY obj_i, obj_j")  # fmt: skip
def dist_uncentered(spark, sf_dir):
    return _gram_distance(spark, sf_dir, "uncentered")


@query(_distance_sql("pow(sum(pow(abs(x - y), 3)) * nr / count(*), 1.0e0 / 3.0e0)"))
def dist_minkowski_p3(spark, sf_dir):
    return rounded(stats.minkowski(long_of(spark, sf_dir, 101), 3.0))


@query(_distance_sql("1.0e0 - corr(x, y)"))
def pooled_distance(spark, sf_dir):
    """Statistics of three projects, pooled: the distance of the unsplit table."""
    w = wide(spark, sf_dir, 101)
    parts = [stats.gram_stats(M.to_vectors(w.where(F.col("label") % 3 == k), "vec_id", DIMS), DIMS) for k in range(3)]
    return rounded(stats.distance(stats.pool_stats(parts), "correlation"))


# ---------------------------------------------------------------- scales, fits, draws


_SIZED = ("nation", "supplier", "customer", "part", "orders", "embeddings")


@query("SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY first) - 1 AS INTEGER) AS scale_idx, CAST(size AS INTEGER) AS size, round(size / n, 9) AS r FROM (SELECT n, size, min(k) AS first FROM (SELECT n, k, floor(n * least(0.5e0 + k * 0.1e0, 1.4e0)) AS size FROM (" + " UNION ".join(f"SELECT CAST(count(*) AS INTEGER) AS n FROM {t}" for t in _SIZED) + ") v(n), range(10) t(k)) GROUP BY n, size) WHERE size > 0")
def effective_scale_table(spark, sf_dir):
    """The scales of tables of several sizes."""
    sizes = sorted({table(spark, sf_dir, t).count() for t in _SIZED})
    return federate.union([scales_frame(spark, n).select(F.lit(n).cast("int").alias("n"), "scale_idx", "size", F.round("r", 9).alias("r")) for n in sizes])


# Proportions of branch cases over the ten scales 0.5 .. 1.4.
_CASES = {
    "rising": [0.60, 0.66, 0.72, 0.77, 0.81, 0.85, 0.89, 0.92, 0.95, 0.975],
    "weak": [0.30, 0.33, 0.36, 0.39, 0.42, 0.45, 0.48, 0.51, 0.54, 0.57],
    "falling": [0.40, 0.36, 0.33, 0.29, 0.26, 0.22, 0.19, 0.16, 0.13, 0.10],
    "none": [0.0] * 10,
    "below": [0.0005] * 10,
    "all": [1.0] * 10,
    "above": [0.9995] * 10,
    "two": [0.0] * 8 + [0.4, 0.6],
    "three": [0.0] * 7 + [0.3, 0.4, 0.6],
    "edges": [0.0, 0.001, 0.01, 0.2, 0.5, 0.8, 0.95, 0.999, 1.0, 1.0],
}
_ROWS = [(name, (k + 5) / 10, 10000, round(p * 10000)) for name, ps in _CASES.items() for k, p in enumerate(ps)]
_VALUES = ", ".join(f"('{e}', {r}e0, {n}, {c})" for e, r, n, c in _ROWS)

_FIT_SQL = f"""
WITH raw(edge_id, r, nboot, count) AS (SELECT * FROM (VALUES {_VALUES}) v UNION ALL SELECT 'part' || p_partkey, (k + 5) / 10.0e0, 1000, least(1000, greatest(0, (p_partkey * 37) % 900 + k * (p_size % 21 - 5))) FROM part, range(10) t(k)),
p AS (SELECT edge_id, r, CAST(nboot AS DOUBLE) AS nb, count / CAST(nboot AS DOUBLE) AS p FROM raw),
z AS (SELECT *, p > 1.0e-3 AND p < 9.99e-1 AS use, -({norm_ppf("p")}) AS z FROM p),
w AS (SELECT *, pow({norm_pdf("z")}, 2) * nb / ((1.0e0 - p) * p) AS w FROM z WHERE use),
m AS (SELECT edge_id, avg(p) AS mean, CAST(count(*) AS INTEGER) AS n_scales, CAST(count(*) FILTER (use) AS INTEGER) AS n_use FROM z GROUP BY edge_id),
s AS (SELECT edge_id, sum(w * r) AS a, sum(w) AS b, sum(w / r) AS d, sum(w * z * sqrt(r)) AS x, sum(w * z / sqrt(r)) AS y FROM w GROUP BY edge_id),
f AS (SELECT *, a * d - b * b AS det, (d * x - b * y) / (a * d - b * b) AS v, (a * y - b * x) / (a * d - b * b) AS c FROM s),
g AS (SELECT *, v - c AS lo, v + c AS hi, c - v AS au_at, -v - c AS bp_at, -c AS neg_c FROM f),
q AS (SELECT edge_id, sum(w * pow(z - v * sqrt(r) - c / sqrt(r), 2)) AS rss FROM w JOIN f USING (edge_id) GROUP BY edge_id),
o AS (SELECT *, n_use - 2 AS dfree, {norm_cdf("lo")} AS up, {norm_cdf("neg_c")} AS d0, {norm_pdf("lo")} AS den FROM m LEFT JOIN g USING (edge_id) LEFT JOIN q USING (edge_id)),
t AS (SELECT *, n_use >= 3 AS fitted, CASE WHEN mean < 0.5e0 THEN 0.0e0 ELSE 1.0e0 END AS flat, least(greatest(1.0e0 - up / d0, 0.0e0), 1.0e0) AS si_, den / d0 AS h1, up * {norm_pdf("c")} / (d0 * d0) - den / d0 AS h2 FROM o)
SELECT edge_id, n_use, n_scales, fitted,
  {r6("CASE WHEN fitted THEN si_ ELSE flat END")} AS si, {r6(f"CASE WHEN fitted THEN {norm_cdf('au_at')} ELSE flat END")} AS au, {r6(f"CASE WHEN fitted THEN {norm_cdf('bp_at')} ELSE flat END")} AS bp,
  {r6("CASE WHEN fitted AND si_ > 0 AND si_ < 1 THEN sqrt((d * h1 * h1 - 2 * b * h1 * h2 + a * h2 * h2) / det) ELSE 0.0e0 END")} AS se_si,
  {r6("CASE WHEN fitted THEN den * sqrt((d + 2 * b + a) / det) ELSE 0.0e0 END")} AS se_au, {r6(f"CASE WHEN fitted THEN {norm_pdf('hi')} * sqrt((d - 2 * b + a) / det) ELSE 0.0e0 END")} AS se_bp,
  {r6("CASE WHEN fitted THEN v ELSE 0.0e0 END")} AS v, {r6("CASE WHEN fitted THEN c ELSE 0.0e0 END")} AS c, CASE WHEN fitted THEN dfree ELSE 0 END AS df,
  {r6("CASE WHEN fitted THEN rss ELSE 0.0e0 END")} AS rss, {r6(f"CASE WHEN fitted THEN {chi2_sf_duckdb('rss', 'dfree')} ELSE 0.0e0 END")} AS pchi
FROM t
"""


@query(_FIT_SQL)
def multiscale_fit(spark, sf_dir):
    """The branch cases, and counts that rise and fall from part to part."""
    cases = spark.createDataFrame(_ROWS, "edge_id string, r double, nboot int, count int")
    k = F.col("k")
    count = F.least(F.lit(1000), F.greatest(F.lit(0), F.col("p_partkey") * 37 % 900 + k * (F.col("p_size") % 21 - 5))).cast("int")
    parts = table(spark, sf_dir, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return rounded(msfit.fit(cases.unionByName(parts.select(F.concat(F.lit("part"), "p_partkey").alias("edge_id"), ((k + 5) / 10).alias("r"), F.lit(1000).alias("nboot"), count.alias("count")))))


def _mix_sql(x: str) -> str:
    s = lambda v, k: f"xor({v}, ({v}) >> {k})"
    m = 1 << 31
    a = s(f"(({x}) % {m})", 15)
    b = s(f"(({a}) * 739982445 % {m})", 12)
    return s(f"(({b}) * 695872825 % {m})", 15)


@query(f"WITH n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT s AS scale_idx, rep, z.size AS size, {_mix_sql('k0 + rep * 104729 + 13')} AS k FROM (SELECT *, {_mix_sql('42 * 1000003 + s * 7919 + 1')} AS k0 FROM (VALUES (0::BIGINT, 30::BIGINT), (1::BIGINT, 60::BIGINT)) z(s, size)) z, range(5) t(rep)), "
       f"d AS (SELECT scale_idx, rep, {_mix_sql('m0 + k')} % n AS unit FROM (SELECT *, {_mix_sql('k + draw * 15485863 % 2147483648')} AS m0 FROM (SELECT *, unnest(range(size)) AS draw FROM k)), n) SELECT scale_idx, rep, unit, count(*) AS times FROM d GROUP BY ALL")  # fmt: skip
def bootstrap_multiplicities(spark, sf_dir):
    return multiplicity_frame(spark, table(spark, sf_dir, "embeddings").count(), [30, 60], 5, 42)


_COUNT_CTE = "c AS (SELECT 'P' || (p_size % 3) AS project, p_brand AS edge_id, (k + 5) / 10.0e0 AS r, 100 + 37 * (p_size % 3) AS n, count(*) * 1000 AS nboot, CAST(sum((p_partkey * 7 + k * 13) % 1001) AS BIGINT) AS count FROM part, range(10) t(k) GROUP BY ALL)"


def _project_counts(spark, sf_dir):
    """Counts of brands by three projects of parts, as if by bootstrap."""
    k, own = F.col("k"), F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    by = rows.groupBy(F.concat(F.lit("P"), own).alias("project"), F.col("p_brand").alias("edge_id"), ((k + 5) / 10).alias("r"), (100 + 37 * own).alias("n"))
    return by.agg((F.count("*") * 1000).alias("nboot"), F.sum((F.col("p_partkey") * 7 + k * 13) % 1001).alias("count"))


@query(f"WITH {_COUNT_CTE}, t AS (SELECT sum(n) AS total FROM (SELECT DISTINCT project, n FROM c)), p AS (SELECT edge_id, string_agg(DISTINCT project, ';' ORDER BY project) AS projects FROM c GROUP BY edge_id) "
       "SELECT edge_id, CAST(round_even(r * n, 0) AS BIGINT) AS size, round(round_even(r * n, 0) / total, 9) AS r, CAST(sum(nboot) AS BIGINT) AS nboot, CAST(sum(count) AS BIGINT) AS count, any_value(projects) AS projects FROM c JOIN p USING (edge_id), t GROUP BY edge_id, size, round_even(r * n, 0), total")  # fmt: skip
def pooled_counts(spark, sf_dir):
    return federate.pool_counts(_project_counts(spark, sf_dir)).withColumn("r", F.round("r", 9))


# ---------------------------------------------------------------- clusters as sets

# Sets of nations: those of some customers dealt by their keys, of each region, and of all customers.
_SET_CTE = """g AS (SELECT 's' || m || '_' || (c_custkey % m) AS edge_id, CAST((c_custkey % m) * 7919 % 1000 AS INTEGER) AS k, 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS x FROM customer, (VALUES (97), (211)) v(m)
UNION ALL SELECT 'r' || n_regionkey, 990 - CAST(n_regionkey AS INTEGER), 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation
UNION ALL SELECT 'whole', 1000, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation),
e AS MATERIALIZED (SELECT *, CAST(len(members) AS INTEGER) AS n_members, CAST(row_number() OVER (ORDER BY len(members), edge_id) AS INTEGER) AS merge_order FROM (SELECT edge_id, max(k) / 1000.0e0 AS au, list_sort(list(DISTINCT x)) AS members FROM g GROUP BY edge_id))"""


def _sets(spark, sf_dir):
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0")).alias("x")
    nation, m = table(spark, sf_dir, "nation"), F.col("m")
    own = table(spark, sf_dir, "customer").withColumn("m", F.explode(F.array(F.lit(97), F.lit(211)))).withColumn("j", F.col("c_custkey") % m)
    rows = own.select(F.concat(F.lit("s"), m, F.lit("_"), "j").alias("edge_id"), (F.col("j") * 7919 % 1000).cast("int").alias("k"), name("c_nationkey"))
    rows = rows.unionByName(nation.select(F.concat(F.lit("r"), "n_regionkey").alias("edge_id"), (990 - F.col("n_regionkey")).cast("int").alias("k"), name("n_nationkey")))
    rows = rows.unionByName(nation.select(F.lit("whole").alias("edge_id"), F.lit(1000).alias("k"), name("n_nationkey")))
    sets = rows.groupBy("edge_id").agg((F.max("k") / 1000).alias("au"), F.array_sort(F.collect_set("x")).alias("members")).withColumn("n_members", F.size("members"))
    return sets.withColumn("merge_order", F.row_number().over(Window.orderBy("n_members", "edge_id")))


_NATIONS = [f"n{k:02d}" for k in range(25)]


@query(f"WITH {_SET_CTE} SELECT edge_id, substr(sha1(array_to_string(list_sort(members), ',')), 1, 12) AS id FROM e")
def edge_identity(spark, sf_dir):
    return _sets(spark, sf_dir).select("edge_id", S.edge_id(F.col("members")).alias("id"))


@query(f"WITH {_SET_CTE} SELECT edge_id, array_to_string(list_transform({_NATIONS}, lambda x: CASE WHEN list_contains(members, x) THEN '1' ELSE '0' END), '') AS pattern FROM e")
def edge_patterns(spark, sf_dir):
    return _sets(spark, sf_dir).select("edge_id", S.pattern(F.col("members"), _NATIONS).alias("pattern"))


@query(f"WITH {_SET_CTE} SELECT a.edge_id AS a, b.edge_id AS b, NOT list_has_any(a.members, b.members) OR list_has_all(a.members, b.members) OR list_has_all(b.members, a.members) AS compatible FROM e a, e b")
def compatible_pairs(spark, sf_dir):
    s = _sets(spark, sf_dir)
    a, b = s.select(F.col("edge_id").alias("a"), F.col("members").alias("m")), s.select(F.col("edge_id").alias("b"), F.col("members").alias("k"))
    return a.crossJoin(b).select("a", "b", S.compatible(F.col("m"), F.col("k")).alias("compatible"))


@query(f"WITH {_SET_CTE} SELECT a.edge_id, round(max(b.au), 6) AS strength FROM e a JOIN e b ON list_has_all(a.members, b.members) GROUP BY a.edge_id")
def subtree_strength(spark, sf_dir):
    return rounded(tree.subtree_support(_sets(spark, sf_dir)))


@query(f"WITH {_SET_CTE} SELECT a.edge_id, round(avg(b.au), 6) AS strength FROM e a JOIN e b ON list_has_all(a.members, b.members) GROUP BY a.edge_id")
def subtree_mean_strength(spark, sf_dir):
    return rounded(tree.subtree_support(_sets(spark, sf_dir), how="mean"))


@query(f"WITH {_SET_CTE}, p AS (SELECT * FROM e WHERE n_members < (SELECT max(n_members) FROM e) AND au >= 0.95e0) SELECT edge_id, au FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.merge_order > p.merge_order AND list_has_any(q.members, p.members))")
def supported_clusters(spark, sf_dir):
    return support.pick(_sets(spark, sf_dir)).select("edge_id", "au")


@query(f"""WITH RECURSIVE {_SET_CTE},
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY au DESC, edge_id) AS rn FROM e WHERE n_members < (SELECT count(DISTINCT x) FROM g) AND au >= 0.9e0),
f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[][]) AS taken, CAST([] AS VARCHAR[]) AS ids
  UNION ALL SELECT o.rn, CASE WHEN fits THEN list_append(taken, members) ELSE taken END, CASE WHEN fits THEN list_append(ids, edge_id) ELSE ids END
  FROM (SELECT o.*, f.taken, f.ids, len(list_filter(f.taken, lambda y: list_has_any(o.members, y) AND NOT list_has_all(o.members, y) AND NOT list_has_all(y, o.members))) = 0 AS fits FROM f JOIN o ON o.rn = f.rn + 1) o)
SELECT edge_id, array_to_string(members, ';') AS members, au FROM e WHERE list_contains((SELECT ids FROM f ORDER BY rn DESC LIMIT 1), edge_id)""")
def consensus_clusters(spark, sf_dir):
    return federate.consensus(_sets(spark, sf_dir), 0.9).withColumn("members", F.array_join(F.array_sort("members"), ";"))


_SPAN = "e AS (SELECT 'g' || (c_custkey % 61) AS edge_id, ((c_custkey % 61) * 389 % 1000) / 1000.0e0 AS au, list_sort(list(DISTINCT 'P' || (c_custkey % 2) || ':c' || (c_custkey // 61 % 40))) AS members FROM customer GROUP BY c_custkey % 61)"


@query(f"WITH {_SPAN}, s AS (SELECT *, len(members) AS size FROM e WHERE len(list_distinct(list_transform(members, lambda x: split_part(x, ':', 1)))) >= 2), x AS (SELECT unnest(members) AS profile_id, * FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY size, edge_id) AS rn FROM x) "
       "SELECT profile_id, edge_id, au, CAST(size AS INTEGER) AS size, array_to_string(list_sort(list_filter(members, lambda y: y <> profile_id)), ';') AS partners, au >= 0.95e0 AS replicated FROM k WHERE rn = 1")  # fmt: skip
def replicated_profiles(spark, sf_dir):
    """Groups of customers as clusters of profiles of two projects."""
    key = F.col("c_custkey")
    profile = F.concat(F.lit("P"), key % 2, F.lit(":c"), F.floor(key / 61) % 40)
    e = table(spark, sf_dir, "customer").groupBy((key % 61).alias("j")).agg(F.array_sort(F.collect_set(profile)).alias("members"))
    return profiles.replication(e.select(F.concat(F.lit("g"), "j").alias("edge_id"), "members", (F.col("j") * 389 % 1000 / 1000).alias("au"), F.size("members").alias("n_members")))


_REAGENT_SQL = "CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_type || (CASE p_partkey % 3 WHEN 0 THEN '_seq.' || p_partkey WHEN 1 THEN ' (' || p_partkey || '-' || p_size || ')' ELSE '_' || p_partkey || '-' || p_size END) END"


@query(f"SELECT regexp_extract(label, '^(.+?)[_ ]\\(?(seq[.0-9]+|[0-9]+-[0-9]+)\\)?$', 1) AS name, array_to_string(list_sort(list(DISTINCT label)), ';') AS members, CAST(count(DISTINCT label) AS INTEGER) AS size FROM (SELECT {_REAGENT_SQL} AS label FROM part) v WHERE name <> '' GROUP BY name HAVING count(DISTINCT label) >= 2")
def reagent_label_groups(spark, sf_dir):
    """Parts' types followed by a number as labels."""
    return profiles.reagent_groups(table(spark, sf_dir, "part").select(F.expr(_REAGENT_SQL).alias("label"))).withColumn("members", F.array_join("members", ";"))


# ---------------------------------------------------------------- vocabularies and scaling


@query(" INTERSECT ".join(f"SELECT p_type || ' ' || p_brand AS feature FROM part WHERE p_size % 3 = {k}" for k in range(3)))
def shared_features(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("feature", F.concat_ws(" ", "p_type", "p_brand"))
    return federate.shared_vocabulary([part.where(F.col("p_size") % 3 == k).select("feature") for k in range(3)])


@query(f"WITH {HOLED} SELECT object AS feature, count(value) AS n_present, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS sd, 'P' AS project FROM emb GROUP BY object")
def project_vocabulary(spark, sf_dir):
    return rounded(M.vocabulary(long_of(spark, sf_dir, 101), "P"))


@query(f"WITH {EMB} SELECT CAST(vec_id AS VARCHAR) AS unit_id, object, {r6('value')} AS value FROM emb WHERE object IN (SELECT object FROM emb GROUP BY object ORDER BY var_samp(value) DESC, object LIMIT 5)")
def most_variable(spark, sf_dir):
    return rounded(M.top_variable(long_of(spark, sf_dir), 5))


@query(f"WITH {HOLED} SELECT CAST(vec_id AS VARCHAR) AS unit_id, object, {r6('coalesce((value - avg(value) OVER w) / stddev_samp(value) OVER w, 0.0e0)')} AS value FROM emb WINDOW w AS (PARTITION BY object)")
def zscored(spark, sf_dir):
    return rounded(M.zscore(long_of(spark, sf_dir, 101)))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS unit_id, 'p_retailprice' AS object, {r6('log2(p_retailprice)')} AS value FROM part")
def log2_prices(spark, sf_dir):
    return rounded(M.log2(M.to_long(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice"])))


@query("SELECT CAST(c_custkey AS VARCHAR) AS unit_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy (' || c_mktsegment || ')' ELSE c_mktsegment END AS object, round(c_acctbal, 4) + 0.0e0 AS value FROM customer")
def relabelled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), F.col("c_mktsegment").alias("object"), F.col("c_acctbal").alias("value"))
    names = spark.createDataFrame([("BUILDING", "heavy"), ("MACHINERY", "heavy"), ("unknown", "x")], "key string, label string")
    return rounded(M.relabel(c, names), 4)


# ---------------------------------------------------------------- batches


@query(f"WITH {EMB} SELECT CAST(vec_id AS VARCHAR) AS unit_id, object, {r6('value - avg(value) OVER (PARTITION BY object, label % 3) + avg(value) OVER (PARTITION BY object)')} AS value FROM emb")
def batch_linear(spark, sf_dir):
    w = wide(spark, sf_dir)
    return rounded(adjust.linear(M.to_long(w, "vec_id", DIMS), w.select(F.col("vec_id").cast("string").alias("unit_id"), (F.col("label") % 3).alias("batch"))))


def _orders_long(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    return M.to_long(o, "o_orderkey", ["o_totalprice"]), o.select("unit_id", F.col("o_orderpriority").alias("batch")), o.select("unit_id", "o_orderstatus")


_OPEN = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, o_totalprice AS v, o_orderpriority AS l, CASE WHEN o_orderstatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS b FROM orders)"


@query(f"WITH {_OPEN}, w AS (SELECT *, b - avg(b) OVER (PARTITION BY l) AS x FROM o), t AS (SELECT sum(x * v) / sum(x * x) AS beta, avg(b) AS share FROM w) SELECT unit_id, 'o_totalprice' AS object, round(v - beta * (b - share), 4) + 0.0e0 AS value FROM o, t")
def batch_protected(spark, sf_dir):
    """Open and other orders as batches, beside their priority: the shift is that of the batch within priorities."""
    long, _, _ = _orders_long(spark, sf_dir)
    o = table(spark, sf_dir, "orders").withColumn("unit_id", F.col("o_orderkey").cast("string"))
    batch = o.select("unit_id", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("batch"))
    return rounded(adjust.linear(long, batch, o.select("unit_id", "o_orderpriority")), 4)


@query(f"""WITH {EMB}, own AS (SELECT *, label % 3 AS batch FROM emb),
m AS (SELECT object, batch, avg(value) AS mb, sum(value * value) AS q, CAST(count(*) AS DOUBLE) AS nb FROM own GROUP BY ALL),
a AS (SELECT object, sum(mb * nb) / sum(nb) AS alpha, sqrt(sum(q - nb * mb * mb) / sum(nb)) AS sigma FROM m GROUP BY object),
g AS (SELECT object, batch, nb, (mb - alpha) / sigma AS g FROM m JOIN a USING (object)),
t AS (SELECT batch, avg(g) AS gbar, var_samp(g) AS t2 FROM g GROUP BY batch),
s AS (SELECT object, batch, (t2 * nb * g + gbar) / (t2 * nb + 1) AS gs FROM g JOIN t USING (batch))
SELECT CAST(vec_id AS VARCHAR) AS unit_id, object, {r6('value - sigma * gs')} AS value FROM own JOIN a USING (object) JOIN s USING (object, batch)""")
def batch_combat_means(spark, sf_dir):
    """Empirical Bayes of means alone, which has a closed form."""
    w = wide(spark, sf_dir)
    return rounded(adjust.combat(M.to_long(w, "vec_id", DIMS), w.select(F.col("vec_id").cast("string").alias("unit_id"), (F.col("label") % 3).alias("batch")), mean_only=True))


@query()
def batch_combat(spark, sf_dir):
    w = wide(spark, sf_dir)
    return rounded(adjust.combat(M.to_long(w, "vec_id", DIMS), w.select(F.col("vec_id").cast("string").alias("unit_id"), (F.col("label") % 3).alias("batch"))))


def _contingency_sql(a: str, b: str, source: str) -> str:
    return f"""
WITH c AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
t AS (SELECT (SELECT sum(o) FROM c) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM ra) AS r, (SELECT CAST(count(*) AS DOUBLE) FROM cb) AS k, (SELECT sum(o * (o - 1) / 2) FROM c) AS cc, (SELECT sum(ra * (ra - 1) / 2) FROM ra) AS ca, (SELECT sum(cb * (cb - 1) / 2) FROM cb) AS cd),
g AS (SELECT *, ra * cb / n AS e, abs(coalesce(o, 0) - ra * cb / n) AS off FROM ra CROSS JOIN cb LEFT JOIN c USING (a, b) CROSS JOIN t),
x AS (SELECT sum(pow(CASE WHEN r = 2 AND k = 2 THEN off - least(0.5e0, off) ELSE off END, 2) / e) AS chi2 FROM g),
u AS (SELECT *, CAST((r - 1) * (k - 1) AS INTEGER) AS dfree, greatest(0.0e0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) AS phi, least(r - pow(r - 1, 2) / (n - 1), k - pow(k - 1, 2) / (n - 1)) - 1 AS low, ca * cd / (n * (n - 1) / 2) AS ex FROM t, x)
SELECT CAST(n AS BIGINT) AS n, CAST(r AS INTEGER) AS r, CAST(k AS INTEGER) AS k, {r6("chi2")} AS chi2, dfree AS df, {r6(chi2_sf_duckdb("chi2", "dfree"))} AS p_value, {r6("CASE WHEN low > 0 THEN sqrt(phi / low) ELSE 0.0e0 END")} AS cramers_v, {r6("(cc - ex) / ((ca + cd) / 2 - ex)")} AS adjusted_rand FROM u"""


@query(_contingency_sql("o_orderstatus", "o_orderpriority", "orders"))
def contingency_orders(spark, sf_dir):
    return rounded(association.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query(_contingency_sql("quality", "toxic", "labels"))
def contingency_labels(spark, sf_dir):
    return rounded(association.contingency(table(spark, sf_dir, "labels"), "quality", "toxic"))


def _kruskal_sql(g: str, x: str, source: str, digits: int = 4) -> str:
    return f"""
WITH v AS (SELECT {g} AS g, {x} AS x FROM {source} WHERE {g} IS NOT NULL AND {x} IS NOT NULL),
m AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS mid, CAST(count(*) OVER () AS DOUBLE) AS n FROM v),
s AS (SELECT g, sum(mid) AS s, CAST(count(*) AS DOUBLE) AS c, any_value(n) AS n FROM m GROUP BY g),
t AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM v GROUP BY x)),
h AS (SELECT any_value(n) AS n, CAST(count(*) AS INTEGER) AS k, (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (pow(any_value(n), 3) - any_value(n))) AS h FROM s, t),
o AS (SELECT *, k - 1 AS dfree FROM h)
SELECT CAST(n AS BIGINT) AS n, k, round(h, {digits}) + 0.0e0 AS h, dfree AS df, round({chi2_sf_duckdb("h", "dfree")}, {digits}) + 0.0e0 AS p_value, round(greatest(0.0e0, (h - k + 1) / (n - k)), {digits}) + 0.0e0 AS eta2 FROM o"""


@query(_kruskal_sql("l_returnflag", "l_quantity", "lineitem"))
def kruskal_lineitem(spark, sf_dir):
    return rounded(association.kruskal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"), 4)


@query(_kruskal_sql("event_type", "value", "events"))
def kruskal_events(spark, sf_dir):
    return rounded(association.kruskal(table(spark, sf_dir, "events"), "event_type", "value"), 4)


@query(f"""SELECT 'o_orderstatus' AS variable, p_value, cramers_v, verdict, CASE verdict WHEN 'partial' THEN 'adjust with protect=' WHEN 'balanced' THEN 'adjust freely' ELSE 'cannot adjust -- design limitation' END AS action
FROM (SELECT *, CASE WHEN (SELECT max(c) FROM (SELECT count(DISTINCT o_orderstatus) AS c FROM orders GROUP BY o_orderpriority)) = 1 THEN 'complete' WHEN p_value < 0.05 AND cramers_v >= 0.10 THEN 'partial' ELSE 'balanced' END AS verdict FROM ({_contingency_sql("o_orderpriority", "o_orderstatus", "orders")}))""")
def confounded_orders(spark, sf_dir):
    _, batch, notes = _orders_long(spark, sf_dir)
    return rounded(association.confounding(batch, notes))


_MARKED = "(SELECT quality, lang, source, CAST(n_chars AS DOUBLE) AS n_chars FROM labels JOIN documents USING (doc_id))"


def _strength(x: str) -> str:
    return f"CASE WHEN {x} < 0.10 THEN 'negligible' WHEN {x} < 0.30 THEN 'weak' WHEN {x} < 0.50 THEN 'moderate' ELSE 'strong' END"


def _associated(variable: str) -> str:
    return f"SELECT '{variable}' AS variable, 'chi-square' AS test, n, k AS levels, chi2 AS statistic, p_value, cramers_v AS effect, 'cramers_v' AS effect_name, adjusted_rand, {_strength('cramers_v')} AS strength, CAST(NULL AS VARCHAR) AS reason FROM ({_contingency_sql('quality', variable, _MARKED)})"


@query(f"{_associated('lang')} UNION ALL {_associated('source')} UNION ALL SELECT 'n_chars', 'kruskal-wallis', n, (SELECT CAST(count(DISTINCT n_chars) AS INTEGER) FROM {_MARKED}), h, p_value, eta2, 'eta2', CAST(NULL AS DOUBLE), {_strength('sqrt(eta2)')}, CAST(NULL AS VARCHAR) FROM ({_kruskal_sql('quality', 'n_chars', _MARKED, 6)}) "
       f"UNION ALL SELECT 'constant', 'skipped', (SELECT count(*) FROM {_MARKED}), 1, NULL, NULL, NULL, NULL, NULL, NULL, 'constant or too few values'")  # fmt: skip
def association_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "lang", "source", "n_chars", F.lit("same").alias("constant"))
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("quality").alias("cluster"))
    return rounded(association.association(q, d))


# ---------------------------------------------------------------- profiles and blocks


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("unit_id", F.col("c_custkey").cast("string"))
    return M.to_long(c, "c_custkey", ["c_acctbal"]), c.select("unit_id", (F.col("c_nationkey") % 5).alias("cluster")), c.select("unit_id", "c_mktsegment")


@query("SELECT 'P:c' || CAST(c_nationkey % 5 AS VARCHAR) AS profile_id, 'P' AS project, CAST(c_nationkey % 5 AS INTEGER) AS cluster, 'c_acctbal' AS feature, round(avg(c_acctbal), 4) + 0.0e0 AS mean FROM customer GROUP BY c_nationkey % 5")
def released_profiles(spark, sf_dir):
    long, groups, _ = _customers(spark, sf_dir)
    return rounded(profiles.release(long, groups, "P")["profiles"], 4).withColumn("cluster", F.col("cluster").cast("int"))


@query("SELECT CAST(c_nationkey % 5 AS INTEGER) AS cluster, 'c_mktsegment' AS variable, c_mktsegment AS level, count(*) AS n, 'P' AS project FROM customer GROUP BY c_nationkey % 5, c_mktsegment HAVING count(*) >= 10")
def released_demographics(spark, sf_dir):
    long, groups, notes = _customers(spark, sf_dir)
    return profiles.release(long, groups, "P", 10, notes)["demographics"].withColumn("cluster", F.col("cluster").cast("int"))


_BLOCK = "'block' || CAST(CAST(substr(object, 2) AS INTEGER) // 4 AS VARCHAR)"


def _blocks(spark):
    return spark.createDataFrame([(d, f"block{k // 4}") for k, d in enumerate(DIMS)], "object string, block string")


@query(f"WITH {HOLED} SELECT CAST(vec_id AS VARCHAR) AS unit_id, {_BLOCK} AS module, {r6('avg(value)')} AS score FROM emb WHERE value IS NOT NULL GROUP BY ALL")
def module_means(spark, sf_dir):
    return rounded(workflows.module_scores(long_of(spark, sf_dir, 101).where("value is not null"), _blocks(spark).withColumnRenamed("block", "module")))


@query(f"WITH {EMB}, z AS (SELECT vec_id, label, object, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM emb WINDOW w AS (PARTITION BY object)) SELECT CAST(label % 4 AS INTEGER) AS unit_group, {_BLOCK} AS block, count(DISTINCT vec_id) AS n_units, count(DISTINCT object) AS n_objects, {r6('avg(z)')} AS mean_z FROM z GROUP BY ALL")
def block_squares(spark, sf_dir):
    w = wide(spark, sf_dir)
    groups = w.select(F.col("vec_id").cast("string").alias("unit_id"), (F.col("label") % 4).cast("int").alias("unit_group"))
    return rounded(blocks.squares(M.to_long(w, "vec_id", DIMS), _blocks(spark), groups))


@query(f"WITH {EMB}, p AS (SELECT label % 2 AS project, label, object, avg(value) AS m FROM emb GROUP BY ALL), c AS (SELECT project, label, object, m - avg(m) OVER (PARTITION BY project, object) AS m FROM p) "
       f"SELECT 'P' || a.project || ':c' || a.label AS profile_a, 'P' || b.project || ':c' || b.label AS profile_b, {r6('corr(a.m, b.m)')} AS r FROM c a JOIN c b USING (object) WHERE a.project < b.project GROUP BY ALL")  # fmt: skip
def profile_similarity(spark, sf_dir):
    w = wide(spark, sf_dir)
    long = M.to_long(w, "vec_id", DIMS).join(w.select(F.col("vec_id").cast("string").alias("unit_id"), "label"), "unit_id")
    means = long.groupBy("label", F.col("object").alias("feature")).agg(F.avg("value").alias("mean"))
    project = F.concat(F.lit("P"), (F.col("label") % 2).cast("string"))
    return rounded(profiles.similarity(means.select(F.concat(project, F.lit(":c"), F.col("label").cast("string")).alias("profile_id"), project.alias("project"), "feature", "mean")))


# ---------------------------------------------------------------- trees


@query()
def support_tree(spark, sf_dir):
    """The flagship: tree, multiscale bootstrap and p-values of 64 objects."""
    found = support.support_tree(vectors_of(spark, sf_dir), DIMS, nboot=NBOOT)
    return rounded(found.edges)


@query()
def support_tree_many_units(spark, sf_dir):
    """The same where units are many: weighted sums per task, added up before the trees."""
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("unit_id"), F.array(*[F.col(c).cast("double") for c in NUMBERS]).alias("values"))
    from ..operators.bootstrap import count_candidates

    made = support.tree_of(line, NUMBERS)
    counts = count_candidates(line, NUMBERS, tree.member_sets(made, NUMBERS), nboot=100, sent_bytes=0)
    ids = tree.edges_frame(spark, made, NUMBERS).select("edge_id", (F.col("merge_order") - 1).alias("candidate"))
    return rounded(msfit.fit(counts.join(ids, "candidate")))


@query()
def dendrogram_layout(spark, sf_dir):
    found = support.support_tree(vectors_of(spark, sf_dir), DIMS, nboot=200)
    return rounded(tree.drawn(found.linkage, DIMS, found.edges, sort_by="au"))


@query()
def tree_cut(spark, sf_dir):
    made = support.tree_of(vectors_of(spark, sf_dir), DIMS, "euclidean", "ward.D2")
    return blocks.cut_blocks(spark, made, DIMS, 4)


def _federation(spark, sf_dir, nboot=NBOOT):
    w = wide(spark, sf_dir)
    parts = [M.to_vectors(w.where(F.col("label") % 3 == k), "vec_id", DIMS) for k in range(3)]
    _, made, catalogue = federate.federated_tree([stats.gram_stats(p, DIMS) for p in parts], DIMS)
    counts = federate.union([support.count_edges(p, DIMS, catalogue, nboot=nboot, seed=42 + k).withColumn("project", F.lit(f"P{k}")) for k, p in enumerate(parts)])
    return parts, federate.federated_support(federate.pool_counts(counts), catalogue)


@query()
def federated_support(spark, sf_dir):
    return rounded(_federation(spark, sf_dir)[1])


@query()
def applied_back(spark, sf_dir):
    """What pooled support is worth in each of the three projects."""
    parts, edges = _federation(spark, sf_dir, 200)
    edges = edges.checkpoint()
    return rounded(federate.union([workflows.apply_back(p, DIMS, edges, nboot=200)["support"].withColumn("project", F.lit(f"P{k}")) for k, p in enumerate(parts)]))


@query()
def coclustered_groups(spark, sf_dir):
    edges = support.support_tree(vectors_of(spark, sf_dir), DIMS, nboot=200).edges
    groups = spark.createDataFrame([("pair", DIMS[:2]), ("four", DIMS[4:8])], "name string, members array<string>")
    return rounded(profiles.cocluster(edges, groups))


def _nations(spark, sf_dir):
    """Nations as units, order priorities as objects: mean totals."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("string").alias("unit_id"), F.col("o_orderpriority").alias("object")).agg(F.avg("o_totalprice").alias("value"))


@query()
def diagnosed_units(spark, sf_dir):
    """Whether clusters of nations follow the region."""
    c = _nations(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_regionkey").cast("string").alias("region"))
    return rounded(workflows.diagnose(c, n, ["region"], k=4)[1])


@query()
def matched_profiles(spark, sf_dir):
    """Profiles of ten labels, as if from two projects, clustered together over 64 features."""
    names = [f"e{k:02d}" for k in range(64)]
    w = wide(spark, sf_dir, 0, names)
    means = w.groupBy("label").agg(*[F.avg(c).alias(c) for c in names]).unpivot("label", names, "feature", "mean")
    project = F.concat(F.lit("P"), (F.col("label") % 2).cast("string"))
    released = means.select(F.concat(project, F.lit(":c"), F.col("label").cast("string")).alias("profile_id"), project.alias("project"), "feature", "mean")
    return rounded(verbs.match_profiles(released)["replication"])


@query()
def two_way_layout(spark, sf_dir):
    """Nations by order priorities in tree order."""
    c = _nations(spark, sf_dir)
    return rounded(verbs.two_way_layout(c))


@query("WITH o AS (SELECT c_nationkey AS u, o_orderpriority AS object, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), z AS (SELECT u, object, coalesce((v - avg(v) OVER w) / stddev_samp(v) OVER w, 0.0e0) AS z FROM o WINDOW w AS (PARTITION BY object)), t AS (SELECT quantile_cont(abs(z), 0.99) AS top FROM z) "
       f"SELECT CAST(u AS INTEGER) AS row, CAST(substr(object, 1, 1) AS INTEGER) AS col, CAST(u AS VARCHAR) AS unit_id, object, {r6('least(greatest(z, -top), top)')} AS z FROM z, t")  # fmt: skip
def two_way_values(spark, sf_dir):
    """Nations by order priorities in a given order: values clipped at their 99th percentile."""
    c = _nations(spark, sf_dir)
    cols = c.select("object").distinct().withColumn("col", F.substring("object", 1, 1).cast("int"))
    rows = c.select("unit_id").distinct().withColumn("row", F.col("unit_id").cast("int"))
    return rounded(blocks.two_way(c, cols, rows))


@query(f"WITH {_SET_CTE}, k AS (SELECT edge_id, members, (t.k + 5) / 10.0e0 AS r, 1000 AS nboot, CAST((merge_order * 31 + t.k * 17) % 1001 AS BIGINT) AS count FROM e, range(10) t(k)) SELECT 'P' AS project, edge_id, array_to_string(members, ';') AS members, r, CAST(25 AS BIGINT) AS n, nboot, count FROM k")
def project_payload(spark, sf_dir):
    """Counts of clusters into a payload and out of it."""
    sets, k = _sets(spark, sf_dir).withColumn("height", F.col("au")), F.col("k")
    rows = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    counts = rows.select("edge_id", (k + 5).cast("int").alias("size"), ((k + 5) / 10).alias("r"), F.lit(1000).alias("nboot"), ((F.col("merge_order") * 31 + k * 17) % 1001).cast("long").alias("count"))
    found = support.SupportTree(sets, counts, [], _NATIONS, 25, {"cluster": "columns", "distance": "correlation", "linkage": "average", "seed": 42})
    out = exchange.counts_from_payloads(exchange.project_payload(found, "P"))
    return out.withColumn("members", F.array_join(F.array_sort("members"), ";")).withColumn("n", F.col("n").cast("long"))
