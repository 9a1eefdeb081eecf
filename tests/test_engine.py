"""The cluster-support engine: formulas, invariants, refusals and round trips."""

import math
import tracemalloc
import warnings
from statistics import NormalDist
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from thicket.functions import members as S
from thicket.functions.scales import default_scales, effective_scales, seq_by
from thicket.functions.special import chi2_sf, norm_cdf, norm_ppf
from thicket.operators import adjust, association, blocks, bootstrap, federate, msfit, profiles, stats, tree
from thicket.plans import support, workflows
from thicket.sources import exchange
from thicket.sources import matrix as M
from thicket.streaming import pooling

LABELS = [f"b{i}_{j}" for i in range(3) for j in range(4)]


def _blocks(n=60, seed=0):
    rng = np.random.default_rng(seed)
    drivers = rng.normal(size=(n, 3))
    return np.repeat(drivers, 4, 1) + 0.25 * rng.normal(size=(n, 12))


def _vectors(spark, x, parts=3):
    rows = [(f"u{i:04d}", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "unit_id string, values array<double>").repartition(parts)


@pytest.fixture(scope="module")
def vectors(spark):
    return _vectors(spark, _blocks()).persist()


@pytest.fixture(scope="module")
def found(vectors):
    return support.support_tree(vectors, LABELS, nboot=50)


def test_normal_functions(spark):
    p = [0.001, 0.0011, 0.02, 0.3, 0.5, 0.77, 0.999, 1e-12]
    rows = spark.createDataFrame([(x,) for x in p], "p double").withColumn("z", F.expr(norm_ppf("p"))).withColumn("q", F.expr(norm_cdf("z"))).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-13)
        assert r.q == pytest.approx(r.p, rel=1e-8)


def test_chi_square(spark):
    # even df: a Poisson tail; df 1: the normal tail
    rows = spark.createDataFrame([(x, d) for x in (0.5, 3.0, 20.0) for d in (1, 2, 6, 7)], "x double, df int").withColumn("p", F.expr(chi2_sf("x", "df"))).collect()
    for r in rows:
        h = r.x / 2
        if r.df == 1:
            assert r.p == pytest.approx(2 * NormalDist().cdf(-math.sqrt(r.x)), rel=1e-8)
        elif r.df % 2 == 0:
            assert r.p == pytest.approx(sum(math.exp(-h) * h**k / math.factorial(k) for k in range(r.df // 2)), rel=1e-12)
        else:
            t = np.linspace(r.x, r.x + 200, 2_000_001)
            f = t ** (r.df / 2 - 1) * np.exp(-t / 2) / (2 ** (r.df / 2) * math.gamma(r.df / 2))
            assert r.p == pytest.approx(np.trapezoid(f, t), rel=1e-6)


def test_scales():
    assert len(default_scales()) == 10 and default_scales()[-1] == 1.4
    assert seq_by(1, 0, -0.5) == [1, 0.5, 0]
    assert [s for s, _ in effective_scales(8)] == [4, 5, 6, 7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        effective_scales(1, [0.5])


def test_statistics_and_distances_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    labels = list("abcde")
    v = _vectors(spark, x)
    long = v.select("unit_id", F.posexplode("values").alias("k", "value")).select("unit_id", F.array(*map(F.lit, labels))[F.col("k")].alias("object"), "value")
    b = stats.pairwise_stats(long)
    for c in ("n", "s", "q", "g"):
        assert np.allclose(stats.matrix(stats.gram_stats(v, labels), labels, c), stats.matrix(b, labels, c), atol=1e-12)
    d = {m: stats.matrix(stats.distance(stats.listwise_stats(v, labels) if m == "uncentered" else b, m), labels) for m in stats.METHODS}
    whole = x[~np.isnan(x).any(1)]
    for i in range(5):
        for j in range(5):
            if i == j:
                continue
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            p, q = x[ok, i], x[ok, j]
            r = np.corrcoef(p, q)[0, 1]
            assert d["correlation"][i, j] == pytest.approx(1 - r, abs=1e-12)
            assert d["abscor"][i, j] == pytest.approx(1 - abs(r), abs=1e-12)
            assert d["euclidean"][i, j] == pytest.approx(math.sqrt(((p - q) ** 2).sum() * 40 / ok.sum()), abs=1e-12)
            w, u = whole[:, i], whole[:, j]
            assert d["uncentered"][i, j] == pytest.approx(1 - w @ u / math.sqrt(w @ w * (u @ u)), abs=1e-12)
    three = stats.matrix(stats.minkowski(long, 2.0), labels)
    assert np.allclose(three, d["euclidean"], atol=1e-12)
    for bad in ("manhattan", "cosine"):
        with pytest.raises(ValueError):
            stats.distance(b, bad)


def test_pooling_is_exact_and_guarded(spark):
    x = _blocks(90)
    parts = [_vectors(spark, x[a:b]) for a, b in ((0, 30), (30, 65), (65, 90))]
    whole = stats.gram_stats(_vectors(spark, x), LABELS)
    d, made, _ = federate.federated_tree([stats.gram_stats(p, LABELS) for p in parts], LABELS)
    assert np.allclose(stats.matrix(d, LABELS), stats.matrix(stats.distance(whole), LABELS), atol=1e-12)
    assert tree.member_sets(made, LABELS) == tree.member_sets(support.tree_of(_vectors(spark, x), LABELS), LABELS)
    with pytest.raises(ValueError, match="differs"):
        stats.pool_stats([stats.gram_stats(parts[0], LABELS), stats.gram_stats(parts[1].withColumn("values", F.slice("values", 1, 2)), LABELS[:2])])
    with pytest.raises(ValueError):
        stats.pool_stats([])
    with pytest.raises(ValueError):
        stats.disclosure_check(10, 3)
    with pytest.warns(UserWarning):
        stats.disclosure_check(30, 40)


def _naive(d, kind):
    """Agglomeration over the original distances, for the methods that have a direct meaning."""
    sets, out = [[k] for k in range(len(d))], []
    pick = {"average": np.mean, "complete": np.max, "single": np.min}[kind]
    while len(sets) > 1:
        h, i, j = min((pick(d[np.ix_(a, b)]), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        sets[i] = sorted(sets[i] + sets.pop(j))
        out.append((round(h, 9), sets[i]))
    return out


def _by_whole_scan(d, kind):
    """Agglomeration by the updating formulas, the nearest pair found by looking at all."""
    d, size, at = d.copy(), [1] * len(d), list(range(len(d)))
    np.fill_diagonal(d, np.inf)
    heights = []
    for _ in range(len(d) - 1):
        i, j = np.unravel_index(d.argmin(), d.shape)
        h, a, b = d[i, j], size[i], size[j]
        heights.append(h)
        for k in range(len(d)):
            if k in (i, j) or not np.isfinite(d[i, k]):
                continue
            x, y = d[i, k], d[j, k]
            if kind == "centroid":
                new = math.sqrt(max(0, (a * x * x + b * y * y) / (a + b) - a * b * h * h / (a + b) ** 2))
            elif kind == "median":
                new = math.sqrt(max(0, x * x / 2 + y * y / 2 - h * h / 4))
            else:
                new = (x + y) / 2
            d[i, k] = d[k, i] = new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += b
    return heights


@pytest.mark.parametrize("kind", ["centroid", "median", "mcquitty"])
def test_linkage_by_updating(kind):
    for seed in range(5):
        p = np.random.default_rng(seed).normal(size=(30, 3))
        d = np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), 12)
        assert np.allclose([m["height"] for m in tree.linkage(d, kind)], _by_whole_scan(d, kind), atol=1e-9)


def test_ties_go_to_the_first_pair():
    d = np.ones((6, 6)) - np.eye(6)
    assert [(m["left"], m["right"]) for m in tree.linkage(d, "single")] == [(0, 1), (6, 2), (7, 3), (8, 4), (9, 5)]


@pytest.mark.parametrize("kind", ["average", "complete", "single"])
def test_linkage(kind):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(12, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got = tree.linkage(d, kind)
    sets = tree.member_sets(got, [f"{k:02d}" for k in range(12)])
    assert sorted((round(m["height"], 9), [int(x) for x in s]) for m, s in zip(got, sets, strict=True)) == sorted(_naive(d, kind))


def test_ward_heights_are_variance_increases():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(10, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got, labels = tree.linkage(d, "ward.D2"), [str(k) for k in range(10)]
    below = {k: [k] for k in range(10)}
    for m in got:
        a, b = below[m["left"]], below[m["right"]]
        gap = p[a].mean(0) - p[b].mean(0)
        assert m["height"] ** 2 == pytest.approx(2 * len(a) * len(b) / (len(a) + len(b)) * gap @ gap)
        below[9 + m["merge_order"]] = a + b
    assert sorted(tree.leaf_order(got, 10)) == list(range(10))
    assert len(set(tree.cut(got, labels, 3).values())) == 3 and set(tree.cut(got, labels, 10).values()) == set(range(1, 11))
    assert tree.cophenetic(got, 10).max() == got[-1]["height"]
    for bad in ("ward.D", "upgma"):
        with pytest.raises(ValueError):
            tree.linkage(d, bad)
    with pytest.raises(ValueError):
        tree.linkage(np.array([[0, np.nan], [np.nan, 0]]))


def test_draws_match_between_engines(spark):
    rows = bootstrap.multiplicity_frame(spark, 50, [20, 70], 4, 7).collect()
    want = {(s, r, int(u)): int(c) for s, size in ((0, 20), (1, 70)) for r in range(4) for u, c in zip(*np.unique(bootstrap.draw(bootstrap.replicate_key(7, s, r), 50, size), return_counts=True), strict=True)}
    assert {(x.scale_idx, x.rep, x.unit): x.times for x in rows} == want


def test_draws_match_between_engines_beyond_a_block(spark):
    n = 2 * bootstrap.BLOCK + 100
    rows = bootstrap.multiplicity_frame(spark, n, [30, 60], 5, 42).collect()
    want = {(s, r, int(u)): int(t[u]) for s, size in ((0, 30), (1, 60)) for r in range(5) for t in [bootstrap.block_draws(42, s, r, n, size, np.arange(1), n)] for u in np.flatnonzero(t)}
    assert {(x.scale_idx, x.rep, x.unit): x.times for x in rows} == want
    assert max(u for _, _, u in want) >= bootstrap.BLOCK
    with pytest.raises(ValueError, match="reach"):
        bootstrap.multiplicity_frame(spark, (1 << 31) + 1, [30], 1, 42)


def test_counts_do_not_depend_on_partitions(spark):
    x, tables = _blocks(40), []
    for parts in (1, 4, 17):
        c = bootstrap.count_candidates(_vectors(spark, x, parts), LABELS, [LABELS, LABELS[:4], LABELS[:5]], nboot=20)
        tables.append(sorted((r.candidate, r.size, r["count"]) for r in c.collect()))
    assert tables[0] == tables[1] == tables[2]
    assert all(n == 20 for c, _, n in tables[0] if c == 0)


@pytest.mark.parametrize(("method", "holes", "linkage"), [("correlation", 0, "average"), ("euclidean", 3, "ward.D2"), ("uncentered", 3, "average")])
def test_counts_are_the_same_wherever_the_matrix_lies(spark, method, holes, linkage):
    rng = np.random.default_rng(4)
    x = _blocks(90) + rng.normal(size=(90, 12)) * 1.2
    x[rng.random(x.shape) < holes / 100] = np.nan
    v = _vectors(spark, x)
    sets = tree.member_sets(support.tree_of(v, LABELS, method, linkage), LABELS)
    a, b = ({(r.candidate, r.size): (r["count"], r.skipped) for r in bootstrap.count_candidates(v, LABELS, sets, nboot=40, method_dist=method, method_hclust=linkage, sent_bytes=n, block=8, part_bytes=1600).collect()} for n in (1 << 20, 0))
    assert a == b
    assert all(n + skipped == 40 for (c, _), (n, skipped) in b.items() if c == len(sets) - 1)


def test_draws_are_split_among_blocks():
    n, size = 2 * bootstrap.BLOCK + 100, 5000
    whole = bootstrap.block_draws(7, 1, 3, n, size, np.arange(3))
    assert len(whole) == n and whole.sum() == size
    assert np.array_equal(bootstrap.block_draws(7, 1, 3, n, size, np.arange(1, 3)), whole[bootstrap.BLOCK :])
    assert 0.3 < whole[: bootstrap.BLOCK].sum() / size < 0.7


def _peak(f):
    """What a call gives, and the most bytes it holds at once."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_draws_of_a_sent_matrix_are_weighed_by_the_block():
    n, p = 40_000, 16
    x = np.random.default_rng(0).normal(size=(n, p))
    labels = [f"o{k:02d}" for k in range(p)]
    sent = SimpleNamespace(value=(x, bootstrap.bit_keys([labels], labels), labels))
    run = bootstrap._by_replicate(sent, [n // 2, n], 16, 7, "correlation", "average", None, bootstrap.BLOCK)
    ids = pa.RecordBatch.from_arrays([pa.array(range(32))], names=["id"])
    (batch,), most = _peak(lambda: list(run([ids])))
    assert sorted(map(tuple, (r.values() for r in batch.to_pylist()))) == [(0, 0, 16), (1, 0, 16)]
    assert most < 64 << 20


def test_draws_of_many_units_are_weighed_by_the_block(monkeypatch):
    n, p = 200_000, 4
    x = np.random.default_rng(0).normal(size=(n, p))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 1))
    first = 25 * bootstrap.BLOCK
    run = bootstrap._by_unit(first + n, {0: 0, 1: first}, [first + n], 32, 7, p, "correlation", bootstrap.BLOCK)
    values = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), p)], names=["values"])
    (batch,), most = _peak(lambda: list(run([values])))
    times = bootstrap.block_draws(7, 0, 5, first + n, first + n, np.arange(25, 25 + -(-n // bootstrap.BLOCK)))
    assert np.allclose(bootstrap._unfolded(batch.column(1)[5].as_py(), p)[3], (x * times[:, None]).T @ x, atol=1e-6)
    assert most < 64 << 20


@pytest.mark.parametrize("gaps", [False, True])
def test_weighted_sums_do_not_depend_on_the_rows_taken_together(monkeypatch, gaps):
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(1000, 5)), 1000
    if gaps:
        x[rng.random(x.shape) < 0.1] = np.nan
    scales, reps = [0, 1, 1], [4, 0, 9]
    weights = np.stack([bootstrap.block_draws(7, s, r, n, [500, 900][s], np.arange(8), 128) for s, r in zip(scales, reps, strict=True)])
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    want = np.array([[(a * w[:, None]).T @ b for w in weights] for a, b in ((seen, seen), (z, seen), (z * z, seen), (z, z))])
    monkeypatch.setattr(bootstrap, "WORK_BYTES", 8 * 3 * 5 * 50)
    assert np.allclose(bootstrap.drawn_stats(x, 0, n, 7, scales, reps, [500, 900], False, 128), want, atol=1e-9)
    parts = [bootstrap.drawn_stats(x[a:b], a, n, 7, scales, reps, [500, 900], False, 128) for a, b in ((0, 384), (384, 1000))]
    assert np.allclose(parts[0] + parts[1], want, atol=1e-9)
    keep = seen.all(1)
    assert np.allclose(bootstrap.drawn_stats(x, 0, n, 7, scales, reps, [500, 900], True, 128)[3], np.array([(x[keep] * w[keep, None]).T @ x[keep] for w in weights]), atol=1e-9)


def test_support_of_planted_blocks(found):
    picked = {tuple(r.members) for r in support.pick(found.edges).collect()}
    assert {tuple(LABELS[k : k + 4]) for k in (0, 4, 8)} <= picked | {tuple(r.members) for r in found.edges.where("au >= 0.95").collect()}
    assert found.edges.count() == 11 and not found.skipped()
    rows = support.pick(found.edges, max_only=False)
    assert rows.count() >= support.pick(found.edges).count()


def test_support_guards(spark):
    with pytest.raises(ValueError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        support.support_tree(_vectors(spark, _blocks(2)), LABELS, nboot=2)
    with pytest.warns(UserWarning):
        support.support_tree(_vectors(spark, _blocks(12)), LABELS, nboot=2)
    with pytest.raises(ValueError):
        M.check_labels(["a", "b;c"])
    with pytest.raises(ValueError):
        M.check_labels(["a", "a"])


def test_own_clustering_function(spark):
    c = bootstrap.count_candidates(_vectors(spark, _blocks(30)), LABELS, [LABELS[:2], LABELS[2:4]], nboot=5, r=[0.5, 1.0], cluster_fn=lambda x: None if len(x) < 20 else [[0, 1], LABELS[5:7]])
    assert sorted((r.candidate, r.scale_idx, r["count"], r.skipped) for r in c.collect()) == [(0, 0, 0, 5), (0, 1, 5, 0), (1, 0, 0, 5), (1, 1, 0, 0)]


def test_federated_support_and_apply_back(spark):
    x = _blocks(120)
    parts = [_vectors(spark, x[:50]), _vectors(spark, x[50:])]
    _, _, catalogue = federate.federated_tree([stats.gram_stats(p, LABELS) for p in parts], LABELS)
    counts = federate.union([support.count_edges(p, LABELS, catalogue, nboot=20, seed=k).withColumn("project", F.lit(f"P{k}")) for k, p in enumerate(parts)])
    edges = federate.federated_support(federate.pool_counts(counts), catalogue)
    assert edges.count() == 11 and {r.n_projects for r in edges.collect()} == {2}
    with pytest.warns(UserWarning):
        federate.federated_support(federate.pool_counts(counts.where("project = 'P0' or edge_id > '7'")), catalogue)
    agreed = federate.consensus(edges.where("au >= 0.9"), 0.9).collect()
    assert all(set(a.members) <= set(b.members) or set(b.members) <= set(a.members) or not set(a.members) & set(b.members) for a in agreed for b in agreed)
    out = workflows.apply_back(parts[0], LABELS, edges, alpha=0.9, nboot=10)
    mods = out["modules"].collect()
    assert sorted(m.object for m in mods) == LABELS
    assert out["support"].count() == 11 and out["agreement"].count() == 1
    assert out["scores"].select("unit_id").distinct().count() == 50
    with pytest.raises(ValueError):
        workflows.apply_back(parts[0], LABELS, edges.withColumn("members", F.array(F.lit("zz"))), nboot=2)


def _long(spark, x, labels):
    return M.to_long(spark.createDataFrame([(f"u{i:03d}", *map(float, r)) for i, r in enumerate(x)], ["unit", *labels]), "unit", labels)


def _shifted(spark, n=200, p=6, confound=0.7):
    rng = np.random.default_rng(5)
    group = rng.integers(0, 2, n)
    batch = np.where(rng.random(n) < np.where(group == 1, confound, 1 - confound), 1, 0)
    x = rng.normal(size=(n, p)) + 2.0 * group[:, None] + 5.0 * batch[:, None]
    names = [f"f{k}" for k in range(p)]
    notes = spark.createDataFrame([(f"u{i:03d}", "AB"[b], f"g{g}") for i, (b, g) in enumerate(zip(batch, group, strict=True))], "unit_id string, batch string, grp string")
    return x, group, batch, names, _long(spark, x, names), notes


def _wide(long, names):
    got = {(r.unit_id, r.object): r.value for r in long.collect()}
    units = sorted({u for u, _ in got})
    return np.array([[got[u, o] for o in names] for u in units])


def test_adjusted_rows_of_one_object_do_not_meet_in_one_task(spark, monkeypatch):
    _, _, _, names, long, notes = _shifted(spark, p=1)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    makers = [lambda: adjust.linear(long, notes), lambda: adjust.linear(long, notes, notes.select("unit_id", "grp"), scale=True), lambda: adjust.combat(long, notes, notes.select("unit_id", "grp"))]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for made in makers:
            out = made()
            most = out.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
            assert out.count() == 200 and most < 100
            monkeypatch.setattr(adjust, "SENT_ROWS", 0)
            assert np.allclose(_wide(out, names), _wide(made(), names), atol=1e-9)
            monkeypatch.undo()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_adjustment(spark):
    x, group, batch, names, long, notes = _shifted(spark)
    y = _wide(adjust.linear(long, notes.select("unit_id", "batch"), notes.select("unit_id", "grp")), names)
    design = np.stack([np.ones(200), batch, group], 1)
    beta = np.linalg.lstsq(design, x, rcond=None)[0]
    want = x - np.outer(batch, beta[1])
    want += x.mean(0) - want.mean(0)
    assert np.allclose(y, want, atol=1e-9)
    plain = _wide(adjust.linear(long, notes.select("unit_id", "batch"), scale=True), names)
    assert np.allclose(plain[batch == 0].mean(0), plain[batch == 1].mean(0)) and np.allclose(plain[batch == 0].std(0, ddof=1), plain[batch == 1].std(0, ddof=1))
    bayes = _wide(adjust.combat(long, notes.select("unit_id", "batch"), notes.select("unit_id", "grp")), names)
    gap = lambda z, by: np.abs(z[by == 1].mean(0) - z[by == 0].mean(0)).mean()
    held = lambda z: np.abs(np.linalg.lstsq(design, z, rcond=None)[0][1:]).mean(1)
    assert held(bayes)[0] < 0.5 and held(bayes)[1] > 1.5 and gap(x, batch) > 4
    kept = _wide(adjust.combat(long, notes.select("unit_id", "batch"), ref_batch="A"), names)
    assert np.allclose(kept[batch == 0], x[batch == 0])
    one = notes.select("unit_id", F.lit("only").alias("batch"))
    assert np.allclose(_wide(adjust.linear(long, one), names), x)
    with pytest.raises(ValueError, match="told apart"):
        adjust.linear(long, notes.select("unit_id", "batch"), notes.select("unit_id", F.col("batch").alias("same")))
    with pytest.raises(ValueError, match="no batch"):
        adjust.linear(long, notes.where("unit_id <> 'u000'").select("unit_id", "batch"))


def test_association(spark):
    rows = [(f"u{i}", i % 3, f"c{i % 3}", "same", float(i % 3) + i / 1000, float(i * 7919 % 101)) for i in range(90)]
    df = spark.createDataFrame(rows, "unit_id string, cluster int, perfect string, constant string, related double, noise double")
    out = {r.variable: r for r in association.association(df.select("unit_id", "cluster"), df.drop("cluster")).collect()}
    assert set(out) == {"perfect", "related", "noise", "constant"}
    assert (out["constant"].test, out["constant"].reason, out["constant"].effect) == ("skipped", "constant or too few values", None)
    assert out["perfect"].effect == pytest.approx(1, abs=0.02) and out["perfect"].adjusted_rand == 1
    assert out["related"].strength == "strong" and out["noise"].p_value > 0.05
    table = association.association(df.select("unit_id", "cluster"), df.drop("cluster"))
    assert "perfect" in association.report(table, ["perfect"], 3)
    effects = [r.effect for r in table.collect()]
    assert effects[:-1] == sorted(effects[:-1], reverse=True) and effects[-1] is None
    verdict = {r.variable: r.verdict for r in association.confounding(df.select("unit_id", F.col("perfect").alias("batch")), df.select("unit_id", F.col("cluster").alias("c"), F.col("noise").alias("n"), "constant")).collect()}
    assert verdict["c"] == "complete" and verdict["constant"] == "skipped"
    wide = df.select("unit_id", F.concat(F.lit("free text "), "unit_id").alias("words"))  # a level for each unit
    words = association.contingency(df.select("unit_id", "cluster").join(wide, "unit_id"), "cluster", "words").first()
    assert (words.r, words.k) == (3, 90) and words.chi2 == pytest.approx(180)
    with pytest.raises(ValueError):
        association.association(df.select("unit_id", "cluster").limit(2), df.drop("cluster"))


def test_release_is_all_or_nothing(spark):
    x = _blocks(30)
    long = _long(spark, x, LABELS)
    groups = spark.createDataFrame([(f"u{i:03d}", 0 if i < 20 else 1) for i in range(30)], "unit_id string, cluster int")
    notes = spark.createDataFrame([(f"u{i:03d}", "x" if i < 15 else "y") for i in range(30)], "unit_id string, sex string")
    out = profiles.release(long, groups, "P", 10, notes)
    assert out["profiles"].count() == 24 and "unit_id" not in out["profiles"].columns
    assert {(r.cluster, r.level, r.n) for r in out["demographics"].collect()} == {(0, "x", 15), (1, "y", 10)}
    with pytest.raises(profiles.SuppressedError):
        profiles.release(long, groups, "P", 11)
    with pytest.raises(ValueError, match="no cluster"):
        profiles.release(long, groups.where("unit_id <> 'u000'"), "P")


def test_blocks_and_cocluster(spark, found, vectors):
    b = blocks.cut_blocks(spark, found.linkage, LABELS, 3)
    seen = blocks.assess(b, found.edges).collect()
    assert [r.n for r in seen] == [4, 4, 4] and all(r.au is not None for r in seen)
    long = vectors.select("unit_id", F.posexplode("values").alias("k", "value")).select("unit_id", F.array(*map(F.lit, LABELS))[F.col("k")].alias("object"), "value")
    groups = blocks.unit_groups(long, b, 2)
    assert groups.count() == 60 and blocks.squares(long, b, groups).count() == 6
    g = spark.createDataFrame([("tight", LABELS[:4]), ("loose", [LABELS[0], LABELS[5]]), ("absent", ["q"])], "name string, members array<string>")
    out = {r.name: r for r in profiles.cocluster(found.edges, g, 100).collect()}
    assert set(out) == {"tight", "loose"} and out["tight"].tight and out["tight"].p_value < 0.2 < out["loose"].p_value
    assert "1 of 2" in profiles.cocluster_summary(profiles.cocluster(found.edges, g, 20))
    order = spark.createDataFrame([(LABELS[k], i) for i, k in enumerate(tree.leaf_order(found.linkage, 12))], "object string, col int")
    rows = long.select("unit_id").distinct().withColumn("row", F.row_number().over(Window.orderBy("unit_id")))
    assert blocks.two_way(long, order, rows).count() == 720
    strength = [0.5] * 11
    assert sorted(tree.leaf_order(tree.rotated(found.linkage, strength), 12)) == list(range(12))


def test_payloads(spark, found, tmp_path):
    exchange.write_payload(exchange.project_payload(found, "P"), str(tmp_path / "p"))
    text = "".join(f.read_text() for f in (tmp_path / "p").glob("*.json"))
    assert "u0001" not in text
    back = exchange.counts_from_payloads(exchange.read_payloads(spark, [str(tmp_path / "p")]))
    assert back.count() == 110 and back.where("n = 60").count() == 110
    spark.createDataFrame([("other/2",)], "schema string").write.json(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        exchange.read_payloads(spark, [str(tmp_path / "q")])
    two = exchange.project_payload(found, "Q").withColumn("settings", F.col("settings").withField("linkage", F.lit("single")))
    with pytest.raises(ValueError):
        exchange.counts_from_payloads(exchange.project_payload(found, "P").unionByName(two))
    exchange.write_edges(found.edges, str(tmp_path / "e"))
    assert {tuple(r.members) for r in exchange.read_edges(spark, str(tmp_path / "e")).collect()} == {tuple(r.members) for r in found.edges.collect()}
    exchange.write_counts(found.counts, "P", 60, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["project", "edge_id", "r", "n", "nboot", "count"]
    s = stats.gram_stats(_vectors(spark, _blocks(10)), LABELS)
    exchange.write_stats(s, str(tmp_path / "s"))
    assert exchange.read_stats(spark, str(tmp_path / "s")).count() == 144
    assert exchange.federated_payload(found.edges, ["P"]).first()["mode"] == "exact"


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("﻿id\ta\tb\nx\t1\t4\ny\t2\t\n", encoding="utf-8")
    out = {(r.unit_id, r.object): r.value for r in M.read_matrix(spark, str(tmp_path / "m.tsv"), take_log2=True).collect()}
    assert out == {("x", "a"): 0.0, ("x", "b"): 2.0, ("y", "a"): 1.0, ("y", "b"): None}
    names = spark.createDataFrame([("a", "same"), ("b", "same")], "k string, l string")
    assert {r.object for r in M.read_matrix(spark, str(tmp_path / "m.tsv"), feature_map=names).collect()} == {"same (a)", "same (b)"}
    assert {r.unit_id for r in M.read_matrix(spark, str(tmp_path / "m.tsv"), transpose=True).collect()} == {"a", "b"}
    assert M.read_annotations(spark, str(tmp_path / "m.tsv")).columns == ["unit_id", "a", "b"]
    (tmp_path / "v.txt").write_text("1\t2\n3\t4\n5\t6\n")
    (tmp_path / "s.txt").write_text("SampleId\tSampleType\np\tSample\np\tSample\nq\tBuffer\n")
    (tmp_path / "r.txt").write_text("SeqId\tTarget\n1-1\tA\n2-1\tB\n")
    out = {(r.unit_id, r.object): r.value for r in M.read_positional(spark, *(str(tmp_path / f"{x}.txt") for x in "vsr")).collect()}
    assert out == {("p_0", "1-1"): 1.0, ("p_0", "2-1"): 2.0, ("p_1", "1-1"): 3.0, ("p_1", "2-1"): 4.0}
    (tmp_path / "v.txt").write_text("1\t2\n3\t4\n")
    with pytest.raises(ValueError):
        M.read_positional(spark, *(str(tmp_path / f"{x}.txt") for x in "vsr"))
    long = M.to_long(spark.createDataFrame([("u", 0.0)], "id string, a double"), "id", ["a"])
    with pytest.raises(Exception, match="above zero"):
        M.log2(long).collect()
    with pytest.raises(ValueError):
        M.restrict(long, spark.createDataFrame([("zz",)], "feature string"))


def test_streamed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("e", 10, 100, 40), ("e", 10, 100, 60), ("f", 10, 50, 1)], "edge_id string, size long, nboot long, count long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = pooling.pooled_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("pooled").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("pooled").collect()} == {("e", 10, 200, 100), ("f", 10, 50, 1)}


def test_sets(spark):
    assert S.edge_id_of(["b", "a"]) == spark.range(1).select(S.edge_id(F.array(F.lit("b"), F.lit("a")))).first()[0]


def test_fit_branches(spark):
    rows = [("zero", k, 100, 0) for k in range(1, 6)] + [("one", k, 100, 100) for k in range(1, 6)] + [("two", k, 100, 50 * (k > 3)) for k in range(1, 6)]
    out = {r.edge_id: r for r in msfit.fit(spark.createDataFrame([(e, k / 4, n, c) for e, k, n, c in rows], "edge_id string, r double, nboot int, count int")).collect()}
    assert (out["zero"].au, out["one"].au, out["two"].au) == (0, 1, 0) and not out["two"].fitted and out["one"].pchi == 0


def test_verbs_end_to_end(spark):
    from thicket.plans import verbs

    x, group, batch, names, long, notes = _shifted(spark, 60, 5)
    ready = verbs.prepare(long, notes, "batch", ["grp"], "linear", "zscore", top_variable=4)
    assert ready.select("object").distinct().count() == 4 and ready.count() == 240
    assert verbs.guess_technical(notes.columns) == ["batch"] and verbs.batch_report(notes, "batch").count() == 1
    halves = [long.where("unit_id < 'u030'"), long.where("unit_id >= 'u030'")]
    vocab = verbs.shared_vocabulary([verbs.vocabulary(h, "x") for h in halves])
    assert [r.feature for r in vocab.collect()] == names
    clusters = verbs.catalogue([verbs.sufficient_stats(h) for h in halves])
    counts = [verbs.count_candidates(h, f"P{k}", clusters, 10) for k, h in enumerate(halves)]
    assert verbs.federated_support(counts, clusters).count() == 4
    assert verbs.support_tree(long, 5).edges.count() == 4
    with pytest.raises(ValueError):
        verbs.sufficient_stats(long.where("unit_id < 'u010'"))
    with pytest.raises(ValueError):
        verbs.prepare(long, shared=vocab, top_variable=2)
    with pytest.raises(ValueError):
        verbs.match_profiles(spark.createDataFrame([("P:c1", "P", "f", 1.0)], "profile_id string, project string, feature string, mean double"))


# Proportions over the ten scales 0.5 .. 1.4 and the published fits at 1000 replicates
# (si, au, bp, se_si, se_au, se_bp, v, c, df, rss, pchi).
PUBLISHED = {
    "strong": ([0.6, 0.66, 0.72, 0.78, 0.84, 0.88, 0.91, 0.94, 0.96, 0.975], (0.99569567955018, 0.999312891405593, 0.88649018629048, 0.00122702103643841, 0.000242715723642567, 0.00375477370740495, -2.20404207795348, 0.995970230352338, 8, 23.0502587920813, 0.00330031555449848)),
    "weak": ([0.3, 0.33, 0.36, 0.39, 0.42, 0.45, 0.48, 0.51, 0.54, 0.57], (0.619173491743868, 0.910147877915832, 0.461290817370459, 0.0356185103823959, 0.0127646374814312, 0.00519838746819662, -0.622241967241361, 0.719424253789858, 8, 5.66316399075104, 0.684903465711035)),
    "midlow": ([0.05, 0.07, 0.09, 0.12, 0.15, 0.18, 0.22, 0.26, 0.3, 0.35], (0.850913421843113, 0.992560505710517, 0.19590841346734, 0.0266273614393998, 0.00210444743826803, 0.00415926758581784, -0.789491987434984, 1.64581917514029, 8, 11.3841784185313, 0.180866592182312)),
    "near_one": ([0.9, 0.93, 0.95, 0.965, 0.978, 0.985, 0.99, 0.994, 0.996, 0.998], (0.995983747702356, 0.998627503750357, 0.985351889587926, 0.0020888238480988, 0.000825907836594145, 0.00150331171187279, -2.5872084741447, 0.407731061278447, 8, 1.69475343478516, 0.988983349580946)),
    "exactly_three": ([0, 0, 0, 0, 0, 0, 0, 0.3, 0.4, 0.6], (1, 1, 0.067529781088095, 0, 0, 0.01325408633261, -4.35120533026412, 5.84564950742003, 1, 7.23240527863107, 0.00715992153854163)),
    "mixed_edges": ([0, 0.001, 0.01, 0.2, 0.5, 0.8, 0.95, 0.999, 1, 1], (1, 1, 0.806461844769262, 0, 0, 0.00810084468958218, -8.48178607292558, 7.61685443327984, 3, 11.5765917526012, 0.00898369971664282)),
}


def test_fits_agree_with_published_values(spark):
    rows = [(name, (k + 5) / 10, 1000, round(1000 * p)) for name, (ps, _) in PUBLISHED.items() for k, p in enumerate(ps)]
    out = {r.edge_id: r for r in msfit.fit(spark.createDataFrame(rows, "edge_id string, r double, nboot int, count int")).collect()}
    for name, (_, want) in PUBLISHED.items():
        got = [out[name][c] for c in ("si", "au", "bp", "se_si", "se_au", "se_bp", "v", "c", "df", "rss", "pchi")]
        assert got == pytest.approx(want, rel=1e-8, abs=1e-10), name


def test_empirical_bayes_by_plain_iteration(spark):
    x, _, batch, names, long, notes = _shifted(spark, 60, 8)
    got = _wide(adjust.combat(long, notes.select("unit_id", "batch")), names)
    n = np.array([(batch == b).sum() for b in (0, 1)])
    mb = np.stack([x[batch == b].mean(0) for b in (0, 1)])
    alpha = (mb * n[:, None]).sum(0) / n.sum()
    sigma = np.sqrt(sum(((x[batch == b] - mb[b]) ** 2).sum(0) for b in (0, 1)) / n.sum())
    z, want = (x - alpha) / sigma, np.zeros_like(x)
    for b in (0, 1):
        own = z[batch == b]
        g, d = own.mean(0), own.var(0, ddof=1)
        gbar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
        lam, theta = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
        gs, ds = g, d
        for _ in range(3000):
            gs = (t2 * n[b] * g + ds * gbar) / (t2 * n[b] + ds)
            ds = (theta + ((own - gs) ** 2).sum(0) / 2) / (n[b] / 2 + lam - 1)
        want[batch == b] = sigma * (own - gs) / np.sqrt(ds) + alpha
    assert np.allclose(got, want, atol=1e-2)


def test_layouts_with_support(spark, found):
    drawn = {r.edge_id: r for r in tree.drawn(found.linkage, LABELS, found.edges, sort_by="au").collect()}
    assert len(drawn) == 11 and {e for e, r in drawn.items() if r.picked} == {r.edge_id for r in support.pick(found.edges).collect()}
    weak = [0.1 * (k % 3) for k in range(11)]
    turned = tree.rotated(found.linkage, weak)
    of = lambda x: -np.inf if x < 12 else weak[x - 12]
    assert all(of(m["left"]) >= of(m["right"]) for m in turned) and turned != found.linkage
    assert {frozenset(s) for s in tree.member_sets(turned, LABELS)} == {frozenset(s) for s in tree.member_sets(found.linkage, LABELS)}


def test_order_within_blocks_and_quantiles(spark, vectors):
    long = vectors.select("unit_id", F.posexplode("values").alias("k", "value")).select("unit_id", F.array(*map(F.lit, LABELS))[F.col("k")].alias("object"), "value")
    b = spark.createDataFrame([(x, "small" if k < 2 else "large") for k, x in enumerate(LABELS)], "object string, block string")
    placed = [(r.block, r.object) for r in blocks.block_order(long, b).orderBy("place").collect()]
    assert [p for p, _ in placed] == ["large"] * 10 + ["small"] * 2 and sorted(o for _, o in placed) == LABELS
    values = np.random.default_rng(9).integers(0, 50, 333).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    for q in (0.0, 0.5, 0.99, 1.0):
        assert blocks.quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(values, q))
    few = blocks.sampled_units(long, 7)
    assert few.select("unit_id").distinct().count() == 7 and few.count() == 84
    assert {r.unit_id for r in few.collect()} == {r.unit_id for r in blocks.sampled_units(long.repartition(9), 7).collect()}


def test_clustered_units_release_profiles(spark):
    from thicket.plans import verbs

    rng = np.random.default_rng(1)
    kinds = rng.normal(size=(2, 40)) * 2
    x = kinds[np.repeat([0, 1], 15)] + 0.4 * rng.normal(size=(30, 40))
    names = [f"f{k}" for k in range(40)]
    long = _long(spark, x, names)
    with pytest.warns(UserWarning):
        out = verbs.cluster_and_release(long, "P", min_cluster=10, nboot=50)
    assert out["profiles"].count() == 80 and out["unassigned"].count() + out["assignment"].count() == 30
    halves = [long.where("unit_id < 'u015'"), long.where("unit_id >= 'u015'")]
    parts = [verbs.sufficient_stats(h, min_n=10) for h in halves]
    known = verbs.aggregate(names, parts)["catalogue"]
    counts = [verbs.count_candidates(h, f"P{k}", known, 5) for k, h in enumerate(halves)]
    both = verbs.aggregate(names, parts, counts)
    assert set(both) == {"distance", "catalogue", "edges", "consensus"} and both["edges"].count() == 39
    with pytest.raises(ValueError, match="labels"):
        verbs.aggregate(names[:-1], parts)
    with pytest.raises(ValueError):
        verbs.aggregate(names)
