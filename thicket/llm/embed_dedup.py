"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node with a multiplicity.  Sorted random projections
deal nodes into small blocks, whose best pairs start a neighbour graph.  Rounds of
joins through common neighbours then improve the lists until they settle.  Every compared
pair at or above the threshold links, whether or not a list keeps it: a block or join
gives the stars of its own components.  Vectors whose lists are full of links are compared
with all of their label, in blocks, since their lists can't show the rest.  The links
of a group are counted in blocks.  Every vector whose id is divisible by 100, and some of
groups of each size, audit recall against all vectors of their label, in blocks; a miss
starts wider rounds, and at last a comparison of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Neighbours in a list, projection trees, rounds at most, vectors in a block.
NEIGHBOURS, TREES, ROUNDS, BLOCK = 8, 8, 3, 64
#: Vectors whose id this divides are audited, and about so many of groups of like size; mean recall of a vector
#: asked for in each size; attempts (each doubles lists and trees).
AUDIT_EVERY, AUDITED, RECALL, ATTEMPTS = 100, 128, 0.995, 3
#: Vectors of a group compared at once.
GROUP_BLOCK = 256
#: Vectors of a label that are compared with as many others at once.
LABEL_BLOCK = 1024


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1))[:, None]


def _deal(trees: int, bits: int, seed: int):
    """(node, label, v) to a row for each tree with its sort key."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(2))
            rng = np.random.Generator(np.random.PCG64(seed))
            for t in range(trees):
                p = x @ rng.normal(size=(x.shape[1], bits + 1))
                code = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), batch.column(1), pa.array(code), pa.array(p[:, bits]), batch.column(0), batch.column(2)], names=["tree", "label", "code", "along", "node", "v"])

    return run


def _best(ids: np.ndarray, s: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Each row's k best others: (u, v, s)."""
    n = len(ids)
    np.fill_diagonal(s, -2)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0)
    top = np.argpartition(-s, k - 1, 1)[:, :k]
    u, v, w = np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()
    if floor is not None:
        keep = w > np.repeat(floor, k)
        u, v, w = u[keep], v[keep], w[keep]
    return u, v, w


def _edges(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind), t) for i, (kind, t) in enumerate(((np.int64, pa.int64()), (np.int64, pa.int64()), (np.float64, pa.float64())))], names=["u", "v", "s"])


def _stars(close: np.ndarray, ids: np.ndarray, others: np.ndarray):
    """Links between rows and columns as stars of their components: (u, v).  Connects what all links connect."""
    m, n = close.shape
    near = np.flatnonzero(close.any(1))
    close = close[near]
    at, last = np.arange(len(near)), None
    while len(near) and (last is None or (at != last).any()):
        last = at
        across = np.where(close, at[:, None], m).min(0)
        at = np.where(close, across[None, :], m).min(1)
        at = np.minimum(at, at[at])
    if not len(near):
        return ids[:0], ids[:0]
    linked = np.flatnonzero(across < m)
    u, v = np.concatenate([ids[near], others[linked]]), np.concatenate([ids[near][at], ids[near][across[linked]]])
    return u[u != v], v[u != v]


def _linked(ids: np.ndarray, s: np.ndarray, threshold: float):
    """Stars of what links rows that are compared with each other, as edges without a similarity."""
    u, v = _stars(s >= threshold, ids, ids)
    return u, v, np.full(len(u), np.nan)


def _against(threshold: float):
    """Rows (label, i, j, role, node, group_, v): stars of the links between block i of some nodes and block j of all."""

    def run(batches):
        for _, parts in _groups(batches, 3):
            role = np.concatenate([p.column(3).to_numpy() for p in parts])
            ids = np.concatenate([p.column(4).to_numpy() for p in parts])
            x = np.concatenate([_units(p.column(6)) for p in parts])
            u, v = _stars(x[role == 0] @ x[role == 1].T >= threshold, ids[role == 0], ids[role == 1])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _facing(some: DataFrame, others: DataFrame) -> DataFrame:
    """Each block of some rows with each block of other rows of the label: (label, i, j, role, node, group_, v), sorted."""

    def parts(df, name):
        return df.groupBy("label").agg(F.ceil(F.count("*") / LABEL_BLOCK).cast("int").alias(name))

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    size = parts(some, "rows").join(parts(others, "columns"), "label")
    left = some.join(size, "label").select("label", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), each("columns").alias("j"), F.lit(0).alias("role"), "node", "group_", "v")
    right = others.join(size, "label").select("label", each("rows").alias("i"), F.pmod(F.xxhash64("node"), F.col("columns")).cast("int").alias("j"), F.lit(1).alias("role"), "node", "group_", "v")
    return left.unionByName(right).repartition(C.slots(some.sparkSession), "label", "i", "j").sortWithinPartitions("label", "i", "j")


def exact_links(some: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): stars of all links of some nodes with all of their label.  some, nodes: node, label, v."""
    own = F.col("node").alias("group_")
    return _facing(some.select("*", own), nodes.select("*", own)).mapInArrow(_against(threshold), "u long, v long")


def recall(asked: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, found): an asked node's links with all nodes of its label, and those within its group.

    asked, nodes: node, label, group_, v.
    """
    told = _facing(asked, nodes).mapInArrow(_audit(threshold), "node long, links long, found long")
    return told.groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))


def _in_blocks(k: int, threshold: float):
    """Sorted rows (tree, label, node, v) to the best pairs and links of each run of BLOCK rows of a tree and label."""

    def solve(keys, ids, x):
        found = []
        cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True):
            for at in range(a, b, BLOCK):
                at = max(a, min(at, b - BLOCK))
                to = min(b, at + BLOCK)
                s = x[at:to] @ x[at:to].T
                found += [_linked(ids[at:to], s, threshold), _best(ids[at:to], s, k)]
        return _edges(found)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)], 1)
                yield solve(keys, batch.column(2).to_numpy(), _units(batch.column(3)))

    return run


def _groups(batches, keys: int):
    """Rows sorted by their first columns, gathered into whole groups."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
        cut = np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(1)))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(table)).tolist(), strict=True):
            now = tuple(table[a])
            if key is not None and now != key:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _meet(k: int, threshold: float):
    """Rows (w, part, node, floor, v) sorted by (w, part): pairs within a group that beat a node's list, and links."""

    def run(batches):
        found, size = [], 0
        for _, parts in _groups(batches, 2):
            ids = np.concatenate([p.column(2).to_numpy() for p in parts])
            floor = np.concatenate([p.column(3).to_numpy() for p in parts])
            x = np.concatenate([_units(p.column(4)) for p in parts])
            s = x @ x.T
            found += [_linked(ids, s, threshold), _best(ids, s, k, floor)]
            size += len(found[-2][0]) + len(found[-1][0])
            if size > 50_000:
                yield _edges(found)
                found, size = [], 0
        yield _edges(found)

    return run


def _counted(threshold: float):
    """Rows (group, i, j, role, node, times, v), i <= j: links between nodes of blocks i and j, copies included."""

    def run(batches):
        for key, parts in _groups(batches, 3):
            role = np.concatenate([p.column(3).to_numpy() for p in parts])
            ids = np.concatenate([p.column(4).to_numpy() for p in parts])
            times = np.concatenate([p.column(5).to_numpy() for p in parts]).astype(np.float64)
            x = np.concatenate([_units(p.column(6)) for p in parts])
            own = role == 0
            if key[1] == key[2]:
                close = x @ x.T >= threshold
                np.fill_diagonal(close, False)
                nodes, links = ids, close @ times
            else:
                close = x[own] @ x[~own].T >= threshold
                nodes, links = np.append(ids[own], ids[~own]), np.append(close @ times[~own], times[own] @ close)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.round().astype(np.int64))], names=["node", "links"])

    return run


def _audit(threshold: float):
    """Rows as for ``_against``: how many links each asked node has, and how many of them within its group."""

    def run(batches):
        for _, parts in _groups(batches, 3):
            role, ids, group = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (3, 4, 5))
            x = np.concatenate([_units(p.column(6)) for p in parts])
            a, b = role == 0, role == 1
            close = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b])
            found = close & (group[a][:, None] == group[b])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(close.sum(1)), pa.array(found.sum(1))], names=["node", "links", "found"])

    return run


def _kept(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node."""
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("n") <= k).select("u", "v", "s")


def neighbour_graph(nodes: DataFrame, k: int, trees: int, threshold: float, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(u, v, s): about the k nearest of each node among those of its label; (u, v): stars of the links of all
    compared pairs.  nodes: node, label, v; checkpointed."""
    spark = nodes.sparkSession
    deal, total = C.slots(spark), nodes.count()
    bits = max(0, min(12, int(np.log2(max(1, total / (BLOCK * 40))))))
    fields = dict(nodes.dtypes)
    dealt = nodes.mapInArrow(_deal(trees, bits, seed), f"tree int, label long, code long, along double, node long, v {fields['v']}")
    start = dealt.repartitionByRange(deal, "tree", "label", "code", "along").sortWithinPartitions("tree", "label", "code", "along").select("tree", "label", "node", "v")
    pairs = start.mapInArrow(_in_blocks(k, threshold), "u long, v long, s double").checkpoint()
    links = pairs.where(F.isnan("s")).select("u", "v")
    graph = _kept(pairs.where(~F.isnan("s")), k).checkpoint()
    for _ in range(rounds):
        around = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        degree = around.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        floor = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).alias("floor"))
        known = nodes.join(floor, nodes.node == floor.u).select("node", "floor", "v")
        members = around.join(degree, "u").select(F.col("u").alias("w"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("node"))
        own = degree.select(F.col("u").alias("w"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("node"))
        gathered = members.unionByName(own).join(known, "node").select("w", "part", "node", "floor", "v").repartition(deal, "w", "part").sortWithinPartitions("w", "part")
        better = gathered.mapInArrow(_meet(k, threshold), "u long, v long, s double").checkpoint()
        links = links.unionByName(better.where(F.isnan("s")).select("u", "v"))
        after = _kept(graph.unionByName(better.where(~F.isnan("s"))), k).checkpoint()
        changed = after.join(graph, ["u", "v"], "left_anti").count()
        graph = after
        if changed <= 0.01 * k * total:
            break
    return graph, links.distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", report: dict | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row with an id.

    Vectors of equal label are linked if their cosine, in double precision, is at least
    ``threshold``.  Null labels, null or empty vectors, zero vectors and those with null or
    non-finite components link with nothing; nor do vectors of different lengths.  n_links counts
    every other vector of the group that is close enough, exact copies included.  Copies
    of a row under one id count as one vector.  Rows with a null id are left out; extra
    columns are ignored; an empty table gives an empty result.

    report: receives ``recall``, the audited vectors' mean share of links found (the worst of
    the group sizes; None if no audited vector has a link), and ``audited``, their number.
    Below ``RECALL`` in the last attempt, all vectors of a label are compared, in blocks.
    """
    spark = vectors.sparkSession
    C.prepare(spark)
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label_"), v.alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label_").isNotNull()
    rows = rows.withColumn("label", F.when(fine, F.xxhash64(F.col("label_").cast("string"), F.size("v")))).select("id", "label", F.when(fine, F.col("v")).alias("v"))
    nodes = rows.where("label is not null").groupBy("label", "v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("times"), F.count("*").alias("rows_"), F.max((F.col("id") % AUDIT_EVERY == 0).cast("int")).alias("asked"))
    nodes = nodes.select("node", "label", "v", "times", "rows_", "asked").checkpoint()
    plain = nodes.select("node", "label", "v")
    links, k, trees = None, NEIGHBOURS, TREES
    told = {} if report is None else report
    for attempt in range(ATTEMPTS):
        graph, found = neighbour_graph(plain, k, trees, threshold, seed=1 + attempt)
        full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold))
        found = found.unionByName(exact_links(plain.join(full, plain.node == full.u, "left_semi"), plain, threshold))
        links = (found if links is None else links.unionByName(found)).checkpoint()
        groups = components(links, "u", "v").checkpoint()
        size = groups.groupBy("component").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("stratum"))
        placed = nodes.join(groups, "node", "left").withColumn("group_", F.coalesce("component", "node")).join(size, "component", "left").withColumn("stratum", F.coalesce("stratum", F.lit(0)))
        held = placed.groupBy("stratum").agg(F.count("*").alias("n_"))  # a row for each power of two
        drawn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 31)) * F.col("n_") <= AUDITED * float(1 << 31)
        asked = placed.join(F.broadcast(held), "stratum").where((F.col("asked") == 1) | drawn).select("node", "label", "group_", "v", "stratum").checkpoint()
        each = recall(asked.drop("stratum"), placed.select("node", "label", "group_", "v"), threshold).where("links > 0")
        by_size = each.join(asked, "node").groupBy("stratum").agg(F.avg(F.col("found") / F.col("links")).alias("recall"), F.count("*").alias("n"))
        told["recall"], told["audited"] = by_size.agg(F.min("recall"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if told["recall"] is None or told["recall"] >= RECALL:
            break
        k, trees = 2 * k, 2 * trees
    else:
        links = links.unionByName(exact_links(plain, plain, threshold)).checkpoint()
        groups = components(links, "u", "v").checkpoint()
        told["recall"] = 1.0
    size = groups.groupBy("component").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    placed = groups.join(size, "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    right = placed.select("component", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("role"), "node")
    below = placed.where("i > 0").select("component", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i_"), F.col("i").alias("j"), F.lit(1).alias("role"), "node").withColumnRenamed("i_", "i")
    compared = right.unionByName(below).join(nodes, "node").select("component", "i", "j", "role", "node", "times", "v").repartition(C.slots(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = compared.mapInArrow(_counted(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.join(counts, "node", "left").join(groups, "node", "left").select("label", "v", F.col("times"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = C.spread_join(rows, whole, ["label", "v"], C.hot_keys(nodes, ["label", "v"], "rows_"), ["id"], "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
