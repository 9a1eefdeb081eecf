"""Hierarchical clustering kernels, batched over many distance matrices.

All replicates of a batch make their t-th merge together, so a merge costs a few
array operations whatever the number of replicates.  Each object keeps its nearest other,
which a merge changes for few, so a tree takes about the square of its objects' number.
Members are 64-bit words.
Ties go to the pair whose lower position is least, then whose upper one is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.members import edge_id_of, within
from ..session import small_frame

METHODS = {"average": "average", "complete": "complete", "single": "single", "centroid": "centroid", "median": "median", "mcquitty": "mcquitty", "weighted": "mcquitty", "ward.d2": "ward", "ward": "ward"}


def method_name(method: str) -> str:
    name = method.lower()
    if name == "ward.d":
        raise ValueError("ward.D expects squared distances; use ward.D2")
    if name not in METHODS:
        raise ValueError(f"unknown linkage {method}; one of {sorted(METHODS)}")
    return METHODS[name]


def _merged(kind: str, di, dj, dij, ni, nj, nk):
    """Distances of the others to a new cluster."""
    if kind == "single":
        return np.minimum(di, dj)
    if kind == "complete":
        return np.maximum(di, dj)
    if kind == "mcquitty":
        return (di + dj) / 2
    if kind == "average":
        return (ni * di + nj * dj) / (ni + nj)
    if kind == "median":
        return np.sqrt(np.maximum(di * di / 2 + dj * dj / 2 - dij * dij / 4, 0))
    if kind == "centroid":
        t = ni + nj
        return np.sqrt(np.maximum((ni * di * di + nj * dj * dj) / t - ni * nj * dij * dij / (t * t), 0))
    t = ni + nj + nk
    return np.sqrt(np.maximum(((nk + ni) * di * di + (nk + nj) * dj * dj - nk * dij * dij) / t, 0))


def batch_linkage(d: np.ndarray, method: str = "average") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (b, p-1, 2) of node numbers, heights (b, p-1) and member words (b, p-1, w) of b matrices.

    Nodes below p are objects; p + t is the t-th merge.
    """
    kind = method_name(method)
    b, p, _ = d.shape
    d = (d + d.transpose(0, 2, 1)) / 2
    at, rows = np.arange(p), np.arange(b)
    d[:, at, at] = np.inf
    size = np.ones((b, p))
    node = np.tile(at, (b, 1))
    words = -(-p // 64)
    bits = np.zeros((b, p, words), np.uint64)
    bits[:, at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    merges, heights, members = np.zeros((b, p - 1, 2), np.int64), np.zeros((b, p - 1)), np.zeros((b, p - 1, words), np.uint64)
    near = d.argmin(2)
    least = np.take_along_axis(d, near[:, :, None], 2)[:, :, 0]
    alive = np.ones((b, p), bool)
    for t in range(p - 1):
        i = least.argmin(1)  # the first row that holds the least, so its partner comes after it
        j, dij = near[rows, i], least[rows, i]
        di, dj = d[rows, i], d[rows, j]
        with np.errstate(invalid="ignore"):
            new = _merged(kind, di, dj, dij[:, None], size[rows, i][:, None], size[rows, j][:, None], size)
        new[~np.isfinite(di) | ~np.isfinite(dj)] = np.inf
        new[~alive] = np.inf
        new[rows, i] = new[rows, j] = np.inf
        d[rows, i] = new
        d[rows, :, i] = new  # what is left of j's row and column is not looked at again
        merges[:, t, 0], merges[:, t, 1], heights[:, t] = node[rows, i], node[rows, j], dij
        bits[rows, i] |= bits[rows, j]
        members[:, t] = bits[rows, i]
        size[rows, i] += size[rows, j]
        node[rows, i] = p + t
        alive[rows, j] = False
        closer = (new < least) | ((new == least) & (i[:, None] < near))
        stale = ((near == i[:, None]) | (near == j[:, None])) & ~closer
        least, near = np.where(closer, new, least), np.where(closer, i[:, None], near)
        stale[rows, i] = True
        least[rows, j] = np.inf
        r, c = np.nonzero(stale & alive)
        part = np.where(alive[r], d[r, c], np.inf)
        near[r, c] = part.argmin(1)
        least[r, c] = part[np.arange(len(r)), near[r, c]]
    return merges, heights, members


def linkage(d: np.ndarray, method: str = "average") -> list[dict]:
    """Rows (merge_order from 1, left, right, height, size) of one matrix."""
    d = np.asarray(d, float)
    if d.ndim != 2 or d.shape[0] != d.shape[1] or len(d) < 2:
        raise ValueError("a square matrix of two or more objects is needed")
    if not np.isfinite(d[~np.eye(len(d), dtype=bool)]).all():
        raise ValueError("distances are missing")
    # near ties must not depend on the order of sums
    merges, heights, members = batch_linkage(np.round(d, 12)[None].copy(), method)
    sizes = [sum(int(w).bit_count() for w in m) for m in members[0]]
    return [{"merge_order": t + 1, "left": int(a), "right": int(b), "height": float(h), "size": n} for t, ((a, b), h, n) in enumerate(zip(merges[0], heights[0], sizes, strict=True))]


def member_sets(tree: list[dict], labels: list[str]) -> list[list[str]]:
    """Sorted members of each merge, in merge order."""
    p, sets = len(labels), []
    for m in tree:
        both = [x for side in (m["left"], m["right"]) for x in ([labels[side]] if side < p else sets[side - p])]
        sets.append(sorted(both))
    return sets


def edges_frame(spark: SparkSession, tree: list[dict], labels: list[str]) -> DataFrame:
    """(edge_id, members, n_members, height, merge_order)."""
    rows = [(edge_id_of(s), s, len(s), m["height"], m["merge_order"]) for m, s in zip(tree, member_sets(tree, labels), strict=True)]
    return small_frame(spark, rows, "edge_id string, members array<string>, n_members int, height double, merge_order int")


def linkage_frame(spark: SparkSession, tree: list[dict]) -> DataFrame:
    return small_frame(spark, [tuple(m.values()) for m in tree], "merge_order int, left int, right int, height double, size int")


def leaf_order(tree: list[dict], p: int) -> list[int]:
    """Leaves from left to right."""
    order, todo = [], [p + len(tree) - 1]
    while todo:
        x = todo.pop()
        if x < p:
            order.append(x)
        else:
            todo += [tree[x - p]["right"], tree[x - p]["left"]]
    return order


def cut(tree: list[dict], labels: list[str], k: int) -> dict[str, int]:
    """At most k clusters, numbered from 1 in leaf order: the least height that leaves so few.

    Ties at the cut give fewer clusters.  A node counts at the greatest height below it,
    so trees with inversions are cut consistently.
    """
    p, top = len(labels), []
    for m in tree:
        top.append(max([m["height"], *(top[x - p] for x in (m["left"], m["right"]) if x >= p)]))
    level = next((h for h in sorted(set(top)) if p - sum(t <= h for t in top) <= k), None) if k < p else -np.inf
    out, number = {}, 0
    todo = [p + len(tree) - 1]
    while todo:
        x = todo.pop()
        if x >= p and top[x - p] > level:
            todo += [tree[x - p]["right"], tree[x - p]["left"]]
            continue
        number += 1
        inside = [x]
        while inside:
            y = inside.pop()
            if y < p:
                out[labels[y]] = number
            else:
                inside += [tree[y - p]["left"], tree[y - p]["right"]]
    return out


def subtree_support(edges: DataFrame, key: str = "au", how: str = "max") -> DataFrame:
    """(edge_id, strength): the greatest or mean ``key`` over each cluster and those within it."""
    inner = edges.select(F.col("members").alias("m"), F.coalesce(F.col(key), F.lit(0.0)).alias("k"))
    both = edges.select("edge_id", "members").join(inner, within(F.col("m"), F.col("members")))
    return both.groupBy("edge_id").agg((F.max("k") if how == "max" else F.avg("k")).alias("strength"))


def rotated(tree: list[dict], strength: list[float]) -> list[dict]:
    """The same tree with the stronger child of each merge on the left (leaves are weakest)."""
    p = len(tree) + 1
    of = lambda x: -np.inf if x < p else strength[x - p]
    return [m | {"left": m["right"], "right": m["left"]} if of(m["right"]) > of(m["left"]) else m for m in tree]


def drawn(tree: list[dict], labels: list[str], edges: DataFrame, alpha: float = 0.95, use: str = "au", sort_by: str | None = None) -> DataFrame:
    """(edge_id, x, y, x_left, x_right, au, bp, picked): the layout with its clusters' support.

    picked: whether the cluster is one that selection takes at ``alpha``.  sort_by: a
    support column whose strongest subtrees are drawn on the left.
    """
    from ..plans.support import pick

    spark = edges.sparkSession
    if sort_by:
        of = {r["edge_id"]: r["strength"] for r in subtree_support(edges, sort_by).collect()}  # a row per cluster
        tree = rotated(tree, [of[edge_id_of(s)] for s in member_sets(tree, labels)])
    places = small_frame(spark, [tuple(x.values()) for x in layout(tree, labels)], "edge_id string, x double, y double, x_left double, x_right double")
    taken = pick(edges, alpha, use).select("edge_id", F.lit(True).alias("picked"))
    return places.join(edges.select("edge_id", "au", "bp"), "edge_id").join(taken, "edge_id", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


def layout(tree: list[dict], labels: list[str]) -> list[dict]:
    """Where each merge is drawn: x midway between its children (leaves at 5, 15, ..), y its height."""
    p = len(labels)
    x = {leaf: 5.0 + 10.0 * k for k, leaf in enumerate(leaf_order(tree, p))}
    out = []
    for m, s in zip(tree, member_sets(tree, labels), strict=True):
        x[p + m["merge_order"] - 1] = (x[m["left"]] + x[m["right"]]) / 2
        out.append({"edge_id": edge_id_of(s), "x": x[p + m["merge_order"] - 1], "y": m["height"], "x_left": x[m["left"]], "x_right": x[m["right"]]})
    return out


def cophenetic(tree: list[dict], p: int) -> np.ndarray:
    """For each pair of objects, the height of the merge that joins them."""
    out, below = np.zeros((p, p)), {k: [k] for k in range(p)}
    for m in tree:
        a, b = below.pop(m["left"]), below.pop(m["right"])
        out[np.ix_(a, b)] = m["height"]
        out[np.ix_(b, a)] = m["height"]
        below[p + m["merge_order"] - 1] = a + b
    return out
