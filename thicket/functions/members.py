"""Clusters as sets of member labels: Column builders."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_id(members: Column) -> Column:
    """A cluster's identity: the first 12 digits of the SHA-1 of its sorted, comma-joined members."""
    return F.substring(F.sha1(F.array_join(F.array_sort(members), ",").cast("binary")), 1, 12)


def edge_id_of(members) -> str:
    return hashlib.sha1(",".join(sorted(members)).encode()).hexdigest()[:12]


def pattern(members: Column, labels: list[str]) -> Column:
    """Membership as a string of 0 and 1 in the order of ``labels``."""
    return F.concat(*[F.when(F.array_contains(members, x), "1").otherwise("0") for x in labels])


def within(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def compatible(a: Column, b: Column) -> Column:
    """Disjoint or nested."""
    return ~F.arrays_overlap(a, b) | within(a, b) | within(b, a)
