"""Resampling scales."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..session import small_frame


def seq_by(start: float, stop: float, by: float) -> list[float]:
    """Evenly spaced numbers, each computed from the start, none past ``stop``."""
    if by == 0 or (stop - start) / by < 0:
        raise ValueError("by must lead from start towards stop")
    n = math.floor((stop - start) / by + 1e-10) + 1
    bound = min if by > 0 else max
    return [bound(start + k * by, stop) for k in range(n)]


def default_scales() -> list[float]:
    return seq_by(0.5, 1.4, 0.1)


def effective_scales(n: int, r: list[float] | None = None) -> list[tuple[int, float]]:
    """(size, size / n) of the distinct positive whole sizes floor(n * r), in order of first occurrence."""
    sizes = list(dict.fromkeys(math.floor(n * x) for x in (default_scales() if r is None else r)))
    sizes = [s for s in sizes if s > 0]
    if not sizes:
        raise ValueError("no scale gives a sample of at least one unit")
    return [(s, s / n) for s in sizes]


def scales_frame(spark: SparkSession, n: int, r: list[float] | None = None) -> DataFrame:
    """(scale_idx, size, r)."""
    rows = [(k, s, x) for k, (s, x) in enumerate(effective_scales(n, r))]
    return small_frame(spark, rows, "scale_idx int, size int, r double")
