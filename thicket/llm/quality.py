"""A text quality classifier: kernel ridge by random Fourier features, calibrated.

Document statistics are mapped by random Fourier features, whose inner products
approximate a Gaussian kernel.  Tasks sum the normal equations of their rows, the sums
are added, and the ridge weights solved from them; isotonic regression on rows kept
from the fit turns scores into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Random features, kernel width in standard deviations, ridge, and labelled rows used at most.
FEATURES, WIDTH, RIDGE, MOST_ROWS = 256, 6.0, 1e-3, 200_000
#: Scores are binned so finely for the isotonic fit.
BINS = 2000
STATISTICS = ("log_words", "word_length", "upper", "digit", "sign", "mark_word", "non_ascii", "distinct_words", "distinct_grams", "top_word", "repeat_next", "lines", "distinct_lines", "line_length", "pipe", "shout", "long_word", "vowel")

_UPPER, _DIGIT, _SIGN, _LINE, _PIPE, _SHOUT, _VOWEL = range(7)
_CLASS = np.zeros((7, 256), bool)
_CLASS[_UPPER, 65:91] = True
_CLASS[_DIGIT, 48:58] = True
_CLASS[_SIGN, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[_LINE, 10] = True
_CLASS[_PIPE, ord("|")] = True
_CLASS[_SHOUT, ord("!")] = True
_CLASS[_VOWEL, [ord(c) for c in "aeiouAEIOU"]] = True


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _distinct(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many distinct values and how often the most frequent."""
    by = np.lexsort((values, row))
    r, v = row[by], values[by]
    head = np.ones(len(r), bool)
    head[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(head)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=rows), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text (0 where there is nothing to measure)."""
    rows = len(offsets) - 1
    starts, ends, first = C.word_spans(data, offsets)
    words, n = C.word_hashes(data, starts, ends), np.diff(first)
    row = np.repeat(np.arange(rows), n)
    size = np.maximum(np.diff(offsets), 1)
    some = np.maximum(n, 1)
    share = [_per_row(c[data], offsets) for c in _CLASS]
    lens = ends - starts
    distinct, top = _distinct(row, words, rows)
    grams = C.window_hashes(words, 3)
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    gram_n = np.bincount(row[2:][inside], minlength=rows) if len(row) > 2 else np.zeros(rows, np.int64)
    gram_distinct, _ = _distinct(row[2:][inside], grams[inside], rows) if len(row) > 2 else (gram_n, gram_n)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    marked = _CLASS[_SIGN][data[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, cuts + 1]))
    lo, hi = edges[:-1], edges[1:]
    filled = hi > lo
    lo, hi = lo[filled], hi[filled]
    line_row = np.searchsorted(offsets, lo, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
    line_distinct, _ = _distinct(line_row, C.word_hashes(data, lo, hi), rows) if len(lo) else (np.zeros(rows), None)
    columns = [
        np.log1p(n), _per_row(lens, first) / some, share[_UPPER] / size, share[_DIGIT] / size, share[_SIGN] / size, _per_row(marked, first) / some,
        _per_row(data > 127, offsets) / size, distinct / some, np.where(gram_n > 0, gram_distinct / np.maximum(gram_n, 1), 1.0), top / some, _per_row(again, first) / some,
        np.log1p(share[_LINE]), line_distinct / lines, np.log1p(size / lines), share[_PIPE] / size, share[_SHOUT] / size, _per_row(lens > 25, first) / some, share[_VOWEL] / size,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def _measure(batches):
    for part, data, offsets in C.chunks(batches):
        x = statistics(data, offsets).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), flat], names=["id", "tkey", "held_out", "x"])


def fourier(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, seed: int = 7) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.Generator(np.random.PCG64(seed))
    w = rng.normal(size=(len(centre), FEATURES)) / WIDTH * np.sqrt(len(centre)) / 2
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), len(STATISTICS))


def _equations(centre, scale):
    """One row per task: the sums of its rows' normal equations."""

    def run(batches):
        a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                f = fourier(_matrix(batch.column(0)), centre, scale)
                a += f.T @ f
                c += f.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), c]).tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches):
    total = 0.0
    for batch in batches:
        for s in batch.column(0).to_pylist():
            total = total + np.frombuffer(s, np.float64)
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y (pool adjacent violators)."""
    value, w, size = [], [], []
    for a, b in zip(y.tolist(), weight.tolist(), strict=True):
        value.append(a)
        w.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            t = w[-2] + w[-1]
            value[-2] = (value[-2] * w[-2] + value[-1] * w[-1]) / t
            w[-2], size[-2] = t, size[-2] + size[-1]
            value.pop()
            w.pop()
            size.pop()
    return np.repeat(value, size)


def _raw(centre, scale, beta, names):
    def run(batches):
        for batch in batches:
            s = fourier(_matrix(batch.column(batch.schema.get_field_index("x"))), centre, scale) @ beta if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns)] + [pa.array(s)], names=[*names, "raw"])

    return run


def _calibrated(at: np.ndarray, to: np.ndarray):
    def run(batches):
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("raw")).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(np.interp(raw, at, to), 0, 1))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted, text_key) for every row with an id; text_key is a hash of the text.

    labels: id_col and label_col (0 or 1; others and nulls teach nothing, and of a
    repeated id the larger label counts).  held_out: a Column over docs; rows where it
    is true teach nothing.  At most about ``most_rows`` labelled rows, those of least
    id hash, are fitted; a fifth of them calibrates, or all where that fifth or the rest
    has labels of one kind only.  Null and empty texts are scored like any other, from
    their statistics (all zero).  With labels of one kind only, scores are that label;
    without labels, 0.5.  A repeated row gives a repeated row.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("tkey"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text")).where("id is not null")
    measured = whole.mapInArrow(_measure, "id long, tkey long, held_out boolean, x array<float>").checkpoint()
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").cast("double").alias("y"))
    taught = measured.where("not held_out").join(known, "id").select("id", "x", "y")
    share = min(1.0, most_rows / max(1, taught.count()))
    bound = int(share * (1 << 31))
    fit = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) != 0
    rows = taught.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 31)) <= bound).withColumn("fit", fit).checkpoint()
    kinds = {(r["fit"], r["y"]): r["count"] for r in rows.groupBy("fit", "y").count().collect()}  # four rows at most

    def told(values):
        out = values.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("tkey").alias("text_key"))
        return out

    if len({y for _, y in kinds}) < 2:
        return told(measured.withColumn("score", F.lit(next((y for _, y in kinds), 0.5))))
    apart = all((part, y) in kinds for part in (True, False) for y in (0.0, 1.0))
    few = min(64, C.slots(spark))
    moments = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()  # a row per statistic
    centre, scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    for r in moments:
        centre[r["k"]], scale[r["k"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    fitted = rows.where("fit") if apart else rows
    sums = fitted.select("x", "y").repartition(few).mapInArrow(_equations(centre, scale), "sums binary").coalesce(1).mapInArrow(_added, "sums binary").first()
    total = np.frombuffer(sums["sums"], np.float64)
    m = FEATURES + 1
    a, c = total[: m * m].reshape(m, m), total[m * m :]
    ridge = RIDGE * max(1.0, a[-1, -1]) / FEATURES * np.eye(m)
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(a + ridge, c)
    checked = rows.where("not fit") if apart else rows
    raw = checked.select("x", "y").mapInArrow(_raw(centre, scale, beta, ["x", "y"]), "x array<float>, y double, raw double")
    bins = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    kept = raw.groupBy(bins.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    at, y, n = (np.array([float(r[k]) for r in kept]) for k in ("raw", "y", "n"))
    if len(at) < 2:
        at, to = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        # a little of the raw score keeps the order within flat stretches
        to = 0.98 * isotonic(y, n) + 0.02 * np.clip(at, 0, 1)
    names = ["id", "tkey", "held_out", "x"]
    kind = "id long, tkey long, held_out boolean, x array<float>, raw double"
    scored = measured.select(*names).mapInArrow(_raw(centre, scale, beta, names), kind).mapInArrow(_calibrated(at, to), kind + ", score double")
    return told(scored)
