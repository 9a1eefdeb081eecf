"""Shared pieces of the corpus operators: session helpers and byte-level numpy kernels.

The kernels work on the contiguous UTF-8 buffer of an Arrow string column, so a
batch of documents is tokenised and hashed by a handful of numpy passes.  A word's
hash mixes its bytes eight at a time; a hash only proposes that words are equal, and
``same_spans`` compares the bytes wherever a result depends on it.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_folder

#: Bytes of text that the kernels take at once (a longer document is taken alone).
CHUNK_BYTES = 1 << 20

_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed by a digest each.
LONG_WORD = 512

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The low 0 .. 8 bytes of eight.
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


# ---------------------------------------------------------------- session


def prepare(spark: SparkSession) -> None:
    """Give Python workers this package, bounded Arrow batches and a checkpoint folder."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    ensure_checkpoint_folder(spark)
    if getattr(sc, "_thicket_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="thicket-py-"), "thicket_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._thicket_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slots(spark: SparkSession) -> int:
    """Partitions to deal shuffled work to, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- Arrow


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) array and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into slices of about ``limit`` bytes of text: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


# ---------------------------------------------------------------- hashing


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, length: int) -> np.ndarray:
    """base**0 .. base**(length-1) modulo 2**64, from one table for each base that grows as needed."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < length:
        table = np.full(max(length, 1 << 16), base, np.uint64)
        table[0] = 1
        _POWERS[int(base)] = np.multiply.accumulate(table, out=table)
    return table[:length]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the first word's number."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SEP[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    gaps = np.flatnonzero(inside[:-1] & (begins[1:] | ~inside[1:])) + 1
    return starts, gaps, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of ``data``, the eight bytes from there as an integer (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (of A-Z lower-cased, with ``lower``); seeds give independent ones."""
    if lower:
        data = LOWER[data]
    at, size = eights(data), ends - starts
    out = mix(size.astype(np.uint64) * _ODD + mix(np.array([seed + 1], np.uint64)))
    own = np.flatnonzero(size <= LONG_WORD)
    left, k = size[own], 0
    while len(own):
        out[own] = mix((out[own] ^ (at[starts[own] + k] & _LOW_BYTES[np.minimum(left, 8)])) * _ODD)
        more = left > 8
        own, left, k = own[more], left[more] - 8, k + 8
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        out[w] = int.from_bytes(hashlib.blake2b(data[starts[w] : ends[w]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same_spans(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes of each span from a equal those of the span from b.  at: ``eights`` of data."""
    at = eights(data) if at is None else at
    size = a_end - a
    out = size == b_end - b
    own = np.flatnonzero(out & (size <= LONG_WORD) & (a != b))
    left, k = size[own], 0
    while len(own):
        same = (at[a[own] + k] ^ at[b[own] + k]) & _LOW_BYTES[np.minimum(left, 8)] == 0
        out[own[~same]] = False
        more = same & (left > 8)
        own, left, k = own[more], left[more] - 8, k + 8
    for w in np.flatnonzero(out & (size > LONG_WORD) & (a != b)).tolist():
        out[w] = np.array_equal(data[a[w] : a_end[w]], data[b[w] : b_end[w]])
    return out


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span; equal numbers mean equal bytes, and only they."""
    _, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if same_spans(data, starts, ends, starts[where][back], ends[where][back]).all():
        return back
    raw, known = data.tobytes(), {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, themselves hashes (len(values) - width + 1 of them); for short runs."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_STEP, len(values)), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * powers(_STEP_INV, len(values))[: len(values) - width + 1])


def window_hashes_2d(values: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    return mix((values * powers(_STEP, values.shape[1])).sum(1, dtype=np.uint64))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (count[0] of them), then first[1], .."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(first, count)


def schema_of(df: DataFrame, *columns: str) -> str:
    """DDL of some columns of a frame."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each word begins (one more entry: the end)."""
    lens = ends - starts + 1
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lens)
    np.minimum(at, max(len(data) - 1, 0), out=at)
    out = data[at] if len(at) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 32
    return out, begin


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """A frame's size: that of its files for a scan, else half its text's (as if compressed)."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    plain = "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    return size if plain and size < 1 << 60 else (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


def hot_keys(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, copies): the keys that hold more than a fair share of all rows.

    counted: a row per key with its number of rows.  A share is a quarter of what a
    partition gets on average, so there are at most four hot keys per shuffle partition:
    few enough to broadcast, whatever the data.
    """
    from pyspark.sql import functions as F

    total = counted.agg(F.sum(n)).first()[0] or 0
    share = max(1024, total // (4 * slots(counted.sparkSession)))
    return counted.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("copies_"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by, how: str = "inner") -> DataFrame:
    """left joined to right (a row per key at most); rows of hot keys are dealt over copies of their row by ``by``."""
    from pyspark.sql import functions as F

    hot = F.broadcast(hot)
    copies = F.coalesce("copies_", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*by), copies).cast("int")).drop("copies_")
    copied = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies_")
    return dealt.join(copied, [*keys, "salt_"], how).drop("salt_")


def rereadable(df: DataFrame) -> DataFrame:
    """The frame itself if it is a file scan under deterministic projections and filters; else a checkpoint of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    same = plan.deterministic()
    while same and plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return df if same and plan.children().size() == 0 and "Relation" in plan.nodeName() else df.checkpoint()


def checkpoint_by(df: DataFrame, key: str) -> DataFrame:
    """A checkpoint that joins and groups by ``key`` use without another shuffle.

    Adaptive plans don't tell a checkpoint how its rows are dealt, so they are off while it is made.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(slots(spark), key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def with_rest(df: DataFrame, *named: str, rest: str = "rest"):
    """Carries all columns but ``named`` in one struct, so their names can't clash: (frame's column, names)."""
    from pyspark.sql import functions as F

    others = [c for c in df.columns if c not in named]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    return packed.alias(rest), others
