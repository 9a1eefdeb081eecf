"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of one length are interchangeable, so best-fit decreasing runs on the counts of
the lengths alone: at most ``capacity`` of them, whatever the corpus.  A segment tree
over remaining capacities gives the tightest open bin in logarithmic time; bins alike
are handled together.  The plan then places each piece by its rank within its length.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import common as C


class Capacities:
    """A segment tree over 0..most: which remaining capacities have open bins."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, there: bool) -> None:
        at += self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open bin."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing on length counts.

    Rows (length, first rank, pieces, first sequence, pieces per sequence, offset):
    piece t of a row lies in sequence first + t // per at offset + t % per * length.
    """
    tree, bins, rows, opened = Capacities(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, there = capacity, opened, -(-left // (capacity // length))
                opened += there
            else:
                first, there = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
            per = room // length
            used = min(there, -(-left // per))
            pieces = min(left, used * per)
            rows.append((length, rank, pieces, first, per, capacity - room))
            rank, left = rank + pieces, left - pieces
            full = pieces // per
            for at, n, after in ((first, full, room - per * length), (first + full, used - full, room - pieces % per * length), (first + used, there - used, room)):
                if n and after:
                    bins.setdefault(after, []).append((at, n))
                    tree.set(after, True)
    return np.array(rows, np.int64).reshape(-1, 6)


def read_tokenizer(path: str) -> tuple[bytes, dict[bytes, int]]:
    """A byte-level BPE tokenizers JSON file as a rank file's bytes, and its added tokens with their ids."""
    made = json.loads(bpe.read_ranks(path))
    tokens, model, cut = made["added_tokens"], made["model"], made["pre_tokenizer"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that take in or ask for what is around them are not supported")
    if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or made["normalizer"]:
        raise ValueError(f"{path} is not plain byte-level BPE")
    vocab = model["vocab"]
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if order != sorted(order):
        raise ValueError("merges are not in the order of their ids")
    # a byte that is a printable Latin-1 sign stands for itself, the others are numbered from 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t["content"]: t["id"] for t in tokens}
    ranks = b"\n".join(base64.b64encode(bytes(byte_of[c] for c in w)) + b" %d" % i for w, i in vocab.items() if w not in added)
    return ranks, {w.encode(): i for w, i in added.items()}


def _tokenise(sent, capacity: int, end_id: int):
    def run(batches):
        ranks, added = sent.value
        own = bpe.vocabulary(ranks)
        for part, data, offsets in C.chunks(batches, limit=bpe.BLOCK_BYTES):
            starts, ends, first = bpe.pretokens_around(data, offsets, added)
            _, words, back = bpe.distinct(data, starts, ends)
            ids, begin = bpe.encode_words(words, own, added)
            size = np.diff(begin)
            flat = ids[C.ranges(begin[:-1][back], size[back])].astype("<u4")
            edge = np.zeros(len(back) + 1, np.int64)
            np.cumsum(size[back], out=edge[1:])
            raw, edge, end = flat.tobytes(), edge[first].tolist(), np.array([end_id], "<u4").tobytes()
            out = []
            for i, a, b in zip(part.column(0).to_pylist(), edge[:-1], edge[1:], strict=True):
                text_ids, n = raw[4 * a : 4 * b] + end, b - a + 1
                at = 0
                to = n % capacity or capacity
                piece = 0
                while at < n:
                    out.append((i, piece, at, to - at, zlib.crc32(text_ids[4 * at : 4 * to])))
                    at, to, piece = to, to + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(rows: np.ndarray):
    order = np.lexsort((rows[:, 1], rows[:, 0])) if len(rows) else np.zeros(0, int)
    length, rank, _, first, per, offset = (rows[order, k] for k in range(6))

    def run(batches):
        key = length << np.int64(44) | rank
        for batch in batches:
            own, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(key, own << np.int64(44) | at, "right") - 1
            t = at - rank[row]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(first[row] + t // per[row]), pa.array(offset[row] + t % per[row] * own)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A document is its text's ids and then ``end_id``.  tokenizer: a tokenizers JSON file of
    byte-level BPE, read on the driver; as with that library, texts are first cut at its added
    tokens, which get their own ids.  A document longer than ``capacity`` is cut into full
    pieces after a first, shorter one.  Null and empty texts are the end id alone.  Every row
    with an id is packed, repeated rows too; rows with a null id are left out.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    sent = spark.sparkContext.broadcast(read_tokenizer(tokenizer))  # bpe.MOST_VOCABULARY bytes at most
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    pieces = whole.mapInArrow(_tokenise(sent, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long").checkpoint()
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(4 * C.slots(spark))).cast("int"))
    sizes = dealt.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", rank).join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    placed = ranked.mapInArrow(_place(plan(counts, capacity)), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
