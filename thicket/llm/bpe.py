"""Byte-level BPE over a corpus: each distinct word is encoded once.

Texts are cut by the tokenizer's pattern with numpy over Unicode classes.  A block of
text sends the distinct words it holds to buckets by word hash; a bucket encodes each
word once, whatever the number of blocks that ask; the ids return to the block, where
the documents' word positions put them in order.  Words are the same if their bytes are;
hashes only route them.  Decoding joins ids to the bytes of the token table, which goes to
every task: a vocabulary is at most ``MOST_VOCABULARY`` bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Words that a worker remembers between blocks; bytes of input for each bucket of words.
KEPT_WORDS, BUCKET_BYTES = 200_000, 16 << 20
#: Bytes that a rank file may have to be sent to every task.
MOST_VOCABULARY = 64 << 20
#: Unicode White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE = range(5)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    of = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[_WHITE] = _BLANK
    table[0x20] = _SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the pattern's matches in rows of UTF-8, and per row the first match's number.

    The pattern is that of byte-level BPE: contractions, then runs of letters, of numbers
    and of other signs, each with one space before it if there is one, then white space,
    whose last character stands apart when text follows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    row_at = np.searchsorted(lead, offsets)
    head[row_at] = True
    head[n] = True
    white = kind >= _BLANK
    before = np.empty(n, np.uint8)
    before[0] = _BLANK
    before[1:] = kind[:-1]
    before[head[:-1]] = _BLANK  # a row's start is like text after a line break
    white_before = before >= _BLANK
    text_next = np.zeros(n, bool)
    text_next[:-1] = ~white[1:]
    text_next[head[1:]] = False
    white_head = white & (head[:-1] | ~white_before)
    begin = np.where(white, white_head | text_next, (before == _BLANK) | (~white_before & (before != kind)))
    mark = np.flatnonzero((points == 39) & (before != _OTHER) & (before != _SPACE))
    if len(mark):
        far = np.append(points, np.zeros(2, np.uint32))
        row_end = np.append(np.flatnonzero(head), n)
        room = row_end[np.searchsorted(row_end, mark, "right")] - mark
        a, b = far[mark + 1], far[mark + 2]
        one = (room > 1) & np.isin(a, [ord(x) for x in "stmd"])
        two = (room > 2) & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = mark[hit]
            begin[at + 1] = False
            after = at + size
            begin[after[after < n]] = True
    begin |= head[:-1]
    first = np.flatnonzero(begin)
    starts = lead[first]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(first, row_at)


def pretokens_around(data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``pretokens``, with rows first cut at the added tokens' strings (leftmost, the longest), which are one match each."""
    raw = data.tobytes()
    if not any(w in raw for w in added):
        return pretokens(data, offsets)
    either = re.compile(b"|".join(re.escape(w) for w in sorted(added, key=len, reverse=True)))
    bounds = offsets.tolist()
    found = np.array([m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in either.finditer(raw, a, b)], np.int64).reshape(-1, 2)
    starts, ends, _ = pretokens(data, np.unique(np.concatenate([offsets, found.ravel()])))
    to = np.searchsorted(found[:, 0], starts, "right") - 1
    inside = (to >= 0) & (starts < found[to, 1])
    keep = ~inside | (starts == found[to, 0])
    ends = np.where(inside, found[to, 1], ends)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


class Vocabulary:
    """A rank file's merges, its tokens' bytes, and the words encoded lately."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        of = {i: w for w, i in table.items()}
        parts = [of.get(i, b"") for i in range(max(of) + 1)]
        self.begin = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.begin[1:])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[bytes, bytes] = {}


@functools.lru_cache(maxsize=4)
def vocabulary(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


def read_ranks(path: str) -> bytes:
    """A rank file, read on the driver alone; tasks get its bytes."""
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY + 1)
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY} bytes")
    return raw


def encode_words(words: list[bytes], own: Vocabulary, added: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after another, and where each word's begin (one more entry: the end).  added: words that are one token each."""
    apart = {w: np.array([i], np.uint32).tobytes() for w, i in (added or {}).items()}
    known = own.known
    if len(known) > KEPT_WORDS:
        known.clear()
    got = []
    for w in words:
        ids = apart.get(w) or known.get(w)
        if ids is None:
            ids = known[w] = np.array(own.encode(w), np.uint32).tobytes()
        got.append(ids)
    begin = np.zeros(len(got) + 1, np.int64)
    np.cumsum([len(x) >> 2 for x in got], out=begin[1:])
    return np.frombuffer(b"".join(got), np.uint32), begin


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct words from the most frequent: their hashes, their bytes; and each position's number among them.

    Words of one hash are compared by their bytes; should any differ, all are told apart by their bytes.
    """
    hashes = C.word_hashes(data, starts, ends)
    _, where, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if not C.same_spans(data, starts, ends, starts[where][back], ends[where][back]).all():
        _, where, back, count = np.unique(C.word_numbers(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(-count, kind="stable")
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    whole, where = data.tobytes(), where[by]
    return hashes[where], [whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], rank[back]


def _planes(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches):
    """(slice, bytes, offsets, block's name): the name is a digest of ids and text."""
    for part, data, offsets in C.chunks(batches, limit=BLOCK_BYTES):
        name = hashlib.blake2b(data, digest_size=16)
        name.update(offsets.tobytes())
        name.update(part.column(0).to_numpy(zero_copy_only=False).tobytes())
        yield part, data, offsets, name.digest()


def _split(hashes: np.ndarray, buckets: int):
    """Word numbers of each bucket: (bucket, numbers)."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else []
    for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
        yield int(bucket[by[a]]), by[a:b]


def _ask(buckets: int):
    def run(batches):
        for _, data, offsets, name in _blocks(batches):
            starts, ends, _ = pretokens(data, offsets)
            hashes, words, _ = distinct(data, starts, ends)
            rows = []
            for bucket, numbers in _split(hashes, buckets):
                own = [words[i] for i in numbers.tolist()]
                lens = np.fromiter(map(len, own), np.uint32, len(own))
                rows.append((bucket, name, len(own), zstandard.compress(lens.tobytes() + b"".join(own), 3)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "block", "n", "words"])

    return run


def _answer(ranks):
    def run(batches):
        own = vocabulary(ranks.value)
        now, held = None, {}
        for batch in batches:
            out = []
            for bucket, n, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != now:
                    now, held = bucket, {}
                raw = zstandard.decompress(blob)
                lens = np.frombuffer(raw, np.uint32, n)
                ends = (np.cumsum(lens, dtype=np.int64) + 4 * n).tolist()
                words = [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)]
                new = [w for w in words if w not in held]
                flat, begin = encode_words(new, own)
                flat, begin = flat.tobytes(), (begin * 4).tolist()
                held.update(zip(new, (flat[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)), strict=True))
                got = [held[w] for w in words]
                sizes = np.fromiter(map(len, got), np.uint32, n) >> np.uint32(2)
                out.append(_planes(np.concatenate([sizes, np.frombuffer(b"".join(got), np.uint32)])))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["block", "bucket", "n", "ids"])

    return run


def _positions(buckets: int):
    def run(batches):
        for part, data, offsets, name in _blocks(batches):
            starts, ends, first = pretokens(data, offsets)
            hashes, _, back = distinct(data, starts, ends)
            order = np.zeros(len(hashes), np.uint32)
            at = 0
            for _, numbers in _split(hashes, buckets):
                order[numbers] = np.arange(at, at + len(numbers), dtype=np.uint32)
                at += len(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(first).tolist()], pa.list_(pa.int32())), pa.array([len(hashes)], pa.int32()), pa.array([_planes(back)], pa.binary()), pa.array([zstandard.compress(order.tobytes(), 1)], pa.binary())], names=["block", "docs", "counts", "n", "positions", "places"])

    return run


def _assemble(ranks):
    def run(batches):
        table, begin = vocabulary(ranks.value).bytes, vocabulary(ranks.value).begin
        width = np.diff(begin)
        for batch in batches:
            for block in batch.to_pylist():
                answers = [x for _, x in sorted({x["bucket"]: x for x in block["answers"] or []}.items())]
                if sum(x["n"] for x in answers) != block["n"]:
                    raise RuntimeError("a block's words are incomplete: the input must give the same rows each time it is read")
                sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for x in answers:
                    raw = _unplanes(x["ids"])
                    sizes.append(raw[: x["n"]])
                    ids.append(raw[x["n"] :])
                size, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
                start = np.cumsum(size) - size
                words = np.frombuffer(zstandard.decompress(block["places"]), np.uint32)[_unplanes(block["positions"])]
                flat = ids[C.ranges(start[words], size[words])]
                per_word = np.zeros(len(words) + 1, np.int64)
                np.cumsum(size[words], out=per_word[1:])
                bound = np.zeros(len(block["docs"]) + 1, np.int64)
                np.cumsum(block["counts"], out=bound[1:])
                bound = per_word[bound].tolist()
                for at in range(0, len(block["docs"]), 200):
                    docs = block["docs"][at : at + 200]
                    cut = bound[at : at + len(docs) + 1]
                    own = flat[cut[0] : cut[-1]]
                    texts = table[C.ranges(begin[own], width[own])].tobytes()
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.cumsum(width[own], out=edge[1:])
                    edge = edge[np.array(cut) - cut[0]].tolist()
                    raw = own.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array([raw[4 * (a - cut[0]) : 4 * (b - cut[0])] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                            pa.array([texts[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                        ],
                        names=["id", "n", "ids", "decoded"],
                    )

    return run


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded bytes.

    ``path`` is a tiktoken rank file, read on the driver.  Null texts are empty; empty texts
    have no ids.  Every row gives a row (rows with a null id are left out).  The input is read
    twice and must give the same rows both times; one that is not a scan with deterministic
    projections and filters is checkpointed first, and blocks that differ stop the run.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    whole = C.rereadable(whole)
    ranks = spark.sparkContext.broadcast(read_ranks(path))  # MOST_VOCABULARY bytes at most
    deal = C.slots(spark)
    buckets = max(deal, C.input_bytes(whole) // BUCKET_BYTES)  # a bucket's distinct words are held together
    asked = whole.mapInArrow(_ask(buckets), "bucket int, block binary, n int, words binary")
    answers = asked.repartitionById(deal, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(ranks), "block binary, bucket int, n int, ids binary")
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("answers"))
    blocks = whole.mapInArrow(_positions(buckets), "block binary, docs array<long>, counts array<int>, n int, positions binary, places binary")
    done = blocks.join(gathered, "block", "left").select("docs", "counts", "n", "positions", "places", "answers").mapInArrow(_assemble(ranks), "id long, n long, ids binary, decoded binary")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "ids", "decoded")
