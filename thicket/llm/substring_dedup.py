"""Removal of word sequences that occur earlier in the corpus.

A window is ``width`` consecutive words.  Consecutive windows whose least word
gram (their minimiser) is the same are a super-k-mer.  Blocks of text first ask, by
minimiser hash alone, which of theirs occur more than once; only those travel, each
super-k-mer as one packed string of words, to the minimiser's bucket.  A bucket sorts
its windows by a hash of their words, compares the words of those with equal hashes byte
by byte, and keeps the earliest of each.  Windows that repeat within a block are settled
there, so a passage that very many documents share travels once per block, not once per
document.  A bucket that very many super-k-mers ask for, as where all blocks share a
minimiser, is settled in parts of bounded size; the earliest of each part's windows then meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Text that one block settles by itself.
BLOCK_BYTES = 1 << 20
#: Compressed bytes of blocks for each bucket.
BUCKET_BYTES = 2 << 20
#: Super-k-mers of a bucket that are held together; a bucket of more is settled in parts.
PART_KEYS = 1 << 18


def _least_over(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each run of ``span`` values."""
    done, out = 1, values
    while done * 2 <= span:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (span - done)], out[span - done :]) if done < span else out


def _runs(keep: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of kept positions that no break divides: first positions and lengths."""
    begins = keep.copy()
    begins[1:] &= ~keep[:-1] | breaks[1:]
    first = np.flatnonzero(begins)
    last = np.append(begins[1:] | ~keep[1:], True) & keep
    return first, np.flatnonzero(last) + 1 - first


def _windows(words: np.ndarray, first: np.ndarray, width: int, skip: np.ndarray | None = None):
    """Window hashes, the windows that lie in one row, and the row of each."""
    n = max(0, len(words) - width + 1)
    valid = np.zeros(n, bool)
    rows = len(first) - 1
    count = np.maximum(0, np.diff(first) - width + 1)
    if skip is not None:
        count[skip] = 0
    at = C.ranges(first[:-1], count)
    valid[at] = True
    row = np.zeros(n, np.int64)
    row[at] = np.repeat(np.arange(rows), count)
    return C.window_hashes(words, width), valid, row


def _again(hashes, valid, row, first_pos, ids, keys, data, starts, ends, width) -> np.ndarray:
    """Which valid windows repeat an earlier one of these.  first_pos: added to a window's number for its
    place in its document; windows of equal place don't repeat each other.

    Windows are grouped by hash and compared with the group's earliest word by word; should one
    differ from it, all are grouped by their bytes instead.
    """
    at = np.flatnonzero(valid)
    r = row[at]
    i, k, p = ids[r], keys[r], at + first_pos[r]
    order = np.lexsort((p, k, i))
    a, b, c = i[order], k[order], p[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    place = np.zeros(len(order), np.int64)
    place[order] = np.cumsum(new)

    def grouped(names):
        by = order[np.argsort(names[order], kind="stable")]
        head = np.ones(len(by), bool)
        head[1:] = names[by][1:] != names[by][:-1]
        return by, by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by

    by, earliest = grouped(hashes[at])
    other = by != earliest
    x, y, bytes_at = at[by[other]], at[earliest[other]], C.eights(data)
    same = np.ones(len(x), bool)
    for j in range(width):
        same &= C.same_spans(data, starts[x + j], ends[x + j], starts[y + j], ends[y + j], bytes_at)
    if not same.all():
        numbers, known = C.word_numbers(data, starts, ends), {}
        by, earliest = grouped(np.array([known.setdefault(numbers[w : w + width].tobytes(), len(known)) for w in at.tolist()], np.int64))
    out = np.zeros(len(valid), bool)
    out[at[by]] = place[by] != place[earliest]
    return out


class _Block:
    """A block's windows, those settled within it, and its super-k-mers in order of their buckets."""

    def __init__(self, ids: pa.Array, keys: pa.Array, data: np.ndarray, offsets: np.ndarray, width: int, gram: int, buckets: int):
        self.data, self.width = data, width
        self.starts, self.ends, self.first = C.word_spans(data, offsets)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids, self.keys = ids.fill_null(0).to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)
        words = C.word_hashes(data, self.starts, self.ends)
        self.hashes, valid, self.row = _windows(words, self.first, width, null)
        again = _again(self.hashes, valid, self.row, -self.first[:-1], self.ids, self.keys, data, self.starts, self.ends, width)
        breaks = np.ones(len(valid), bool)
        breaks[1:] = self.row[1:] != self.row[:-1]
        self.settled = _runs(valid & again, breaks) if len(valid) else (np.zeros(0, int), np.zeros(0, int))
        least = _least_over(C.window_hashes(words, gram), width - gram + 1)[: len(valid)] if len(valid) else np.zeros(0, np.uint64)
        breaks[1:] |= least[1:] != least[:-1]
        f, c = _runs(valid & ~again, breaks) if len(valid) else (np.zeros(0, int), np.zeros(0, int))
        bucket = (least[f] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.at, self.count, self.bucket, self.least = f[by], c[by], bucket[by], least[f][by]

    def each_bucket(self):
        """(bucket, from, to) over the super-k-mers."""
        edge = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) else np.zeros(0, int)
        yield from zip(self.bucket[edge].tolist(), edge.tolist(), np.append(edge[1:], len(self.bucket)).tolist() if len(edge) else [], strict=True)


def _blocks(batches):
    """(slice of id, tkey, text, rest, bytes, offsets, name): the name is a digest of ids and text."""
    for part, data, offsets in C.chunks(batches, limit=BLOCK_BYTES):
        name = hashlib.blake2b(data, digest_size=16)
        name.update(offsets.tobytes())
        for k in (0, 1):
            name.update(repr(part.column(k).to_pylist()).encode())
        yield part, data, offsets, name.digest()


def _rows(found: list[tuple], **kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _ask(width: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            for name, blob in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                part = _opened(blob)
                data, offsets = C.utf8(part.column(2))
                block = _Block(part.column(0), part.column(1), data, offsets, width, gram, buckets)
                found = [(b, name, block.least[lo:hi].tobytes()) for b, lo, hi in block.each_bucket()]
                yield _rows(found, bucket=pa.int32(), block=pa.binary(), hashes=pa.binary())

    return run


def _answer(most: int):
    """Streams rows of one bucket after another; about ``most`` of a bucket's hashes are held together.

    A bucket of more is dealt in parts numbered from 1, all of whose super-k-mers travel: a hash met once in its
    part may be in another.  Other buckets are part 0.
    """

    def answered(held, part):
        hashes = [np.frombuffer(h, np.uint64) for _, _, h in held]
        flat = np.concatenate(hashes)
        more = np.full(len(flat), part > 0)
        if not part:
            order = np.argsort(flat, kind="stable")
            same = flat[order][1:] == flat[order][:-1]
            more[order[1:][same]] = True
            more[order[:-1][same]] = True
        at, rows = 0, []
        for (bucket, block, _), h in zip(held, hashes, strict=True):
            own = more[at : at + len(h)]
            at += len(h)
            if own.any():
                rows.append((block, bucket, part, np.packbits(own).tobytes()))
        return _rows(rows, block=pa.binary(), bucket=pa.int32(), part=pa.int32(), more=pa.binary())

    def run(batches):
        held, size, part = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (held[0][0] != row[0] or size >= most):
                    part += part > 0 or held[0][0] == row[0]
                    yield answered(held, part)
                    part = part if held[0][0] == row[0] else 0
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) // 8
        if held:
            yield answered(held, part + (part > 0))

    return run


def _squeezed(batches):
    """Blocks as compressed Arrow streams: (block, blob)."""
    for part, _, _, name in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(part)
        yield _rows([(name, sink.getvalue().to_pybytes())], block=pa.binary(), blob=pa.binary())


def _opened(blob: bytes | None) -> pa.RecordBatch:
    if blob is None:
        raise RuntimeError("answers or removals belong to no block")
    return next(iter(pa.ipc.open_stream(blob)))


def _packed(head: bytes, text: bytes) -> bytes:
    return zstandard.compress(np.int64(len(head)).tobytes() + head + text, 1)


def _pack(width: int, gram: int, buckets: int):
    """(block, blob, answers) to settled windows and the super-k-mers that may repeat elsewhere."""

    def run(batches):
        for batch in batches:
            for name, blob, answers in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part = _opened(blob)
                data, offsets = C.utf8(part.column(2))
                block = _Block(part.column(0), part.column(1), data, offsets, width, gram, buckets)
                out = []
                f, c = block.settled
                if len(f):
                    r = block.row[f]
                    out.append((0, 0, name, None, np.stack([r, f - block.first[r], c], 1).astype(np.int32).tobytes()))
                more = {a["bucket"]: (a["part"], a["more"]) for a in answers or []}
                text, begin = C.spaced(data, block.starts, block.ends)
                text = text.tobytes()
                for b, lo, hi in block.each_bucket():
                    if b in more:
                        part_of, bits = more[b]
                        own = lo + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo))
                        at = block.at[own]
                        r = block.row[at]
                        x, y = begin[at], begin[at + block.count[own] + width - 1]
                        head = np.stack([block.ids[r], block.keys[r], at - block.first[r], y - x, r], 1).astype(np.int64).tobytes()
                        packed = b"".join([text[a:b] for a, b in zip(x.tolist(), y.tolist(), strict=True)])
                        out.append((b, part_of, name, _packed(head, packed), None))
                yield _rows(out, bucket=pa.int32(), part=pa.int32(), block=pa.binary(), blob=pa.binary(), settled=pa.binary())

    return run


#: Covers of a block, and what goes from a bucket's part to the bucket.
SETTLED = "block binary, covers binary, bucket int, blob binary"


def _settle(width: int):
    """Rows in order of buckets and parts to (block, covers, bucket, blob): covers are (row, first window, windows)
    of 32-bit integers; a blob holds the windows that repeat nothing in their part, for the bucket."""

    def settled(held, part):
        heads, texts, of = [], [], []
        for k, (_, _, blob) in enumerate(held):
            raw = zstandard.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            heads.append(np.frombuffer(raw, np.int64, n // 8, 8).reshape(-1, 5))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + n))
            of.append(np.full(len(heads[-1]), k))
        head, data, of = np.concatenate(heads), np.concatenate(texts), np.concatenate(of)
        offsets = np.zeros(len(head) + 1, np.int64)
        np.cumsum(head[:, 3], out=offsets[1:])
        starts, ends, first = C.word_spans(data, offsets)
        words = C.word_hashes(data, starts, ends)
        hashes, valid, row = _windows(words, first, width)
        again = _again(hashes, valid, row, head[:, 2] - first[:-1], head[:, 0].copy(), head[:, 1].copy(), data, starts, ends, width)
        breaks = np.ones(len(valid), bool)
        breaks[1:] = row[1:] != row[:-1]

        def by_block(keep):
            f, c = _runs(keep, breaks)
            edge = np.searchsorted(of[row[f]], np.arange(len(held) + 1)).tolist()
            return f, c, [(bucket, name, a, b) for (bucket, name, _), a, b in zip(held, edge[:-1], edge[1:], strict=True) if b > a]

        f, c, found = by_block(again)
        r = row[f]
        cover = np.stack([head[r, 4], head[r, 2] + f - first[r], c], 1).astype(np.int32)
        out = [(name, cover[a:b].tobytes(), None, None) for _, name, a, b in found]
        if part:
            f, c, found = by_block(valid & ~again)
            r = row[f]
            x, y = starts[f], ends[f + c + width - 2] + 1  # each word has a space after it
            own = np.stack([head[r, 0], head[r, 1], head[r, 2] + f - first[r], y - x, head[r, 4]], 1).astype(np.int64)
            text = data.tobytes()
            out += [(name, None, bucket, _packed(own[a:b].tobytes(), b"".join(text[m:n] for m, n in zip(x[a:b].tolist(), y[a:b].tolist(), strict=True)))) for bucket, name, a, b in found]
        return out

    def rows(found):
        return _rows(found, block=pa.binary(), covers=pa.binary(), bucket=pa.int32(), blob=pa.binary())

    def run(batches):
        now, held = None, []
        for batch in batches:
            done = []
            for bucket, part, block, blob, covers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if blob is None:
                    done.append((block, covers, None, None))
                    continue
                if (bucket, part) != now and held:
                    yield rows(settled(held, now[1]))
                    held = []
                now = bucket, part
                held.append((bucket, block, blob))
            yield rows(done)
        if held:
            yield rows(settled(held, now[1]))

    return run


def _remove(width: int):
    """(blob, covers) to the block's rows with what is left of their texts."""

    def cleared(part, covers):
        data, offsets = C.utf8(part.column(2))
        starts, ends, first = C.word_spans(data, offsets)
        gone = np.zeros(len(starts), bool)
        if covers:
            row, pos, count = np.frombuffer(b"".join(covers), np.int32).reshape(-1, 3).astype(np.int64).T
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, first[row] + pos, 1)
            np.add.at(edge, first[row] + pos + count + width - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
        text, begin = C.spaced(data, starts, ends)
        kept = text[np.repeat(~gone, np.diff(begin))].tobytes()
        size, removed = np.zeros(len(starts) + 1, np.int64), np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.where(gone, 0, np.diff(begin)), out=size[1:])
        np.cumsum(gone, out=removed[1:])
        bounds = size[first].tolist()
        texts = [kept[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(removed[first]), pa.int64()), pa.array(texts, pa.string())], names=["id", "text", "rest", "n_words", "n_removed", "kept_text"])

    def run(batches):
        for batch in batches:
            for blob, covers in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                yield cleared(_opened(blob), covers)

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, gram: int = 4, part_keys: int = PART_KEYS) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words left, joined by one space).

    A word ``[^\\x20\\x09-\\x0D]+`` goes if a window of ``width`` words that covers it also
    starts earlier: in a document of smaller id, or earlier in the same one.  Windows
    are judged on the input.  Null and empty texts have no words (kept_text is empty).
    Rows with a null id come back unjudged (n_removed 0).  A row repeated in full is the
    same document and doesn't count against itself; different texts under one id are
    ordered by a hash of the text.  Input columns named like an output column are
    replaced; an empty table gives an empty result.  The input is read once: it is cut into
    blocks, which are checkpointed by name, so that both joins leave them in place.  A bucket that over
    ``part_keys`` super-k-mers ask for is settled in parts; results don't depend on it.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    outputs = ("n_words", "n_removed", "kept_text")
    docs = docs.drop(*outputs)
    rest, _ = C.with_rest(docs, id_col, text_col)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("tkey"), F.col(text_col).alias("text"), rest)
    blocks = C.checkpoint_by(whole.mapInArrow(_squeezed, "block binary, blob binary"), "block")
    buckets, deal = max(-(-(blocks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // BUCKET_BYTES), C.slots(spark)), C.slots(spark)
    asked = blocks.mapInArrow(_ask(width, gram, buckets), "bucket int, block binary, hashes binary")
    answers = asked.repartitionById(deal, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(part_keys), "block binary, bucket int, part int, more binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "part", "more")).alias("answers"))
    sent = blocks.join(answers, "block", "full").select("block", "blob", "answers").mapInArrow(_pack(width, gram, buckets), "bucket int, part int, block binary, blob binary, settled binary")
    place = F.pmod(F.col("bucket") + F.col("part"), F.lit(deal)).cast("int")
    found = sent.repartitionById(deal, place).sortWithinPartitions("bucket", "part").mapInArrow(_settle(width), SETTLED)
    found = found.select("bucket", F.lit(0).alias("part"), "block", "blob", F.col("covers").alias("settled"))
    # Covers go along unchanged, so that what is found is read once and needs no checkpoint.
    place = F.pmod(F.coalesce("bucket", F.hash("block")), F.lit(deal)).cast("int")
    told = found.repartitionById(deal, place).sortWithinPartitions("bucket").mapInArrow(_settle(width), SETTLED)
    covers = told.groupBy("block").agg(F.collect_list("covers").alias("covers"))
    ddl = C.schema_of(whole, "id", "text", "rest") + ", n_words long, n_removed long, kept_text string"
    done = blocks.join(covers, "block", "full").select("blob", "covers").mapInArrow(_remove(width), ddl)
    return done.select(*[F.col("id").cast(docs.schema[c].dataType).alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns], *outputs)
