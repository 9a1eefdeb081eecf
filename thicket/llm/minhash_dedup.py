"""Near-duplicate documents by MinHash.

One-permutation hashing: each distinct word shingle is hashed once, the hash's
high part names its bin and each bin keeps its least hash; empty bins borrow from
a bin that optimal densification picks.  Bands of bins give buckets.  Documents
with equal shingle sets are one class from the start, so copies never meet as
pairs.  Within a bucket, candidate edges form a star around one class.  Edges are
confirmed on the full sets of the shingles' words, not of their hashes.  Where a bucket still holds several components
after the stars, pairs between its components that share a rare shingle are
confirmed too, so that no link is lost to the choice of a centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Salted copies of a star's centre take so many members each; documents of a shingle that meet in one task.
MEMBERS_PER_COPY, PER_TOKEN = 1024, 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = 0) -> list[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its lower-cased word shingles.

    With fewer words than ``shingle``, the whole sequence is the one shingle; without
    words there is none.
    """
    starts, ends, first = C.word_spans(data, offsets)
    words = C.word_hashes(data, starts, ends, lower=True, seed=seed)
    windows = C.window_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(windows[a : b - shingle + 1]))
        elif b > a:
            out.append(C.window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _borrowing(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin, the order in which it looks at other bins while it is empty."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (C.mix(at) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set of hashes, empty bins densified."""
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(where, return_index=True)
    own = np.zeros(bins, np.uint64)
    own[filled] = hashes[first]
    has = np.zeros(bins, bool)
    has[filled] = True
    empty = np.flatnonzero(~has)
    if len(empty):
        looks = has[order[empty]]
        got = looks.any(1)
        pick = order[empty, looks.argmax(1)]
        # beyond the tries, the next filled bin in a circle
        after = filled[np.searchsorted(filled, empty) % len(filled)]
        own[empty] = own[np.where(got, pick, after)]
    return own


def _features(shingle: int, bins: int, rows: int):
    order, bands = _borrowing(bins), bins // rows
    salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for part, data, offsets in C.chunks(batches):
            n, h1, h2, sig = [], [], [], []
            for s, t in zip(shingle_sets(data, offsets, shingle), shingle_sets(data, offsets, shingle, 1), strict=True):
                n.append(len(s))
                h1.append(int(C.mix(s).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(C.mix(t).sum(dtype=np.uint64).view(np.int64)))
                sig.append((C.window_hashes_2d(signature(s, bins, order).reshape(bands, rows)) ^ salt).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["id", "tkey", "n", "h1", "h2", "bands"])

    return run


def _words(batches):
    """Texts to their lower-cased words with one space after each: (id, s)."""
    for part, data, offsets in C.chunks(batches):
        starts, ends, first = C.word_spans(data, offsets)
        text, begin = C.spaced(C.LOWER[data], starts, ends)
        text, bounds = text.tobytes(), begin[first].tolist()
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "s"])


def _tokens(shingle: int):
    """A row for each shingle of (s, id, comp), with the number of shingles."""

    def run(batches):
        for part, data, offsets in C.chunks(batches, "s"):
            for own, i, comp in zip(shingle_sets(data, offsets, shingle), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), v), pa.int64()) for v in (i, comp, len(own))] + [pa.array(own.view(np.int64))], names=["id", "comp", "n", "token"])

    return run


def shared_shingles(texts: list[bytes], centre: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, how many distinct shingles it has and how many of them its centre (a text's number) has too.

    Words are numbered by their bytes and shingles by their words' numbers, so nothing rests on a hash.
    """
    data, offsets = C.utf8(pa.array(texts, pa.binary()))
    starts, ends, first = C.word_spans(data, offsets)
    words = C.word_numbers(data, starts, ends)
    names = words
    for k in range(1, shingle):  # a run of k + 1 words is numbered by the run of k and its last word
        names = np.unique(names[: max(0, len(words) - k)] << 32 | words[k:], return_inverse=True)[1]
    size = np.diff(first)
    row = np.repeat(np.arange(len(texts)), np.maximum(0, size - shingle + 1))
    name = names[C.ranges(first[:-1], np.maximum(0, size - shingle + 1))]
    short = np.flatnonzero((size > 0) & (size < shingle))
    known: dict[bytes, int] = {}
    whole = [len(words) + known.setdefault(words[first[k] : first[k + 1]].tobytes(), len(known)) for k in short.tolist()]
    keys = np.unique(np.append(row, short) << 32 | np.append(name, np.array(whole, np.int64)))
    row, name = keys >> 32, keys & 0xFFFFFFFF
    both = np.isin(centre[row] << 32 | name, keys, kind="sort")
    return np.bincount(row, minlength=len(texts)), np.bincount(row[both], minlength=len(texts))


def _confirm(percent: int, shingle: int):
    """Streams rows sorted by centre, copy and role: each copy of a centre, then its members."""

    def settled(ids, texts, of):
        n, both = shared_shingles(texts, np.array(of), shingle)
        of = np.array(of)
        fine = (of != np.arange(len(of))) & (100 * both >= percent * (n + n[of] - both)) & (both > 0)
        ids = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[fine]), pa.array(ids[of[fine]])], names=["a", "b"])

    def run(batches):
        ids, texts, of, size, key, own = [], [], [], 0, None, []
        for batch in batches:
            for c, salt, role, i, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (c, salt) != key:
                    key, own = (c, salt), []  # the centre's texts: one, unless its id is repeated
                if role == 0:
                    own.append((len(ids), s))
                for k in [len(ids)] if role == 0 else [k for k, _ in own]:
                    ids.append(i)
                    texts.append(s)
                    of.append(k)
                    size += len(s)
                if role == 1 and size > C.CHUNK_BYTES:
                    yield settled(ids, texts, of)
                    ids, texts, of = [c] * len(own), [s for _, s in own], list(range(len(own)))  # the centre may have more members
                    own = list(enumerate(texts))
                    size = sum(map(len, texts))
        if ids:
            yield settled(ids, texts, of)

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Of candidate pairs (a, c) of ids, those similar on their full sets of shingles: (a, b).

    Each a is shipped once per pair; each c once per ``MEMBERS_PER_COPY`` of its
    pairs, so a centre with very many members is spread over tasks.  pairs: checkpointed.
    """
    counted = pairs.groupBy("c").agg(F.count("*").alias("n"))
    copies = counted.select("c", F.ceil(F.col("n") / MEMBERS_PER_COPY).cast("int").alias("copies"))
    routed = C.spread_join(pairs, copies, ["c"], C.hot_keys(counted, ["c"], "n"), ["a"])
    routed = routed.select("c", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("id"))
    centres = copies.select("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("c").alias("id"))
    dealt = routed.unionByName(centres).join(texts, "id").select("c", "salt", "role", "id", "s")
    return dealt.repartition(C.slots(texts.sparkSession), "c", "salt").sortWithinPartitions("c", "salt", "role", "id").mapInArrow(_confirm(percent, shingle), "a long, b long")


def _sized(x, y, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def across_components(texts: DataFrame, placed: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Candidate pairs (a, c) between different components of the buckets in ``placed``.

    Only documents of buckets that hold several components take part.  A pair similar
    enough shares one of the rarest shingles of either document (prefix filtering,
    with shingles ordered by their frequency among these documents), and enough
    shingles follow the first one shared; documents that only share common passages
    don't meet.  A shingle that very many of them have rare is dealt in blocks of documents.
    """
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = placed.join(mixed, "key").select("rep", "comp").distinct()
    tokens = texts.join(left, texts.id == left.rep).select("s", "id", "comp").mapInArrow(_tokens(shingle), "id long, comp long, n long, token long").checkpoint()
    common = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).checkpoint()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    ranked = C.spread_join(tokens, common, ["token"], C.hot_keys(common, ["token"], "df"), ["id"]).withColumn("rank", rank)
    prefix = ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1) & (F.col("lo") < F.col("hi")))
    prefix = prefix.select("token", "id", "comp", "n", (F.col("n") - F.col("rank")).alias("after")).checkpoint()
    held = prefix.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").checkpoint()
    blocks = held.select("token", F.ceil(F.col("held") / PER_TOKEN).cast("int").alias("blocks"))
    sized = C.spread_join(prefix, blocks, ["token"], C.hot_keys(held, ["token"], "held"), ["id"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = sized.select("token", own.alias("i"), each.alias("j"), "id", "comp", "n", "after")
    y = sized.select("token", each.alias("i"), own.alias("j"), "id", "comp", "n", "after")
    most = 1 + F.least("x.after", "y.after")
    pairs = x.alias("x").join(y.alias("y"), ["token", "i", "j"]).where((F.col("x.comp") < F.col("y.comp")) & _sized(F.col("x.n"), F.col("y.n"), percent) & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("c")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bins: int = 96, rows: int = 4) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, text_key) for every row with an id; text_key is a hash of the text.

    Two documents are linked if 100 * shared shingles >= percent * shingles of either.
    component_id is the least id reachable by links.  Documents are compared if they share
    a band of ``rows`` bins out of ``bins``: with the defaults, two that are just similar
    enough (of many shingles) share none with a chance of 3e-6 at 80 percent and 2e-8 at 85;
    a link is confirmed on the shingles themselves.  Documents whose whole sets have equal
    128-bit hashes and sizes are one from the start.  Rows with a null id are left
    out; null and empty texts have no shingles and link with nothing, as do texts of
    separators only.  Equal texts under different ids are linked; a repeated row gives a repeated row,
    and rows of one id with different texts are judged each by its own.  Extra columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    keyed = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
    features = keyed.mapInArrow(_features(shingle, bins, rows), "id long, tkey long, n long, h1 long, h2 long, bands array<long>").checkpoint()
    classes = features.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("centre")).where("size > 1")
    members = keys.join(buckets, "key").select("key", "rep", "n", "centre").checkpoint()

    sets = docs.join(members.select(F.col("rep").alias("id")).distinct(), "id").select("id", "text").mapInArrow(_words, "id long, s binary").checkpoint()
    stars = members.where((F.col("rep") != F.col("centre.rep")) & _sized(F.col("n"), F.col("centre.n"), percent)).select(F.col("rep").alias("a"), F.col("centre.rep").alias("c")).distinct().checkpoint()
    links = confirmed(sets, stars, percent, shingle).checkpoint()
    found = components(links, "a", "b")
    placed = members.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")).checkpoint()
    rest = across_components(sets, placed, percent, shingle).join(stars, ["a", "c"], "left_anti").checkpoint()
    found = components(links.unionByName(confirmed(sets, rest, percent, shingle)), "a", "b")
    reps = classes.select("h1", "h2", F.col("n").alias("n_"), "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n_", F.coalesce("component", "rep").alias("comp"))
    placed = features.select("id", "tkey", "n", "h1", "h2").join(reps.withColumnsRenamed({"h1": "r1", "h2": "r2"}), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("n") == F.col("n_")) & (F.col("n") > 0), "left")
    component = F.coalesce("comp", "id")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"), F.col("tkey").alias("text_key"))
