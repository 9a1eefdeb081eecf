"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text stands for each language.  A
text is parsed greedily into the longest pieces that occur in the sample; the language
that needs the fewest pieces, normalised by what its own held-back text needs, wins.
Symbols are the UTF-8 bytes of lower-cased letters, so no script or letter is left out;
each language's table has a column for each byte that its own sample holds.  The
automata become flat transition tables, so many texts are parsed in step.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Bytes of letters that make an automaton at most, and documents sampled for each language.
SAMPLE_SYMBOLS, SAMPLE_DOCS = 24_000, 96
#: Characters of a language's sampled documents together; a longer document gives a passage from a hashed place.
SAMPLE_CHARS = 400_000
#: Bytes of all tables together: with very many languages each gets a smaller automaton.  Characters sent to the driver at most.
MODEL_BYTES, MOST_CHARS = 256 << 20, 64_000_000
#: Symbols of a passage that no two documents of a fit may share.
PASSAGE = 64
#: A text is parsed in stretches of so many symbols.
STRETCH = 256
_RESTART = np.int32(1 << 30)


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of rows of UTF-8, each run of other signs one space: code points and row bounds."""
    points = _folded()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    row_at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    heads = row_at[:-1][row_at[:-1] < len(points)]
    keep[heads] = points[heads] != 32  # a row begins with a letter
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return points[keep], at[row_at]


def bytes_of(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as UTF-8 bytes, and the rows' bounds in them."""
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), at[bounds]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton of a sequence as a flat table: state * width + symbol.

    A missing transition holds the state after a restart with that symbol, marked by
    ``_RESTART``: each one met is the end of a longest piece.
    """
    most = 2 * len(symbols) + 2
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for s in symbols:
        now = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    assert len(nxt) <= most
    root = np.zeros(width, np.int32)
    for s, to in nxt[0].items():
        root[s] = to
    table = np.tile(root | _RESTART, (len(nxt), 1))
    for state, moves in enumerate(nxt):
        for s, to in moves.items():
            table[state, s] = to
    return table.ravel()


def pieces(table: np.ndarray, width: int, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many longest pieces each row's symbols are parsed into.

    Rows are parsed in stretches of ``STRETCH`` symbols, each from the start state.
    """
    size = np.diff(bounds)
    stretches = -(-size // STRETCH)
    row = np.repeat(np.arange(len(size)), stretches)
    nth = C.ranges(np.zeros(len(size), np.int64), stretches)
    start = bounds[:-1][row] + nth * STRETCH
    length = np.minimum(size[row] - nth * STRETCH, STRETCH)
    by = np.argsort(-length, kind="stable")
    start, length = start[by], length[by]
    state, count = np.zeros(len(by), np.int32), np.zeros(len(by), np.int32)
    alive = np.searchsorted(-length, -np.arange(STRETCH), "left")
    for t in range(int(length[0]) if len(by) else 0):
        n = alive[t]
        to = table[state[:n] * np.int32(width) + symbols[start[:n] + t]]
        count[:n] += to >> np.int32(30)
        state[:n] = to & np.int32(_RESTART - 1)
    return np.bincount(row[by], count + 1, len(size)).astype(np.int64)


def unlike(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Those of some texts that share no passage of ``PASSAGE`` symbols with one before; a short text counts as a passage."""
    seen, out = set(), []
    for x in parts:
        own = {x.tobytes()} if len(x) < PASSAGE else set(C.window_hashes(C.mix(x.astype(np.uint64) + np.uint64(1)), PASSAGE).tolist())
        if len(x) and seen.isdisjoint(own):
            seen |= own
            out.append(x)
    return out


class Model:
    """Languages, their automata, and the pieces a symbol of their own text needs.

    A language's sampled texts are taken in order: those of the first half make its
    automaton (``sample`` symbols at most), the rest measure its norm.
    """

    def __init__(self, texts: dict[str, list[str]], sample: int = SAMPLE_SYMBOLS, most_bytes: int = MODEL_BYTES):
        self.languages = sorted(texts)
        own_texts, self.columns = [], []
        for lang in self.languages:
            data, offsets = C.utf8(pa.array(texts[lang], pa.string()))
            symbols, bounds = bytes_of(*letters_of(data, offsets))
            own_texts.append(unlike([symbols[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]))
            seen = np.unique(symbols)
            column = np.full(256, len(seen), np.int32)  # bytes that the language hasn't shown share the last column: they end a piece
            column[seen] = np.arange(len(seen))
            self.columns.append(column)
        width = [int(c.max(initial=0)) + 1 for c in self.columns]
        sample = max(1, min(sample, most_bytes // (8 * max(1, sum(width)))))
        self.tables, self.own, self.width = [], [], width
        for parts, column, w in zip(own_texts, self.columns, width, strict=True):
            edge = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
            most = max(0, len(parts) - 1 if len(parts) < 4 else len(parts) // 2)  # the others measure the norm
            taught = min(int(np.searchsorted(edge, sample, "left")), most) if len(parts) > 1 else len(parts)
            none = np.zeros(0, np.uint8)
            table = automaton(column[np.concatenate([*parts[:taught], none])[:sample]].tolist(), w)
            rest = column[np.concatenate([*parts[taught:], none])]
            self.tables.append(table)
            self.own.append(pieces(table, w, rest, edge[taught:] - edge[taught]).sum() / len(rest) if len(rest) > STRETCH else None)
        known = [x for x in self.own if x]  # a language with too little text to tell takes the mean of the others
        self.own = [x or (sum(known) / len(known) if known else 0.3) for x in self.own]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        points, rows = letters_of(data, offsets)
        symbols, bounds = bytes_of(points, rows)
        size = np.diff(bounds)
        has = np.zeros(len(points) + 1, np.int64)
        np.cumsum(points != 32, out=has[1:])
        has = np.diff(has[rows]) > 0
        cost = np.full(len(size), np.inf), np.zeros(len(size), np.int64)
        weight = np.zeros(len(size))  # of all languages, relative to the best so far
        for k, (table, column, w, own) in enumerate(zip(self.tables, self.columns, self.width, self.own, strict=True)):
            now = pieces(table, w, column[symbols], bounds) / own / np.maximum(size, 1)
            better = now < cost[0]
            least = np.where(better, now, cost[0])
            with np.errstate(invalid="ignore"):
                weight = np.where(np.isinf(cost[0]), 0.0, weight * np.exp(-8 * np.where(better, cost[0] - least, 0.0))) + np.exp(-8 * (now - least))
            cost = least, np.where(better, k, cost[1])
        langs = self.languages or ["und"]
        has &= len(self.languages) > 0
        return [langs[b] if h else "und" for b, h in zip(cost[1].tolist(), has.tolist(), strict=True)], np.where(has, 1 / np.maximum(weight, 1e-300), 0.0)


@functools.lru_cache(maxsize=2)
def _model(packed: tuple) -> Model:
    return Model({lang: list(texts) for lang, texts in packed})


def _predict(sent):
    def run(batches):
        model = _model(sent.value)
        for batch in batches:
            for part, data, offsets in C.chunks([batch], limit=C.CHUNK_BYTES // 2):
                langs, score = model.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def _sampled(train: DataFrame, sample_docs: int, sample_chars: int) -> dict[str, list[str]]:
    """Each language's sampled texts, in order of their hashes."""
    h = F.xxhash64("text", F.lit(5))
    texts_of = train.groupBy("lang", h.alias("h")).agg(F.min("id").alias("id"), F.max(F.char_length("text")).alias("n"))  # equal texts teach once
    w = Window.partitionBy("lang").orderBy("h")
    near = texts_of.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample_docs)
    size = F.least("n", F.lit(sample_chars))
    near = near.withColumn("before", F.sum(size).over(w) - size).where(F.col("before") < sample_chars).select("lang", "h", "id").checkpoint()
    languages = near.select("lang").distinct().count()
    share = max(200, min(sample_chars, MOST_CHARS // max(1, languages)))
    picked = train.withColumn("h", h).join(F.broadcast(near), ["lang", "h", "id"], "left_semi")  # sample_docs rows a language at most
    # a text longer than the whole sample gives a passage that begins at a hashed place
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - share + 1, F.lit(1))).cast("int") + 1
    texts: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    rows = picked.select("lang", "h", F.substr("text", start, F.lit(share)).alias("text")).dropDuplicates(["lang", "h"])
    rows = rows.withColumn("n", F.char_length("text")).withColumn("before", F.sum("n").over(w) - F.col("n")).where(F.col("before") < share)
    for r in rows.orderBy("lang", "h").select("lang", "text").toLocalIterator():  # MOST_CHARS characters, or 200 a language, and one text more of each
        room = left.get(r["lang"], share)
        if room > 0:
            texts.setdefault(r["lang"], []).append(r["text"][:room])
            left[r["lang"]] = room - len(r["text"])
    return texts


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row with an id.

    held_out: a Column; rows where it is true teach nothing.  Each language learns from a
    bounded sample of its distinct texts: those of least hash, ``sample_docs`` of them and
    ``sample_chars`` characters together at most (the text that reaches the bound is taken in
    part; a longer text gives a passage from a hashed place).  Texts that share a passage with
    one before are left out; ``SAMPLE_SYMBOLS`` symbols of the first half at most make the
    automaton, the rest measure its norm.  With so many languages that tables would pass
    ``MODEL_BYTES`` together, each automaton is smaller; no language is left out.  Every text
    is parsed whole, in stretches of ``STRETCH`` symbols.  A text without letters (null,
    empty) is ``und`` with score 0, as is every text if nothing is labelled.  Ties go to the
    language first by name.  A repeated row gives a repeated row.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(True)).alias("held_out")).where("id is not null")
    texts = _sampled(whole.where("not held_out and lang is not null and text is not null"), sample_docs, sample_chars)
    sent = spark.sparkContext.broadcast(tuple((lang, tuple(own)) for lang, own in sorted(texts.items())))  # MOST_CHARS characters, as above
    done = whole.select("id", "text", "held_out").mapInArrow(_predict(sent), "id long, held_out boolean, lang_pred string, score double")
    return done.withColumnRenamed("id", id_col)
