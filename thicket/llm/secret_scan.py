"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give spans with their places; long mixed strings are candidates too.  Hashes
of all values are counted by distinct repositories and by distinct owners over the whole
corpus: a value that many owners hold is a copied example, one that few hold, in however
many repositories of theirs, looks like a live credential.  Candidates that look live are
added to the patterns' spans.  Places are running sums over a document's matches, so the
work grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Kinds in the order they are listed: (name, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Strings of 20 or more with a digit, from where they begin.
MIXED = ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}", 0, 20)
#: Owners that may hold a value that still looks live.
MOST_OWNERS = 2


def _matches(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that don't overlap, in order: what lies before each (its characters and bytes), its own
    size, and a digest of its value (null if that is too short)."""
    rx = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, rx, F.lit(0)).alias("whole"), F.regexp_extract_all(text, rx, F.lit(group)).alias("value"))

    def told(p):
        gap, value = lambda i: F.get(p["gaps"], i), lambda i: F.get(p["value"], i)
        digest = lambda i: F.when(F.char_length(value(i)) >= least, F.sha1(value(i).cast("binary")))
        sizes = lambda m, i: [F.char_length(gap(i)).alias("gap"), F.octet_length(gap(i)).alias("gap_bytes"), F.char_length(m).alias("size"), F.octet_length(m).alias("bytes")]
        return F.transform(p["whole"], lambda m, i: F.struct(F.lit(order).alias("ord"), i.alias("nth"), *sizes(m, i), digest(i).alias("value")))

    kind = "array<struct<ord:int,nth:int,gap:int,gap_bytes:int,size:int,bytes:int,value:string>>"
    return F.when(F.regexp_like(text, rx), F.transform(F.array(parts), told)[0].cast(kind)).otherwise(F.array().cast(kind))


def owner_of(repository: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repository, "/", 1)


def _hits(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str | None) -> DataFrame:
    """id, tkey, repository, owner, matches of all kinds: one scan of the texts."""
    repository = F.coalesce(F.col(repository_col).cast("string"), F.lit(""))
    owner = owner_of(repository) if owner_col is None else F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), repository.alias("repository"), owner.alias("owner"))
    found = F.concat(*[_matches(F.col("text"), k, *spec[1:]) for k, spec in enumerate((*BASE, MIXED))])
    return rows.select("id", F.xxhash64("text").alias("tkey"), "repository", "owner", found.alias("found"))


_SPANS = "array<struct<start:int,ord:int,kind:string,end:int,value:string,repositories:bigint,owners:bigint,live:boolean,from:int,to:int,after:int>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """(id, tkey, base, added): arrays of spans (start, ord, kind, end, value, repositories, owners, live, from, to, after), in order.

    base: matches of ``BASE``; added: live-looking ``MIXED`` strings outside them.  start and
    end count code points, end excluded; from and to count bytes, and after is the byte at
    which the spans before end (0 before the first).  value is a SHA-1.  repositories and
    owners: how many distinct ones hold the value (null ones count as one); owners are in
    ``owner_col`` or, without it, the part of the repository's name before its first slash.
    live: at most ``most_owners`` owners hold it.  tkey is a hash of the text.  Null texts are
    empty and have no spans; rows with a null id are left out; a repeated row gives a repeated
    row, whose values count once for its repository.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    C.prepare(docs.sparkSession)
    hits = _hits(docs, id_col, text_col, repository_col, owner_col).withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    each = hits.where(F.size("found") > 0).select("rid", "repository", "owner", F.inline("found"))
    before = Window.partitionBy("rid", "ord").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)

    def place(gap, size):
        return F.coalesce(F.sum(F.col(gap) + F.col(size)).over(before), F.lit(0)).cast("int") + F.col(gap)

    placed = each.withColumn("start", place("gap", "size")).withColumn("from", place("gap_bytes", "bytes")).where("value is not null")
    placed = placed.select("rid", "repository", "owner", "ord", "value", "start", (F.col("start") + F.col("size")).alias("end"), "from", (F.col("from") + F.col("bytes")).alias("to")).checkpoint()
    held = placed.groupBy("value", "owner", "repository").agg(F.count("*").alias("n")).groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    owners = held.groupBy("value").agg(F.sum("r").alias("repositories"), F.count("*").alias("owners"), F.sum("n").alias("n")).checkpoint()
    marked = C.spread_join(placed, owners.drop("n"), ["value"], C.hot_keys(owners, ["value"], "n"), ["rid"])
    marked = marked.withColumn("live", F.col("owners") <= most_owners)
    base = F.col("ord") < len(BASE)
    w = Window.partitionBy("rid").orderBy("start", "ord")
    reach = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("ord"))  # a frame up to the partition's end would be gone over for every row
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    kept = marked.withColumn("apart", apart).where(base | (F.col("live") & F.col("apart")))
    kept = kept.withColumn("after", F.coalesce(F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kinds = F.array(*[F.lit(k) for k, *_ in (*BASE, MIXED)])
    span = F.struct("start", "ord", kinds[F.col("ord")].alias("kind"), "end", "value", "repositories", "owners", "live", "from", "to", "after")
    spans = kept.groupBy("rid").agg(F.array_sort(F.collect_list(span)).cast(_SPANS).alias("spans"))
    joined = hits.select("rid", "id", "tkey").join(spans, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    own = lambda wanted: F.filter("spans", lambda s: (s["ord"] < len(BASE)) if wanted else (s["ord"] == len(BASE)))
    return joined.select("id", "tkey", own(True).alias("base"), own(False).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", mask: str = "[SECRET]", owner_col: str | None = None) -> DataFrame:
    """docs with every span (base and added) replaced by ``mask``; overlapping spans by one.

    Rows without spans, null texts and rows with a null id come back as they are; rows of one
    id with different texts are masked each by its own spans.
    """
    found = find_secrets(docs, id_col, text_col, repository_col, owner_col)
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select("id", "tkey", F.array_sort(F.concat("base", "added")).alias("spans")).dropDuplicates(["id", "tkey"])
    text = F.col(f"d.`{text_col}`")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    joined = docs.alias("d").join(spans.alias("s"), (F.col(f"d.`{id_col}`").cast("long") == F.col("s.id")) & (key == F.col("s.tkey")), "left")
    raw, spans = text.cast("binary"), F.col("s.spans")

    def piece(start, end=None):
        return F.substring(raw, start + 1, F.octet_length(raw) if end is None else end - start).cast("string")

    cut = F.transform(spans, lambda s: F.when(s["from"] >= s["after"], F.concat(piece(s["after"], s["from"]), F.lit(mask))).otherwise(F.lit("")))
    last = F.element_at(spans, -1)
    masked = F.concat(F.array_join(cut, ""), piece(F.greatest(last["after"], last["to"])))
    return joined.select(*[F.when(spans.isNull(), text).otherwise(masked).alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns])
