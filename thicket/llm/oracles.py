"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

The others (learned models, fingerprints, encodings, packing) are tested against
brute-force versions, round trips or held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# words lower-cased in A-Z only
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
ids AS MATERIALIZED (SELECT id, len(s) AS n FROM s),
g AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
f AS MATERIALIZED (SELECT g.*, row_number() OVER (PARTITION BY id ORDER BY df, t) AS rk FROM (SELECT g.*, count(*) OVER (PARTITION BY t) AS df FROM g) g),
p AS MATERIALIZED (SELECT * FROM f WHERE rk <= n - ceil(n * 0.85) + 1),
c AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b, x.n AS n, y.n AS m FROM p x JOIN p y ON x.t = y.t AND x.id < y.id WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
l AS MATERIALIZED (SELECT a, b FROM c JOIN g x ON x.id = a JOIN g y ON y.id = b AND y.t = x.t GROUP BY a, b, c.n, c.m HAVING 100 * count(*) >= 85 * (c.n + c.m - count(*))),
links AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT id, id AS least FROM ids UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.id WHERE reach.least < links.b)
SELECT ids.id AS doc_id, any_value(n) AS n_shingles, min(least) AS component_id, min(least) = ids.id AS kept FROM ids JOIN reach USING (id) GROUP BY ids.id"""

_OP3 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
f AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93e0),
reach AS (SELECT id, id AS least FROM v UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.id WHERE reach.least < links.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(least) AS component_id, min(least) = v.id AS kept FROM v JOIN reach USING (id) LEFT JOIN n ON n.a = v.id GROUP BY v.id"""

_OP7 = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, len(w) AS n FROM w WHERE len(w) >= 20),
h AS MATERIALIZED (SELECT s.doc_id, k, sha1(array_to_string(w[k:k + 19], ' ')) AS h FROM s JOIN w USING (doc_id)),
d AS MATERIALIZED (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS rn FROM h) WHERE rn > 1),
g AS MATERIALIZED (SELECT DISTINCT doc_id, k + o AS at FROM d, range(20) t(o)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM w),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.at) FILTER (g.at IS NULL) AS t, count(g.at) AS gone FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.at = a.at GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_HEX5 = "CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)"
_OP10 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
k AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_HEX5} >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM k"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Leftmost matches with their places: sums of the lengths between and of the matches."""
    q = pattern.replace("'", "''")
    return f"""
SELECT doc_id, source, {order} AS ord, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s, length(whole[i]) AS len, val[i] AS val
FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, source, regexp_split_to_array(t, '{q}') AS gaps, regexp_extract_all(t, '{q}', 0) AS whole, regexp_extract_all(t, '{q}', {group}) AS val FROM docs)) WHERE length(val[i]) >= {least}"""


_OP5 = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
raw AS MATERIALIZED ({_spans("assign", 0, r'''(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 1, 8)}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]{12,}", 0, 16)}
UNION ALL {_spans("hex", 2, "[0-9a-f]{32,}", 0, 32)}
UNION ALL SELECT * FROM ({_spans("mixed", 3, "[A-Za-z0-9+/_-]{20,}", 0, 20)}) WHERE regexp_matches(val, '[0-9]')),
own AS (SELECT val, count(DISTINCT split_part(source, '/', 1)) AS k FROM raw GROUP BY val),
r AS (SELECT raw.*, s + len AS e, k <= 2 AS live FROM raw JOIN own USING (val)),
added AS (SELECT * FROM r WHERE ord = 3 AND live AND NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = r.doc_id AND b.ord < 3 AND b.s < r.e AND r.s < b.e)),
everything AS (SELECT * FROM r WHERE ord < 3 UNION ALL SELECT * FROM added),
o AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (ord < 3 AND live) AS n_live,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS spans FROM everything GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM docs LEFT JOIN o USING (doc_id)"""


def oracles() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": _OP1,
        "op3_embedding_near_dedup": _OP3,
        "op5_secret_scan": _OP5,
        "op7_substring_dedup": _OP7,
        "op10_content_addressed_warc": _OP10,
    }
