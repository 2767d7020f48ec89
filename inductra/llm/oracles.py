"""The queries that SQL can express, for DuckDB over the base tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"

# Windows are lists of words; a document's windows of each size that items have are compared with them.
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, n, w[i : i + n - 1] AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
windows AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM windows JOIN wanted USING (n, win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

# Bytes as hex digits; starts of repeated windows become stretches, and what lies between them is kept.
SUFFIX_DEDUP = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM docs WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
repeated AS (SELECT w.doc_id, w.p FROM windows w JOIN firsts f ON f.s = w.s WHERE f.first_doc < w.doc_id),
marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh
  FROM repeated),
stretches AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (
  SELECT s.doc_id, s.a, s.b, substr(d.h, 2 * coalesce(lag(s.b) OVER o, 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER o, 0))) AS kept
  FROM stretches s JOIN docs d ON d.doc_id = s.doc_id WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.a)),
cut AS (
  SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.kept || substr(d.h, 2 * c.b + 1), d.h))) AS kept_sha256
FROM docs d LEFT JOIN cut c ON c.doc_id = d.doc_id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i : i + 4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of m ON m.a = d.doc_id"""

WARC = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
tops AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS top FROM bodies),
judged AS (SELECT *, strlen(body) >= 1000 AND page_id IS DISTINCT FROM top AS revisit FROM tops)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN top END AS refers_to
FROM judged"""

ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op7_suffix_dedup": SUFFIX_DEDUP,
    "op8_jaccard_join": JACCARD_JOIN,
    "op11_warc": WARC,
}
