"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP10 = f"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT row_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10
), per_doc AS (
  SELECT row_id, count(*) AS n_lines, count(f.k) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '') AS kept
  FROM keyed LEFT JOIN frequent f USING (k) GROUP BY row_id
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM per_doc JOIN doc USING (row_id)
"""

OP8 = """
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digested AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM page
), led AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS lead FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NULL OR page_id IS NOT DISTINCT FROM lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM led
"""

OP2 = """
WITH code AS (
  SELECT vec_id, list_transform(embedding, lambda x: (coalesce(x, 0) > 0)::INT) AS bits FROM embeddings WHERE embedding IS NOT NULL
), pair AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: (p[1] <> p[2])::INT))::INT AS distance
  FROM (SELECT DISTINCT * FROM code WHERE vec_id % 100 = 0) q, code r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id NULLS LAST)::INT AS rank FROM pair
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

OP1 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))) END AS s FROM doc
), class AS (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s
), post AS (
  SELECT id, n, unnest(s) AS shingle FROM class
), link AS (
  SELECT a.id AS x, b.id AS y FROM post a JOIN post b ON a.shingle = b.shingle AND a.id <> b.id
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(x, y) AS (
  SELECT id, id FROM class UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), least_of AS (
  SELECT x AS id, min(y) AS component FROM reach GROUP BY x
)
SELECT doc_id, len(shingled.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
FROM shingled LEFT JOIN class ON class.s = shingled.s LEFT JOIN least_of USING (id)
"""

ORACLES = {"op1_jaccard_join": OP1, "op2_hamming_topk": OP2, "op8_warc": OP8, "op10_line_dedup": OP10}
