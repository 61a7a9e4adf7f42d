"""DuckDB SQL for the driver-table queries."""

from __future__ import annotations

_STATS = """stats AS (
  SELECT doc_id, source, lang, text, ls, len(ls)::BIGINT AS total, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = ''))::BIGINT AS blank,
         len(list_filter(ls, lambda x: starts_with(trim(x, ' ' || chr(9) || chr(13)), '#')))::BIGINT AS comment
  FROM (SELECT *, CASE WHEN length(text) > 0 THEN string_split_regex(text, '\\r\\n|\\n') ELSE [] END AS ls FROM documents)
)"""
_SECRET = r"(?i)(secret|token)\s*[:=]\s*[\"''][^\"'']{8,}[\"'']"
_KEY = r"(?i)(api_?key|apikey)\s*[:=]\s*[\"''][^\"'']{8,}[\"'']"
_PASS = r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"''][^\"'']+[\"'']"
_SCAN = f"""line AS (
  SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r\\n|\\n'), 1)::INT AS line FROM documents
), hit AS (
  SELECT doc_id, line, 'SEC001' AS code, 'High' AS severity FROM line WHERE regexp_matches(t, '{_KEY}')
  UNION ALL SELECT doc_id, line, 'SEC002', 'Critical' FROM line WHERE regexp_matches(t, '{_PASS}')
  UNION ALL SELECT doc_id, line, 'SEC003', 'High' FROM line WHERE regexp_matches(t, '{_SECRET}')
  UNION ALL SELECT doc_id, line, 'SEC030', 'Medium' FROM line WHERE regexp_matches(t, '(?i)http://') AND NOT regexp_matches(t, '(?i)http://(localhost|127\\.0\\.0\\.1)')
)"""
_SUPPLY = """e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
d AS (SELECT node, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)"""
_GEO = """e AS (SELECT n_regionkey::BIGINT + 1000000000 AS src, n_nationkey::BIGINT + 500000000 AS dst FROM nation UNION ALL SELECT c_nationkey::BIGINT + 500000000, c_custkey FROM customer)"""
_RING = """e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"""
_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
_BLOCK = "upper(substr(sha256({}), 1, 32))"

ORACLES: dict[str, str] = {
    "line_stats": f"WITH {_STATS} SELECT doc_id, total, blank, comment, total - blank - comment AS code, len(list_filter(ls, lambda x: length(x) < 40))::BIGINT AS short FROM stats",
    "file_rollup": f"WITH {_STATS} SELECT source, count(*) AS files, sum(total)::BIGINT AS lines, round(avg(total), 6) AS avg_lines, max(total) AS max_lines FROM stats GROUP BY source",
    "project_rollup": f"WITH {_STATS}, f AS (SELECT lang, source, avg(total) AS m FROM stats GROUP BY ALL) SELECT lang, round(avg(m), 6) AS avg_of_avgs, count(*) AS groups FROM f GROUP BY lang",
    "maintainability": f"""WITH {_STATS}, v AS (SELECT doc_id, len(string_split(text, ','))::BIGINT AS cc, greatest(total - blank - comment, 1)::DOUBLE AS loc FROM stats)
        SELECT doc_id, cc, round(greatest(0.0, least(100.0, (171.0 - ln(greatest(loc * ln(loc), 1.0)) * 5.2 - (cc * 0.7) * 0.23 - ln(loc) * 16.2) * 100.0 / 171.0)), 6) AS mi FROM v""",
    "dup_exact": f"""WITH g AS (SELECT {_BLOCK.format("lower(trim(text))")} AS hash, count(*) AS instances, count(DISTINCT source) AS files FROM documents GROUP BY 1 HAVING count(*) >= 2)
        SELECT *, CASE WHEN files <= 1 THEN 'ExtractMethod' WHEN files = 2 THEN 'ExtractToBase' ELSE 'CreateUtilityFunc' END AS suggestion FROM g""",
    "dup_line_blocks": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM d)
        SELECT {_BLOCK.format("array_to_string(l[s:s+2], chr(10))")} AS hash, count(*) AS instances FROM b GROUP BY 1 HAVING count(*) >= 2""",
    "dup_similar_classes": r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(lower(trim(text)), '[\s\x0B]+', ' ', 'g')) AS class_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
    "dup_instances_merged": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, unnest(range(1, len(l))) AS s FROM d),
        h AS (SELECT doc_id, s, array_to_string(l[s:s+1], chr(10)) AS t FROM b), k AS (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM h),
        m AS (SELECT doc_id, s, s + 1 AS e FROM k WHERE c >= 2),
        n AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
        SELECT doc_id, min(s)::INT AS start, max(e)::INT AS "end", count(*) AS n FROM i GROUP BY doc_id, island""",
    "dup_baseline_diff": """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents), a AS (SELECT DISTINCT t FROM l WHERE lang = 'de'), b AS (SELECT DISTINCT t FROM l WHERE lang = 'fr')
        SELECT CASE WHEN b.t IS NULL THEN 'new' WHEN a.t IS NULL THEN 'fixed' ELSE 'kept' END AS status, count(*) AS n FROM a FULL JOIN b ON a.t = b.t GROUP BY 1""",
    "secrets_scan": f"WITH {_SCAN} SELECT * FROM hit",
    "severity_pivot": f"""WITH {_SCAN} SELECT code, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high,
        count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low FROM hit GROUP BY code""",
    "insecure_url": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)http://') AND NOT regexp_matches(url, '(?i)http://(localhost|127\\.0\\.0\\.1)')",
    "suppression_filter": """WITH s AS (SELECT event_id, user_id, event_type, last_value(CASE event_type WHEN 'click' THEN 'off' WHEN 'view' THEN 'on' END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM events)
        SELECT event_id, user_id FROM s WHERE event_type = 'error' AND coalesce(state, 'on') = 'on'""",
    "regex_name_filter": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^.*wid.et$') AND regexp_matches(p_name, '(?i)^(red|blue)')",
    "glob_path_filter": f"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE regexp_matches(path, '(?i)^en/[^/]*$') OR regexp_matches(path, '(?i)^de(/.*)?$') OR regexp_matches(path, '(?i)^(?:.*/)?7[^/][^/]$')",
    "sorted_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "topk_per_group": "SELECT l_suppkey, rank, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM lineitem) WHERE rank <= 5",
    "fan_in_out": f"WITH {_SUPPLY} SELECT * FROM d",
    "coupling": f"WITH {_SUPPLY} SELECT node, fan_in + fan_out AS coupling, round(fan_out / (fan_in + fan_out), 6) AS instability FROM d",
    "dir_rollup": f"SELECT string_split({_PATH}, '/')[1] AS dir, count(*) AS files, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
    "closure": f"WITH RECURSIVE {_GEO}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
    "topo_level": f"""WITH RECURSIVE {_GEO}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.node = e.src)
        SELECT node, max(level)::BIGINT AS level FROM r GROUP BY node""",
    "cycle_flag": f"WITH RECURSIVE {_RING} SELECT DISTINCT src AS node FROM r WHERE src = dst",
    "strong_components": f"""WITH RECURSIVE {_RING}, b AS (SELECT r.src, min(r.dst) AS m FROM r JOIN r q ON r.src = q.dst AND r.dst = q.src GROUP BY r.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
        SELECT node, least(node, coalesce(m, node)) AS component FROM n LEFT JOIN b ON node = src""",
    "unused_entities": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_used": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "missing_targets": f"""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS path FROM pages) SELECT path, count(*) AS n FROM l WHERE path <> '' AND path NOT IN (SELECT {_PATH} FROM pages) GROUP BY path""",
    "liveness_cascade": """WITH u AS (SELECT l_partkey, bool_or(l_quantity >= 50 AND l_returnflag = 'R') AS called FROM lineitem WHERE l_quantity >= 45 GROUP BY 1), s AS (SELECT * FROM part LEFT JOIN u ON p_partkey = l_partkey), b AS (SELECT p_brand, count(called) AS peers FROM s GROUP BY 1)
        SELECT p_partkey, CASE WHEN called THEN 'Strict' WHEN called IS NOT NULL THEN 'Potential' WHEN peers > 0 THEN 'NameMatch' ELSE 'Dead' END AS verdict FROM s JOIN b USING (p_brand)""",
    "relational_division": """WITH s AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), q AS (SELECT c_mktsegment FROM s WHERE c_nationkey = 0)
        SELECT c_nationkey FROM s JOIN q USING (c_mktsegment) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM q)""",
    "set_union_types": "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') AS types FROM customer GROUP BY 1",
    "consensus": "SELECT o_custkey, min(o_orderstatus) AS value, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1",
    "name_lookup_priority": """WITH a AS (SELECT r_name AS s, 0 AS rank, r_regionkey::BIGINT AS id FROM region UNION ALL SELECT n_name, 1, n_nationkey FROM nation UNION ALL SELECT s_name, 2, s_suppkey FROM supplier UNION ALL SELECT c_name, 3, c_custkey FROM customer),
        k AS (SELECT try_cast(regexp_extract(s, '[0-9]+$') AS INT)::VARCHAR AS name, rank, id FROM a)
        SELECT name, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, id) AS n FROM k WHERE name IS NOT NULL) WHERE n = 1""",
    "theta_filter_join": """SELECT kind, value, count(*) AS n FROM part, (VALUES ('begins', 'red'), ('ends', 'ring'), ('contains', 'wid')) v(kind, value)
        WHERE (kind = 'begins' AND starts_with(p_name, value)) OR (kind = 'ends' AND ends_with(p_name, value)) OR (kind = 'contains' AND contains(p_name, value)) GROUP BY ALL""",
    "fuzzy_match": """WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name, b.p_name AS candidate, levenshtein(a.p_name, b.p_name)::INT AS distance FROM n a, n b)
        SELECT p_name, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY distance, candidate) AS r FROM p WHERE distance BETWEEN 1 AND 3) WHERE r <= 3""",
    "self_join_same_key": "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2",
    "interval_containment": """WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
        SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN s USING (o_custkey) WHERE l_shipdate BETWEEN a AND b GROUP BY 1""",
    "equal_runs": """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT user_id, run, event_type, count(*) AS n FROM i GROUP BY ALL)
        SELECT user_id, event_type, count(*) AS runs, max(n) AS longest FROM g WHERE n >= 3 GROUP BY ALL""",
    "order_violations": "SELECT user_id, count(*) AS n FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE value < m GROUP BY 1",
    "useless_assignment": "SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE event_type = 'click' AND nx = 'click'",
    "snapshot_diff": """WITH a AS (SELECT n_chars, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1), b AS (SELECT n_chars, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1)
        SELECT CASE WHEN a.n IS NULL THEN 'Added' WHEN b.n IS NULL THEN 'Deleted' WHEN a.n = b.n THEN 'Same' ELSE 'Modified' END AS change, count(*) AS n FROM a FULL JOIN b USING (n_chars) GROUP BY 1""",
    "coverage_ratios": """WITH g AS (SELECT lang, count(*) AS n, count(quality) AS known, sum(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
        SELECT lang, round(CASE WHEN n > 0 THEN known * 100.0 / n ELSE 100 END, 6)::DOUBLE AS coverage, round(CASE WHEN known > 0 THEN toxic * 100.0 / known ELSE 0 END, 6)::DOUBLE AS toxic_share FROM g""",
    "health_summary": f"""WITH {_STATS}, o AS (SELECT count(*) AS files, round(avg(total), 6) AS avg_lines, (SELECT count(*) FROM labels) AS labels FROM stats)
        SELECT files, avg_lines, labels, CASE WHEN avg_lines <= 10 THEN 'good' WHEN avg_lines <= 20 THEN 'fair' ELSE 'poor' END AS size_health, CASE WHEN labels * 100.0 / files >= 80 THEN 'good' WHEN labels * 100.0 / files >= 50 THEN 'fair' ELSE 'poor' END AS cover_health FROM o""",
    "token_normalise": r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|"[^"\n]*"|[.,:;=]')) AS t FROM documents)
        SELECT CASE WHEN t LIKE '"%' THEN '$STR' WHEN regexp_matches(t, '^[0-9]') THEN '$NUM' WHEN t IN ('and','or','not','if','else','for','while','return','is','in','as') THEN t WHEN regexp_matches(t, '^[A-Za-z_]') THEN '$ID' ELSE t END AS class, count(*) AS n FROM t GROUP BY 1""",
    "style_mode": "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) SELECT lang, source AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM c) WHERE r = 1",
    "stream_debounce": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM i GROUP BY user_id, run HAVING count(*) >= 2""",
    "stream_tumbling": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "incremental_recompute": f"""WITH RECURSIVE {_GEO}, r AS (SELECT n_nationkey::BIGINT + 500000000 AS node FROM nation WHERE n_regionkey = 0 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r""",
}
