"""DuckDB SQL for the queries over Markdown that is built from the tables."""

_BOOK = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  a0 AS (SELECT c, 0 AS idx, 'heading' AS kind, 'Customer ' || c AS body, '# Customer ' || c AS raw, 1 AS lv, '' AS tail, NULL::BIGINT AS k FROM o GROUP BY c
    UNION ALL SELECT c, 4 * n - 3, 'heading', 'Order ' || k, '## Order ' || k, 2, '', k FROM o
    UNION ALL SELECT c, 4 * n - 2, 'paragraph', trim(repeat('The order ' || k || ' is in state ' || s || ' now. ', 40)), repeat('The order ' || k || ' is in state ' || s || ' now. ', 40), NULL, '', k FROM o
    UNION ALL SELECT c, 4 * n - 1, 'table', '| key | state |' || chr(10) || '| ' || k || ' | ' || s || ' |', '| key | state |' || chr(10) || '| ' || k || ' | ' || s || ' |', NULL, '', k FROM o
    UNION ALL SELECT c, 4 * n, 'code', '```' || chr(10) || 'code of ' || k || chr(10) || '```', '```' || chr(10) || 'code of ' || k || chr(10) || '```', NULL, '', k FROM o),
  a1 AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY c ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, '# ')) * (lv IS NOT NULL)::INT - CASE WHEN lv IS NULL THEN length(raw) ELSE 0 END AS pos FROM a0),
  atoms AS (SELECT c AS doc_id, idx::INT AS idx, kind, body, greatest(1, ceil(length(body) / 1.5))::BIGINT AS tokens, 'Customer ' || c || CASE WHEN k IS NULL THEN '' ELSE ' > Order ' || k END AS path, lv AS level, pos::INT AS char_start, (pos + length(body))::INT AS char_end,
    substr(trim(regexp_replace(substr(body, 1, 120), '\\s+', ' ', 'g')), 1, 80) AS preview, max(idx) OVER (PARTITION BY c) AS last FROM a1)"""
#: Segments: runs of atoms that are closed at a top heading past 6,000 tokens, or past 24,000.
_SEGMENTS = f"""RECURSIVE {_BOOK},
  w AS (SELECT doc_id, idx, tokens, 0 AS seg, idx AS start, tokens AS size, idx = last AS closed FROM atoms WHERE idx = 0
    UNION ALL SELECT a.doc_id, a.idx, a.tokens, w.seg + w.closed::INT, CASE WHEN w.closed THEN a.idx ELSE w.start END, CASE WHEN w.closed THEN a.tokens ELSE w.size + a.tokens END,
      (coalesce(a.level <= 2, false) AND CASE WHEN w.closed THEN a.tokens ELSE w.size + a.tokens END >= 6000 AND NOT w.closed) OR CASE WHEN w.closed THEN a.tokens ELSE w.size + a.tokens END >= 24000 OR a.idx = a.last
    FROM w JOIN atoms a ON a.doc_id = w.doc_id AND a.idx = w.idx + 1),
  segs AS (SELECT doc_id, seg AS idx, min(idx)::INT AS start_atom, max(idx)::INT AS end_atom, sum(tokens)::BIGINT AS tokens FROM w GROUP BY doc_id, seg)"""
#: Chunks: sections gathered up to 2,500 tokens; one of under 500 still grows. A text of at most 2,500 is one chunk.
_CHUNKS = f"""RECURSIVE {_BOOK},
  t AS (SELECT c, '# Customer ' || c || chr(10) || chr(10) || string_agg('## Order ' || k || chr(10) || chr(10) || x || chr(10), chr(10) ORDER BY k) AS text FROM (SELECT c, k, string_agg(raw, chr(10) || chr(10) ORDER BY idx) AS x FROM a0 WHERE lv IS NULL GROUP BY c, k) GROUP BY c),
  s0 AS (SELECT c, 0 AS n, '' AS body, 'Customer ' || c AS head, 'Customer ' || c AS path FROM o GROUP BY c
    UNION ALL SELECT o.c, n, chr(10) || (SELECT string_agg(raw, chr(10) || chr(10) ORDER BY idx) FROM a0 WHERE a0.c = o.c AND a0.k = o.k AND lv IS NULL) || chr(10), 'Order ' || k, 'Customer ' || o.c || ' > Order ' || k FROM o),
  s AS (SELECT *, greatest(1, ceil(length(body) / 1.5))::BIGINT AS tk FROM s0),
  g AS (SELECT c, n, tk AS size, 0 AS chunk FROM s WHERE n = 0
    UNION ALL SELECT s.c, s.n, CASE WHEN g.size + s.tk > 2500 AND g.size >= 500 THEN 1 + s.tk ELSE g.size + s.tk END, g.chunk + (g.size + s.tk > 2500 AND g.size >= 500)::INT FROM g JOIN s ON s.c = g.c AND s.n = g.n + 1),
  many AS (SELECT g.c, chunk, arg_max(head, g.n) AS title, arg_max(path, g.n) AS path, arg_max(size, g.n)::BIGINT AS tokens, regexp_replace(string_agg(body || chr(10) || chr(10), '' ORDER BY g.n), '^\\s+|\\s+$', '', 'g') AS content FROM g JOIN s ON s.c = g.c AND s.n = g.n GROUP BY g.c, chunk),
  chunks AS (SELECT m.c AS doc_id, chunk::INT AS idx, title, path, tokens, content FROM many m JOIN t ON t.c = m.c WHERE ceil(length(text) / 1.5) > 2500
    UNION ALL SELECT c, 0, 'Customer ' || c, 'Customer ' || c, greatest(1, ceil(length(text) / 1.5))::BIGINT, text FROM t WHERE ceil(length(text) / 1.5) <= 2500)"""
_WINDOWS = f"""RECURSIVE {_BOOK},
  w AS (SELECT doc_id, idx, tokens, 0 AS win, tokens AS size, tokens >= 1500 AS closed FROM atoms WHERE idx = 0
    UNION ALL SELECT a.doc_id, a.idx, a.tokens, w.win + (w.closed OR (coalesce(a.level <= 2, false) AND w.size >= 750))::INT,
      CASE WHEN w.closed OR (coalesce(a.level <= 2, false) AND w.size >= 750) THEN a.tokens ELSE w.size + a.tokens END,
      CASE WHEN w.closed OR (coalesce(a.level <= 2, false) AND w.size >= 750) THEN a.tokens ELSE w.size + a.tokens END >= 1500 FROM w JOIN atoms a ON a.doc_id = w.doc_id AND a.idx = w.idx + 1)"""
_PARTS = "p AS (SELECT p_partkey AS k, 'About ' || p_name || chr(10) AS a, '[IMAGE_REQUEST:' || chr(10) || 'id=i' || p_partkey || chr(10) || 'title=' || p_name || chr(10) || 'prompt=draw ' || p_name || ']' AS b, chr(10) || 'middle of ' || p_partkey || ' ' AS c, '[DIAGRAM: ' || p_partkey || '|id=d' || p_partkey || '|title=' || p_type || ']' AS d, p_name, p_type FROM part)"

SQL = {
    "structure_chunks": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
        '## Order ' || o_orderkey || chr(10) || chr(10) || repeat('The order ' || o_orderkey || ' is in state ' || o_orderstatus || ' now. ', 40) || chr(10) || chr(10) || '| key | state |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' || chr(10) || chr(10) || '```' || chr(10) || 'code of ' || o_orderkey || chr(10) || '```' AS t FROM orders),
      h AS (SELECT *, (n - 1) // 3 AS chapter FROM o),
      g AS (SELECT c, chapter, min(n) AS n, 'Order ' || min(k) AS name, string_agg(t, chr(10) || chr(10) ORDER BY n) AS body FROM h GROUP BY c, chapter),
      r AS (SELECT c, 0 AS n, 'Customer ' || c AS path, '# Customer ' || c AS body FROM o GROUP BY c UNION ALL SELECT c, n, name, body FROM g WHERE ceil(length(body) / 1.5) <= 1500
        UNION ALL SELECT h.c, h.n, CASE WHEN h.n = g.n THEN name ELSE name || ' > Order ' || k END, t FROM h JOIN g ON g.c = h.c AND g.chapter = h.chapter WHERE ceil(length(body) / 1.5) > 1500)
      SELECT c AS doc_id, (row_number() OVER (PARTITION BY c ORDER BY n) - 1)::INT AS idx, path, greatest(1, ceil(length(body) / 1.5))::BIGINT AS tokens, md5(body) AS digest FROM r""",
    # One vector after the other, with what a cut depends on.
    "semantic_numbers": """WITH RECURSIVE e AS (SELECT label AS d, vec_id AS idx, vec_id * 7 % 50 + 10 AS size, row_number() OVER w - 1 AS i, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w) < 0 AS valley FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
      f AS (SELECT d, idx, i, 0::BIGINT AS chunk, NULL::BIGINT AS last, size AS since, size AS total FROM e WHERE i = 0
        UNION ALL SELECT d, idx, i, CASE WHEN cut OR full_ THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN i ELSE last END, CASE WHEN cut THEN size ELSE since + size END, CASE WHEN cut OR full_ THEN size ELSE total + size END
        FROM (SELECT e.d, e.idx, e.i, e.size, f.chunk, f.last, f.since, f.total, e.valley AND NOT coalesce(e.i - f.last <= 2 AND f.since < 120, false) AS cut, f.total + e.size > 100 AS full_ FROM f JOIN e ON e.d = f.d AND e.i = f.i + 1))
      SELECT d AS doc_id, idx, chunk FROM f""",
    "book_atoms": f"WITH {_BOOK} SELECT doc_id, idx, kind, tokens, path, level, char_start, char_end, md5(body) AS digest FROM atoms",
    "book_windows": f"""WITH {_WINDOWS} SELECT w.doc_id, win::INT AS idx, min(w.idx)::INT AS start_atom, max(w.idx)::INT AS end_atom, sum(w.tokens)::BIGINT AS tokens, arg_min(path, w.idx) AS path,
      count(*) FILTER (WHERE kind = 'heading') AS heading, count(*) FILTER (WHERE kind = 'paragraph') AS paragraph, count(*) FILTER (WHERE kind = 'table') AS table, count(*) FILTER (WHERE kind = 'code') AS code,
      least(3, count(*) FILTER (WHERE kind IN ('heading', 'paragraph'))) AS previews FROM w JOIN atoms a ON a.doc_id = w.doc_id AND a.idx = w.idx GROUP BY w.doc_id, win""",
    "book_boundaries": f"""WITH RECURSIVE {_BOOK}, w AS (SELECT doc_id, idx, tokens AS since, false AS hit FROM atoms WHERE idx = 0
      UNION ALL SELECT a.doc_id, a.idx, CASE WHEN w.hit THEN 0 ELSE w.since END + a.tokens, coalesce(a.level <= 2, false) AND CASE WHEN w.hit THEN 0 ELSE w.since END + a.tokens >= 1000 FROM w JOIN atoms a ON a.doc_id = w.doc_id AND a.idx = w.idx + 1)
      SELECT doc_id, idx AS boundary FROM w WHERE hit""",
    "book_segments": f"""WITH {_SEGMENTS} SELECT g.doc_id, g.idx, a.preview AS title, start_atom, end_atom, g.tokens, a.path, end_atom - start_atom + 1 AS atoms, 0.6::DOUBLE AS confidence FROM segs g JOIN atoms a ON a.doc_id = g.doc_id AND a.idx = start_atom""",
    "book_segment_texts": f"""WITH {_SEGMENTS} SELECT w.doc_id, seg AS segment, md5(string_agg(body, chr(10) || chr(10) ORDER BY w.idx)) AS digest FROM w JOIN atoms a ON a.doc_id = w.doc_id AND a.idx = w.idx GROUP BY w.doc_id, seg""",
    "book_segment_metrics": f"WITH {_SEGMENTS} SELECT doc_id, count(*) AS segments, floor(avg(tokens) + 0.5)::BIGINT AS tokens_avg, max(tokens) AS tokens_max, 1.0::DOUBLE AS coverage FROM segs GROUP BY doc_id",
    "book_chunks": f"WITH {_CHUNKS} SELECT doc_id, idx, title, path, tokens, md5(content) AS digest FROM chunks",
    "book_context": f"""WITH {_CHUNKS}, {_SEGMENTS.split(_BOOK + ",", 1)[1]},
      pl AS (SELECT doc_id, idx, floor(idx / count(*) OVER (PARTITION BY doc_id) * (SELECT max(last) + 1 FROM atoms x WHERE x.doc_id = chunks.doc_id)) AS place, content FROM chunks),
      m AS (SELECT doc_id, count(*) AS n FROM segs GROUP BY doc_id)
      SELECT pl.doc_id, pl.idx, CASE WHEN n >= 2 THEN g.idx END AS segment, CASE WHEN n >= 2 THEN '[Context: Segment "' || a.preview || '"]' ELSE string_split(content, chr(10))[1] END AS head
      FROM pl JOIN m ON m.doc_id = pl.doc_id JOIN segs g ON g.doc_id = pl.doc_id AND pl.place BETWEEN start_atom AND end_atom JOIN atoms a ON a.doc_id = g.doc_id AND a.idx = start_atom""",
    "line_chunks": r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) AS digest FROM documents",
    "structured_sentences": f"""WITH {_BOOK}, t AS (SELECT c, '# Customer ' || c || chr(10) || chr(10) || string_agg('## Order ' || k || chr(10) || chr(10) || x || chr(10), chr(10) ORDER BY k) AS text, count(*) AS m FROM (SELECT c, k, string_agg(raw, chr(10) || chr(10) ORDER BY idx) AS x FROM a0 WHERE lv IS NULL GROUP BY c, k) GROUP BY c)
      SELECT c AS doc_id, 2 + m * 48 - 1 AS sentences, md5(text) AS digest FROM t""",
    "outline_tree": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, left(o_orderpriority, 1) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
      SELECT c AS doc_id, (2 * n - 2)::INT AS idx, (n - 1)::VARCHAR AS path, NULL AS parent, 0 AS depth, n::VARCHAR AS num, 'Order ' || k AS title, 'key ' || k || '|state ' || s AS points FROM o
      UNION ALL SELECT c, (2 * n - 1)::INT, (n - 1) || ',0', (n - 1)::VARCHAR, 1, n || '.1', 'Priority ' || p, 'item of ' || k FROM o""",
    "outline_statistics": """SELECT o_custkey AS doc_id, count(*) AS leaves, 2::BIGINT AS depth, sum(o_orderkey % 900 + 100)::BIGINT AS words, 0::BIGINT AS missing_points, (count(*) < 4)::BIGINT + (count(*) > 8)::BIGINT + (count(*) < 8)::BIGINT AS issues FROM orders GROUP BY o_custkey""",
    "content_markers": f"""WITH {_PARTS} SELECT k AS doc_id, 0 AS idx, 'image' AS kind, true AS request, 'i' || k AS marker_id, length(a) AS start, length(a || b) AS stop, p_name AS title FROM p
      UNION ALL SELECT k, 1, 'diagram', false, 'd' || k, length(a || b || c), length(a || b || c || d), p_type FROM p""",
    "content_segments": f"""WITH {_PARTS}, x AS (SELECT k, unnest([0, 1, 2, 3, 4]) AS idx, unnest(['text', 'image_request', 'text', 'diagram_asset', 'text']) AS kind, unnest([trim(a, chr(10)), b, trim(trim(c), chr(10)), d, 'end']) AS content FROM p) SELECT k AS doc_id, idx, kind, md5(content) AS digest FROM x""",
    "content_replaced": f"WITH {_PARTS} SELECT k AS doc_id, 1 AS requests, length(trim(a, chr(10)) || chr(10) || c || d || chr(10) || 'end') AS rest, length(a || 'X' || c || d || chr(10) || 'end') AS replaced, true AS has_ids FROM p",
    "extracted_tags": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE lower(p_brand) || '|' || lower(p_type) END AS tags FROM part",
}
