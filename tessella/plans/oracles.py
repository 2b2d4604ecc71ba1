"""DuckDB SQL for the queries of the catalog."""

from tessella.operators import tasks as _tasks

_USAGE = """usage AS (SELECT event_id AS id, ts, event_type AS module, CASE WHEN user_id % 7 > 0 THEN user_id % 7 END AS model_id,
  floor(value)::BIGINT AS tokens_in, (event_id % 50)::BIGINT AS tokens_out FROM events)"""
_TASKS = """tasks AS (SELECT o_orderkey AS id, o_orderpriority AS type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
  o_orderdate AS created_at, o_custkey AS document_id FROM orders)"""
_REFS = """refs AS (SELECT l_orderkey % 100 AS draft_id, l_orderkey AS section_id, l_suppkey AS document_id, 'doc-' || l_suppkey AS document, l_discount AS relevance,
  CASE WHEN l_returnflag = 'R' THEN 'wiki' ELSE 'rag_chunk' END AS source_type FROM lineitem)"""
_EDGES = "edges AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, count(*) AS weight FROM lineitem GROUP BY ALL)"
_WAYS = "ways AS (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges)"
_DEG = "deg AS (SELECT node, count(*) AS degree FROM ways GROUP BY node)"
_SECTIONS = """secs AS (SELECT o_custkey AS draft_id, o_orderkey AS section_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'revising' ELSE 'pending' END AS status,
  floor(o_totalprice / 100)::BIGINT AS words FROM orders)"""
_WORDS = r"regexp_extract_all(lower({}), '[\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{N}}_]+')"
_TOKEN = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]|[\p{Latin}\p{Greek}\p{Cyrillic}\p{N}_]+"
_TITLE = r"list_distinct(regexp_extract_all(lower(trim({})), '[a-z0-9]{{2,}}'))"
_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::FLOAT[]::DOUBLE[]"
_COSINE = f"list_dot_product(embedding::DOUBLE[], {_QUERY_VECTOR}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QUERY_VECTOR}, {_QUERY_VECTOR})))"


def _bm25(groups: list[list[str]]) -> str:
    terms = list(dict.fromkeys(t for g in groups for t in g))
    w = _WORDS.format("coalesce(text, '')")
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS df{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 0.000001::DOUBLE END"
    part = lambda k: f"({idf(k)}) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))"
    hit = lambda g: " AND ".join(f"f{terms.index(t)} > 0" for t in g)
    total = " + ".join(f"CASE WHEN {hit(g)} THEN {' + '.join(part(terms.index(t)) for t in g)} ELSE 0 END" for g in groups)
    any_group = " OR ".join(f"({hit(g)})" for g in groups)
    return f"""words AS (SELECT doc_id, {w} AS w FROM documents),
      counted AS (SELECT doc_id, len(w) AS length, {counts} FROM words),
      stats AS (SELECT count(*) AS n, avg(length) AS avgdl, {dfs} FROM counted),
      ranked AS (SELECT doc_id, length, -({total}) AS rank FROM counted, stats WHERE {any_group})"""


_PAGE = """page AS (SELECT doc_id, rank FROM ranked ORDER BY rank, doc_id LIMIT {n}),
  scored AS (SELECT doc_id, rank, floor(least(greatest(1 - (rank - (SELECT min(rank) FROM page)) / (SELECT CASE WHEN max(rank) = min(rank) THEN 1 ELSE max(rank) - min(rank) END FROM page), 0), 1) * 100 + 0.5) / 100 AS score FROM page)"""
_ZH = r"篇幅|字数|页数|文档长度|报告长度|格式要求|简版|标准版|完整版|[0-9０-９一二三四五六七八九十百千万]+\s*(字|页)"

# One candidate after the other: titles so far (token lists) and the entry that each candidate went to.
_MERGED = f"""p AS (SELECT p_partkey AS k, p_partkey % 3 AS u, p_partkey % 4 AS kind, ['doc_summary', 'topic', 'concept', 'claim'][p_partkey % 4 + 1] AS type, p_name || ' ' || p_brand || ' size ' || p_size AS title, p_type AS content, [p_brand, 'p' || p_partkey] AS refs, p_size / 100::DOUBLE AS confidence, p_size <= 5 AS old FROM part),
      t AS (SELECT *, {_TITLE.format("title")} AS tok, CASE WHEN old THEN row_number() OVER (PARTITION BY u, old ORDER BY k) ELSE row_number() OVER (PARTITION BY u, old ORDER BY kind, k) END AS i FROM p),
      walk AS (SELECT u, 0::BIGINT AS i, list(tok ORDER BY i) AS titles, []::BIGINT[] AS goes FROM t WHERE old GROUP BY u
               UNION ALL SELECT u, i, CASE WHEN best >= 0.45::DOUBLE THEN titles ELSE list_append(titles, tok) END, list_append(goes, CASE WHEN best >= 0.45::DOUBLE THEN list_position(scores, best)::BIGINT ELSE len(titles) + 1 END)
               FROM (SELECT *, list_max(scores) AS best FROM (SELECT w.u, c.i, w.titles, w.goes, c.tok, list_transform(w.titles, lambda x: len(list_intersect(x, c.tok)) / (len(x) + len(c.tok) - len(list_intersect(x, c.tok)))::DOUBLE) AS scores FROM walk w JOIN t c ON c.u = w.u AND NOT c.old AND c.i = w.i + 1))),
      ends AS (SELECT u, goes FROM walk QUALIFY row_number() OVER (PARTITION BY u ORDER BY i DESC) = 1),
      moves AS (SELECT u, unnest(range(1, len(goes) + 1)) AS i, unnest(goes) AS at FROM ends),
      olds AS (SELECT u, count(*) AS n FROM t WHERE old GROUP BY u),
      parts AS (SELECT u, i AS place, 0 AS i, 'keep' AS how, type, title, content, refs, confidence FROM t WHERE old
                UNION ALL SELECT t.u, m.at, t.i, CASE WHEN m.at > n AND row_number() OVER (PARTITION BY t.u, m.at ORDER BY t.i) = 1 THEN 'create' ELSE 'merge' END, type, title, content, refs, confidence FROM t JOIN moves m ON m.u = t.u AND m.i = t.i JOIN olds ON olds.u = t.u WHERE NOT old),
      merged AS (SELECT u AS user_id, place, first(type ORDER BY i) AS type, first(title ORDER BY i) AS title, CASE WHEN bool_or(how = 'create') THEN 'create' WHEN count(*) > 1 THEN 'update' ELSE 'keep' END AS action, count(*) - 1 AS merges,
                 md5(string_agg(CASE WHEN how = 'merge' THEN chr(10) || chr(10) || '--- Update 2024-01-01 ---' || chr(10) ELSE '' END || content, '' ORDER BY i)[1:6000]) AS content, flatten(list(refs ORDER BY i)) AS refs, round(least(1, first(confidence ORDER BY i) + 0.05::DOUBLE * (count(*) - 1)), 6) AS confidence FROM parts GROUP BY u, place)"""

SQL = {
    "wiki_merge": f"WITH RECURSIVE {_MERGED} SELECT user_id, type, title, action, merges, content, list_reduce(list_transform(list_filter(list_zip(refs, range(1, len(refs) + 1)), lambda z: list_position(refs, z[1]) = z[2]), lambda z: z[1]), lambda a, b: a || ',' || b) AS refs, confidence FROM merged",
    "wiki_merge_statistics": f"WITH RECURSIVE {_MERGED} SELECT user_id, count(*) FILTER (WHERE action = 'create') AS created, sum(merges)::BIGINT AS updated, 0::BIGINT AS skipped, 0::BIGINT AS fusion_calls FROM merged GROUP BY user_id",
    "usage_by_dimension": f"""WITH {_USAGE}, models AS (SELECT n_nationkey::BIGINT AS model_id, n_name AS model, r_name AS provider FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey BETWEEN 1 AND 5)
      SELECT 'model' AS kind, CASE WHEN u.model_id IS NULL THEN 'Unattributed' ELSE coalesce(model, 'Unknown') END AS label, provider, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, count(*) AS calls FROM usage u LEFT JOIN models m ON u.model_id = m.model_id GROUP BY u.model_id, model, provider
      UNION ALL SELECT 'module', module, NULL, sum(tokens_in)::BIGINT, sum(tokens_out)::BIGINT, count(*) FROM usage GROUP BY module
      UNION ALL SELECT 'total', 'total', NULL, sum(tokens_in)::BIGINT, sum(tokens_out)::BIGINT, count(*) FROM usage""",
    "usage_daily_trend": f"""WITH {_USAGE}, recent AS (SELECT * FROM usage WHERE ts >= DATE '2024-01-17'),
      grid AS (SELECT d::DATE AS day, module FROM range(DATE '2024-01-17', DATE '2024-01-31', INTERVAL 1 DAY) t(d), (SELECT DISTINCT module FROM recent))
      SELECT day, module, coalesce(sum(tokens_in + tokens_out), 0)::BIGINT AS tokens, count(id) AS calls FROM grid LEFT JOIN recent USING (module) WHERE false GROUP BY ALL
      UNION ALL SELECT g.day, g.module, coalesce(sum(tokens_in + tokens_out), 0)::BIGINT, count(r.id) FROM grid g LEFT JOIN recent r ON r.module = g.module AND r.ts::DATE = g.day GROUP BY ALL""",
    "usage_totals": f"WITH {_USAGE} SELECT sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, count(*) AS calls FROM usage WHERE ts >= TIMESTAMP '2024-01-16 12:00:00'",
    "recent_usage": f"WITH {_USAGE} SELECT id, module, tokens_in, tokens_out FROM usage ORDER BY ts DESC, id DESC LIMIT 100",
    "tag_counts": "SELECT tag, count(*) AS documents FROM (SELECT doc_id, unnest([source, lang]) AS tag FROM documents) GROUP BY tag",
    "document_list_page": "SELECT doc_id, source AS name, n_chars AS size, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10",
    "content_dedupe": """SELECT min(doc_id) AS id, sha256(text) AS hash FROM documents WHERE source <> 'src0' AND length(text) > 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY sha256(text)""",
    "topology": f"WITH {_REFS} SELECT draft_id, document, count(*) AS refs, floor(sum(relevance::DECIMAL(18, 6))::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS relevance, count(DISTINCT section_id) AS sections FROM refs WHERE source_type = 'rag_chunk' GROUP BY ALL",
    "topology_stats": f"""WITH {_REFS}, {_SECTIONS}, s AS (SELECT section_id % 100 AS draft_id, section_id, status FROM secs), per AS (SELECT draft_id, section_id, count(*) AS n FROM refs GROUP BY ALL),
      a AS (SELECT draft_id, coalesce(sum(n), 0)::BIGINT AS total_references, count(n) AS sections_with_references, count(*) AS total_sections, count(*) FILTER (WHERE status = 'confirmed') AS completed_sections FROM s LEFT JOIN per USING (draft_id, section_id) GROUP BY draft_id),
      g AS (SELECT draft_id, document, count(*) AS refs FROM refs WHERE source_type = 'rag_chunk' GROUP BY ALL),
      t AS (SELECT draft_id, count(*) AS documents, arg_min(document, struct_pack(r := -refs, d := document)) AS most_referenced FROM g GROUP BY draft_id)
      SELECT draft_id, total_references, sections_with_references, total_sections, completed_sections, coalesce(documents, 0) AS documents, most_referenced, sections_with_references || '/' || total_sections || ' sections have references' AS coverage FROM a LEFT JOIN t USING (draft_id)""",
    "draft_progress": f"""WITH {_SECTIONS} SELECT draft_id, count(*) AS total, count(*) FILTER (WHERE status = 'confirmed') AS done, 0::BIGINT AS locked, sum(words)::BIGINT AS words,
      CASE WHEN bool_or(status = 'revising') THEN 'modifying' WHEN bool_and(status = 'confirmed') THEN 'completed' ELSE 'drafting' END AS status FROM secs GROUP BY draft_id""",
    "storage_bytes": "SELECT lang AS user_id, (sum(strlen(text)) + sum(n_chars))::BIGINT AS bytes FROM documents GROUP BY lang",
    "latency_p95": "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k = greatest(1, ceil(n * 95 / 100.0))",
    "latency_ewma": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: 0.2::DOUBLE * x + 0.8::DOUBLE * s), 6) AS ewma FROM events GROUP BY user_id",
    "conversation_tail": """SELECT conv_id, CASE WHEN length(t) > 500 THEN right(t, 500) ELSE t END AS transcript FROM (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""",
    "conversation_latest": "SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3",
    "length_replies": rf"""WITH r AS (SELECT *, lag(role) OVER w AS previous_role, lag(text) OVER w AS previous_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, previous_role, coalesce(role = 'user' AND (regexp_matches(text, '(?i){_ZH}|{_tasks._EN_LENGTH}') OR coalesce(previous_role = 'assistant' AND regexp_matches(trim(text), '(?i){_tasks._OPTION}') AND regexp_matches(previous_text, '(?i){_tasks._ASKS}'), false)), false) AS states_length FROM r""",
    "quality_groups": "SELECT lang, count(*) AS documents, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "latest_task": f"WITH {_TASKS} SELECT document_id, type, id, status FROM tasks QUALIFY row_number() OVER (PARTITION BY document_id, type ORDER BY created_at DESC, id DESC) = 1",
    "queue_position": f"""WITH {_TASKS} SELECT document_id % 10 AS user_id, id, row_number() OVER (PARTITION BY document_id % 10 ORDER BY status <> 'running', created_at, id) AS place, count(*) OVER (PARTITION BY document_id % 10) AS total FROM tasks WHERE status <> 'completed'""",
    "task_list": f"WITH {_TASKS} SELECT id, status, document_id FROM tasks WHERE status <> 'completed' AND type = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 200",
    "document_durations": f"""WITH {_TASKS}, l AS (SELECT *, CASE WHEN status = 'completed' THEN created_at + INTERVAL 1 HOUR END AS finished FROM tasks WHERE type IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY document_id, type ORDER BY created_at DESC, id DESC) = 1),
      g AS (SELECT document_id, max(created_at) FILTER (WHERE type = '1-URGENT') AS s, count(finished) AS done, max(finished) AS e FROM l GROUP BY document_id)
      SELECT document_id, CASE WHEN done = 2 AND e >= s THEN epoch_ms(e) - epoch_ms(s) END AS duration_ms FROM g""",
    # One failure after the other, with the state that a limiter holds for the key.
    "lockouts": """WITH RECURSIVE e AS (SELECT user_id AS k, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'error'),
      f AS (SELECT k, i, ts AS started, 1 AS n, NULL::TIMESTAMP AS until FROM e WHERE i = 1
            UNION ALL SELECT k, i, CASE WHEN fresh THEN ts ELSE started END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN NULL WHEN n + 1 >= 2 THEN ts + INTERVAL 6 HOUR ELSE until END
            FROM (SELECT e.k, e.i, e.ts, f.started, f.n, f.until, (f.until IS NULL OR e.ts >= f.until) AND e.ts - f.started >= INTERVAL 1 DAY AS fresh FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1))
      SELECT k AS key, started AS window_start, max(n)::BIGINT AS failures, max(until) AS locked_until FROM f GROUP BY k, started HAVING max(n) >= 2""",
    "generation_fence": """WITH u AS (SELECT user_id AS task_id, ts::DATE AS generation, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS t FROM events),
      n AS (SELECT * FROM u QUALIFY generation = max(generation) OVER (PARTITION BY task_id))
      SELECT task_id, generation::VARCHAR AS generation, status FROM n QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY status <> 'running' DESC, CASE WHEN status <> 'running' THEN t END ASC NULLS LAST, t DESC) = 1""",
    "token_word_estimate": r"""SELECT doc_id, greatest(1, ceil(length(text) / 1.5))::BIGINT AS tokens, (len(regexp_extract_all(text, '[a-zA-Z0-9]+')) + len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')))::BIGINT AS words,
      len(regexp_split_to_array(text, '\s+'))::BIGINT AS pieces, greatest(1, ceil(length(text) / 1.5)) > 1800 AS split FROM documents""",
    "title_scalars": rf"""SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
      CASE WHEN p_partkey * 777 < 1024 THEN p_partkey * 777 || 'B' WHEN p_partkey * 777 < 1048576 THEN printf('%.1fKB', floor(p_partkey * 777 / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1fMB', floor(p_partkey * 777 / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size,
      CASE WHEN p_size / 50 >= 0.8::DOUBLE THEN 'high' WHEN p_size / 50 >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS label, p_brand AS document, len({_TITLE.format("p_name")})::INT AS n_tokens, lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) AS key FROM part""",
    "search_excerpt": """WITH t AS (SELECT doc_id, trim(text) AS t FROM documents), p AS (SELECT *, CASE WHEN instr(t, 'License') > 0 THEN instr(t, 'License') WHEN instr(lower(t), 'license') > 0 THEN instr(lower(t), 'license') END AS place FROM t),
      s AS (SELECT *, greatest(0, place - 61) AS s FROM p)
      SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN place IS NULL THEN trim(substr(t, 1, 120)) || '...' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(substr(t, s + 1, 120)) || (CASE WHEN s + 120 < length(t) THEN '...' ELSE '' END) END AS excerpt FROM s""",
    "graph_error_types": """WITH m AS (SELECT event_id, event_type || ' failed: http ' || (395 + event_id % 110) AS t FROM events)
      SELECT event_id, CASE WHEN contains(t, '429') THEN 'rate_limit' WHEN regexp_matches(t, '50[0234]') THEN 'server_error' WHEN contains(t, '401') OR contains(t, '403') THEN 'auth' WHEN contains(t, '404') THEN 'config' ELSE 'unknown' END AS type, contains(t, '429') OR regexp_matches(t, '50[0234]') AS retryable FROM m""",
    "processing_estimate": """WITH d AS (SELECT source, sum(n_chars) * 100 AS bytes, count(*) AS files FROM documents GROUP BY source), t AS (SELECT *, CASE WHEN bytes < 5242880 THEN 0 WHEN bytes < 20971520 THEN 1 WHEN bytes < 52428800 THEN 2 ELSE 3 END AS k, greatest(least(files, 100) - 1, 0) AS more FROM d),
      e AS (SELECT *, [0.5, 2.0, 8.0, 20.0][k + 1] * 1.5 + least(more, 9) * 0.5 + least(greatest(more - 9, 0), 90) * 0.1 AS lo, [2.0, 8.0, 20.0, 45.0][k + 1] * 2.0 + least(more, 9) * 1.0 + least(greatest(more - 9, 0), 90) * 0.25 AS hi FROM t),
      r AS (SELECT *, greatest(1, floor(lo + 0.5))::BIGINT AS a FROM e) SELECT source, ['fast', 'medium', 'slow', 'heavy'][k + 1] AS level, a AS min_minutes, greatest(a, floor(hi + 0.5)::BIGINT) AS max_minutes FROM r""",
    "bm25_keyword_search": f"WITH {_bm25([['licensed'], ['under']])}, {_PAGE.format(n=20)} SELECT doc_id, round(rank, 6) AS rank, score FROM scored",
    "bm25_match_groups": f"WITH {_bm25([['and', 'the', 'license'], ['the', 'license', 'version']])} SELECT doc_id, length, round(rank, 6) AS rank FROM ranked",
    "bm25_scan_groups": f"WITH {_bm25([['and', 'the', 'license'], ['the', 'license', 'version']])} SELECT doc_id, length, round(rank, 6) AS rank FROM ranked",
    # Windows start at each hit (centred) and at its sentence; texts are cut into words and what stands between them.
    "keyword_snippets": rf"""WITH {_bm25([['licensed'], ['under']])}, {_PAGE.format(n=20)},
      t AS (SELECT doc_id, score, regexp_extract_all(text, '{_TOKEN}') AS w, regexp_split_to_array(text, '{_TOKEN}') AS g FROM scored JOIN documents USING (doc_id)),
      p AS (SELECT doc_id, i - 1 AS pos, lower(w[i]) AS term, len(w) AS size, CASE WHEN i = 1 OR regexp_matches(g[i], '[.:][ 	

]+$') THEN i - 1 END AS head FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
      h AS (SELECT *, max(head) OVER (PARTITION BY doc_id ORDER BY pos) AS from_head FROM p),
      hit AS (SELECT doc_id, pos, term, size, from_head FROM h WHERE term IN ('licensed', 'under')),
      cand AS (SELECT doc_id, size, pos AS place, pos AS start, 0 AS kind FROM hit UNION ALL SELECT doc_id, size, pos, from_head, 1 FROM hit WHERE from_head < pos AND size > 40),
      s AS (SELECT c.doc_id, c.size, c.place, c.start, c.kind, 999 * count(DISTINCT term) + count(*) + CASE WHEN kind = 0 THEN 0 WHEN start = 0 THEN 120 ELSE 100 END AS points, min(pos) AS a, max(pos) + 1 AS b
            FROM cand c JOIN hit ON hit.doc_id = c.doc_id AND pos >= c.start AND pos < c.start + 40 GROUP BY c.doc_id, c.size, c.place, c.start, c.kind),
      best AS (SELECT doc_id, size, CASE WHEN kind = 1 THEN start ELSE greatest(0, least(a - (40 - (b - a)) // 2, size - 40)) END AS start FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, place, kind) = 1),
      cut AS (SELECT doc_id, score, w, g, start, size, least(start + 39, size - 1) AS stop FROM t JOIN best USING (doc_id))
      SELECT doc_id, score, CASE WHEN start > 0 THEN '...' ELSE g[1] END || list_reduce(list_transform(range(start, stop + 1), lambda i: CASE WHEN lower(w[i + 1]) IN ('licensed', 'under') THEN '<mark>' || w[i + 1] || '</mark>' ELSE w[i + 1] END || CASE WHEN i < stop THEN g[i + 2] ELSE '' END), lambda x, y: x || y)
        || CASE WHEN start + 39 >= size - 1 THEN g[size + 1] ELSE '...' END AS snippet FROM cut""",
    "index_statistics": f"SELECT count(*) AS documents, sum(len({_WORDS.format('coalesce(text, chr(0))')}))::BIGINT AS tokens, sum(len({_WORDS.format('coalesce(text, chr(0))')}))::BIGINT AS places FROM documents",
    "postings_index": f"WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "cosine_topk": f"SELECT vec_id, round({_COSINE}, 6) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 20",
    "cosine_threshold": f"""WITH c AS (SELECT vec_id, {_COSINE} AS s FROM embeddings), t AS (SELECT * FROM c WHERE s >= 0.1::DOUBLE ORDER BY s DESC, vec_id LIMIT 50)
      SELECT vec_id, floor(s * 1000 + 0.5) / 1000 AS score, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS label FROM t""",
    "adjacent_similarity": "WITH n AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings) SELECT label, vec_id, round(list_dot_product(a, b), 6) AS similarity FROM n WHERE b IS NOT NULL",
    "rrf_fusion": f"""WITH {_bm25([["licensed"], ["under"]])}, {_PAGE.format(n=40)},
      docs AS (SELECT doc_id, text AS content, substr(text, 1, 80) AS title FROM documents),
      near AS (SELECT vec_id AS doc_id, {_COSINE} AS s FROM embeddings QUALIFY s >= 0 AND row_number() OVER (ORDER BY s DESC, vec_id) <= 40),
      direct AS (SELECT doc_id, title, content, floor(s * 1000 + 0.5) / 1000 AS score, 0 AS nth FROM near JOIN docs USING (doc_id)),
      keyword AS (SELECT doc_id, title, content, scored.score, 1 AS nth FROM scored JOIN docs USING (doc_id)),
      every AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, doc_id) AS place, title || chr(10) || content AS t FROM (SELECT * FROM direct UNION ALL SELECT * FROM keyword)),
      boosted AS (SELECT *, CASE WHEN contains(title, 'Licensed under') THEN 0.14 WHEN instr(t, 'Licensed under') BETWEEN 1 AND 121 THEN 0.12 WHEN instr(t, 'Licensed under') BETWEEN 1 AND 301 THEN 0.08 WHEN instr(t, 'Licensed under') > 0 OR (contains(t, 'Licensed') AND contains(t, 'under')) THEN 0.03 ELSE 0 END::DOUBLE AS boost FROM every),
      g AS (SELECT doc_id, min(nth) AS first, count(*) AS n, sum((CASE nth WHEN 0 THEN 1.0 ELSE 1.35 END)::DOUBLE / (20 + place) + 0.01::DOUBLE * score + boost) AS fusion, max(CASE WHEN nth = 0 THEN least(1, greatest(0, score + boost)) END) AS v, max(CASE WHEN nth = 1 THEN score END) AS k FROM boosted GROUP BY doc_id),
      o AS (SELECT doc_id, CASE WHEN n > 1 THEN 'fused' WHEN first = 0 THEN 'direct' ELSE 'keyword' END AS source, CASE WHEN first = 1 THEN k ELSE v END AS s, fusion FROM g),
      r AS (SELECT *, row_number() OVER (ORDER BY s DESC, fusion DESC, doc_id) AS rank FROM o)
      SELECT doc_id, source, floor(s * 1000 + 0.5) / 1000 AS score, floor(fusion * 1000 + 0.5) / 1000 AS fusion, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS label, rank FROM r WHERE rank <= 20""",
    "phrase_boosts": """WITH d AS (SELECT doc_id, substr(text, 1, 20) AS title, substr(text, 1, 20) || chr(10) || text AS t FROM documents)
      SELECT doc_id, CASE WHEN contains(title, 'License, Version') THEN 0.14 WHEN instr(t, 'License, Version') BETWEEN 1 AND 121 THEN 0.12 WHEN instr(t, 'License, Version') BETWEEN 1 AND 301 THEN 0.08 WHEN instr(t, 'License, Version') > 0 OR (contains(t, 'License') AND contains(t, 'Version')) THEN 0.03 ELSE 0 END::DOUBLE AS boost FROM d""",
    "graph_degree": f"WITH {_EDGES}, {_WAYS}, {_DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 100",
    "graph_khop": f"""WITH {_EDGES}, {_WAYS}, {_DEG}, h1 AS (SELECT DISTINCT other AS node FROM ways WHERE node = 'p1'), h2 AS (SELECT DISTINCT w.other AS node FROM ways w JOIN h1 ON w.node = h1.node WHERE w.other <> 'p1' AND w.other NOT IN (SELECT node FROM h1)),
      seen AS (SELECT 'p1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, hops FROM seen LEFT JOIN deg USING (node) ORDER BY hops, degree DESC NULLS LAST, node LIMIT 10000""",
    "graph_core": f"""WITH {_EDGES}, {_WAYS}, {_DEG}, c AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1), h1 AS (SELECT DISTINCT other AS node FROM ways WHERE node IN (SELECT node FROM c)),
      h2 AS (SELECT DISTINCT w.other AS node FROM ways w JOIN h1 ON w.node = h1.node WHERE w.other NOT IN (SELECT node FROM c) AND w.other NOT IN (SELECT node FROM h1)),
      near AS (SELECT s.node FROM (SELECT node, 0 AS hops FROM c UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) s LEFT JOIN deg USING (node) ORDER BY hops, degree DESC NULLS LAST, s.node LIMIT 50),
      inner_deg AS (SELECT node, count(*) AS degree FROM ways WHERE node IN (SELECT node FROM near) AND other IN (SELECT node FROM near) GROUP BY node),
      k AS (SELECT node, coalesce(degree, 0) AS degree, node IN (SELECT node FROM c) AS centre FROM near LEFT JOIN inner_deg USING (node)),
      t AS (SELECT count(*) FILTER (WHERE degree >= 2 OR centre) AS kept, count(*) AS n FROM k)
      SELECT node, degree FROM k, t WHERE degree >= 2 OR centre OR kept < least(8, n)""",
    "entity_evidence": """WITH e AS (SELECT p_name AS name, list_sort(list_distinct(list(l_orderkey))) AS chunk_ids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
      a AS (SELECT DISTINCT upper(p_name) AS entity FROM part WHERE p_partkey <= 5),
      p AS (SELECT entity, name, chunk_ids, CASE WHEN name = entity THEN 0 WHEN lower(name) = lower(entity) THEN 1 ELSE 2 END AS tier FROM e JOIN a ON contains(lower(name), lower(entity)) OR contains(lower(entity), lower(name))),
      b AS (SELECT * FROM p QUALIFY tier = min(tier) OVER (PARTITION BY entity)),
      x AS (SELECT entity, name, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS place FROM b),
      o AS (SELECT entity, chunk_id, min(struct_pack(n := name, a := place)) AS first FROM x GROUP BY ALL)
      SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY first) AS nth, chunk_id::VARCHAR AS chunk_id FROM o QUALIFY nth <= 8""",
    "graph_purge": """WITH n AS (SELECT l_partkey AS id, list_sort(list_distinct(list('d' || (l_suppkey % 20) || '/c'))) AS s FROM lineitem GROUP BY l_partkey),
      f AS (SELECT id, list_filter(s, lambda x: x NOT IN ('d0/c', 'd1/c', 'd2/c', 'd3/c', 'd4/c', 'd5/c', 'd6/c', 'd7/c', 'd8/c', 'd9/c')) AS s FROM n) SELECT id, array_to_string(s, '<SEP>') AS source_id FROM f WHERE len(s) > 0""",
    "title_jaccard_merge": f"""WITH c AS (SELECT p_partkey AS id, {_TITLE.format("p_name")} AS t FROM part WHERE p_size > 5), e AS (SELECT printf('%08d', p_partkey) AS slug, {_TITLE.format("p_name")} AS u FROM part WHERE p_size <= 5),
      ct AS (SELECT id, len(t) AS n, unnest(t) AS tok FROM c), et AS (SELECT slug, len(u) AS m, unnest(u) AS tok FROM e),
      s AS (SELECT id, slug, count(*)::DOUBLE / (n + m - count(*)) AS score FROM ct JOIN et USING (tok) GROUP BY id, slug, n, m),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, slug) = 1)
      SELECT c.id, CASE WHEN b.score >= 0.45::DOUBLE THEN 'update' ELSE 'create' END AS action, CASE WHEN b.score >= 0.45::DOUBLE THEN slug END AS slug, round(CASE WHEN b.score >= 0.45::DOUBLE THEN b.score ELSE 0 END, 6) AS score FROM c LEFT JOIN b ON c.id = b.id""",
    "source_ref_sweep": """WITH r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS doc, l_linenumber AS ln FROM lineitem), ok AS (SELECT DISTINCT id FROM r),
      m AS (SELECT id, doc, doc % 2 = 0 AS now, doc % 2 = 0 OR doc % 9 = 0 AS dead FROM r WHERE id % 97 <> 0),
      g AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE NOT dead) AS l, count(*) FILTER (WHERE now) AS k FROM m GROUP BY id)
      SELECT id, CASE WHEN n > 0 AND l = 0 THEN CASE WHEN k = 0 THEN 'purge' ELSE 'delete' END WHEN l < n THEN 'update' ELSE 'keep' END AS action, l::INT AS refs FROM g
      UNION ALL SELECT id, 'keep', 0 FROM ok WHERE id % 97 = 0""",
    "wiki_stats": """WITH r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey, l_linenumber FROM lineitem), g AS (SELECT id, CASE WHEN id % 97 = 0 THEN 0 ELSE count(*) END AS n FROM r GROUP BY id)
      SELECT count(*) AS total, count(*) FILTER (WHERE id % 4 = 3) AS doc_summary, count(*) FILTER (WHERE id % 4 = 0) AS topics, count(*) FILTER (WHERE id % 4 = 1) AS concepts, count(*) FILTER (WHERE id % 4 = 2) AS claims, count(*) FILTER (WHERE n >= 2) AS multi_source, sum(n)::BIGINT AS source_refs FROM g""",
    "unique_slugs": """WITH s AS (SELECT p_partkey AS id, lower(regexp_replace(regexp_replace(p_type, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS b FROM part), k AS (SELECT id, b, row_number() OVER (PARTITION BY b ORDER BY id) AS n FROM s)
      SELECT id, CASE WHEN n > 1 THEN b || '-' || n ELSE b END AS slug FROM k""",
    "budgeted_context": """WITH c AS (SELECT source, doc_id, least(length(text), 2500) AS n FROM documents), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
      SELECT source, doc_id, least(n, 12000 - before)::INT AS n FROM b WHERE before < 12000""",
    "semi_anti_joins": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'unlabelled' END AS side FROM documents",
    "range_join": """WITH s AS (SELECT o_custkey AS doc, o_orderkey AS seg, o_orderdate AS lo, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '2100-01-01') AS hi FROM orders)
      SELECT o.o_orderkey AS x, s.seg FROM orders o JOIN s ON o.o_custkey = s.doc AND o.o_orderdate + INTERVAL 12 HOURS >= s.lo AND o.o_orderdate + INTERVAL 12 HOURS < s.hi""",
    "earlier_summaries": f"""WITH {_SECTIONS}, l AS (SELECT draft_id, section_id AS idx, list(CASE WHEN status = 'confirmed' THEN words::VARCHAR END) OVER (PARTITION BY draft_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM secs),
      f AS (SELECT draft_id, idx, coalesce(list_filter(l, lambda x: x IS NOT NULL), []) AS l FROM l) SELECT draft_id, idx, len(l)::INT AS n, array_to_string(l, '|') AS earlier FROM f""",
}

SQL |= {
    "pipeline_progress": """WITH o AS (SELECT o_orderkey % 5 AS k, o_orderkey % 2 = 0 AS conv, o_orderkey % 101 AS p, (o_orderkey % 101) / 100.0::DOUBLE AS f, o_orderstatus AS s FROM orders),
      x AS (SELECT *, CASE k WHEN 0 THEN 1
          WHEN 1 THEN CASE s WHEN 'F' THEN 3 WHEN 'O' THEN CASE WHEN conv THEN 2 + least(f, 1) ELSE 1 + least(f, 1) END ELSE 1 END
          WHEN 2 THEN CASE s WHEN 'F' THEN 5 WHEN 'O' THEN CASE WHEN p >= 70 THEN 4 + least(f, 1) ELSE 3 + least(f, 1) END ELSE 3 END
          WHEN 3 THEN CASE s WHEN 'F' THEN 6 WHEN 'O' THEN 5 + least(f, 1) ELSE 5 END
          ELSE CASE s WHEN 'F' THEN 7 WHEN 'O' THEN 5 + least(f, 1) + least(f, 1) ELSE 5 END END::DOUBLE AS done,
        k >= 3 OR (k = 2 AND s = 'F') AS basic FROM o),
      d AS (SELECT *, CASE WHEN k = 4 AND s = 'F' THEN 'ready' WHEN k > 0 AND s NOT IN ('F', 'O') THEN 'failed' WHEN basic THEN 'enhancing' ELSE 'processing' END AS display FROM x)
      SELECT display, count(*) AS documents, sum(floor(done / 7 * 100 + 0.5))::BIGINT AS percent_sum, count(*) FILTER (WHERE basic) AS basic_ready FROM d GROUP BY display""",
    "document_atoms": """SELECT doc_id, 0 AS idx, 'paragraph' AS kind, greatest(1, ceil(length(trim(text)) / 1.5))::BIGINT AS tokens, 0 AS char_start, length(trim(text))::INT AS char_end FROM documents""",
    "atoms_windows_segments": r"""SELECT doc_id, 0 AS idx, substr(trim(regexp_replace(substr(text, 1, 120), '\s+', ' ', 'g')), 1, 80) AS title, 0 AS start_atom, 0 AS end_atom, greatest(1, ceil(length(text) / 1.5))::BIGINT AS tokens FROM documents""",
    "split_sentences": r"""SELECT doc_id, (len(regexp_extract_all(text, '[。！？.!?][\sA-Z\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]')) + len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS sentences, length(text)::BIGINT AS chars FROM documents""",
    "wiki_section_query": f"""WITH e AS (SELECT doc_id AS id, substr(text, 1, 60) AS title, text AS content, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents),
      {_bm25([['public'], ['license']]).replace("coalesce(text, '')", "substr(text, 1, 60) || ' ' || text")},
      h AS (SELECT doc_id AS id, rank FROM ranked ORDER BY rank, doc_id LIMIT 80),
      l AS (SELECT id, NULL::DOUBLE AS rank FROM e WHERE (contains(lower(title), 'public') OR contains(lower(title), 'license')) AND id NOT IN (SELECT id FROM h) AND (SELECT count(*) FROM h) < 40
        AND len(list_intersect(['public', 'license'], {_TITLE.format("title")})) / len(list_distinct(list_concat(['public', 'license'], {_TITLE.format("title")}))) >= 0.34::DOUBLE ORDER BY id LIMIT 160),
      c AS (SELECT e.*, rank FROM e JOIN (SELECT * FROM h UNION ALL SELECT * FROM l) USING (id)),
      r AS (SELECT *, 3 * contains(lower(title), 'public')::INT + 3 * contains(lower(title), 'license')::INT + contains(lower(content), 'public')::INT + contains(lower(content), 'license')::INT AS raw FROM c),
      s AS (SELECT id, raw, raw * (0.5::DOUBLE + confidence * 0.5::DOUBLE) + CASE WHEN rank < 0 THEN 0.5::DOUBLE / (1 + abs(rank)) ELSE 0 END AS score FROM r)
      SELECT id, raw, round(score, 6) AS score FROM s WHERE raw >= 2 AND score > 0 ORDER BY s.score DESC, id LIMIT 20""",
    "graph_overview": f"""WITH {_EDGES}, {_WAYS}, {_DEG},
      n AS (SELECT 's' || l_suppkey AS node, l_orderkey % 8 AS doc FROM lineitem UNION SELECT 'p' || l_partkey, l_orderkey % 8 FROM lineitem),
      k AS (SELECT node, list_sort(list(DISTINCT doc::VARCHAR)) AS docs FROM n GROUP BY node), known AS (SELECT k.node, docs, coalesce(degree, 0) AS degree FROM k LEFT JOIN deg USING (node)),
      b AS (SELECT least((SELECT count(*) FROM known WHERE len(docs) > 1), 26) AS x, greatest((SELECT count(DISTINCT doc) FROM n), 1) AS d), bd AS (SELECT greatest(floor((80 - x) / d), 5) AS per FROM b),
      ts AS (SELECT node FROM known WHERE len(docs) > 1 ORDER BY degree DESC, node LIMIT 26),
      td AS (SELECT node FROM (SELECT DISTINCT known.node, doc, row_number() OVER (PARTITION BY doc ORDER BY degree DESC, known.node) AS r FROM known JOIN (SELECT DISTINCT node, doc FROM n) m ON known.node = m.node), bd WHERE r <= per),
      ch AS (SELECT node FROM ts UNION SELECT node FROM td), f AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS r FROM known WHERE node NOT IN (SELECT node FROM ch)) WHERE r <= greatest(80 - (SELECT count(*) FROM ch), 0)),
      se AS (SELECT * FROM known WHERE node IN (SELECT node FROM ch UNION SELECT node FROM f)), rl AS (SELECT count(*) FILTER (WHERE degree >= 2) < 0.6 * count(*) AS relax FROM se)
      SELECT node, degree, array_to_string(docs, ',') AS documents FROM se, rl WHERE degree >= CASE WHEN relax THEN 1 ELSE 2 END""",
}

SQL |= {
    "wiki_list": "SELECT doc_id AS id, least(length(text), 200)::INT AS preview, 1 AS ref_count FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license')) AND source IN ('src1', 'src2', 'src3', 'src4') ORDER BY n_chars DESC, doc_id LIMIT 15",
    "citation_confidence": "SELECT c_custkey AS id, round(least(1.0::DOUBLE, (c_custkey % 10) / 10.0::DOUBLE + 0.03::DOUBLE * count(o_orderkey)), 6) AS confidence FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "index_markdown": """WITH g AS (SELECT p_brand AS u, p_type AS t, count(*) AS n, string_agg('- [' || p_name || '](' || printf('%07d', p_partkey) || '.md)', chr(10) ORDER BY p_name, printf('%07d', p_partkey)) AS lines FROM part GROUP BY ALL),
      m AS (SELECT u AS user_id, '# Index' || chr(10) || chr(10) || string_agg('## ' || t || ' (' || n || ')' || chr(10) || chr(10) || lines, chr(10) || chr(10) ORDER BY t) AS m FROM g GROUP BY u) SELECT user_id, md5(m) AS digest, length(m)::INT AS n FROM m""",
    "draft_assemble": """SELECT conv_id AS draft_id, md5(string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    "embedding_manifest": 'SELECT label AS doc_id, vec_id AS chunk_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS "offset" FROM embeddings',
    "model_resolution": "SELECT c_nationkey AS user_id, c_custkey AS id FROM customer WHERE c_custkey % 3 < 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN 1 ELSE 2 END, c_custkey) = 1",
    "stalled_tasks": f"WITH {_TASKS} SELECT id FROM tasks WHERE status = 'running' AND created_at < TIMESTAMP '1997-12-02'",
    "section_prefix": f"""WITH {_SECTIONS}, i AS (SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY section_id) - 1 AS idx, status FROM secs)
      SELECT draft_id, coalesce(min(CASE WHEN status <> 'confirmed' THEN idx END), count(*)) AS prefix FROM i GROUP BY draft_id""",
    "section_depth": """WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 > 0 THEN o_orderkey - CASE WHEN o_orderkey % 2 = 1 THEN 1 WHEN o_orderkey % 4 = 2 THEN 2 WHEN o_orderkey % 8 = 4 THEN 4 ELSE 8 END END AS up FROM orders),
      w AS (SELECT id, (up IS NOT NULL)::BIGINT AS depth FROM t WHERE up IS NULL OR up NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, w.depth + 1 FROM t JOIN w ON t.up = w.id) SELECT id, depth FROM w""",
    "entity_merge": f"""WITH {_EDGES}, m AS (SELECT source, CASE WHEN substr(target, 2)::INT % 2 = 1 THEN 's' || (substr(target, 2)::INT - 1) ELSE target END AS target, weight FROM edges)
      SELECT source, target, sum(weight)::BIGINT AS weight FROM m GROUP BY ALL""",
    "related_images": "WITH h AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT h.doc_id, count(page_id)::INT AS images FROM h LEFT JOIN pages ON page_id % 1000 = h.doc_id GROUP BY h.doc_id",
    "segment_metrics": "SELECT doc_id, 1 AS segments, greatest(1, ceil(length(text) / 1.5))::BIGINT AS tokens_avg, greatest(1, ceil(length(text) / 1.5))::BIGINT AS tokens_max, 1.0::DOUBLE AS coverage FROM documents",
    "sanitized_markdown": r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '!\[([^\]]*)\]\([^)]+\)', '[Image: \1]', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))::INT AS n FROM documents",
}

SQL |= {
    "segment_texts": "SELECT doc_id, 0 AS segment, md5(trim(text)) AS digest FROM documents",
    "document_detail": """WITH v AS (SELECT doc_id, source AS name, CASE WHEN doc_id % 10 > 0 THEN doc_id - doc_id % 10 END AS parent_id, text, lang, source FROM documents), k AS (SELECT parent_id, count(*) AS n FROM v GROUP BY parent_id)
      SELECT v.doc_id, p.name AS parent_name, coalesce(k.n, 0)::INT AS children, len(string_split(v.text, chr(10))) AS chunks, array_to_string(list_sort([v.lang, v.source]), ',') AS tags FROM v LEFT JOIN v p ON v.parent_id = p.doc_id LEFT JOIN k ON k.parent_id = v.doc_id""",
    "page_backfill": """WITH s AS (SELECT o_custkey AS doc_id, lower(o_orderpriority) AS h, arg_max((o_orderkey % 50)::INT, o_orderkey) AS page FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
      a AS (SELECT o_custkey AS doc_id, o_orderkey AS idx, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) END AS h FROM orders), j AS (SELECT a.doc_id, idx, page FROM a LEFT JOIN s ON a.doc_id = s.doc_id AND a.h = s.h)
      SELECT doc_id, idx, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM j""",
    "cross_references": """WITH r AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS t FROM part WHERE p_partkey <= 20), x AS (SELECT f AS q FROM r UNION SELECT t FROM r),
      m AS (SELECT q, min(p_partkey) AS id FROM x JOIN part ON contains(lower(p_name), lower(q)) GROUP BY q)
      SELECT DISTINCT a.id AS from_id, b.id AS to_id, 'relates' AS relation FROM r JOIN m a ON r.f = a.q JOIN m b ON r.t = b.q WHERE a.id <> b.id""",
}

# The whole jobs: of every user, term and node, and beside the samples of what is asked for.
for _name, _part in {"postings_index": "", "graph_overview": "", "latency_ewma": "", "entity_evidence": " WHERE p_partkey <= 5", "cross_references": " WHERE p_partkey <= 20"}.items():
    SQL[f"{_name}_all"] = SQL[_name].replace(_part, "") if _part else SQL[_name]
