"""DuckDB SQL for the queries of catalog_tables."""

from tessella.plans.oracles import _EDGES, _PAGE, _REFS, SQL as _BASE
from tessella.plans.oracles import _WORDS, _bm25

_LINEAGE = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'document_convert' WHEN 1 THEN 'rag_embed_index' WHEN 2 THEN 'rag_index' ELSE 'wiki_index' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS made, o_custkey AS doc, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey - o_orderkey % 4 END AS up,
  CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey WHEN o_orderkey % 8 < 4 AND o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 8 END AS op, (o_orderkey % 3)::INT AS attempt FROM orders)"""
_RF = "r AS (SELECT l_orderkey AS section_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chunk_id, l_suppkey AS document_id, l_discount * 10::DOUBLE AS score, l_returnflag AS kind FROM lineitem)"
_SEC = "s AS (SELECT o_orderkey AS section_id, ['pending', 'generating', 'reviewing', 'failed', 'locked'][o_orderkey % 5 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS content, CASE WHEN o_orderkey % 2 = 0 THEN 'one' END AS a, CASE WHEN o_orderkey % 7 > 0 THEN 'two' END AS b, o_orderkey % 100 AS words FROM orders)"
_HITS = f"{_bm25([['licensed'], ['under']])}, {_PAGE.format(n=40)}"

_GRAPH = """v AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT max(embedding) FILTER (WHERE vec_id = 0)::DOUBLE[] AS low, max(embedding) FILTER (WHERE vec_id = 1)::DOUBLE[] AS high FROM embeddings),
      c AS (SELECT vec_id, list_dot_product(e, low) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(low, low))) AS low, list_dot_product(e, high) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(high, high))) AS high FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q),
      li AS (SELECT l_partkey AS p, l_orderkey AS o, 'd' || (l_orderkey % n) AS chunk, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem, v),
      en AS (SELECT 'p' || p AS name, list(DISTINCT chunk ORDER BY chunk) AS ids, p % any_value(n) AS vec FROM li, v GROUP BY p),
      re AS (SELECT 'p' || least(p, b) AS s, 'p' || greatest(p, b) AS t, list(DISTINCT chunk ORDER BY chunk) AS ids, (least(p, b) * 7 + greatest(p, b)) % any_value(n) AS vec FROM li, v WHERE b IS NOT NULL AND b <> p GROUP BY least(p, b), greatest(p, b)),
      be AS (SELECT name, ids, row_number() OVER (ORDER BY low DESC, name) AS k FROM en JOIN c ON vec = vec_id WHERE low >= 0.2::DOUBLE QUALIFY k <= 60),
      br AS (SELECT s, t, ids, row_number() OVER (ORDER BY high DESC, s, t) AS k FROM re JOIN c ON vec = vec_id WHERE high >= 0.2::DOUBLE QUALIFY k <= 60),
      own AS (SELECT name, k, unnest(ids) AS chunk, unnest(range(len(ids))) AS pos FROM be),
      near AS (SELECT DISTINCT name, other FROM (SELECT s AS name, t AS other FROM re UNION ALL SELECT t, s FROM re) w WHERE name IN (SELECT name FROM be)),
      held AS (SELECT near.name, unnest(ids) AS chunk FROM near JOIN en ON en.name = other),
      sh AS (SELECT own.name, own.chunk, count(*) AS n FROM own JOIN held ON held.name = own.name AND held.chunk = own.chunk GROUP BY ALL),
      l AS (SELECT chunk, k, -coalesce(n, 0) AS n, pos FROM own LEFT JOIN sh USING (name, chunk)),
      l1 AS (SELECT chunk, k, n, pos FROM l QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY k, n, pos) = 1),
      g1 AS (SELECT chunk, k, pos FROM (SELECT k, unnest(ids) AS chunk, unnest(range(len(ids))) AS pos FROM br) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY k, pos) = 1),
      lists AS (SELECT 'local' AS origin, chunk, row_number() OVER (ORDER BY k, n, pos, chunk) AS nth, NULL::DOUBLE AS cosine FROM l1 QUALIFY nth <= 80
        UNION ALL SELECT 'global', chunk, row_number() OVER (ORDER BY k, pos, chunk) AS nth, NULL FROM g1 QUALIFY nth <= 80
        UNION ALL SELECT 'vector', 'd' || vec_id, row_number() OVER (ORDER BY low DESC, 'd' || vec_id) AS nth, low FROM c WHERE low >= 0.2::DOUBLE QUALIFY nth <= 80),
      modes AS (SELECT * FROM (VALUES ('local', 'local', 0), ('global', 'global', 0), ('hybrid', 'local', 0), ('hybrid', 'global', 1), ('mix', 'vector', 0), ('mix', 'local', 1), ('mix', 'global', 2), ('naive', 'vector', 0)) m(mode, origin, turn)),
      firsts AS (SELECT mode, chunk, origin, nth, turn, max(cosine) OVER (PARTITION BY mode, chunk) AS cosine FROM lists JOIN modes USING (origin) QUALIFY row_number() OVER (PARTITION BY mode, chunk ORDER BY nth, turn) = 1),
      kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY mode ORDER BY nth, turn) <= 80),
      fits AS (SELECT *, sum(substr(chunk, 2)::BIGINT % 90 + 10) OVER (PARTITION BY mode ORDER BY nth, turn) AS used FROM kept),
      placed AS (SELECT mode, chunk, origin, cosine, row_number() OVER (PARTITION BY mode ORDER BY nth, turn) AS nth, count(*) OVER (PARTITION BY mode) AS total FROM fits WHERE used <= 2000)"""

def _extracted(where: str) -> str:
    return f"""WITH d AS (SELECT source || '/' || doc_id AS chunk, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{{6,}}') AS w FROM documents WHERE {where}),
      e AS (SELECT DISTINCT chunk, unnest(w) AS name FROM d),
      r AS (SELECT chunk, least(w[i], w[i + 1]) AS a, greatest(w[i], w[i + 1]) AS b FROM (SELECT chunk, w, unnest(range(1, len(w))) AS i FROM d) WHERE w[i] <> w[i + 1])
      SELECT name AS a, '' AS b, CASE WHEN length(name) > 9 THEN 'concept' ELSE 'component' END AS kind, 0.0::DOUBLE AS weight, md5(string_agg(chunk, '<SEP>' ORDER BY chunk)) AS source_id FROM e GROUP BY name
      UNION ALL SELECT a, b, 'edge', count(*)::DOUBLE, md5(string_agg(DISTINCT chunk, '<SEP>' ORDER BY chunk)) FROM r GROUP BY a, b"""


SQL = {
    "retry_delays": """WITH e AS (SELECT event_id, event_id AS k FROM events), h AS (SELECT *, CASE k % 5 WHEN 0 THEN least((k % 1000) * 1000, 300000) WHEN 1 THEN greatest(0, least((k % 900 - 100) * 1000, 300000)) END AS hint FROM e)
      SELECT event_id, hint::BIGINT AS hint_ms, floor(b + b * 0.25::DOUBLE * ((k % 21 - 10) / 10::DOUBLE) + 0.5::DOUBLE)::BIGINT AS wait_ms, (400 + k % 30) IN (402, 403, 429) AND k % 3 = 0 AS spent,
        CASE k % 4 WHEN 0 THEN (k % 3) * 60000 + (k % 60) * 1000 WHEN 1 THEN k % 900 WHEN 2 THEN (k % 90) * 1000 + 500 END::BIGINT AS reset_ms
      FROM (SELECT *, CASE WHEN k % 5 = 0 THEN hint ELSE power(2, 4 - greatest(1, least(k % 5, 3))) * 1000 END::DOUBLE AS b FROM h)""",
    "diagram_needs": """WITH t AS (SELECT p_partkey, lower(concat_ws(' ', p_name, ['the Data Flow', 'a pipeline', 'nothing', 'Include a Flowchart', '部署拓扑', 'a roadmap, phased', 'sequence of calls', '需要一张图', 'HIGH availability', 'plain'][p_partkey % 10 + 1], CASE WHEN p_partkey % 2 = 0 THEN p_type END)) AS t FROM part)
      SELECT p_partkey, p_partkey % 10 NOT IN (2, 9) AS needs, CASE p_partkey % 10 WHEN 0 THEN 'data-flow' WHEN 3 THEN 'flowchart' WHEN 4 THEN 'deployment' WHEN 5 THEN 'timeline' WHEN 6 THEN 'sequence' ELSE 'architecture' END AS type FROM t""",
    "edited_entities": """WITH n AS (SELECT 'p' || p_partkey AS id, p_type AS t, p_name AS x, p_brand AS s, p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 'p' || p_partkey, 'new', p_name, '', p_partkey, p_brand FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 = 0)
      SELECT id, CASE WHEN k % 5 = 1 THEN v ELSE t END AS entity_type, CASE WHEN k % 5 > 1 THEN v ELSE x END AS description, s AS source_id FROM n
      UNION ALL SELECT 'p' || p_partkey, 'refused', CASE p_partkey % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'entity_type' ELSE 'description' END, CASE WHEN p_partkey % 5 = 0 THEN 'field' ELSE 'missing' END FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 4 > 0)""",
    "extracted_graph": _extracted("true"),
    "extracted_graph_purged": _extracted("source <> 'src1'"),
    "graph_retrieval": f"WITH {_GRAPH} SELECT mode, nth, chunk, origin, round(least(0.75::DOUBLE, CASE WHEN cosine IS NOT NULL THEN least(1, greatest(0, cosine)) ELSE greatest(0.25::DOUBLE, 0.75::DOUBLE - 0.35::DOUBLE * (nth - 1) / greatest(total - 1, 1)) END), 6) AS score FROM placed",
    "upload_layers": """WITH p AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS page, (l_quantity * 2)::INT AS len, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
      s AS (SELECT *, greatest(1.0::DOUBLE, n / 200.0::DOUBLE) AS step FROM p), g AS (SELECT doc_id, max(n) AS pages, avg((len > 50)::INT) AS ratio FROM s WHERE n <= 200 OR floor(page / step) <> floor((page - 1) / step) GROUP BY doc_id)
      SELECT doc_id, pages, round(ratio, 6) AS ratio, pages >= 80 AND ratio >= 0.5 AS bypass, (doc_id % 10) / 10.0::DOUBLE < 0.6 OR (pages + 400 > 500 AND pages / (pages + 400) < 0.4::DOUBLE) AS poor FROM g""",
    "synthesized_headings": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '### 1.2 ' || p_name WHEN 1 THEN '## Chapter 3 ' || p_name WHEN 2 THEN '4. ' || p_name || '.' ELSE p_name END AS line FROM part",
    "structure_buckets": "SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_linenumber % 5 IN (0, 4))::INT AS sections, count(*) FILTER (WHERE l_linenumber % 5 = 1)::INT AS texts, count(*) FILTER (WHERE l_linenumber % 5 = 2)::INT AS tables, count(*) FILTER (WHERE l_linenumber % 5 = 3)::INT AS pictures FROM lineitem GROUP BY l_orderkey",
    "image_manifest": "SELECT DISTINCT doc_id % 50 AS doc_id, 'img_' || substr(md5(text), 1, 8) || '.png' AS filename FROM documents WHERE strlen(text) >= 100",
    "conversion_cache": "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)",
    "event_stream_text": "SELECT event_type AS event, count(*) AS events, count(*) FILTER (WHERE event_id % 7 > 0) AS whole, sum(CASE WHEN event_id % 7 > 0 THEN floor(value)::BIGINT END)::BIGINT AS total FROM events GROUP BY event_type",
    "result_badges": """WITH h AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN (p_partkey % 131 - 15) / 100.0::DOUBLE END AS score, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 113) / 107.0::DOUBLE END AS vector FROM part),
      p AS (SELECT id, floor(greatest(0, least(100, coalesce(CASE WHEN id % 4 = 0 THEN score ELSE coalesce(vector, score) END, 0) * 100)) + 0.5)::INT AS percent FROM h)
      SELECT id, percent, CASE WHEN id % 4 = 0 THEN 'hit' WHEN percent >= 80 THEN 'high' WHEN percent >= 60 THEN 'medium' ELSE 'low' END AS level FROM p""",
    "model_catalog": "SELECT DISTINCT p_brand AS model, (length(p_brand) * 100 - 700)::BIGINT AS context FROM part WHERE length(p_brand) > 7",
    "usage_sink": "WITH u AS (SELECT event_id AS id, CASE WHEN floor(value)::BIGINT % 3 > 0 THEN floor(value)::BIGINT % 3 END AS tokens_in, (event_id % 50) % 2 AS tokens_out FROM events) SELECT * FROM u WHERE coalesce(tokens_in, 0) + tokens_out > 0",
    "orphan_folders": "SELECT DISTINCT o_orderkey % 3000 AS doc_id FROM orders WHERE o_orderkey % 3000 NOT IN (SELECT c_custkey FROM customer)",
    "okf_entries": """SELECT printf('%07d', p_partkey) AS slug, md5('---' || chr(10) || 'title: {"title":"' || p_name || '"}' || chr(10) || 'type: ' || p_type || chr(10) || 'confidence: ' || ['0.0', '0.25', '0.5', '0.75'][p_partkey % 4 + 1] || chr(10) || 'sources: ["' || p_brand || '"]' || chr(10) || '---' || chr(10) || chr(10) || p_brand) AS digest FROM part""",
    "log_markdown": """WITH c AS (SELECT o_custkey % 20 AS u, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, '- ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' **' || o_orderstatus || '** ' || o_orderpriority AS line FROM orders)
      SELECT u AS user_id, md5('# Log' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS digest FROM c WHERE n <= 50 GROUP BY u""",
    "draft_markdown": """WITH b AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN '### ' ELSE '## ' END || o_orderpriority || chr(10) || chr(10) || 'See ' || CASE o_orderkey % 3 WHEN 2 THEN '*Pic 2 unavailable*' ELSE '![Figure: Pic ' || (o_orderkey % 3) || '](p' || (o_orderkey % 3) || '.png)' END || ' and [DIAGRAM:zz]' AS body FROM orders WHERE o_orderstatus <> 'O')
      SELECT c AS draft_id, md5('# ' || any_value(c_name) || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY k)) AS digest FROM b JOIN customer ON c = c_custkey GROUP BY c""",
    "indexed_keyword_search": f"WITH {_bm25([['and', 'the', 'license'], ['the', 'license', 'version']])} SELECT r.doc_id, source || '/' || r.doc_id AS chunk_id, round(rank, 6) AS rank, (SELECT count(*) FROM documents x WHERE x.source = documents.source) AS documents FROM (SELECT doc_id, rank FROM ranked ORDER BY rank, doc_id LIMIT 30) r JOIN documents ON documents.doc_id = r.doc_id",
    "refreshed_postings": f"WITH w AS (SELECT doc_id, {_WORDS.format('CASE WHEN doc_id % 5 = 0 THEN source ELSE text END')} AS w FROM documents) SELECT doc_id, len(list_distinct(w))::BIGINT AS terms, len(w)::BIGINT AS tokens FROM w WHERE len(w) > 0",
    "hybrid_search": _BASE["rrf_fusion"].replace("every AS (SELECT *, row_number()", """graph AS (SELECT doc_id, title, content, least(0.75::DOUBLE, greatest(0.25::DOUBLE, 0.75::DOUBLE - 0.35::DOUBLE * (m - 1) / 39)) AS score, 2 AS nth FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id * 53 % 997, doc_id) AS m FROM documents) h JOIN (SELECT doc_id, title, content FROM docs) USING (doc_id) WHERE m <= 40),
      every AS (SELECT *, row_number()""").replace("UNION ALL SELECT * FROM keyword)", "UNION ALL SELECT * FROM keyword UNION ALL SELECT * FROM graph)").replace("CASE nth WHEN 0 THEN 1.0 ELSE 1.35 END", "CASE nth WHEN 0 THEN 1.0 WHEN 1 THEN 1.35 ELSE 0.85 END").replace("0.01::DOUBLE * score + boost", "0.01::DOUBLE * least(1, greatest(0, score)) + boost").replace("CASE WHEN nth = 0 THEN least(1, greatest(0, score + boost)) END) AS v", "CASE WHEN nth <> 1 THEN least(1, greatest(0, score + boost)) END) AS v").replace("WHEN first = 0 THEN 'direct' ELSE 'keyword' END", "WHEN first = 0 THEN 'direct' WHEN first = 1 THEN 'keyword' ELSE 'graph' END").replace("CASE WHEN first = 1 THEN k ELSE v END AS s", "CASE WHEN first = 1 THEN greatest(k, coalesce(v, 0)) ELSE v END AS s").replace(", CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS label", "").replace("rank <= 20", "rank <= 30"),
    "entity_lookup": """WITH e AS (SELECT DISTINCT l_suppkey || '/' || l_orderkey AS chunk_id, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_name = 'large ring')
      SELECT row_number() OVER (ORDER BY chunk_id) AS nth, chunk_id, s_name AS document_name, 'line' AS content, 1.0::DOUBLE AS score FROM e QUALIFY nth <= 8""",
    "distinct_images": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "domain_context": "WITH h AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n, text FROM documents QUALIFY n <= 5) SELECT md5(string_agg('[' || n || '] ' || substr(text, 1, 500), chr(10) || chr(10) ORDER BY n)) AS digest FROM h",
    "graph_summary": f"WITH {_EDGES}, n AS (SELECT source AS id FROM edges UNION SELECT target FROM edges) SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM edges) AS relations, (SELECT count(*) FROM n WHERE contains(id, 'p1')) AS labels",
    "graph_flat_nodes": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'entity' END AS type, p_name AS description, 'd1/c' AS source_id FROM part",
    "graph_deletion": f"WITH {_EDGES}, n AS (SELECT source AS id FROM edges UNION SELECT target FROM edges) SELECT source, target, weight FROM edges WHERE substr(target, 2)::BIGINT % 2 = 1 UNION ALL SELECT id, NULL, 0 FROM n WHERE id NOT LIKE 's%' OR substr(id, 2)::BIGINT % 2 = 1",
    "graph_checks": """WITH f AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders) SELECT id AS doc_id, 'stale' AS issue FROM f WHERE id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT id FROM f)
      UNION ALL SELECT p_partkey, 'lost' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 > 0)""",
    "cross_document_nodes": "SELECT l_partkey AS id FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey % 3) > 1",
    "graph_modes": "SELECT p_partkey, CASE WHEN p_size * 100 >= 1536 THEN 'graph' ELSE 'basic' END AS mode FROM part",
    "topology_edges": f"WITH {_REFS} SELECT draft_id, document AS document_name, count(*) AS weight, count(DISTINCT section_id)::INT AS sections, min(section_id) AS first, count(*)::INT AS chunks FROM refs WHERE source_type = 'rag_chunk' GROUP BY ALL",
    "wiki_links": """WITH l AS (SELECT DISTINCT a.l_partkey AS f, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
      SELECT p_partkey AS id, coalesce(o.n, 0)::INT AS outgoing, coalesce(b.n, 0)::INT AS backlinks FROM part LEFT JOIN (SELECT f, count(*) AS n FROM l GROUP BY f) o ON o.f = p_partkey LEFT JOIN (SELECT t, count(*) AS n FROM l GROUP BY t) b ON b.t = p_partkey""",
    "wiki_tags": "SELECT doc_id, lang AS tag FROM documents UNION SELECT doc_id, lang || 'x' FROM documents WHERE doc_id % 2 = 1",
    "wiki_hits_page": f"""WITH {_HITS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS pos FROM page) SELECT doc_id AS id, pos, 'hit ' || lang AS preview, 1 AS ref_count FROM p JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2', 'src3') ORDER BY pos LIMIT 3 OFFSET 3""",
    "packed_vector_scan": "SELECT len(embedding)::INT AS dimensions, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings",
    "event_text_scan": "SELECT event_type AS event, count(*) AS events, sum(event_id)::BIGINT AS ids, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "key_value_scan": "SELECT p_name || ' ' || p_partkey AS name, count(DISTINCT l_suppkey)::INT AS sources, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS chunk_ids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_partkey",
    "deep_descendants": """WITH RECURSIVE t AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders),
      w AS (SELECT up AS above, id FROM t WHERE up IS NOT NULL UNION ALL SELECT t.up, w.id FROM w JOIN t ON t.id = w.above WHERE t.up IS NOT NULL)
      SELECT above AS root, id FROM w WHERE above % 7 = 0""",
    "task_descendants": f"WITH {_LINEAGE} SELECT r.id AS root, t.id FROM t JOIN t r ON t.up = r.id",
    "latest_attempts": f"WITH {_LINEAGE} SELECT doc AS document_id, type, id, attempt FROM t QUALIFY row_number() OVER (PARTITION BY doc, type ORDER BY CASE WHEN type = 'rag_index' THEN attempt ELSE 0 END DESC, made DESC, id DESC) = 1",
    "processing_round": f"""WITH {_LINEAGE}, c AS (SELECT doc, id, op, made FROM t WHERE type = 'document_convert' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY made DESC, id DESC) = 1)
      SELECT t.doc AS document_id, t.id, t.type FROM t JOIN c ON t.doc = c.doc WHERE CASE WHEN c.op IS NOT NULL THEN coalesce(t.op = c.op, false) ELSE t.id = c.id OR (t.type <> 'document_convert' AND t.op IS NULL AND t.made >= c.made AND (t.up IS NULL OR t.up = c.id)) END""",
    "claimable_tasks": f"""WITH {_LINEAGE}, k AS (SELECT *, CASE WHEN status = 'failed' THEN 'pending' WHEN id % 50 = 0 THEN 'running' ELSE 'completed' END AS now FROM t), b AS (SELECT type, count(*) AS busy FROM k WHERE now = 'running' GROUP BY type),
      d AS (SELECT id, type, made, row_number() OVER (PARTITION BY type ORDER BY made, id) AS nth FROM k WHERE now = 'pending'),
      f AS (SELECT d.* FROM d LEFT JOIN b USING (type) WHERE nth <= 300 AND nth + coalesce(busy, 0) <= CASE type WHEN 'document_convert' THEN 100 WHEN 'rag_embed_index' THEN 200 WHEN 'rag_index' THEN 50 ELSE 1 END)
      SELECT id, type FROM (SELECT *, row_number() OVER (ORDER BY made, id) AS place FROM f) WHERE place + (SELECT coalesce(sum(busy), 0) FROM b) <= 300""",
    "task_recovery": f"""WITH {_LINEAGE} SELECT id, CASE WHEN id % 5 = 0 THEN 'cancelled' ELSE 'pending' END AS what, NULL::BIGINT AS not_before FROM t WHERE status = 'running' AND made + INTERVAL 5 MINUTES < TIMESTAMP '1996-01-01'
      UNION ALL SELECT id, 'retry', epoch(made)::BIGINT + 3600 + CASE attempt WHEN 0 THEN 120 ELSE 600 END FROM t WHERE status = 'failed' AND attempt < 2 AND id % 2 = 0
      UNION ALL SELECT id, 'clean', epoch(made)::BIGINT + 3660 FROM t WHERE status = 'failed' AND attempt < 1 AND id % 2 = 0""",
    "task_identity": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey + 1)::VARCHAR WHEN o_orderkey % 5 > 0 THEN o_custkey::VARCHAR END AS document FROM orders",
    "resumed_work": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "reply_markers": "SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN 'DIRECTION_CONFIRMED' WHEN 2 THEN 'GENERATE_DIRECT' END AS marker FROM conversations",
    "section_references": f"WITH {_RF} (SELECT chunk_id, score, true AS wiki FROM r WHERE score >= 0.4::DOUBLE AND document_id BETWEEN 1 AND 60 ORDER BY score DESC, chunk_id LIMIT 4) UNION ALL (SELECT chunk_id, score, false FROM r WHERE score >= 0.4::DOUBLE ORDER BY score DESC, chunk_id LIMIT 8)",
    "merged_references": f"""WITH {_RF} SELECT section_id, chunk_id, row_number() OVER (PARTITION BY section_id ORDER BY kind <> 'R', score DESC, chunk_id)::INT AS position FROM r
      UNION ALL SELECT section_id, chunk_id, 0 FROM r WHERE section_id NOT IN (SELECT section_id FROM r WHERE section_id % 3 = 0 AND kind = 'N') UNION ALL SELECT section_id, chunk_id, 0 FROM r WHERE section_id % 3 = 0 AND kind = 'N'""",
    "graph_references": f"WITH {_RF} SELECT 'rag_chunk' AS source_type, 'doc' AS document_name, count(*) AS rows, round(sum(score), 3) AS relevance FROM r UNION ALL SELECT 'rag_graph', 'Knowledge graph', count(*), round(count(*) * 0.7::DOUBLE, 3) FROM r WHERE section_id % 10 = 0",
    "reference_views": f"WITH {_RF} SELECT chunk_id, CASE WHEN kind = 'R' THEN 'wiki' ELSE 'rag_chunk' END AS source_type, (kind = 'R')::INT AS images FROM r",
    "section_states": f"""WITH {_SEC} SELECT section_id, status = 'reviewing' AND a IS NOT NULL AND b IS NOT NULL AND content IS NULL AS comparing, coalesce(content, a, b) AS shown,
      CASE WHEN coalesce(content, a, b) = a THEN 'model_a' WHEN coalesce(content, a, b) = b THEN 'model_b' ELSE 'edited' END AS source,
      status IN ('pending', 'failed') OR (status = 'reviewing' AND coalesce(content, '') = '') AS fresh, status <> 'generating' AS again FROM s""",
    "confirmed_sections": f"WITH {_SEC} SELECT section_id, CASE WHEN section_id % 2 = 0 THEN 'locked' ELSE status END AS status, CASE WHEN section_id % 2 = 0 THEN 4 ELSE words END AS words, CASE WHEN section_id % 4 = 0 THEN 2 WHEN section_id % 2 = 0 THEN 1 END AS version FROM s",
    "patched_outline": """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey - 1)::VARCHAR END AS parent_id, o_orderkey::INT AS idx, CASE WHEN o_orderkey % 5 = 1 THEN 'changed' ELSE o_orderpriority END AS title, (o_orderkey % 900)::INT AS words FROM orders WHERE o_orderkey % 5 > 0
      UNION ALL SELECT 'new-' || substr(md5('tmp' || o_orderkey), 1, 12), 'new-' || substr(md5('tmp' || o_orderkey), 1, 12), o_orderkey::INT, '', (o_orderkey % 900)::INT FROM orders WHERE o_orderkey % 5 = 2""",
    "outline_parents": """WITH o AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT c AS doc_id, (n - 1)::VARCHAR AS path, NULL AS parent, NULL::INT AS parent_idx FROM o UNION ALL SELECT c, (n - 1) || ',0', (n - 1)::VARCHAR, (2 * n - 2)::INT FROM o""",
    "updated_embeddings": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 6 = 0 THEN 1 ELSE len(embedding) END::INT AS dimensions FROM embeddings",
    "document_deletion": """WITH c AS (SELECT DISTINCT l_suppkey AS s, l_orderkey FROM lineitem) SELECT 'documents' AS what, count(*) AS rows FROM supplier WHERE s_suppkey % 4 <> 2 UNION ALL SELECT 'chunks', count(*) FROM c WHERE s % 4 <> 2 UNION ALL SELECT 'index', count(*) FROM c WHERE s % 4 <> 2
      UNION ALL SELECT 'deleted', count(*) FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL SELECT 'not found', count(*) FROM supplier WHERE s_suppkey % 4 = 0""",
    "text_rules": """SELECT p_partkey AS id, p_name AS plain, p_name AS title, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '…' ELSE p_name END AS short, p_brand || '__' || p_name AS file, 'https://h/v1' AS base, CASE WHEN p_partkey % 2 = 0 THEN least(p_partkey, 3600) END AS wait,
      greatest(0, len(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' end', ' ')) - 2)::INT AS triples, array_to_string(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 2), '|') AS terms, '![a](/api/' || p_partkey || '.png)' AS image, CASE WHEN p_partkey % 2 = 0 THEN 'zh-CN' ELSE 'en' END AS locale,
      CASE WHEN p_partkey % 2 = 0 THEN 'body' ELSE '## 1. ' || p_name || chr(10) || chr(10) || 'body' END AS body, CASE WHEN p_type IN ('LARGE', 'SMALL') THEN p_type ELSE 'general' END || CASE WHEN p_brand = 'Brand#7' THEN '+Brand#7' ELSE '' END AS archetype,
      CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS points, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS constraints, p_name || ' ' || p_name || ' ' || p_name || ' ' || p_type || ' p q h' AS query FROM part""",
}
