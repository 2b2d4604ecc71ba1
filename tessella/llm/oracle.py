"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from tessella.llm.chat_format import BEGIN, CLOSE, END, NEXT, OPEN

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

# The water-filling runs over the sources sorted by cap / weight: the level is the first one whose
# remaining sources all stay under their cap.
OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_cap,
             sum(weight) OVER (ORDER BY cap / weight DESC, source DESC) AS open_weight, (SELECT sum(source_size) FROM s) AS total FROM w),
l AS (SELECT arg_min((total - full_cap) / open_weight, ratio) FILTER (WHERE (total - full_cap) / open_weight <= ratio) AS level FROM o),
t AS (SELECT w.*, least(cap, weight * level)::DOUBLE AS target,
             ('0x' || substr(md5('42:' || coalesce(source, chr(0))), 1, 5))::INT / 1048576.0::DOUBLE AS draw FROM w, l),
r AS (SELECT d.*, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (least(floor(k * rate + draw) - floor((k - 1) * rate + draw), 3) * size)::BIGINT AS taken
FROM r
"""

_CONTROL = r"""regexp_replace({}, '(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\]|SEP\])', '\1\4\\\2\5\3\6', 'g')"""
OP7 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS again FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_CONTROL.format("text")}) + CASE WHEN again THEN {len(NEXT)} ELSE {len(BEGIN + OPEN + CLOSE + END)} + length({_CONTROL.format("role")}) END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


# All pages of the synthetic table hold one article of headings and paragraphs, so SQL can cut it out.
OP8 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(h1|p|br)[^a-zA-Z>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(x, '&(amp|quot|lt|gt)\b;?', '&\1;', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) QUALIFY row_number() OVER w <= 5
"""

# crc32 by its table, which is worked out by rule; near words by strings with one code point taken out.
OP13 = r"""
WITH RECURSIVE tb AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, count(*) AS n, encode(doc || ':' || run) AS s FROM r GROUP BY doc, run),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(1, octet_length(s) + 1), lambda i: ('0x' || hex(array_slice(s, i, i)))::INT::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM d, tb),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(w) >= 7),
x AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM w)),
p AS (SELECT a.w AS a, b.w AS b, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
      UNION SELECT w.w, x.w, x.n FROM w JOIN x ON w.w = x.rest UNION SELECT x.w, w.w, w.n FROM w JOIN x ON w.w = x.rest),
m AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM p GROUP BY a),
f AS (SELECT w.w AS word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN m ON w.w = m.a),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.at AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op5_mix_sources": OP5, "op7_chat_format": OP7, "op8_html_extract": OP8, "op11_vantage_negatives": OP11, "op13_anagram_variants": OP13}
