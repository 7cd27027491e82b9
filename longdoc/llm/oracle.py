"""DuckDB SQL of the queries that SQL can express (the others are tested against brute force)."""

from __future__ import annotations

from longdoc.llm import chat, lexical, licenses, merkle

WORD = r"'[^\x20\x09-\x0D]+'"


def components(nodes: str, links: str) -> str:
    """CTE ``component``(id, component_id) over ``nodes``(id) and ``links``(a, b)."""
    return f"""
sides AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, e.b FROM reach r JOIN sides e ON r.other = e.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id < y.id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{components("v", "links").strip()},
degree AS (SELECT a AS id, count(*) AS n FROM sides GROUP BY a)
SELECT v.id AS vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.id = c.component_id AS kept
FROM v JOIN component c USING (id) LEFT JOIN degree d USING (id)"""

OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
owner AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS p FROM windows x JOIN owner o USING (k) WHERE o.first < x.doc_id),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
cut AS (SELECT s.doc_id, count(g.p) AS n_removed, string_agg(s.word, ' ' ORDER BY s.p) FILTER (WHERE g.p IS NULL) AS kept
        FROM placed s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p GROUP BY s.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN cut c USING (doc_id)"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (SELECT id, CASE WHEN len(ws) < 2 THEN ws
                      ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS x FROM w),
u AS (SELECT id, unnest(x) AS x FROM s),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (SELECT h.a, h.b FROM shared h JOIN s p ON p.id = h.a JOIN s q ON q.id = h.b
          WHERE 100 * h.n >= 80 * (len(p.x) + len(q.x) - h.n)),
{components("w", "links").strip()}
SELECT s.id AS doc_id, len(s.x) AS n_shingles, c.component_id, s.id = c.component_id AS kept FROM s JOIN component c USING (id)"""

SQL: dict[str, str] = {"op3_embedding_neardup": OP3, "op7_chat_format": chat.SQL, "op8_substring_dedup": OP8,
                       "op10_minhash": OP10, "op11_lexical_search": lexical.SQL, "op12_licenses": licenses.SQL, "op13_merkle": merkle.SQL}
