"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Fragments below mirror the Spark derivations in ``longdoc.plans.corpus``:
the same word splitter, vocabulary order, chunking and test-data mapping.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see longdoc.constants): 32000 pieces
# with ids of their own, chunk size 64, k 2, PAD 0, EOS 1, UNK 2, WORD 3, bytes
# from 4 and pieces from 260 on.
V = 32000
C = 64

WORDS = r"list_filter(regexp_split_to_array({x}, '[ \t\n\r]+'), lambda w: w <> '')"
PIECES = WORDS.replace("{x}", r"regexp_replace({x}, '(<pad>|</s>|<unk>)', ' \1 ', 'g')")


def words(x: str) -> str:
    return WORDS.replace("{x}", x)


def pieces(x: str) -> str:
    return PIECES.replace("{x}", x)


VOCAB = f"""
_vp AS (SELECT doc_id, {pieces('text')} AS toks FROM documents),
_vc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM _vp)
        WHERE token NOT IN ('<pad>', '</s>', '<unk>') GROUP BY token),
vocab AS (SELECT token, CAST(259 + row_number() OVER (ORDER BY cnt DESC, token ASC) AS INTEGER) AS token_id,
                 CAST(cnt AS BIGINT) AS cnt
          FROM (SELECT * FROM _vc ORDER BY cnt DESC, token ASC LIMIT {V}))
"""


def token_rows(name: str, src: str, key: str, text: str, max_len: int | None = None) -> str:
    """CTEs ``{name}_raw``(key, pos, id) without EOS and ``name`` with the
    trailing EOS (C1 when ``max_len`` is set: ids cut to max_len - 1, then EOS). A
    piece outside the vocabulary is WORD and its UTF-8 bytes."""
    cut = f"WHERE pos < {max_len - 1}" if max_len else ""
    eos_pos = f"least(coalesce(n.n, 0), {max_len - 1})" if max_len else "coalesce(n.n, 0)"
    return f"""
_{name}_p AS (SELECT {key} AS k, {pieces(text)} AS toks FROM {src}),
_{name}_t AS (SELECT k, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM _{name}_p),
_{name}_s AS (
  SELECT t.k, t.pos, CASE t.token WHEN '<pad>' THEN [0] WHEN '</s>' THEN [1] WHEN '<unk>' THEN [2]
    ELSE CASE WHEN v.token_id IS NOT NULL THEN [v.token_id]
      ELSE list_concat([3], list_transform(range(1, len(hex(encode(t.token))), 2),
             lambda i: CAST('0x' || substr(hex(encode(t.token)), i, 2) AS INTEGER) + 4)) END END AS ids
  FROM _{name}_t t LEFT JOIN vocab v ON t.token = v.token),
_{name}_u AS (SELECT k, pos, unnest(ids) AS id, unnest(range(len(ids))) AS sub FROM _{name}_s),
{name}_raw AS (SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY pos, sub) - 1 AS pos, id FROM _{name}_u),
_{name}_n AS (SELECT {key} AS k, count(*) AS n FROM {name}_raw GROUP BY ALL),
{name} AS (SELECT * FROM {name}_raw {cut}
  UNION ALL SELECT p.k AS {key}, {eos_pos} AS pos, 1 AS id FROM _{name}_p p LEFT JOIN _{name}_n n ON p.k = n.k)
"""


def decode_ctes(name: str, src: str, keys: str, clean: bool = True) -> str:
    """``name``({keys}, text): the words of id rows ``src``({keys}, pos, id). A
    word begins at a piece or at WORD; its bytes make characters, and those that a cut
    left without their lead or their last byte go."""
    text = "string_agg(w, ' ' ORDER BY wd)"
    text = f"regexp_replace({text}, ' ([.,!?])', '\\1', 'g')" if clean else text
    return f"""
_{name}_w AS (SELECT {keys}, pos, id, sum(CASE WHEN id = 3 OR id >= 260 THEN 1 ELSE 0 END)
                OVER (PARTITION BY {keys} ORDER BY pos) AS wd FROM {src} WHERE id >= 3),
_{name}_b AS (SELECT {keys}, wd, pos, id - 4 AS b, sum(CASE WHEN id - 4 BETWEEN 128 AND 191 THEN 0 ELSE 1 END)
                OVER (PARTITION BY {keys}, wd ORDER BY pos) AS ch FROM _{name}_w WHERE id BETWEEN 4 AND 259),
_{name}_e AS (SELECT {keys}, wd, ch, string_agg(printf('%02X', b), '' ORDER BY pos) AS h, count(*) AS n, arg_min(b, pos) AS lead
              FROM _{name}_b GROUP BY ALL),
_{name}_c AS (SELECT *, CASE WHEN lead < 128 THEN 1 WHEN lead BETWEEN 192 AND 223 THEN 2 WHEN lead BETWEEN 224 AND 239 THEN 3
                             WHEN lead >= 240 THEN 4 ELSE 9 END AS need FROM _{name}_e),
_{name}_f AS (SELECT {keys}, wd, 1 AS part, decode(from_hex(string_agg(h[:2 * need], '' ORDER BY ch))) AS w FROM _{name}_c
              WHERE n >= need GROUP BY ALL
              UNION ALL SELECT {', '.join('x.' + c.strip() for c in keys.split(','))}, x.wd, 0, v.token FROM _{name}_w x JOIN vocab v ON x.id = v.token_id),
_{name}_d AS (SELECT {keys}, wd, string_agg(w, '' ORDER BY part) AS w FROM _{name}_f GROUP BY ALL),
{name} AS (SELECT {keys}, {text} AS text FROM _{name}_d GROUP BY ALL)
"""


DOC_IDS = token_rows("doc_ids", "documents", "doc_id", "text")

CHUNKS = f"""
_ch AS (SELECT doc_id AS article_id, pos // {C} AS chunk_no, list(id ORDER BY pos) AS ids
        FROM doc_ids GROUP BY ALL),
_nch AS (SELECT article_id, max(chunk_no) + 1 AS n_chunks FROM _ch GROUP BY ALL),
chunks AS (SELECT c.article_id, c.chunk_no, n.n_chunks,
                  list_concat(c.ids, list_transform(range({C} - len(c.ids)), lambda x: 0)) AS token_ids
           FROM _ch c JOIN _nch n USING (article_id))
"""

def term_ctes(name: str, src: str, keys: str) -> str:
    """``name``({keys}, term, token_id, tf): a piece is its id, a spelled word (or what a chunk border
    has left of it) one term. Everything is counted by ``term``, the word's own bytes; token_id, from their md5, is only shown."""
    return f"""
_{name}_w AS (SELECT {keys}, pos, id, sum(CASE WHEN id = 3 OR id >= 260 THEN 1 ELSE 0 END)
                OVER (PARTITION BY {keys} ORDER BY pos) AS wd FROM {src} WHERE id >= 3),
_{name}_h AS (SELECT {keys}, wd, string_agg(printf('%02X', id - 4), '' ORDER BY pos) AS term
              FROM _{name}_w WHERE id BETWEEN 4 AND 259 GROUP BY ALL),
{name} AS (SELECT {keys}, term, any_value(token_id) AS token_id, CAST(count(*) AS BIGINT) AS tf FROM (
             SELECT {keys}, 'piece ' || id AS term, CAST(id AS BIGINT) AS token_id FROM _{name}_w WHERE id >= 260
             UNION ALL SELECT {keys}, term, 1152921504606846976 + CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) FROM _{name}_h)
           GROUP BY {keys}, term)
"""


# every chunk but the last, of documents with 3 chunks or more, searches the
# others of its document; the lowest chunks fill up to 2 neighbours
SPARSE = f"""
_keys AS (SELECT * FROM chunks WHERE n_chunks >= 3 AND chunk_no < n_chunks - 1),
_kid AS (SELECT article_id, chunk_no, unnest(token_ids) AS id, unnest(range({C})) AS pos FROM _keys),
{term_ctes("key_tf", "_kid", "article_id, chunk_no").strip()},
key_norm AS (SELECT article_id, chunk_no, CAST(sum(tf * tf) AS BIGINT) AS norm2 FROM key_tf GROUP BY ALL),
_dots AS (SELECT q.article_id, q.chunk_no AS query_no, k.chunk_no, sum(q.tf * k.tf) AS dot
          FROM key_tf q JOIN key_tf k ON q.article_id = k.article_id AND q.term = k.term
          WHERE q.chunk_no <> k.chunk_no GROUP BY ALL
          UNION ALL SELECT article_id, query_no, chunk_no, 0 AS dot FROM (
            SELECT article_id, chunk_no AS query_no, unnest(range(least(n_chunks - 1, 5))) AS chunk_no FROM _keys)
          WHERE chunk_no <> query_no),
_dot AS (SELECT article_id, query_no, chunk_no, sum(dot) AS dot FROM _dots GROUP BY ALL),
knn AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY article_id, query_no ORDER BY score DESC, chunk_no) AS rank
    FROM (SELECT d.article_id, d.query_no, d.chunk_no, CASE WHEN d.dot = 0 THEN 0.0::DOUBLE ELSE d.dot / sqrt(n.norm2) END AS score
          FROM _dot d LEFT JOIN key_norm n USING (article_id, chunk_no)) s)
  WHERE rank <= 2)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


SQL: dict[str, str] = {}

SQL["vocab"] = with_(VOCAB) + "\nSELECT token, CAST(token_id AS BIGINT) AS token_id, cnt FROM vocab"

SQL["tokenize_full"] = with_(VOCAB, DOC_IDS) + """
SELECT doc_id AS article_id, CAST(count(*) AS BIGINT) AS n_ids,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS token_ids
FROM doc_ids GROUP BY ALL"""

SQL["tokenize_roundtrip"] = f"""
SELECT doc_id, len(p) AS n_words, CAST(0 AS BIGINT) AS n_unk, coalesce(array_to_string(list_filter(p, lambda x: x NOT IN ('<pad>', '</s>', '<unk>')), ' '), '') AS words
FROM (SELECT doc_id, {pieces('text')} AS p FROM documents)"""

SQL["chunk_documents"] = with_(VOCAB, DOC_IDS, CHUNKS) + """
SELECT article_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(n_chunks AS BIGINT) AS n_chunks,
       array_to_string(token_ids, ' ') AS token_ids
FROM chunks"""

SQL["chunk_tf"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + """
SELECT t.article_id, CAST(t.chunk_no AS BIGINT) AS chunk_no, CAST(t.token_id AS BIGINT) AS token_id,
       t.tf, n.norm2
FROM key_tf t JOIN key_norm n USING (article_id, chunk_no)"""

SQL["chunk_idf"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + """,
df AS (SELECT term, count(*) AS n FROM key_tf GROUP BY ALL)
SELECT t.article_id, CAST(t.chunk_no AS BIGINT) AS chunk_no, CAST(t.token_id AS BIGINT) AS token_id,
       round(t.tf * ln(1 + (SELECT count(*) FROM _keys)::DOUBLE / d.n), 6) AS weight
FROM key_tf t JOIN df d USING (term)"""

SQL["chunk_postings"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + """
SELECT t.article_id, any_value(t.token_id) AS token_id, count(*) AS df, round(max(t.tf / sqrt(n.norm2)), 6) AS impact
FROM key_tf t JOIN key_norm n USING (article_id, chunk_no) GROUP BY t.article_id, t.term"""

SQL["knn_sparse"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + """
SELECT article_id, CAST(query_no AS BIGINT) AS query_no, CAST(rank AS BIGINT) AS rank,
       CAST(chunk_no AS BIGINT) AS chunk_no, round(score, 6) AS score
FROM knn"""

ARTICLES = f"""
articles AS (
  SELECT CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         doc_id AS article_id, doc_id AS ord,
         list_transform(string_split(array_to_string({words('text')}, ' '), '. '),
                        lambda s: '<S> ' || s || ' </S>') AS abstract_text,
         string_split(text, chr(10)) AS article_text
  FROM documents)
"""

TITLES = """
titles AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                  page_id AS ord FROM pages),
titles_dup AS (SELECT * FROM titles
               UNION ALL SELECT id, title || ' (revised)' AS title, ord + 1000000000000 AS ord FROM titles)
"""

SAMPLES = """
title_map AS (SELECT id, arg_max(title, ord) AS title FROM titles GROUP BY id),
samples AS (
  SELECT a.split, a.article_id, a.ord, t.title,
         replace(replace(array_to_string(a.abstract_text, ' '), '<S> ', ''), ' </S>', '') AS abstract,
         '<pad>title: ' || t.title || ' abstract: ' AS prompt,
         '<pad>title: ' || t.title || ' abstract: '
           || replace(replace(array_to_string(a.abstract_text, ' '), '<S> ', ''), ' </S>', '') AS model_input
  FROM articles a JOIN title_map t ON a.article_id = t.id)
"""

TRUNC = token_rows("trunc_ids", "documents", "doc_id", "text", 512)


def ids_string(tbl: str, key: str, extra: str = "") -> str:
    return (f"SELECT {key}{extra}, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS token_ids "
            f"FROM {tbl} GROUP BY ALL")


SQL["abstract_flatten"] = with_(ARTICLES) + """
SELECT article_id, replace(replace(array_to_string(abstract_text, ' '), '<S> ', ''), ' </S>', '') AS abstract
FROM articles"""

SQL["text_flatten"] = with_(ARTICLES) + """
SELECT article_id, array_to_string(article_text, ' ') AS text FROM articles"""

SQL["prompt_build"] = with_(ARTICLES, TITLES, SAMPLES) + """
SELECT article_id, split, prompt, model_input FROM samples"""

SQL["min_chunks"] = with_(VOCAB, DOC_IDS, CHUNKS) + """
SELECT DISTINCT article_id, CAST(n_chunks AS BIGINT) AS n_chunks FROM chunks WHERE n_chunks >= 3"""

SQL["id_filter"] = f"""
SELECT doc_id, len(w) AS n_words, len(ids) AS n_new_ids, ids[1] AS first_new_id
FROM (SELECT doc_id, w, list_filter(list_transform(w, lambda x: CASE WHEN contains(x, '.') THEN x END),
                                    lambda x: x IS NOT NULL) AS ids
      FROM (SELECT doc_id, {words('text')} AS w FROM documents))"""

SQL["quarantine"] = with_(ARTICLES, TITLES) + f"""
SELECT a.article_id,
       nullif(concat_ws(',', CASE WHEN t.title IS NULL THEN 'missing_title' END,
                             CASE WHEN len({words("array_to_string(a.article_text, ' ')")}) < 64
                                  THEN 'short_body' END), '') AS error
FROM articles a LEFT JOIN (SELECT id, arg_max(title, ord) AS title FROM titles GROUP BY id) t
  ON a.article_id = t.id"""

from longdoc.functions.text import STRIP_CLASS  # noqa: E402

SQL["strip_predictions"] = f"""
SELECT conv_id, turn, regexp_replace(text, '^{STRIP_CLASS}+|{STRIP_CLASS}+\\z', '', 'g') AS text
FROM conversations"""

SQL["trim_sections"] = f"""
WITH s AS (
  SELECT doc_id,
         list_transform(string_split(text, chr(10)), lambda l: lower(coalesce({words('l')}[1], ''))) AS names,
         list_transform(string_split(text, chr(10)), lambda l: string_split(l, '. ')) AS sections
  FROM documents),
p AS (SELECT *, coalesce(nullif(list_position(list_transform(names, lambda n: contains(n, 'the')), true), 0), 1) AS st
      FROM s),
q AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, len(names) + 1),
                                   lambda i: i >= st AND contains(names[i], 'and')), true), 0), len(names)) AS en
      FROM p)
SELECT doc_id, array_to_string(flatten(list_slice(sections, st, en)), '|') AS kept FROM q"""

SQL["tokenize_truncate"] = with_(VOCAB, TRUNC) + "\n" + ids_string("trunc_ids", "doc_id AS article_id",
                                                                      ", CAST(count(*) AS BIGINT) AS n_ids")

PROMPT_IDS = token_rows("prompt_ids", "samples", "article_id", "prompt")

SQL["prompt_ids"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, PROMPT_IDS) + """
SELECT s.article_id, coalesce(p.ids, '') AS prompt_ids FROM samples s LEFT JOIN
  (SELECT article_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM prompt_ids_raw
   GROUP BY ALL) p USING (article_id)"""

SQL["pad_multiple"] = with_(VOCAB, DOC_IDS) + f"""
SELECT doc_id AS article_id, CAST(count(*) AS BIGINT) AS n_ids,
       CAST((({C} - count(*) % {C}) % {C}) AS BIGINT) AS n_pad,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) || repeat(' 0', CAST(({C} - count(*) % {C}) % {C} AS INTEGER)) AS padded
FROM doc_ids GROUP BY ALL"""

CHUNK_IDS = f"""
_ce AS (SELECT article_id, chunk_no, unnest(token_ids) AS id, unnest(range({C})) AS pos FROM chunks)
"""
CHUNK_TEXT = CHUNK_IDS.strip() + "," + decode_ctes("_ct", "_ce", "article_id, chunk_no") + """,
chunk_text AS (SELECT c.article_id, c.chunk_no, c.n_chunks, coalesce(t.text, '') AS text
               FROM chunks c LEFT JOIN _ct t USING (article_id, chunk_no))
"""

SQL["decode_chunks"] = with_(VOCAB, DOC_IDS, CHUNKS, CHUNK_TEXT) + """
SELECT article_id, CAST(chunk_no AS BIGINT) AS chunk_no, text FROM chunk_text"""

SQL["drop_last_chunk"] = with_(VOCAB, DOC_IDS, CHUNKS) + """
SELECT article_id, CAST(chunk_no AS BIGINT) AS chunk_no FROM chunks WHERE chunk_no < n_chunks - 1"""

SQL["full_chunks"] = with_(VOCAB, DOC_IDS) + f"""
SELECT doc_id AS article_id, CAST(pos // {C} AS BIGINT) AS query_no,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS token_ids
FROM doc_ids GROUP BY ALL HAVING count(*) = {C}"""

SQL["last_full_chunk"] = with_(VOCAB, DOC_IDS) + f"""
, _n AS (SELECT doc_id, count(*) AS n FROM doc_ids GROUP BY ALL)
SELECT t.doc_id AS article_id,
       CASE WHEN n.n % {C} = 0 THEN string_agg(CAST(t.id AS VARCHAR), ' ' ORDER BY t.pos)
                                    FILTER (WHERE t.pos >= n.n - {C}) END AS last_chunk
FROM doc_ids t JOIN _n n USING (doc_id) GROUP BY t.doc_id, n.n"""

_MASKED = with_(VOCAB, DOC_IDS) + """,
_len AS (SELECT doc_id, max(pos) + 1 AS n FROM doc_ids GROUP BY ALL),
_all AS (SELECT doc_id, pos, id FROM doc_ids
         UNION ALL SELECT t.doc_id, t.pos + l.n AS pos, t.id FROM doc_ids t JOIN _len l USING (doc_id)),
_first AS (SELECT doc_id, min(pos) AS f FROM _all WHERE id = 1 GROUP BY ALL)
SELECT a.doc_id AS article_id, {chunk}
       string_agg(CAST(CASE WHEN f.f IS NOT NULL AND a.pos > f.f THEN 0 ELSE a.id END AS VARCHAR), ' '
                  ORDER BY a.pos) AS masked
FROM _all a LEFT JOIN _first f USING (doc_id) GROUP BY ALL"""
SQL["mask_after_eos"] = _MASKED.replace("{chunk}", "")
SQL["mask_after_eos_window"] = _MASKED.replace("{chunk}", f"CAST(a.pos // {C} AS BIGINT) AS chunk_no,")

SQL["sequence_windows"] = with_(VOCAB, DOC_IDS, CHUNKS) + f"""
SELECT article_id, CAST(chunk_no // 32 AS BIGINT) AS seq_no, CAST(min(chunk_no) AS BIGINT) AS first_chunk,
       CAST(max(chunk_no) AS BIGINT) AS last_chunk, CAST(count(*) AS BIGINT) AS n_chunks
FROM chunks GROUP BY ALL"""

SQL["lm_shift"] = with_(VOCAB, DOC_IDS) + """,
_n AS (SELECT doc_id, max(pos) AS last FROM doc_ids GROUP BY ALL)
SELECT t.doc_id AS article_id,
       coalesce(string_agg(CAST(t.id AS VARCHAR), ' ' ORDER BY t.pos) FILTER (WHERE t.pos < n.last), '') AS input,
       coalesce(string_agg(CAST(t.id AS VARCHAR), ' ' ORDER BY t.pos) FILTER (WHERE t.pos > 0), '') AS label
FROM doc_ids t JOIN _n n USING (doc_id) GROUP BY ALL"""

SQL["chunk_pairs"] = with_(VOCAB, DOC_IDS, CHUNKS) + """
SELECT a.article_id, CAST(a.chunk_no AS BIGINT) AS chunk_no,
       CASE WHEN b.chunk_no IS NOT NULL THEN array_to_string(list_concat(a.token_ids, b.token_ids), ' ') END AS pair_ids
FROM chunks a LEFT JOIN chunks b ON a.article_id = b.article_id AND b.chunk_no = a.chunk_no + 1"""

SQL["title_map_last"] = with_(TITLES) + """
SELECT id, arg_max(title, ord) AS title FROM titles_dup GROUP BY id"""

SQL["title_join"] = with_(ARTICLES, TITLES) + """
SELECT a.article_id, a.split, t.title FROM articles a
JOIN (SELECT id, arg_max(title, ord) AS title FROM titles_dup GROUP BY id) t ON a.article_id = t.id"""

SQL["title_lookup_first"] = with_(TITLES) + """
SELECT d.doc_id AS article_id, t.title FROM documents d
LEFT JOIN (SELECT id, arg_min(title, ord) AS title FROM titles_dup GROUP BY id) t ON d.doc_id = t.id"""

SQL["neighbor_expand"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + """
SELECT k.article_id, CAST(k.query_no AS BIGINT) AS query_no, CAST(k.rank AS BIGINT) AS rank,
       CAST(k.chunk_no AS BIGINT) AS chunk_no, array_to_string(list_concat(a.token_ids, b.token_ids), ' ') AS pair_ids
FROM knn k JOIN chunks a ON a.article_id = k.article_id AND a.chunk_no = k.chunk_no
JOIN chunks b ON b.article_id = k.article_id AND b.chunk_no = k.chunk_no + 1"""

SQL["neighbor_text"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE, CHUNK_TEXT) + """
SELECT k.article_id, CAST(k.query_no AS BIGINT) AS query_no, CAST(k.rank AS BIGINT) AS rank,
       CAST(k.chunk_no AS BIGINT) AS chunk_no, concat_ws(' ', a.text, b.text) AS pair_text
FROM knn k JOIN chunk_text a ON a.article_id = k.article_id AND a.chunk_no = k.chunk_no
JOIN chunk_text b ON b.article_id = k.article_id AND b.chunk_no = k.chunk_no + 1"""

# ---- D ---------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def dot(a: str, b: str) -> str:
    return DOT.replace("{a}", a).replace("{b}", b)


SQL["knn_within_label"] = f"""
WITH q AS (SELECT label, vec_id AS query_id, embedding AS qv FROM embeddings),
k AS (SELECT label, vec_id AS key_id, embedding AS kv FROM embeddings),
s AS (SELECT q.label, q.query_id, k.key_id, {dot('qv', 'kv')} AS score
      FROM q JOIN k ON q.label = k.label AND q.query_id <> k.key_id)
SELECT CAST(label AS BIGINT) AS label, query_id, rank, key_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, key_id) AS rank FROM s)
WHERE rank <= 2"""

NB_PAIRS = """
nb AS (SELECT k.article_id, k.query_no, k.rank, k.chunk_no, list_concat(a.token_ids, b.token_ids) AS pair
       FROM knn k JOIN chunks a ON a.article_id = k.article_id AND a.chunk_no = k.chunk_no
       JOIN chunks b ON b.article_id = k.article_id AND b.chunk_no = k.chunk_no + 1)
"""

SQL["retrieved_tokens"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE, NB_PAIRS) + """,
per_q AS (SELECT article_id, query_no, string_agg(array_to_string(pair, ' '), '|' ORDER BY rank) AS r
          FROM nb GROUP BY ALL)
SELECT article_id, string_agg(r, '#' ORDER BY query_no) AS retrieved FROM per_q GROUP BY ALL"""

SQL["index_report"] = """
SELECT CAST(label AS BIGINT) AS label, 'Flat' AS index_key, count(*) AS nb_vectors,
       CAST(max(len(embedding)) AS BIGINT) AS dim,
       CAST(sum(len(embedding)) * 4 + count(*) * 8 AS BIGINT) AS size_bytes,
       round((count(*) * max(len(embedding)) * 4)::DOUBLE / (sum(len(embedding)) * 4 + count(*) * 8), 6) AS compression_ratio,
       0.0::DOUBLE AS reconstruction_error
FROM embeddings GROUP BY label"""

# ---- E ---------------------------------------------------------------------

LOGITS = """
lg AS (SELECT vec_id AS grp, CAST(unnest(range(len(embedding))) AS BIGINT) AS cand,
              CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)
"""

SQL["topk_fraction"] = with_(LOGITS) + f"""
SELECT grp, cand, round(logit, 6) AS logit FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logit DESC, cand) AS r,
         count(*) OVER (PARTITION BY grp) AS n FROM lg)
WHERE r <= greatest(floor({1.0 - 0.9!r} * n), 1)"""

SQL["nucleus_filter"] = with_(LOGITS) + """,
sm AS (SELECT grp, cand, exp(logit - max(logit) OVER (PARTITION BY grp)) AS e FROM lg),
pr AS (SELECT grp, cand, e / sum(e) OVER (PARTITION BY grp) AS prob FROM sm),
cum AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY grp ORDER BY prob DESC, cand
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr)
SELECT grp, cand, round(prob, 6) AS prob FROM cum WHERE before < 0.9"""

SQL["extractive_draft"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE, NB_PAIRS) + """,
best AS (SELECT article_id, chunk_no, min(query_no) AS query_no FROM nb WHERE rank = 1 GROUP BY ALL),
d AS (SELECT b.article_id, b.query_no, n.pair FROM best b
      JOIN (SELECT DISTINCT article_id, chunk_no, pair FROM nb) n USING (article_id, chunk_no))
SELECT article_id, array_to_string(flatten(list(pair ORDER BY query_no)), ' ') AS draft_ids
FROM d GROUP BY ALL"""

# ---- F ---------------------------------------------------------------------

RANK_EXPR = ("row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' "
             "THEN md5('42' || CAST(article_id AS VARCHAR)) END, ord, article_id)")
BATCH_EXPR = "(pos - 1) // (CASE split WHEN 'test' THEN 1 ELSE 8 END)"

SQL["shuffle_seeded"] = with_(ARTICLES) + f"""
SELECT split, article_id, {RANK_EXPR} AS pos FROM articles"""

SQL["batch_assign"] = with_(ARTICLES) + f""",
r AS (SELECT split, article_id, {RANK_EXPR} AS pos FROM articles)
SELECT split, article_id, pos, {BATCH_EXPR} AS batch_no FROM r"""

SQL["shard_assign"] = with_(ARTICLES) + f""",
r AS (SELECT split, article_id, {RANK_EXPR} AS pos FROM articles)
SELECT split, article_id, (pos - 1) % 4 AS shard FROM r"""

SQL["cap_per_split"] = with_(ARTICLES, TITLES, SAMPLES) + """
SELECT split, article_id FROM (
  SELECT split, article_id, row_number() OVER (PARTITION BY split ORDER BY ord, article_id) AS r FROM samples)
WHERE r <= 100"""

INPUT_IDS = token_rows("input_ids", "samples", "article_id", "model_input")
ABS_IDS = token_rows("abs_ids", "samples", "article_id", "abstract")

BATCHED = f"""
_sl AS (SELECT s.split, s.article_id, s.ord,
               coalesce((SELECT list(id ORDER BY pos) FROM prompt_ids_raw p
                         WHERE p.article_id = s.article_id), []) AS prompt_ids,
               (SELECT list(id ORDER BY pos) FROM input_ids i WHERE i.article_id = s.article_id) AS input_ids,
               (SELECT list(id ORDER BY pos) FROM abs_ids i WHERE i.article_id = s.article_id) AS labels
        FROM samples s),
bs AS (SELECT *, {BATCH_EXPR} AS batch_no FROM (SELECT *, {RANK_EXPR} AS pos FROM _sl))
"""


def padded_batch(cols: dict[str, int], side: str = "right", extra: str = "") -> str:
    sel = []
    for c, v in cols.items():
        pad = f"list_transform(range(m_{c} - len({c})), lambda x: {v})"
        body = f"list_concat({pad}, {c})" if side == "left" else f"list_concat({c}, {pad})"
        sel.append(f"string_agg(array_to_string({body}, ' '), '|' ORDER BY pos) AS {c}")
    maxes = ", ".join(f"max(len({c})) OVER (PARTITION BY split, batch_no) AS m_{c}" for c in cols)
    return f"""
SELECT split, batch_no, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY pos) AS ids, {', '.join(sel)}{extra}
FROM (SELECT *, {maxes} FROM bs) GROUP BY split, batch_no"""


_FB = with_(VOCAB, ARTICLES, TITLES, SAMPLES, PROMPT_IDS, INPUT_IDS, ABS_IDS, BATCHED)

SQL["collate_decoder"] = _FB + padded_batch({"prompt_ids": 1, "input_ids": 1})
SQL["pad_left"] = _FB + padded_batch({"prompt_ids": 0}, side="left")
SQL["collate_all"] = _FB + padded_batch({"prompt_ids": 0, "input_ids": 0})
SQL["collate_mask"] = _FB + padded_batch(
    {"input_ids": 0, "labels": 0},
    extra=", string_agg(array_to_string(list_transform(range(m_input_ids), lambda i: i < len(input_ids)), ' '), "
          "'|' ORDER BY pos) AS attention_mask")
SQL["flatten_batches"] = _FB + """
SELECT split, batch_no, CAST(row_number() OVER (PARTITION BY split, batch_no ORDER BY pos) - 1 AS BIGINT)
         AS pos_in_batch, article_id FROM bs"""

SQL["collate_retrieved"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, DOC_IDS, CHUNKS,
                                 SPARSE, NB_PAIRS) + f""",
_tt AS (SELECT article_id, list(array_to_string(token_ids, ' ') ORDER BY chunk_no) AS tt
        FROM chunks WHERE n_chunks >= 3 GROUP BY ALL),
_rq AS (SELECT article_id, query_no, string_agg(array_to_string(pair, ' '), '|' ORDER BY rank) AS q
        FROM nb GROUP BY ALL),
_rt AS (SELECT article_id, list(q ORDER BY query_no) AS rt FROM _rq GROUP BY ALL),
_rs AS (SELECT s.split, s.article_id, s.ord, t.tt, coalesce(r.rt, []) AS rt
        FROM samples s JOIN _tt t USING (article_id) LEFT JOIN _rt r USING (article_id)),
bs AS (SELECT *, (pos - 1) // 8 AS batch_no FROM (SELECT *, {RANK_EXPR} AS pos FROM _rs)),
mx AS (SELECT *, max(len(tt)) OVER (PARTITION BY split, batch_no) AS m_tt,
              max(len(rt)) OVER (PARTITION BY split, batch_no) AS m_rt FROM bs)
SELECT split, batch_no,
  string_agg(array_to_string(list_concat(rt, list_transform(range(m_rt - len(rt)),
      lambda x: trim(repeat('1 ', 128)) || '|' || trim(repeat('1 ', 128)))), '#'), ';' ORDER BY pos) AS retrieved,
  string_agg(array_to_string(list_concat(tt, list_transform(range(m_tt - len(tt)),
      lambda x: trim(repeat('1 ', 64)))), '|'), ';' ORDER BY pos) AS text_tokenized
FROM mx GROUP BY split, batch_no"""

# ---- G ---------------------------------------------------------------------

PAIRS = """
pairs AS (SELECT CAST(u.conv_id AS VARCHAR) || '.' || CAST(u.turn AS VARCHAR) AS id,
                 u.text AS reference, a.text AS prediction
          FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')
"""

QA_TOK = (r"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\[-`{-~]', '', 'g'), "
          r"'[ \t\n\r]+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


def qa_tok(x: str) -> str:
    return QA_TOK.replace("{x}", x)


def rouge_tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def overlap_cte(src: str) -> str:
    return f"""
ov AS (SELECT id, sum(least(a, b)) AS overlap FROM (
         SELECT id, g, sum(a) AS a, sum(b) AS b FROM (
           SELECT id, unnest(r) AS g, 1 AS a, 0 AS b FROM {src}
           UNION ALL SELECT id, unnest(p) AS g, 0 AS a, 1 AS b FROM {src}) GROUP BY ALL)
       GROUP BY ALL)
"""


SQL["qa_f1_em"] = with_(PAIRS) + f""",
qa AS (SELECT id, {qa_tok('reference')} AS r, {qa_tok('prediction')} AS p FROM pairs),
{overlap_cte('qa').strip()}
SELECT q.id,
  round(CASE WHEN len(r) = 0 OR len(p) = 0 THEN (CASE WHEN len(r) = 0 AND len(p) = 0 THEN 1.0 ELSE 0.0 END)
             WHEN coalesce(o.overlap, 0) = 0 THEN 0.0
             ELSE 2.0 * o.overlap / (len(r) + len(p)) END, 6) AS f1,
  CAST(CASE WHEN array_to_string(r, ' ') = array_to_string(p, ' ') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS exact_match
FROM qa q LEFT JOIN ov o USING (id)"""


def ngram_list(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def rouge_n_sql(n: int, src: str = "pairs", x: str = "") -> str:
    return f"""
_rt{n}{x} AS (SELECT id, {rouge_tok('reference')} AS rt, {rouge_tok('prediction')} AS pt FROM {src}),
rg{n}{x} AS (SELECT id, {ngram_list('rt', n)} AS r, {ngram_list('pt', n)} AS p FROM _rt{n}{x}),
{overlap_cte(f'rg{n}{x}').strip().replace('ov AS', f'ov{n}{x} AS')},
sc{n}{x} AS (SELECT g.id, coalesce(o.overlap, 0) AS ov, len(r) AS nr, len(p) AS np
          FROM rg{n}{x} g LEFT JOIN ov{n}{x} o USING (id)),
prf{n}{x} AS (SELECT id, CASE WHEN np > 0 THEN ov / np ELSE 0.0 END AS precision,
                 CASE WHEN nr > 0 THEN ov / nr ELSE 0.0 END AS recall FROM sc{n}{x})
"""


def rouge_select(n: int) -> str:
    return f"""
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END, 6) AS fmeasure
FROM prf{n}"""


SQL["rouge1"] = with_(PAIRS, rouge_n_sql(1)) + rouge_select(1)
SQL["rouge2"] = with_(PAIRS, rouge_n_sql(2)) + rouge_select(2)


def _fm(n: int) -> str:
    return (f"(SELECT 'rouge{n}' AS metric, round(avg(CASE WHEN precision + recall > 0 "
            f"THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END), 4) AS mean, count(*) AS n "
            f"FROM prf{n})")


SQL["rouge_corpus_mean"] = with_(PAIRS, rouge_n_sql(1), rouge_n_sql(2)) + f"\n{_fm(1)} UNION ALL {_fm(2)}"

SQL["greedy_match"] = f"""
WITH c AS (SELECT label AS g, vec_id AS cid, embedding AS cv FROM embeddings),
r AS (SELECT label + 1 AS g, vec_id AS rid, embedding AS rv FROM embeddings),
s AS (SELECT c.g, cid, rid, {dot('cv', 'rv')} AS score FROM c JOIN r ON c.g = r.g),
p AS (SELECT g, avg(m) AS precision FROM (SELECT g, cid, max(score) AS m FROM s GROUP BY ALL) GROUP BY g),
rr AS (SELECT g, avg(m) AS recall FROM (SELECT g, rid, max(score) AS m FROM s GROUP BY ALL) GROUP BY g)
SELECT CAST(g AS BIGINT) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1
FROM (SELECT g, coalesce(p.precision, 0.0) AS precision, coalesce(rr.recall, 0.0) AS recall
      FROM (SELECT g FROM c UNION SELECT g FROM r) e LEFT JOIN p USING (g) LEFT JOIN rr USING (g))"""

SQL["classification_prf"] = """
WITH d AS (SELECT list_position([toxic::DOUBLE, (1 - toxic)::DOUBLE],
                                list_max([toxic::DOUBLE, (1 - toxic)::DOUBLE])) - 1 AS pred,
                  quality AS truth FROM labels),
a AS (SELECT sum(CASE WHEN pred = 1 AND truth = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN pred = 1 AND truth <> 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN pred <> 1 AND truth = 1 THEN 1 ELSE 0 END) AS fn, count(*) AS n FROM d)
SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, n
FROM a"""

SQL["weighted_mean"] = """
SELECT round(sum(value * weight) / sum(weight), 6) AS weighted_mean
FROM (SELECT doc_id % 16 AS b, avg(quality) AS value, count(*) AS weight FROM labels GROUP BY 1)"""

SQL["corpus_stats"] = with_(VOCAB, DOC_IDS, ARTICLES) + f""",
n AS (SELECT doc_id AS article_id, count(*) AS n_tokens FROM doc_ids GROUP BY ALL),
j AS (SELECT a.split, n.n_tokens, ceil(n.n_tokens / 64) AS n_chunks,
             len({words("replace(replace(array_to_string(a.abstract_text, ' '), '<S> ', ''), ' </S>', '')")})
               AS n_abstract
      FROM articles a JOIN n USING (article_id))
SELECT split, count(*) AS n_docs, round(avg(n_tokens), 6) AS mean_tokens,
       round(quantile_cont(n_tokens, 0.5), 6) AS p50_tokens, round(quantile_cont(n_tokens, 0.9), 6) AS p90_tokens,
       round(avg(n_chunks), 6) AS mean_chunks, round(avg(n_abstract), 6) AS mean_abstract
FROM j GROUP BY split"""

# ---- A ---------------------------------------------------------------------

SQL["src_articles"] = with_(ARTICLES) + """
SELECT split, article_id, array_to_string(abstract_text, '|') AS abstract,
       array_to_string(article_text, chr(10)) AS body FROM articles"""

SQL["src_titles"] = with_(TITLES) + "\nSELECT id, title FROM titles"

SQL["roundtrip_samples"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, INPUT_IDS) + """
SELECT s.split, s.article_id, s.prompt, s.model_input,
       (SELECT string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FROM input_ids i
        WHERE i.article_id = s.article_id) AS input_ids
FROM samples s"""

SQL["export_first_n"] = with_(ARTICLES, TITLES, SAMPLES) + """
SELECT split, article_id, prompt FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord, article_id) AS r FROM samples)
WHERE r <= 20"""

SQL["read_documents"] = "SELECT doc_id, text FROM documents"

# ROUGE-L over whole texts: the LCS row update runs one reference token per
# recursion step; row j of step i is
#   L_i[j] = max(L_{i-1}[j], max over j' <= j with b[j'] = a[i] of L_{i-1}[j'-1] + 1)
# (the running max is a window over the prediction positions).
def rouge_l_ctes(src: str = "pairs", x: str = "") -> str:
    """CTEs ending in ``prfl{x}``(id, precision, recall) over ``src``(id, reference, prediction)."""
    return f"""
tk{x} AS (SELECT id, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r,
              regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p FROM {src}),
pos{x} AS (SELECT id, unnest(range(1, len(p) + 1)) AS j, unnest(p) AS b FROM tk{x}),
dp{x}(id, i, j, b, v) AS (
  SELECT id, 0, j, b, 0 FROM pos{x}
  UNION ALL
  SELECT id, i, j, b, greatest(v, coalesce(max(c) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING), 0))
  FROM (SELECT d.id, d.i + 1 AS i, d.j, d.b, d.v,
               CASE WHEN d.b = t.r[d.i + 1]
                    THEN coalesce(lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j), 0) + 1 END AS c
        FROM dp{x} d JOIN tk{x} t ON d.id = t.id WHERE d.i < len(t.r))),
l{x} AS (SELECT t.id, len(t.r) AS nr, len(t.p) AS np, coalesce(max(d.v), 0) AS lcs
      FROM tk{x} t LEFT JOIN dp{x} d ON d.id = t.id AND d.i = len(t.r) GROUP BY ALL),
prfl{x} AS (SELECT id, CASE WHEN np > 0 THEN lcs / np ELSE 0.0 END AS precision,
                CASE WHEN nr > 0 THEN lcs / nr ELSE 0.0 END AS recall FROM l{x})
"""


def fm_select(cte: str, extra: str = "") -> str:
    return f"""
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END, 6) AS fmeasure{extra}
FROM {cte}"""


SQL["rouge_l"] = "WITH RECURSIVE " + PAIRS.strip() + ",\n" + rouge_l_ctes().strip() + fm_select("prfl")

SQL["generate"] = with_(ARTICLES, TITLES, SAMPLES) + """
SELECT article_id, prompt, prompt || ' ' || {last} AS prediction FROM samples""".replace(
    "{last}", words("prompt") + "[-1]")

SQL["materialize_chunks"] = with_(VOCAB, DOC_IDS, CHUNKS) + """
SELECT article_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(n_chunks AS BIGINT) AS n_chunks,
       array_to_string(token_ids, ' ') AS token_ids FROM chunks"""

SQL["results_roundtrip"] = """
WITH pairs AS (SELECT u.conv_id, u.turn, CAST(u.conv_id AS VARCHAR) || '.' || CAST(u.turn AS VARCHAR) AS id,
                      u.text AS reference, a.text AS prediction
               FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
               WHERE u.role = 'user' AND a.role = 'assistant')
SELECT id, reference AS truth_output, prediction AS model_answer,
       row_number() OVER (ORDER BY conv_id, turn) AS ordinal FROM pairs"""

# ROUGE-Lsum over whole texts. Per (reference sentence, candidate sentence):
# the LCS table by the same recursion as ROUGE-L, each cell's backtrack move
# (diagonal on a match, else left when T[i][j-1] > T[i-1][j], else up), then
# a second recursion walks back one table row per step (a row is a list of
# moves). Hits = sum over tokens of min(union-LCS occurrences, candidate
# count), which is what counting token by token with clipping adds up to.
# The CTEs read inside the recursions are MATERIALIZED so they run once.
_LSUM_CTES = """
rl{x} AS (SELECT id, unnest(string_split(reference, chr(10))) AS line,
              unnest(range(len(string_split(reference, chr(10))))) AS si FROM {src}),
cl{x} AS (SELECT id, unnest(string_split(prediction, chr(10))) AS line,
              unnest(range(len(string_split(prediction, chr(10))))) AS sj FROM {src}),
rs{x} AS (SELECT id, si, regexp_extract_all(lower(line), '[a-z0-9]+') AS a FROM rl{x}),
cs{x} AS (SELECT id, sj, regexp_extract_all(lower(line), '[a-z0-9]+') AS b FROM cl{x}),
sp{x} AS MATERIALIZED (SELECT r.id, r.si, c.sj, r.a, c.b FROM rs{x} r JOIN cs{x} c USING (id) WHERE len(r.a) > 0 AND len(c.b) > 0),
pos{x} AS (SELECT id, si, sj, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS bt FROM sp{x}),
dp{x}(id, si, sj, i, j, bt, v) AS (
  SELECT id, si, sj, 0, j, bt, 0 FROM pos{x}
  UNION ALL
  SELECT id, si, sj, i, j, bt,
         greatest(v, coalesce(max(c) OVER (PARTITION BY id, si, sj ORDER BY j ROWS UNBOUNDED PRECEDING), 0))
  FROM (SELECT d.id, d.si, d.sj, d.i + 1 AS i, d.j, d.bt, d.v,
               CASE WHEN d.bt = s.a[d.i + 1]
                    THEN coalesce(lag(d.v) OVER (PARTITION BY d.id, d.si, d.sj ORDER BY d.j), 0) + 1 END AS c
        FROM dp{x} d JOIN sp{x} s ON d.id = s.id AND d.si = s.si AND d.sj = s.sj WHERE d.i < len(s.a))),
mvc{x} AS (SELECT d.id, d.si, d.sj, d.i, d.j,
                CASE WHEN d.bt = s.a[d.i] THEN 0
                     WHEN coalesce(lag(d.v) OVER (PARTITION BY d.id, d.si, d.sj, d.i ORDER BY d.j), 0)
                          > lag(d.v) OVER (PARTITION BY d.id, d.si, d.sj, d.j ORDER BY d.i) THEN 1
                     ELSE 2 END AS mv
         FROM dp{x} d JOIN sp{x} s ON d.id = s.id AND d.si = s.si AND d.sj = s.sj),
mvr{x} AS MATERIALIZED (SELECT id, si, sj, i, list(mv ORDER BY j) AS mv FROM mvc{x} WHERE i >= 1 GROUP BY ALL),
bk{x}(id, si, sj, i, j, hit) AS (
  SELECT id, si, sj, len(a), len(b), CAST(NULL AS BIGINT) FROM sp{x}
  UNION ALL
  SELECT id, si, sj, i - 1,
         CASE WHEN k = 0 THEN 0 WHEN mv[j - k + 1] = 0 THEN j - k ELSE j - k + 1 END,
         CASE WHEN k > 0 AND mv[j - k + 1] = 0 THEN i END
  FROM (SELECT f.id, f.si, f.sj, f.i, f.j, r.mv,
               list_position(list_transform(list_reverse(r.mv[1:f.j]), lambda x: x <> 1), true) AS k
        FROM bk{x} f JOIN mvr{x} r ON f.id = r.id AND f.si = r.si AND f.sj = r.sj AND f.i = r.i
        WHERE f.i > 0 AND f.j > 0)),
un{x} AS (SELECT DISTINCT b.id, b.si, b.hit, r.a[b.hit] AS tok FROM bk{x} b JOIN rs{x} r ON b.id = r.id AND b.si = r.si
       WHERE b.hit IS NOT NULL),
ut{x} AS (SELECT id, tok, count(*) AS u FROM un{x} GROUP BY ALL),
ct{x} AS (SELECT id, tok, count(*) AS cc FROM (SELECT id, unnest(b) AS tok FROM cs{x}) GROUP BY ALL),
hits{x} AS (SELECT u.id, sum(least(u.u, c.cc)) AS hits FROM ut{x} u JOIN ct{x} c USING (id, tok) GROUP BY ALL),
n{x} AS (SELECT p.id, coalesce((SELECT sum(len(a)) FROM rs{x} q WHERE q.id = p.id), 0) AS nr,
             coalesce((SELECT sum(len(b)) FROM cs{x} q WHERE q.id = p.id), 0) AS nc FROM {src} p),
lsum{x} AS (SELECT n.id, CASE WHEN n.nc > 0 THEN coalesce(h.hits, 0) / n.nc ELSE 0.0 END AS precision,
                   CASE WHEN n.nr > 0 THEN coalesce(h.hits, 0) / n.nr ELSE 0.0 END AS recall
            FROM n{x} n LEFT JOIN hits{x} h USING (id))
"""


def rouge_lsum_ctes(src: str = "pairs", x: str = "") -> str:
    """CTEs ending in ``lsum{x}``(id, precision, recall) over ``src``(id, reference, prediction)."""
    return _LSUM_CTES.replace("{src}", src).replace("{x}", x)


SQL["rouge_lsum"] = "WITH RECURSIVE " + PAIRS.strip() + ",\n" + rouge_lsum_ctes().strip() + fm_select("lsum")


def uniform_sql(*parts: str) -> str:
    """The md5 uniform of ``longdoc.operators.sampling.uniform``."""
    key = " || '|' || ".join(["'42'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return (f"((CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT))::DOUBLE + 0.5::DOUBLE)"
            f" / 4503599627370496.0::DOUBLE")


SQL["gumbel_sample"] = with_(LOGITS) + f""",
top AS (SELECT grp, cand, logit FROM (
          SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logit DESC, cand) AS r,
                 count(*) OVER (PARTITION BY grp) AS n FROM lg)
        WHERE r <= greatest(floor({1.0 - 0.9!r} * n), 1)),
gu AS (SELECT grp, cand, logit, {uniform_sql('grp', 'cand')} AS u FROM top)
SELECT grp, arg_max(cand, logit / 1.0 - ln(-ln(u))) AS sampled FROM gu GROUP BY grp"""


def _poisson_case(u: str) -> str:
    import math
    cdf = [sum(math.exp(-1.0) / math.factorial(i) for i in range(j + 1)) for j in range(8)]
    whens = " ".join(f"WHEN {u} <= {c!r}::DOUBLE THEN {k}" for k, c in enumerate(cdf))
    return f"CASE {whens} ELSE 8 END"


def _bootstrap(scores: str, x: str = "") -> str:
    """CTE ``bt{x}``(low, mid, high) of ``scores``(id, f): one 64-bit factor per replicate, one
    hash per row, their product mod 2^64 (in 128 bits) is the uniform."""
    return f"""
fa{x} AS (SELECT r AS rep, 2 * CAST(('0x' || substr(md5('42|' || CAST(r AS VARCHAR)), 1, 15)) AS HUGEINT) + 1 AS k FROM range(1000) t(r)),
ro{x} AS (SELECT f, CAST(('0x' || substr(md5('42|' || id), 1, 13)) AS HUGEINT) + 1 AS h FROM {scores}),
wu{x} AS (SELECT rep, f, ((h * k) % 18446744073709551616::HUGEINT // 4096)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM ro{x}, fa{x}),
wt{x} AS (SELECT rep, f, {_poisson_case('u')} AS w FROM wu{x}),
per{x} AS (SELECT rep, sum(w * f) / greatest(sum(w), 1) AS m FROM wt{x} GROUP BY rep),
q{x} AS (SELECT quantile_cont(m, [0.025, 0.5, 0.975]) AS q FROM per{x}),
bt{x} AS (SELECT round(q[1], 4) AS low, round(q[2], 4) AS mid, round(q[3], 4) AS high FROM q{x})
"""


def _f_of(n: int) -> str:
    return (f"sc_{n} AS (SELECT id, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
            f"ELSE 0.0 END AS f FROM prf{n})")


SQL["rouge_bootstrap"] = with_(PAIRS, rouge_n_sql(1), _f_of(1), _bootstrap("sc_1")) + "\nSELECT * FROM bt"

# the record's LCS scores have the same bootstrap over the columns that rouge_l and rouge_lsum check
SQL["score_record"] = with_(PAIRS, rouge_n_sql(1), rouge_n_sql(2), _f_of(1), _f_of(2), _bootstrap("sc_1", "1"), _bootstrap("sc_2", "2")) + f"""
SELECT (SELECT round(avg(f1), 6) FROM ({SQL["qa_f1_em"].replace(", 6) AS f1", ", 15) AS f1")})) AS f1,
       (SELECT round(avg(exact_match), 6) FROM ({SQL["qa_f1_em"]})) AS exact_match,
       (SELECT mid FROM bt1) AS rouge1, (SELECT mid FROM bt2) AS rouge2"""

SQL["embed_chunks"] = with_(VOCAB, DOC_IDS, CHUNKS) + """,
ce AS (SELECT article_id, chunk_no, unnest(token_ids) AS id FROM chunks),
he AS (SELECT article_id, chunk_no, md5('42|' || CAST(id AS VARCHAR)) AS h FROM ce WHERE id >= 3),
bs AS (SELECT article_id, chunk_no, CAST(('0x' || substr(h, 1, 13)) AS BIGINT) % 64 AS b,
              CASE WHEN CAST(('0x' || substr(h, 14, 1)) AS INTEGER) < 8 THEN 1 ELSE -1 END AS s FROM he),
agg AS (SELECT article_id, chunk_no, b, sum(s) AS v FROM bs GROUP BY ALL),
nrm AS (SELECT article_id, chunk_no, sqrt(sum(v * v)::DOUBLE) AS n FROM agg GROUP BY ALL),
grid AS (SELECT article_id, chunk_no, unnest(range(64)) AS d FROM chunks)
SELECT g.article_id, CAST(g.chunk_no AS BIGINT) AS chunk_no, g.d,
       CAST(CAST(CASE WHEN n.n > 0 THEN coalesce(a.v, 0) / n.n ELSE 0.0 END AS FLOAT) AS DOUBLE) AS value
FROM grid g LEFT JOIN agg a ON a.article_id = g.article_id AND a.chunk_no = g.chunk_no AND a.b = g.d
LEFT JOIN nrm n ON n.article_id = g.article_id AND n.chunk_no = g.chunk_no"""

SQL["chunk_index"] = SQL["embed_chunks"]


def _search(name: str, queries: str) -> str:
    """``{name}_knn``: rows ``queries``(article_id, query_no, token_id, tf) and ``{name}_q``(article_id,
    query_no) against the keys of their article; the lowest chunks fill up to 2."""
    return f"""
{name}_dots AS (SELECT k.article_id, q.query_no, k.chunk_no, sum(q.tf * k.tf) AS dot
                FROM {queries} q JOIN key_tf k ON q.article_id = k.article_id AND q.token_id = k.token_id GROUP BY ALL
                UNION ALL SELECT q.article_id, q.query_no, unnest(range(least(n.n_chunks - 1, 5))) AS chunk_no, 0 AS dot
                FROM {name}_q q JOIN _nch n USING (article_id) WHERE n.n_chunks >= 3),
{name}_dot AS (SELECT article_id, query_no, chunk_no, sum(dot) AS dot FROM {name}_dots GROUP BY ALL),
{name}_knn AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY article_id, query_no ORDER BY score DESC, chunk_no) AS rank
    FROM (SELECT d.article_id, d.query_no, d.chunk_no,
                 CASE WHEN d.dot = 0 THEN 0.0::DOUBLE ELSE d.dot / sqrt(n.norm2) END AS score
          FROM {name}_dot d LEFT JOIN key_norm n USING (article_id, chunk_no)) s)
  WHERE rank <= 2)
"""


_QUERY_ROWS = f"""
_qn AS (SELECT article_id, max(pos) // {C} + 1 AS n FROM input_ids GROUP BY ALL),
_qid AS (SELECT article_id, pos // {C} AS query_no, pos, id FROM input_ids),
{term_ctes("qc_tf", "_qid", "article_id, query_no").strip()}
"""

# L1: samples with 3 body chunks or more; every chunk of the whole input but the
# last searches the body; the retrieved pairs are compared by their tokens.
SQL["prepare_samples"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, DOC_IDS, CHUNKS, SPARSE, PROMPT_IDS, INPUT_IDS, _QUERY_ROWS) + f""",
pr_q AS (SELECT article_id, unnest(range(n - 1)) AS query_no FROM _qn),
pr_tf AS (SELECT t.* FROM qc_tf t JOIN _qn n USING (article_id) WHERE t.query_no < n.n - 1),
{_search("pr", "pr_tf").strip()},
pr_pair AS (SELECT k.article_id, k.query_no, string_agg(array_to_string(list_concat(a.token_ids, b.token_ids), ' '), '|' ORDER BY k.rank) AS p
            FROM pr_knn k JOIN chunks a ON a.article_id = k.article_id AND a.chunk_no = k.chunk_no
            JOIN chunks b ON b.article_id = k.article_id AND b.chunk_no = k.chunk_no + 1 GROUP BY ALL),
pr_ret AS (SELECT article_id, count(*) AS n, string_agg(p, '#' ORDER BY query_no) AS r FROM pr_pair GROUP BY ALL),
npr AS (SELECT article_id, count(*) AS n_prompt FROM prompt_ids_raw GROUP BY ALL),
nin AS (SELECT article_id, count(*) AS n_input FROM input_ids GROUP BY ALL)
SELECT s.split, s.article_id, coalesce(p.n_prompt, 0) AS n_prompt, i.n_input, CAST(b.n_chunks AS BIGINT) AS n_chunks,
       coalesce(r.n, 0) AS n_retrieved, md5(coalesce(r.r, '')) AS retrieved_md5
FROM samples s JOIN _nch b USING (article_id) LEFT JOIN npr p USING (article_id) JOIN nin i USING (article_id)
LEFT JOIN pr_ret r USING (article_id) WHERE b.n_chunks >= 3"""

# generation that searches again after every full chunk. The start's full chunks (a) and the chunk that the first round
# fills up (b) are searched; from then on a chunk of output is a chunk of the document, whose neighbours (t) are known, so the
# recursion goes from chunk to chunk: the one after the best neighbour, until an EOS or 512 ids.
SQL["generate_incremental"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, DOC_IDS, CHUNKS, SPARSE, PROMPT_IDS).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
gi_s AS (SELECT p.article_id, list(p.id ORDER BY p.pos) AS ids, CAST(count(*) AS INTEGER) AS n
         FROM prompt_ids_raw p JOIN _nch c USING (article_id) WHERE c.n_chunks >= 3 GROUP BY ALL),
gi_aid AS (SELECT article_id, pos // {C} AS query_no, pos, id FROM prompt_ids_raw JOIN gi_s USING (article_id) WHERE pos < (n // {C}) * {C}),
gi_a_q AS (SELECT article_id, unnest(range(n // {C})) AS query_no FROM gi_s),
{term_ctes("gi_atf", "gi_aid", "article_id, query_no").strip()},
{_search("gi_a", "gi_atf").strip()},
gi_b AS (SELECT s.article_id, s.n, s.ids, CASE WHEN s.n % {C} = 0 THEN []
           WHEN s.n < {C} THEN list_transform(range({C} - s.n), lambda j: s.ids[1 + j % s.n]) ELSE c.token_ids[1:{C} - s.n % {C}] END AS new
         FROM gi_s s LEFT JOIN gi_a_knn k ON k.article_id = s.article_id AND k.query_no = s.n // {C} - 1 AND k.rank = 1
         LEFT JOIN chunks c ON c.article_id = k.article_id AND c.chunk_no = k.chunk_no + 1),
gi_live AS (SELECT article_id, n // {C} AS query_no, list_concat(ids[(n // {C}) * {C} + 1:], new) AS chunk FROM gi_b
            WHERE n % {C} <> 0 AND NOT list_contains(new, 1)),
gi_bid AS (SELECT article_id, query_no, unnest(chunk) AS id, unnest(range({C})) AS pos FROM gi_live),
gi_b_q AS (SELECT article_id, query_no FROM gi_live),
{term_ctes("gi_btf", "gi_bid", "article_id, query_no").strip()},
{_search("gi_b", "gi_btf").strip()},
gi_ttf AS (SELECT article_id, chunk_no AS query_no, token_id, tf FROM key_tf),
gi_t_q AS (SELECT article_id, chunk_no AS query_no FROM _keys),
{_search("gi_t", "gi_ttf").strip()},
gi_near AS (SELECT 0 AS tree, article_id, query_no, rank, chunk_no FROM gi_a_knn
            UNION ALL SELECT 0, article_id, query_no, rank, chunk_no FROM gi_b_knn
            UNION ALL SELECT 1, article_id, query_no, rank, chunk_no FROM gi_t_knn),
gi_first AS (SELECT b.article_id, CAST(b.n + len(b.new) AS INTEGER) AS size, k.chunk_no + 1 AS chunk_no
             FROM gi_b b JOIN gi_near k ON k.tree = 0 AND k.article_id = b.article_id AND k.rank = 1
               AND k.query_no = CASE WHEN b.n % {C} = 0 THEN b.n // {C} - 1 ELSE b.n // {C} END
             WHERE NOT list_contains(b.new, 1)),
gi_r(article_id, step, chunk_no, size, over) AS (
  SELECT f.article_id, 1, f.chunk_no, f.size + {C}, list_contains(c.token_ids, 1) OR f.size + {C} >= 512
  FROM gi_first f JOIN chunks c USING (article_id, chunk_no) WHERE f.size < 512
  UNION ALL
  SELECT r.article_id, r.step + 1, k.chunk_no + 1, r.size + {C}, list_contains(c.token_ids, 1) OR r.size + {C} >= 512
  FROM gi_r r JOIN gi_t_knn k ON k.article_id = r.article_id AND k.query_no = r.chunk_no AND k.rank = 1
  JOIN chunks c ON c.article_id = k.article_id AND c.chunk_no = k.chunk_no + 1 WHERE NOT r.over),
gi_out AS (SELECT r.article_id, flatten(list(c.token_ids ORDER BY r.step)) AS ids FROM gi_r r JOIN chunks c USING (article_id, chunk_no) GROUP BY ALL),
gi_all AS (SELECT b.article_id, list_concat(list_concat(b.ids, b.new), coalesce(o.ids, [])) AS ids FROM gi_b b LEFT JOIN gi_out o USING (article_id)),
gi_ids AS (SELECT article_id, CASE WHEN list_contains(ids, 1) THEN list_concat(ids[:list_position(ids, 1)],
             list_transform(range(len(ids) - list_position(ids, 1)), lambda x: 0)) ELSE ids END AS ids FROM gi_all),
gi_asked AS (SELECT article_id, query_no AS place, 0 AS tree, query_no FROM gi_near WHERE tree = 0 AND rank = 1
             UNION ALL SELECT article_id, 1000000 + step, 1, chunk_no FROM gi_r WHERE NOT over),
gi_pairs AS (SELECT q.article_id, q.place, string_agg(array_to_string(list_concat(x.token_ids, y.token_ids), ' '), '|' ORDER BY k.rank) AS p
             FROM gi_asked q JOIN gi_near k ON k.tree = q.tree AND k.article_id = q.article_id AND k.query_no = q.query_no
             JOIN chunks x ON x.article_id = k.article_id AND x.chunk_no = k.chunk_no
             JOIN chunks y ON y.article_id = k.article_id AND y.chunk_no = k.chunk_no + 1 GROUP BY ALL),
gi_found AS (SELECT article_id, count(*) AS n, string_agg(p, '#' ORDER BY place) AS p FROM gi_pairs GROUP BY ALL)
SELECT i.article_id, CAST(len(i.ids) AS BIGINT) AS n_ids, md5(array_to_string(i.ids, ' ')) AS ids_md5,
       coalesce(f.n, 0) AS n_retrieved, md5(coalesce(f.p, '')) AS retrieved_md5
FROM gi_ids i LEFT JOIN gi_found f USING (article_id)"""

# the hooks: a character is its code + 3, a chunk's vector the number of ids by remainder


def _char_chunks(name: str, text: str) -> str:
    """``{name}``(article_id, no, n, ids, v): padded chunks of characters with their vectors."""
    return f"""
{name}_t AS (SELECT article_id, regexp_replace({text}, '[^ -~]', '?', 'g') AS t FROM hk_s),
{name}_i AS (SELECT article_id, list_concat(list_transform(CASE WHEN t = '' THEN [] ELSE string_split(t, '') END, lambda c: ascii(c) + 3), [1]) AS ids FROM {name}_t),
{name}_c AS (SELECT article_id, unnest(range(CAST(ceil(len(ids) / {C}) AS BIGINT))) AS no, CAST(ceil(len(ids) / {C}) AS BIGINT) AS n, ids FROM {name}_i),
{name}_p AS (SELECT article_id, no, n, list_concat(ids[no * {C} + 1:no * {C} + {C}],
               list_transform(range(greatest((no + 1) * {C} - len(ids), 0)), lambda x: 0)) AS ids FROM {name}_c),
{name} AS (SELECT *, list_transform(range(8), lambda b: CAST(len(list_filter(ids, lambda x: x % 8 = b)) AS DOUBLE)) AS v FROM {name}_p)"""


SQL["prepare_hooks"] = with_(ARTICLES, TITLES, SAMPLES) + f""",
hk_s AS (SELECT s.article_id, s.model_input, array_to_string(a.article_text, ' ') AS body FROM samples s JOIN articles a USING (article_id)),
{_char_chunks("hk_b", "body").strip()},
{_char_chunks("hk_q", "model_input").strip()},
hk_d AS (SELECT q.article_id, q.no AS query_no, b.no AS chunk_no, list_inner_product(q.v, b.v) AS score
         FROM hk_q q JOIN hk_b b USING (article_id) WHERE q.no < q.n - 1 AND b.no < b.n - 1 AND b.n >= 3),
hk_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, query_no ORDER BY score DESC, chunk_no) AS rank FROM hk_d) WHERE rank <= 2),
hk_n AS (SELECT r.article_id, r.query_no, string_agg(array_to_string(list_concat(a.ids, b.ids), ' '), '|' ORDER BY r.rank) AS p
         FROM hk_r r JOIN hk_b a ON a.article_id = r.article_id AND a.no = r.chunk_no
         JOIN hk_b b ON b.article_id = r.article_id AND b.no = r.chunk_no + 1 GROUP BY ALL),
hk_a AS (SELECT article_id, count(*) AS n, string_agg(p, '#' ORDER BY query_no) AS p FROM hk_n GROUP BY ALL)
SELECT b.article_id, b.n AS n_chunks, coalesce(a.n, 0) AS n_queries, md5(coalesce(a.p, '')) AS retrieved_md5
FROM hk_b b LEFT JOIN hk_a a USING (article_id) WHERE b.no = 0 AND b.n >= 3"""

SQL["materialize_files"] = with_(ARTICLES) + """
SELECT article_id, md5(array_to_string(article_text, ' ')) AS body_md5 FROM articles"""

SQL["subword_roundtrip"] = """
SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents"""

SQL["quarantine_flow"] = with_(ARTICLES, TITLES) + """
SELECT a.split, CASE WHEN a.article_id % 7 <> 0 THEN a.article_id END AS article_id,
       CAST(CASE WHEN a.article_id % 7 = 0 THEN 20 END AS BIGINT) AS line_chars,
       CASE WHEN a.article_id % 7 = 0 THEN 'not_json' ELSE 'no_title' END AS error
FROM articles a LEFT JOIN titles t ON a.article_id = t.id
WHERE a.article_id % 7 = 0 OR t.id IS NULL"""

# G6 on texts: every whitespace token as its counts of character 3-grams between < and >
SQL["greedy_text"] = with_(PAIRS) + f""",
gt AS (SELECT id, 'r' AS side, unnest({words('reference')}) AS tok FROM pairs
       UNION ALL SELECT id, 'c' AS side, unnest({words('prediction')}) AS tok FROM pairs),
gn AS (SELECT id, side, tok, count(*) AS n FROM gt GROUP BY ALL),
gg AS (SELECT tok, g, count(*) AS n FROM (SELECT tok, unnest(list_transform(range(1, len(tok) + 1), lambda i: substr('<' || tok || '>', i, 3))) AS g
                                          FROM (SELECT DISTINCT tok FROM gt)) GROUP BY ALL),
gl AS (SELECT tok, sqrt(sum(n * n)) AS l FROM gg GROUP BY tok),
gp AS (SELECT a.id, a.tok AS c, b.tok AS r FROM gn a JOIN gn b ON a.id = b.id AND a.side = 'c' AND b.side = 'r'),
gd AS (SELECT x.tok AS c, y.tok AS r, sum(x.n * y.n) AS d FROM gg x JOIN gg y ON x.g = y.g
       WHERE (x.tok, y.tok) IN (SELECT DISTINCT c, r FROM gp) GROUP BY ALL),
gs AS (SELECT p.id, p.c, p.r, coalesce(d.d, 0) / (lc.l * lr.l) AS s
       FROM gp p LEFT JOIN gd d ON d.c = p.c AND d.r = p.r JOIN gl lc ON lc.tok = p.c JOIN gl lr ON lr.tok = p.r),
gm AS (SELECT id, 'c' AS side, c AS tok, max(s) AS m FROM gs GROUP BY ALL UNION ALL SELECT id, 'r', r, max(s) FROM gs GROUP BY ALL),
ga AS (SELECT m.id, m.side, sum(m.m * n.n) / sum(n.n) AS v FROM gm m JOIN gn n USING (id, side, tok) GROUP BY ALL),
ge AS (SELECT p.id, len({words('reference')}) AS nr, len({words('prediction')}) AS nc FROM pairs p),
gv AS (SELECT e.id, CASE WHEN nr = 0 AND nc = 0 THEN 1.0 ELSE coalesce(c.v, 0.0) END AS precision,
              CASE WHEN nr = 0 AND nc = 0 THEN 1.0 ELSE coalesce(r.v, 0.0) END AS recall
       FROM ge e LEFT JOIN ga c ON c.id = e.id AND c.side = 'c' LEFT JOIN ga r ON r.id = e.id AND r.side = 'r'),
gf AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM gv)
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM gf"""
SQL["score_result_file"] = SQL["greedy_text"].rsplit("SELECT id, round", 1)[0] + """
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n FROM gf"""

SQL["generate_retrieval"] = with_(VOCAB, DOC_IDS, CHUNKS, SPARSE) + f""",
gr AS (SELECT k.article_id, string_agg(c.token_ids[1] || ':' || d.token_ids[{C}], ' ' ORDER BY k.query_no, k.rank) AS pairs
       FROM knn k JOIN chunks c ON c.article_id = k.article_id AND c.chunk_no = k.chunk_no
       JOIN chunks d ON d.article_id = k.article_id AND d.chunk_no = k.chunk_no + 1 GROUP BY ALL)
SELECT n.article_id, coalesce(r.pairs, '') || ' #' || CAST(n.article_id AS VARCHAR) AS prediction
FROM _nch n LEFT JOIN gr r USING (article_id) WHERE n.n_chunks >= 3"""


# ---- L2: the evaluation flow --------------------------------------------------
# Every chunk of the samples' whole input (the last one padded) searches the body
# chunks of the same article (documents with >= k+1 chunks, all but the last chunk) by
# term frequency; the best pair of each query chunk (first query wins), in query order,
# follows the prompt ids; prediction = strip(decode(...)), F1 reference =
# decode(input ids), ROUGE reference = the raw model input.

_EVAL = f"""
ev_q AS (SELECT article_id, unnest(range(n)) AS query_no FROM _qn),
{_search("ev", "qc_tf").strip()},
ev_best AS (SELECT article_id, chunk_no, min(query_no) AS query_no FROM ev_knn WHERE rank = 1 GROUP BY ALL),
ev_draft AS (SELECT b.article_id,
                    flatten(list(list_concat(a.token_ids, c.token_ids) ORDER BY b.query_no)) AS draft
             FROM ev_best b JOIN chunks a ON a.article_id = b.article_id AND a.chunk_no = b.chunk_no
             JOIN chunks c ON c.article_id = b.article_id AND c.chunk_no = b.chunk_no + 1 GROUP BY ALL),
ev_pred_ids AS (
  SELECT s.article_id,
         list_concat(coalesce((SELECT list(id ORDER BY pos) FROM prompt_ids_raw p
                               WHERE p.article_id = s.article_id), []),
                     coalesce(d.draft, [])) AS ids
  FROM samples s LEFT JOIN ev_draft d USING (article_id)),
ev_pred_rows AS (SELECT article_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM ev_pred_ids),
{decode_ctes('ev_pred_t', 'ev_pred_rows', 'article_id').strip()},
ev_pred_txt AS (SELECT s.article_id, coalesce(t.text, '') AS text FROM samples s LEFT JOIN ev_pred_t t USING (article_id)),
{decode_ctes('ev_ref_t', 'input_ids', 'article_id').strip()},
ev_ref_txt AS (SELECT s.article_id, coalesce(t.text, '') AS text FROM samples s LEFT JOIN ev_ref_t t USING (article_id)),
ev_f1_src AS (SELECT CAST(s.article_id AS VARCHAR) AS id, r.text AS reference,
                     regexp_replace(p.text, '^{STRIP_CLASS}+|{STRIP_CLASS}+\\z', '', 'g') AS prediction
              FROM samples s JOIN ev_ref_txt r USING (article_id) JOIN ev_pred_txt p USING (article_id)),
ev_rg_src AS (SELECT CAST(s.article_id AS VARCHAR) AS id, s.model_input AS reference, f.prediction
              FROM samples s JOIN ev_f1_src f ON f.id = CAST(s.article_id AS VARCHAR)),
ev_qa AS (SELECT id, {qa_tok('reference')} AS r, {qa_tok('prediction')} AS p FROM ev_f1_src),
{overlap_cte('ev_qa').strip().replace('ov AS', 'ev_ov AS')},
ev_f1 AS (SELECT q.id,
  CASE WHEN len(r) = 0 OR len(p) = 0 THEN (CASE WHEN len(r) = 0 AND len(p) = 0 THEN 1.0 ELSE 0.0 END)
       WHEN coalesce(o.overlap, 0) = 0 THEN 0.0
       ELSE 2.0 * o.overlap / (len(r) + len(p)) END AS f1,
  CAST(CASE WHEN array_to_string(r, ' ') = array_to_string(p, ' ') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS em
  FROM ev_qa q LEFT JOIN ev_ov o USING (id))
"""


def _fm(cte: str) -> str:
    return (f"(SELECT id, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
            f"ELSE 0.0 END AS f FROM {cte})")


# the LCS scores of whole documents are beyond SQL: tests hold them against brute force
SQL["evaluate_flow"] = with_(VOCAB, ARTICLES, TITLES, SAMPLES, DOC_IDS, CHUNKS, SPARSE, PROMPT_IDS, INPUT_IDS, _QUERY_ROWS) + ",\n" + ",\n".join([
    _EVAL.strip(), rouge_n_sql(1, "ev_rg_src", "_ev").strip(), rouge_n_sql(2, "ev_rg_src", "_ev").strip()]) + f"""
SELECT f.id, round(f.f1, 6) AS f1, round(f.em, 6) AS exact_match, round(a.f, 6) AS rouge1, round(b.f, 6) AS rouge2
FROM ev_f1 f JOIN {_fm('prf1_ev')} a USING (id) JOIN {_fm('prf2_ev')} b USING (id)"""
