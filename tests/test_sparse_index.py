"""The inverted index against scoring every pair."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from longdoc.operators import sparse_index as S
from longdoc.operators.chunks import chunk_tf
from longdoc.operators.retrieve import knn_sparse

PIECE = 260


def _article(rng, n, vocab, width=12, common=0):
    """n chunks of word ids: a Zipf-like vocabulary, and ``common`` words that every chunk has."""
    words = np.minimum(rng.zipf(1.4, (n, width)), vocab) - 1 + PIECE + common
    return [[PIECE + c for c in range(common)] + row for row in words.tolist()]


def _blocks(articles, drop=0):
    t = pa.array([c for c in articles], pa.list_(pa.list_(pa.int32())))
    b = S.index_batch(pa.array(range(len(articles)), pa.int64()), t, drop)
    return pa.table({n: b.column(i) for i, n in enumerate(b.schema.names)})


def _tile(articles, k=2, exclude_self=True, queries=None):
    groups = {}
    q = S.Blocks(_blocks(queries or articles), groups)
    keys = S.Blocks(_blocks(articles), groups)
    return S.Tile(q, keys, k, exclude_self)


def _brute(articles, k, exclude_self, queries=None):
    out = []
    for a, (qs, ks) in enumerate(zip(queries or articles, articles, strict=True)):
        tf = [dict(zip(*np.unique([x for x in c if x >= PIECE], return_counts=True), strict=True)) for c in ks]
        norm = [sum(int(v) ** 2 for v in t.values()) for t in tf]
        for i, c in enumerate(qs):
            own = dict(zip(*np.unique([x for x in c if x >= PIECE], return_counts=True), strict=True))
            scored = []
            for j, t in enumerate(tf):
                if not (exclude_self and i == j):
                    dot = sum(int(v) * int(t.get(w, 0)) for w, v in own.items())
                    scored.append((-(dot / np.sqrt(norm[j]) if dot else 0.0), j))
            out += [(a, i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def _rows(tile, found):
    query, key, score = found
    rank, out, last = 0, [], None
    for i in np.lexsort((key, -score, query)).tolist():
        rank = rank + 1 if query[i] == last else 0
        last = query[i]
        out.append((int(tile.q.chunk_group[query[i]]), int(tile.q.chunk_no[query[i]]), rank, int(tile.blocks.chunk_no[key[i]]), float(score[i])))
    return out


@pytest.mark.parametrize("few", [0, 60, 10 ** 9])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_tiles_equal_all_pairs(monkeypatch, few, exclude_self):
    monkeypatch.setattr(S, "FEW_POSTINGS", few)
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "PARTS", 500)
    monkeypatch.setattr(S, "SEED_POSTINGS", 4)
    rng = np.random.default_rng(few % 1000)
    for k in (1, 2, 5):
        articles = [_article(rng, n, v, common=c) for n, v, c in ((40, 30, 0), (3, 5, 1), (1, 4, 0), (90, 400, 2), (25, 3, 0))]
        articles += [[[0] * 12, [PIECE] * 3, [], [PIECE + 7]], [], [[1, 2, 0]]]
        queries = [_article(rng, 5, 30) for _ in articles] if not exclude_self else None
        tile = _tile(articles, k, exclude_self, queries)
        assert _rows(tile, tile.search()) == _brute(articles, k, exclude_self, queries)


def test_postings_scored_are_linear_in_a_hot_article(monkeypatch):
    """Common words stand in every chunk, so all pairs share terms; a chunk's near ones share rare words with it. Scoring all
    postings would read 10 n^2 and more of them."""
    rng = np.random.default_rng(7)
    read = {}
    for n in (5_000, 20_000):
        topic = rng.permutation(n) // 5
        article = [[PIECE + c for c in range(10)] + [PIECE + 10 + int(t) * 8 + w for w in rng.permutation(8)[:5]] * 3 for t in topic]
        tile = _tile([article])
        query, key, score = tile.search()
        read[n] = tile.scored
        assert len(query) == 2 * n
        for q in rng.integers(0, n, 5).tolist():  # against all keys of the sampled queries
            want = _brute([[article[q], *article]], 2, False, [[article[q]]])
            own = [(j - 1, s) for _, _, _, j, s in _brute([[article[q], *article]], 4, False, [[article[q]]]) if j - 1 not in (q, -1)][:2]
            assert want and [(int(a), float(b)) for a, b in zip(key[query == q], score[query == q], strict=True)] == own
    assert read[20_000] < 6 * read[5_000] and read[20_000] < 20_000 ** 2 / 100


def test_search_equals_the_relational_form(spark):
    """Through Spark, with articles of many tiles, small ones and empty ones."""
    rng = np.random.default_rng(3)
    articles = [_article(rng, n, 200) for n in (300, 70, 5, 3)] + [[], [[0, 0]]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(articles)] + [(None, articles[2])], "article_id long, text_tokenized array<array<int>>")
    index = S.build(df.withColumn("g", F.lit("clash"))).cache()
    got = sorted(tuple(r) for r in S.search(index, index, exclude_self=True).where("article_id is not null")
                 .select("article_id", "query_no", "rank", "chunk_no", "score").collect())
    chunks = df.where("article_id is not null").select("article_id", F.size("text_tokenized").alias("n_keys"),
                                                       F.posexplode("text_tokenized").alias("chunk_no", "token_ids"))
    k_tf = chunk_tf(chunks, ["article_id", "chunk_no"])
    queries = chunks.select("article_id", F.col("chunk_no").alias("query_no"), "n_keys")
    want = knn_sparse(k_tf.drop("norm2").withColumnRenamed("chunk_no", "query_no"), k_tf, queries, exclude_self=True)
    assert got == sorted(tuple(r) for r in want.select("article_id", "query_no", "rank", "chunk_no", "score").collect())
    assert S.search(index.limit(0), index, k=1).collect() == [] and S.search(index, index.limit(0), k=1).collect() == []


def test_hot_article_is_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(1, _article(rng, 700, 50)), (2, _article(rng, 40, 50))], "article_id long, text_tokenized array<array<int>>")
    index = S.build(df).cache()
    whole = sorted(tuple(r) for r in S.search(index, index, exclude_self=True).collect())
    monkeypatch.setattr(S, "TILE_BLOCKS", 2)
    assert sorted(tuple(r) for r in S.search(index, index, exclude_self=True).collect()) == whole


def test_words_that_shared_an_id_of_28_bits_are_two_terms():
    """Two spelled words whose md5 agree in their first 7 digits: one term before, two now."""
    import hashlib
    import itertools
    import string

    from longdoc.constants import FIRST_BYTE_ID, WORD
    from longdoc.operators.chunks import terms_of
    seen, pair = {}, None
    for w in itertools.product(string.ascii_lowercase, repeat=4):
        w = "".join(w)
        h = hashlib.md5(w.encode().hex().upper().encode()).hexdigest()[:7]
        if h in seen:
            pair = seen[h], w
            break
        seen[h] = w
    ids = [[WORD, *(b + FIRST_BYTE_ID for b in w.encode())] for w in pair]
    _, terms = terms_of(np.repeat([0, 1], 5), np.array(ids[0] + ids[1]))
    assert len(set(terms.tolist())) == 2 and min(terms) > 1 << 60


def test_postings_of_a_written_index(spark):
    df = spark.createDataFrame([(1, [[PIECE, PIECE, PIECE + 1], [PIECE, 0, 0], [0, 0, 0]])] , "article_id long, text_tokenized array<array<int>>")
    got = {(r.token_id, r.df, round(r.impact, 6)) for r in S.postings(S.build(df)).collect()}
    assert got == {(PIECE, 2, 1.0), (PIECE + 1, 1, round(1 / 5 ** 0.5, 6))}
