"""Top-k search: tiled dense path vs the relational path, sparse vs brute force."""

import numpy as np
from pyspark.sql import functions as F

from longdoc.operators.retrieve import knn_sparse, knn_within, top_k
from longdoc.sources.tables import read_table
from tests.conftest import SF_SMALL


def knn_within_sql(queries, keys, group, q_id, k_id, vec="embedding", k=2, exclude_self=False):
    """Brute force for small fixtures: all pairs of a group, dot, row_number."""
    q = queries.select(group, F.col(q_id).alias("_q"), F.col(vec).alias("_qv"))
    kk = keys.select(group, F.col(k_id).alias("_k"), F.col(vec).alias("_kv"))
    j = q.join(kk, group)
    if exclude_self:
        j = j.where(F.col("_q") != F.col("_k"))
    d = F.aggregate(F.zip_with("_qv", "_kv", lambda x, y: x.cast("double") * y.cast("double")),
                    F.lit(0.0).cast("double"), lambda u, v: u + v)
    scored = j.select(group, "_q", "_k", d.alias("score"))
    return (top_k(scored, [group, "_q"], "_k", k)
            .select(group, F.col("_q").alias(q_id), "rank", F.col("_k").alias(k_id), "score"))


def test_tiled_equals_relational(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    q = e.select("label", F.col("vec_id").alias("qid"), "embedding")
    k = e.select("label", F.col("vec_id").alias("kid"), "embedding")
    # block 7 forces several query and key blocks per label (hot-group path)
    tiled = knn_within(q, k, "label", "qid", "kid", k=3, block=7, exclude_self=True)
    rel = knn_within_sql(q, k, "label", "qid", "kid", k=3, exclude_self=True)
    a = sorted((r.label, r.qid, r.rank, r.kid, round(r.score, 9)) for r in tiled.collect())
    b = sorted((r.label, r.qid, r.rank, r.kid, round(r.score, 9)) for r in rel.collect())
    assert a == b and len(a) > 0


def test_tiled_l2_and_cosine_rank_like_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(40, 5))
    rows = [(int(i % 2), int(i), [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "g int, id long, embedding array<double>")
    for metric in ("l2", "cosine"):
        r = knn_within(df, df, "g", "id", "id", k=2, block=6, exclude_self=True, metric=metric)
        res = {}
        for x in r.collect():
            res.setdefault(x.id, {})[x.rank] = x
        for i in range(40):
            same = [j for j in range(40) if j % 2 == i % 2 and j != i]
            if metric == "l2":
                s = {j: -np.sum((vecs[i] - vecs[j]) ** 2) for j in same}
            else:
                s = {j: vecs[i] @ vecs[j] / np.linalg.norm(vecs[i]) / np.linalg.norm(vecs[j]) for j in same}
            best = sorted(same, key=lambda j: (-s[j], j))[:2]
            assert [round(res[i][n].score, 9) for n in (1, 2)] == [round(s[j], 9) for j in best]


def test_sparse_matches_brute_force(spark):
    q = spark.createDataFrame([(1, 0, 3, 2), (1, 0, 4, 1), (2, 0, 5, 1)],
                              "article_id long, query_no int, token_id int, tf long")
    keys = {(1, 0): {3: 1, 9: 3}, (1, 1): {3: 2, 4: 1}, (1, 2): {4: 5}, (2, 0): {6: 1}, (2, 1): {5: 2}}
    rows = [(a, c, int(sum(v * v for v in tf.values())), t, n) for (a, c), tf in keys.items() for t, n in tf.items()]
    k = spark.createDataFrame(rows, "article_id long, chunk_no int, norm2 long, token_id int, tf long")
    n_keys = {1: 3, 2: 2}
    queries = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (2, 1, 2)], "article_id long, query_no int, n_keys int")
    found = knn_sparse(q, k, queries, k=2).orderBy("article_id", "rank").collect()
    # a query without a common token has the lowest keys
    assert [(r.rank, r.chunk_no, r.score) for r in found if (r.article_id, r.query_no) == (2, 1)] == [(1, 0, 0.0), (2, 1, 0.0)]
    got = [(r.article_id, r.rank, r.chunk_no) for r in found if r.query_no == 0]
    qv = {1: {3: 2, 4: 1}, 2: {5: 1}}
    exp = []
    for a, qt in qv.items():
        sc = []
        for (aa, c), tf in keys.items():
            if aa != a:
                continue
            d = sum(qt.get(t, 0) * n for t, n in tf.items())
            sc.append((-d / np.sqrt(sum(v * v for v in tf.values())), c))
        exp += [(a, i + 1, c) for i, (_, c) in enumerate(sorted(sc)[:2])]
        assert len(sc) == n_keys[a]
    assert got == exp
    alone = knn_sparse(q, k, queries, k=2, exclude_self=True).where("article_id = 1").collect()
    assert sorted(r.chunk_no for r in alone) == [1, 2]


def test_tiled_with_string_groups_and_timing(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.9, 0.1]), ("a", 3, [0.0, 1.0]),
            ("b", 4, [1.0, 1.0]), ("b", 5, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "g string, id long, embedding array<double>")
    q = df.select("g", F.col("id").alias("qid"), "embedding")
    k = df.select("g", F.col("id").alias("kid"), "embedding")
    r = knn_within(q, k, "g", "qid", "kid", k=1, block=2, exclude_self=True, with_timing=True).collect()
    got = {(x.g, x.qid): x.kid for x in r}
    assert got == {("a", 1): 2, ("a", 2): 1, ("a", 3): 2, ("b", 4): 5, ("b", 5): 4}
    assert all(x.search_ms >= 0 for x in r)


def test_sparse_topk_unchanged_under_repartition(spark):
    from longdoc.plans import corpus
    from longdoc.plans.registry import key_tf
    k = key_tf(spark, SF_SMALL)
    q = k.drop("norm2").withColumnRenamed("chunk_no", "query_no")
    n = corpus.doc_arrays(spark, SF_SMALL).where("n_chunks >= 3").select(
        "article_id", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 2)).alias("query_no"), (F.col("n_chunks") - 1).alias("n_keys"))
    cols = ["article_id", "query_no", "rank", "chunk_no"]
    a = sorted(tuple(r) for r in knn_sparse(q, k, n).select(cols).collect())
    b = sorted(tuple(r) for r in knn_sparse(q.repartition(7, "token_id"), k.repartition(3), n.repartition(2)).select(cols).collect())
    assert a == b and a
    ranks = {}
    for art, query, rank, _ in a:
        ranks.setdefault((art, query), []).append(rank)
    want = {(r.article_id, r.query_no): list(range(1, min(2, r.n_keys) + 1)) for r in n.collect()}
    assert {x: sorted(v) for x, v in ranks.items()} == want


def test_tiled_mixed_small_and_big_groups(spark):
    rng = np.random.default_rng(3)
    rows = []
    vid = 0
    for g, n in [(0, 5), (1, 70), (2, 12), (3, 1), (4, 40)]:
        for _ in range(n):
            rows.append((g, vid, [float(x) for x in rng.normal(size=4)]))
            vid += 1
    df = spark.createDataFrame(rows, "g int, id long, embedding array<double>")
    q = df.select("g", F.col("id").alias("qid"), "embedding")
    k = df.select("g", F.col("id").alias("kid"), "embedding")
    tiled = knn_within(q, k, "g", "qid", "kid", k=3, block=16, exclude_self=True)
    rel = knn_within_sql(q, k, "g", "qid", "kid", k=3, exclude_self=True)
    a = sorted((r.g, r.qid, r.rank, r.kid, round(r.score, 9)) for r in tiled.collect())
    b = sorted((r.g, r.qid, r.rank, r.kid, round(r.score, 9)) for r in rel.collect())
    assert a == b and len(a) == sum(min(3, n - 1) * n for n in (5, 70, 12, 1, 40))


def test_embed_with_user_encoder(spark):
    from longdoc.operators.retrieve import embed

    class Enc:
        def __call__(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    r = sorted(tuple(x.embedding) for x in embed(df, "t", encoder=Enc).collect())
    assert r == [(2.0, 1.0), (4.0, 1.0)]


def test_collect_retrieved_nesting_order(spark):
    from longdoc.operators.retrieve import collect_retrieved
    from longdoc.operators.retrieve import expand_neighbors
    rows = [(1, 2, 2, 0), (1, 0, 1, 1), (1, 2, 1, 2), (1, 0, 2, 0), (1, 1, 1, 2), (2, 0, 1, 0)]
    df = spark.createDataFrame(rows, "article_id long, query_no int, rank int, chunk_no int").repartition(3)
    art = spark.createDataFrame([(1, [[1, 2], [3, 4], [5, 6], [7, 0]]), (2, [[8], [9]]), (3, [[5]])],
                                "article_id long, text_tokenized array<array<int>>")
    got = {r.article_id: r.retrieved for r in collect_retrieved(df, art).collect()}
    assert got == {1: [[[3, 4, 5, 6], [1, 2, 3, 4]], [[5, 6, 7, 0]], [[5, 6, 7, 0], [1, 2, 3, 4]]], 2: [[[8, 9]]], 3: []}
    rows = {(r.article_id, r.query_no, r["rank"]): (r.chunk_no, r.pair_ids) for r in expand_neighbors(df, art).collect()}
    assert len(rows) == 6 and rows[(1, 2, 2)] == (0, [1, 2, 3, 4])


def test_report_of_a_written_index(spark, tmp_path):
    from longdoc.operators.retrieve import index_report
    from longdoc.sources.io import read_chunk_index, write_chunk_index
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    e = spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>")
    write_chunk_index(e, str(tmp_path / "i"), key="label", chunk="vec_id")
    index = read_chunk_index(spark, str(tmp_path / "i"))
    q = e.select("label", F.col("vec_id").alias("qid"), "embedding")
    t = knn_within(q, e.withColumnRenamed("vec_id", "kid"), "label", "qid", "kid", k=1, with_timing=True)
    r = index_report(index, "label", e, "vec_id", timings=t.select("label", F.col("search_ms").alias("ms"))).collect()
    assert [(x.nb_vectors, x.dim, x.size_bytes, x.reconstruction_error) for x in r] == [(150, 8, 150 * (32 + 8), 0.0)] * 2
    assert all(x.p99_search_ms > x.avg_search_ms > 0 for x in r)
    lossy = index.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 1).cast("float")))
    assert all(0 < x.reconstruction_error < 1 for x in index_report(lossy, "label", e, "vec_id").collect())


def test_top_columns_equals_stable_sort():
    from longdoc.operators.retrieve import _top_columns
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m, k = rng.integers(1, 20), rng.integers(1, 60), rng.integers(1, 5)
        kk = min(k, m)
        s = rng.integers(-3, 4, size=(n, m)).astype(float)  # many exact ties
        s[rng.random((n, m)) < 0.1] = -np.inf
        assert (_top_columns(s, kk) == np.argsort(-s, axis=1, kind="stable")[:, :kk]).all()
