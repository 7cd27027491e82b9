"""Embedding and retrieval.

Search is always *within* a group (the article): an equi-key, never a cross
join. Two exact top-k paths:

* ``knn_sparse``: term-frequency vectors, fully relational: postings join on
  (group, token), partial sums, then a per-query top-k (``row_number`` with
  Spark's partial WindowGroupLimit before the exchange).
* ``knn_within``: dense vectors, tiled. Small groups share hash-bucket
  tiles; a bigger group's keys and queries are cut into blocks of at most
  ``block`` rows by a hash of their id, one tile per (query block, key
  block). A tile is one cogroup, scored with one numpy matrix product per
  group, and emits only its local top-k per query. A hot group becomes many
  bounded tiles; no tile holds more than ``block`` keys of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.constants import N_NEIGHBORS


# ---- D3b: sparse --------------------------------------------------------

def knn_sparse(q_tf: DataFrame, k_tf: DataFrame, queries: DataFrame, group: str = "article_id",
               query: str = "query_no", key: str = "chunk_no", k: int = N_NEIGHBORS,
               exclude_self: bool = False) -> DataFrame:
    """Top-k keys of the same group by dot(q, k) / |k|, as an exact index returns them:
    min(k, keys) for every query, keys without a common token last, by number.

    The query norm is constant per query, so leaving it out cannot change the
    ranking. Ties: lower key first. ``exclude_self``: a query's own number is no key.
    q_tf: (group, query, token_id, tf); k_tf: (group, key, norm2, token_id, tf);
    queries: (group, query, n_keys), the keys of a group being 0 .. n_keys - 1.
    """
    q = q_tf.select(group, query, "token_id", F.col("tf").alias("qtf"))
    kt = k_tf.select(group, key, "norm2", "token_id", F.col("tf").alias("ktf"))
    hits = q.join(kt, [group, "token_id"]).select(group, query, key, (F.col("qtf") * F.col("ktf")).alias("part"), "norm2")
    # the k lowest keys fill up; of 2k + 1 at most k are better placed and one is the query
    low = F.sequence(F.lit(0), F.least(F.col("n_keys"), F.lit(2 * k + 1)).cast("int") - 1)
    fill = queries.where(F.col("n_keys") > 0).select(group, query, F.explode(low).alias(key), F.lit(0).cast("bigint").alias("part"),
                                                     F.lit(None).cast("bigint").alias("norm2"))
    every = hits.unionByName(fill)
    if exclude_self:
        every = every.where(F.col(key) != F.col(query))
    dots = every.groupBy(group, query, key).agg(F.sum("part").alias("dot"), F.max("norm2").alias("norm2"))
    scored = dots.select(group, query, key, F.when(F.col("dot") == 0, F.lit(0.0)).otherwise(
        F.col("dot").cast("double") / F.sqrt(F.col("norm2").cast("double"))).alias("score"))
    return top_k(scored, [group, query], key, k)


def top_k(scored: DataFrame, part: list[str], key: str, k: int) -> DataFrame:
    """Rank within each query by score desc, then key asc; keep rank <= k."""
    w = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col(key).asc())
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


# ---- D3: dense, tiled ---------------------------------------------------

def knn_within(queries: DataFrame, keys: DataFrame, group: str, q_id: str, k_id: str,
               vec: str = "embedding", k: int = N_NEIGHBORS, block: int = 2048,
               exclude_self: bool = False, metric: str = "ip", with_timing: bool = False) -> DataFrame:
    """D3: exact top-k keys of the same group for every query.

    Returns (group, q_id, rank, k_id, score). ``metric``: ip | cosine | l2
    (l2 ranks by negative squared distance). Ties: lower key id first.
    ``with_timing`` adds ``search_ms``: queries are then searched one by one, and it is the
    measured time of the query in its tiles.

    Tiles: a group that fits in one block on both sides shares a tile with
    other such groups, so a million small articles are not a million Python
    calls; there are as many of these tiles as blocks of keys and queries. A bigger group is cut into query blocks x key blocks of at most
    ``block`` rows (hash of the id); its queries go to every key block of the
    group, its keys to every query block, so each same-group pair meets in
    exactly one tile.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    gtype = dict(queries.dtypes)[group]
    nq = queries.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("_nq"))
    nk = keys.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("_nk"))
    sizes = nq.join(nk, "g").withColumn("_nqb", F.ceil(F.col("_nq") / block).cast("int")).withColumn(
        "_nkb", F.ceil(F.col("_nk") / block).cast("int"))
    # shared tiles hold about a block of keys and of queries, however many groups there are
    fit = sizes.where("_nqb = 1 and _nkb = 1").agg(F.sum("_nq").alias("q"), F.sum("_nk").alias("k")).first()
    nb = max(1, -(-max(fit["q"] or 0, fit["k"] or 0) // block))
    sizes = sizes.drop("_nq", "_nk")
    small = (F.col("_nqb") == 1) & (F.col("_nkb") == 1)
    tile_id = F.when(small, F.pmod(F.xxhash64(F.col("g")), F.lit(nb))).otherwise(F.xxhash64(F.col("g")))
    qv = queries.select(F.col(group).alias("g"), F.col(q_id).cast("bigint").alias("qid"),
                        F.col(vec).alias("qv"))
    kv = keys.select(F.col(group).alias("g"), F.col(k_id).cast("bigint").alias("kid"),
                     F.col(vec).alias("kv"))
    qx = (qv.join(sizes, "g")
          .withColumn("t", tile_id)
          .withColumn("qb", F.when(small, F.lit(-1)).otherwise(
              F.pmod(F.xxhash64("qid"), F.col("_nqb")).cast("int")))
          .withColumn("kb", F.when(small, F.array(F.lit(-1))).otherwise(
              F.sequence(F.lit(0), F.col("_nkb") - 1)))
          .withColumn("kb", F.explode("kb"))
          .select("t", "qb", "kb", "g", "qid", "qv"))
    kx = (kv.join(sizes, "g")
          .withColumn("t", tile_id)
          .withColumn("kb", F.when(small, F.lit(-1)).otherwise(
              F.pmod(F.xxhash64("kid"), F.col("_nkb")).cast("int")))
          .withColumn("qb", F.when(small, F.array(F.lit(-1))).otherwise(
              F.sequence(F.lit(0), F.col("_nqb") - 1)))
          .withColumn("qb", F.explode("qb"))
          .select("t", "qb", "kb", "g", "kid", "kv"))

    def tile(qdf: pd.DataFrame, kdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_groups(qdf, kdf, k, exclude_self, metric, with_timing)

    local = (qx.groupBy("t", "qb", "kb")
             .cogroup(kx.groupBy("t", "qb", "kb"))
             .applyInPandas(tile, f"g {gtype}, qid long, kid long, score double, ms double"))
    if with_timing:
        local = local.withColumn("search_ms", F.sum("ms").over(Window.partitionBy("g", "qid")))
    ranked = top_k(local, ["g", "qid"], "kid", k)
    extra = ["search_ms"] if with_timing else []
    return ranked.select(F.col("g").alias(group), F.col("qid").alias(q_id), "rank",
                         F.col("kid").alias(k_id), "score", *extra)


def _tile_groups(qdf: pd.DataFrame, kdf: pd.DataFrame, k: int, exclude_self: bool,
                 metric: str, one_by_one: bool) -> pd.DataFrame:
    """One tile: per group present on both sides, one matrix product and the
    local top-k; ``one_by_one`` searches and times each query alone, against keys
    that are laid out once per group."""
    import time
    out: dict[str, list] = {"g": [], "qid": [], "kid": [], "score": [], "ms": []}
    if len(qdf) and len(kdf):
        kgroups = {g: d for g, d in kdf.groupby("g", sort=False)}
        for g, qg in qdf.groupby("g", sort=False):
            kg = kgroups.get(g)
            if kg is None:
                continue
            kg = kg.sort_values("kid", kind="stable")  # ties: lower key first
            keys, kid = np.vstack(kg["kv"].to_numpy()).astype(np.float64), kg["kid"].to_numpy()
            queries, qid = np.vstack(qg["qv"].to_numpy()).astype(np.float64), qg["qid"].to_numpy()
            norms = (keys * keys).sum(axis=1)
            step = 1 if one_by_one else len(qid)
            for i in range(0, len(qid), step):
                t0 = time.perf_counter()
                rows, cols, scores = _search(queries[i:i + step], qid[i:i + step], keys, kid, norms, k, exclude_self, metric)
                ms = (time.perf_counter() - t0) * 1000.0
                own = qid[i:i + step][rows]
                out["g"].append(np.full(len(rows), g, dtype=object))
                out["qid"].append(own.astype(np.int64))
                out["kid"].append(kid[cols].astype(np.int64))
                out["score"].append(scores)
                out["ms"].append(np.where(np.r_[True, own[1:] != own[:-1]][:len(own)], ms, 0.0))
    kinds = {"g": "object", "qid": "int64", "kid": "int64", "score": "float64", "ms": "float64"}
    cat = {c: np.concatenate(v) if v else np.empty(0, kinds[c]) for c, v in out.items()}
    r = pd.DataFrame(cat).astype({c: t for c, t in kinds.items() if c != "g"})
    return r.astype({"g": qdf["g"].dtype if len(qdf) else kdf["g"].dtype})


def _search(queries: np.ndarray, qid: np.ndarray, keys: np.ndarray, kid: np.ndarray, norms: np.ndarray, k: int,
            exclude_self: bool, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, key row, score) of the top k keys of each query; ``keys`` in the order of ``kid``."""
    s = queries @ keys.T
    if metric == "cosine":
        qn, kn = np.linalg.norm(queries, axis=1), np.sqrt(norms)
        s = s / np.where(qn == 0, 1, qn)[:, None] / np.where(kn == 0, 1, kn)[None, :]
    elif metric == "l2":
        s = -((queries * queries).sum(1)[:, None] - 2 * s + norms[None, :])
    if exclude_self:
        s = np.where(qid[:, None] != kid[None, :], s, -np.inf)
    kk = min(k, s.shape[1])
    cols = _top_columns(s, kk).reshape(-1)
    rows = np.repeat(np.arange(len(qid)), kk)
    scores = s[rows, cols]
    keep = scores > -np.inf
    return rows[keep], cols[keep], scores[keep]


def _top_columns(Sm: np.ndarray, kk: int) -> np.ndarray:
    """Per row, the kk columns with the largest values, ordered by value desc
    then column asc (columns are already in key-id order). argpartition finds
    the set in linear time; rows where a tie at the kk-th value was cut
    arbitrarily fall back to a stable sort, so the result equals
    ``argsort(-Sm, stable)[:, :kk]``."""
    n, m = Sm.shape
    if m <= 4 * kk:
        return np.argsort(-Sm, axis=1, kind="stable")[:, :kk]
    r = np.arange(n)[:, None]
    part = np.argpartition(-Sm, kk - 1, axis=1)[:, :kk]
    vals = Sm[r, part]
    t = vals.min(axis=1)
    cut = (Sm == t[:, None]).sum(axis=1) > (vals == t[:, None]).sum(axis=1)
    order = np.lexsort((part, -vals), axis=-1)
    out = part[r, order]
    if cut.any():
        out[cut] = np.argsort(-Sm[cut], axis=1, kind="stable")[:, :kk]
    return out


# ---- J4, J5, D4: neighbour expansion and collection -----------------------

def neighbors_by_group(nbrs: DataFrame, group: str = "article_id", query: str = "query_no",
                       key: str = "chunk_no") -> DataFrame:
    """(group, found): the numbers of every query's neighbours, in query and rank order; three
    integers per neighbour, k neighbours per query chunk of the article."""
    return nbrs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(
        F.col(query).alias("query_no"), F.col("rank").alias("rank"), F.col(key).alias("chunk_no")))).alias("found"))


def _pair(chunks: Column, chunk_no: Column) -> Column:
    """Chunk i followed by chunk i + 1, from an article's own chunks."""
    return F.concat(F.element_at(chunks, chunk_no + 1), F.element_at(chunks, chunk_no + 2))


def expand_neighbors(nbrs: DataFrame, articles: DataFrame, group: str = "article_id", chunks: str = "text_tokenized") -> DataFrame:
    """(group, query_no, rank, chunk_no, pair_ids). The neighbours' numbers meet the
    article's one row, whose chunk array is sliced; no table of pairs is stored or shuffled."""
    j = articles.select(group, F.col(chunks).alias("_c")).join(neighbors_by_group(nbrs, group), group)
    pairs = F.transform("found", lambda r: F.struct(r["query_no"].alias("query_no"), r["rank"].alias("rank"),
                                                    r["chunk_no"].alias("chunk_no"), _pair(F.col("_c"), r["chunk_no"]).alias("pair_ids")))
    return j.select(group, F.explode(pairs).alias("_p")).select(group, "_p.query_no", "_p.rank", "_p.chunk_no", "_p.pair_ids")


def collect_retrieved(nbrs: DataFrame, articles: DataFrame, group: str = "article_id", chunks: str = "text_tokenized") -> DataFrame:
    """J4 + D4: ``articles`` with ``retrieved`` = [n_query][k][2c], in query order, then rank
    order; [] without queries. One join per article; the nesting is array functions."""
    j = articles.join(neighbors_by_group(nbrs, group), group, "left")
    found = F.coalesce("found", F.array().cast("array<struct<query_no:int,rank:int,chunk_no:int>>"))
    j = j.withColumn("found", found)
    starts = F.filter(F.transform("found", lambda r, i: F.when(r["rank"] == 1, i)), lambda i: i.isNotNull())
    sizes = F.size("found")
    # the rows of one query stand together: from its rank 1 to the next one's
    nested = F.transform(F.col("_at"), lambda i, n: F.transform(
        F.slice("found", i + 1, F.coalesce(F.get("_at", n + 1), sizes) - i), lambda r: _pair(F.col(chunks), r["chunk_no"])))
    return j.withColumn("_at", starts).withColumn("retrieved", nested).drop("found", "_at")


# ---- D1: embeddings -------------------------------------------------------

def token_hash(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket bits, sign) per token id from md5("seed|id"): the first 52 bits
    pick the bucket, the next hex digit the sign; md5 keeps the encoder reproducible by
    any engine. Each distinct id of a batch is hashed once."""
    import hashlib
    if len(ids) == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float64)
    uniq, inv = np.unique(ids, return_inverse=True)
    digests = [hashlib.md5(f"{seed}|{t}".encode()).hexdigest() for t in uniq.tolist()]
    hb = np.array([int(h[:13], 16) for h in digests], dtype=np.int64)
    sg = np.array([1.0 if int(h[13], 16) < 8 else -1.0 for h in digests])
    return hb[inv], sg[inv]


def hash_embed_batch(offsets: np.ndarray, ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Signed feature hashing of id lists given as (offsets, flat ids):
    integer sums per bucket, divided by the exact L2 norm, as float32."""
    n = len(offsets) - 1
    outm = np.zeros((n, dim), dtype=np.float64)
    if len(ids):
        hb, sign = token_hash(ids, seed)
        rows = np.repeat(np.arange(n), np.diff(offsets))
        np.add.at(outm, (rows, hb % dim), sign)
    norm = np.sqrt((outm * outm).sum(axis=1))
    outm /= np.where(norm == 0, 1.0, norm)[:, None]
    return outm.astype(np.float32)


def _hash_embed_udf(dim: int, seed: int):
    @F.arrow_udf("array<float>")
    def enc(ids: pa.Array) -> pa.Array:
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        offs = pc.subtract(ids.offsets, ids.offsets[0]).to_numpy()
        flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
        m = hash_embed_batch(offs, flat, dim, seed)
        values = pa.array(m.reshape(-1), pa.float32())
        step = np.arange(0, (len(offs) - 1) * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(step), values, mask=ids.is_null())

    return enc.asNondeterministic()


def hash_embed(ids, dim: int = 64, seed: int = 42) -> Column:
    """D1 built-in encoder: signed feature hashing of the real token ids
    (PAD/EOS/UNK dropped JVM-side), L2-normalised; one vectorised numpy pass
    per Arrow batch."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return _hash_embed_udf(dim, seed)(F.filter(c, lambda x: x >= 3))


class HashEncoder:
    """The built-in chunk encoder as flows take it: an id-array column -> vector column."""

    def __init__(self, dim: int = 64, seed: int = 42):
        self.dim, self.seed = dim, seed

    def encode(self, ids) -> Column:
        return hash_embed(ids, self.dim, self.seed)


class UserEncoder:
    """H3: a chunk encoder of the caller's. ``factory()`` makes a callable
    list[list[int]] -> array (n, d); it is made once per task and called on batches."""

    def __init__(self, factory, batch_rows: int = 256):
        self.factory, self.batch_rows = factory, batch_rows

    def encode(self, ids) -> Column:
        factory, rows = self.factory, self.batch_rows

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fn = factory()
            for s in batches:
                vals, vecs = [list(x) for x in s], []
                for i in range(0, len(vals), rows):
                    vecs.extend(np.asarray(fn(vals[i:i + rows]), dtype=np.float32).tolist())
                yield pd.Series(vecs)

        return run(F.col(ids) if isinstance(ids, str) else ids)


def embed(df: DataFrame, col: str, encoder=None, out: str = "embedding",
          dim: int = 64, batch_rows: int = 256) -> DataFrame:
    """Batch-encode a column. ``encoder`` is a user callable
    list[str] -> array (n, d) loaded once per task through an iterator pandas
    UDF; without it the built-in hashing encoder runs on token-id arrays."""
    if encoder is None:
        return df.withColumn(out, hash_embed(col, dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = encoder() if isinstance(encoder, type) else encoder
        for s in batches:
            vals = s.tolist()
            out_rows = []
            for i in range(0, len(vals), batch_rows):
                out_rows.extend(np.asarray(fn(vals[i:i + batch_rows]), dtype=np.float32).tolist())
            yield pd.Series(out_rows)

    return df.withColumn(out, enc(F.col(col)))


# ---- D5: index report -----------------------------------------------------

def index_report(index: DataFrame, group: str, source: DataFrame, key: str, vec: str = "embedding",
                 timings: DataFrame | None = None) -> DataFrame:
    """D5 of a written index (A10), per group: vectors, dimension, bytes of the stored
    components and of the keys that lead to them, compression ratio (raw bytes / index bytes),
    reconstruction error (percent, of the stored vectors against ``source``), and
    mean and p99 of ``timings`` (group, ms) when given."""
    raw = F.col("nb_vectors") * F.col("dim") * 4
    own = index.select(group, key, F.col(vec).alias("_v"))
    both = own.join(source.select(group, key, F.col(vec).alias("_s")), [group, key])
    err = F.aggregate(F.zip_with("_v", "_s", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    r = both.groupBy(group).agg(F.count(F.lit(1)).alias("nb_vectors"), F.max(F.size("_v")).cast("bigint").alias("dim"),
                                (F.sum(F.size("_v") * 4) + F.count(F.lit(1)) * 8).cast("bigint").alias("size_bytes"),
                                (100 * F.sum(err) / F.sum(norm)).alias("reconstruction_error"))
    r = r.select(group, F.lit("Flat").alias("index_key"), "nb_vectors", "dim", "size_bytes",
                 (raw.cast("double") / F.col("size_bytes")).alias("compression_ratio"), "reconstruction_error")
    if timings is not None:
        # p99 of continuous timings from a bounded sketch: an exact percentile
        # would keep every value of a hot group in one buffer
        t = timings.groupBy(group).agg(F.avg("ms").alias("avg_search_ms"),
                                       F.percentile_approx("ms", 0.99, 10000).alias("p99_search_ms"))
        r = r.join(t, group, "left")
    return r
