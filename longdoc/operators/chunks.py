"""Chunk tables.

Chunking is row-local: a document's id array is padded and sliced with
higher-order functions and exploded, so a long (or hot) document never makes a
shuffle partition of its own; the continuation of chunk i (chunk i+1, W2) is
taken from the same array before exploding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.constants import CHUNK_SIZE, FIRST_BYTE_ID, FIRST_PIECE_ID, N_NEIGHBORS, PAD
from longdoc.functions.arrays import chunk_array, full_chunks, mask_after_eos

#: Terms of spelled words lie above this, those of the vocabulary below.
SPELLED = 1 << 60


def chunk_documents(df: DataFrame, key: str = "article_id", ids: str = "token_ids",
                    c: int = CHUNK_SIZE, with_pairs: bool = False,
                    keep: list[str] | None = None) -> DataFrame:
    """C4+C5 (+W2): one row per chunk: key, chunk_no, n_chunks, token_ids[, pair_ids].

    ``pair_ids`` is chunk i followed by chunk i+1, taken from the same array before
    it is exploded; NULL for the last chunk. Chunk tables that are stored do without it.
    """
    keep = keep or []
    ch = chunk_array(ids, c, PAD)
    base = df.select(key, *keep, ch.alias("_ch"))
    if with_pairs:
        pairs = F.transform("_ch", lambda x, i: F.when(i + 1 < F.size("_ch"),
                                                      F.concat(x, F.element_at("_ch", i + 2))))
        z = F.arrays_zip(F.col("_ch").alias("token_ids"), pairs.alias("pair_ids"))
        out = base.select(key, *keep, F.size("_ch").alias("n_chunks"),
                          F.posexplode(z).alias("chunk_no", "_z"))
        return out.select(key, *keep, "chunk_no", "n_chunks",
                          F.col("_z.token_ids").alias("token_ids"),
                          F.col("_z.pair_ids").alias("pair_ids"))
    return base.select(key, *keep, F.size("_ch").alias("n_chunks"),
                       F.posexplode("_ch").alias("chunk_no", "token_ids"))


def full_chunk_rows(df: DataFrame, key: str, ids: str, c: int = CHUNK_SIZE) -> DataFrame:
    """Query chunks at inference are the floor(n/c) full chunks."""
    return df.select(key, F.posexplode(full_chunks(ids, c)).alias("query_no", "token_ids"))


def filter_min_chunks(df: DataFrame, k: int = N_NEIGHBORS, n_col: str = "n_chunks") -> DataFrame:
    """Documents with fewer than k+1 chunks are dropped."""
    return df.where(F.col(n_col) >= k + 1)


def drop_last_chunk(chunks: DataFrame, n_col: str = "n_chunks") -> DataFrame:
    """Every chunk except the last one of its document (keys and queries)."""
    return chunks.where(F.col("chunk_no") < F.col(n_col) - 1)


def chunk_pairs(chunks: DataFrame, key: str = "article_id") -> DataFrame:
    """W2 over an exploded chunk table from elsewhere: chunk i joined to i+1.

    An equi-join on (key, chunk_no) rather than a window over the document, so
    one very long document spreads over many join keys.
    """
    nxt = chunks.select(key, (F.col("chunk_no") - 1).alias("chunk_no"),
                        F.col("token_ids").alias("_next"))
    return (chunks.join(nxt, [key, "chunk_no"], "left")
            .withColumn("pair_ids", F.when(F.col("_next").isNotNull(),
                                           F.concat("token_ids", "_next")))
            .drop("_next"))


def sequence_windows(docs: DataFrame, key: str = "article_id", n_chunks: str = "n_chunks",
                     seq_len: int = 2048, c: int = CHUNK_SIZE) -> DataFrame:
    """C11: non-overlapping sequences of seq_len tokens = seq_len/c chunks. The
    bounds follow from a document's number of chunks, row by row."""
    per = seq_len // c
    seqs = F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n_chunks) / per).cast("int") - 1, F.lit(0)))
    out = docs.where(F.col(n_chunks) > 0).select(key, F.col(n_chunks).alias("_n"), F.explode(seqs).alias("seq_no"))
    last = F.least((F.col("seq_no") + 1) * per, F.col("_n")) - 1
    return out.select(key, "seq_no", (F.col("seq_no") * per).alias("first_chunk"), last.alias("last_chunk"),
                      (last - F.col("seq_no") * per + 1).alias("n_chunks"))


def terms_of(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, terms) of id rows: a piece is its id, a spelled word one term, 2^60 and 60 bits of
    the md5 of its bytes (also what a chunk border has left of it). WORD and special ids
    are no terms."""
    import hashlib
    piece = ids >= FIRST_PIECE_ID
    byte = (ids >= FIRST_BYTE_ID) & ~piece
    at = np.flatnonzero(byte)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]])
    start = np.flatnonzero(new)
    raw = (ids[at] - FIRST_BYTE_ID).astype(np.uint8).tobytes()
    words = [raw[a:b] for a, b in zip(start.tolist(), [*start[1:].tolist(), len(at)], strict=True)] if len(at) else []
    code = {w: SPELLED + int(hashlib.md5(w.hex().upper().encode()).hexdigest()[:15], 16) for w in set(words)}
    spelled = np.array([code[w] for w in words], np.int64)
    return np.concatenate([rows[piece], rows[at[start]]]), np.concatenate([ids[piece].astype(np.int64), spelled])


def tf_batch(rows: np.ndarray, terms: np.ndarray, n: int):
    """Per-row term frequencies, vectorised: one sort of (row, term) keys for the whole
    Arrow batch."""
    names, code = np.unique(terms, return_inverse=True)
    key = (rows.astype(np.int64) << 32) | code
    key.sort()  # numpy sorts many times as fast as it finds unique values
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    uniq, counts = key[first], np.diff(np.r_[first, len(key)])
    urow = uniq >> 32
    utok = names[uniq & 0xFFFFFFFF] if len(names) else np.empty(0, np.int64)
    new_offs = np.searchsorted(urow, np.arange(n + 1)).astype(np.int32)
    norm2 = np.bincount(urow, weights=counts.astype(np.float64) ** 2, minlength=n).astype(np.int64)
    return new_offs, utok, counts.astype(np.int32), norm2


_TF_TYPE = T.StructType([T.StructField("token_id", T.ArrayType(T.LongType())),
                         T.StructField("tf", T.ArrayType(T.IntegerType())),
                         T.StructField("norm2", T.LongType())])


@F.arrow_udf(_TF_TYPE)
def _tf_udf(ids: pa.Array) -> pa.Array:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    rows = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
    new_offs, utok, cnt, norm2 = tf_batch(*terms_of(rows, flat), len(ids))
    o = pa.array(new_offs)
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(o, pa.array(utok)), pa.ListArray.from_arrays(o, pa.array(cnt)),
         pa.array(norm2)], fields=list(_TF_TYPE_ARROW))


_TF_TYPE_ARROW = pa.struct([("token_id", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())),
                            ("norm2", pa.int64())])


def chunk_tf(chunks: DataFrame, keys: list[str], ids: str = "token_ids") -> DataFrame:
    """Term frequencies of each chunk (``terms_of``) and the chunk's squared L2 norm, one
    row per (chunk, term). Row-local: the counts come from one vectorised sort per Arrow
    batch, then an explode."""
    base = chunks.select(*keys, _tf_udf.asNondeterministic()(F.col(ids)).alias("_tf"))
    z = F.arrays_zip(F.col("_tf.token_id").alias("token_id"), F.col("_tf.tf").alias("tf"))
    return (base.select(*keys, F.col("_tf.norm2").alias("norm2"), F.explode(z).alias("_e"))
            .select(*keys, "norm2", F.col("_e.token_id").alias("token_id"),
                    F.col("_e.tf").cast("bigint").alias("tf")))


def idf_weights(tf: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Optional weight of D1b: adds ``idf`` = ln(1 + N / n) to term-frequency rows, n being the
    chunks that hold the token and N all chunks."""
    seen = tf.groupBy("token_id").agg(F.count(F.lit(1)).alias("_n"))
    return (tf.join(seen, "token_id").withColumn("idf", F.log(1 + F.lit(float(n_rows)) / F.col("_n")))
            .select(*keys, "norm2", "token_id", "tf", "idf"))


def mask_after_eos_rows(df: DataFrame, key: str, ids: str, c: int = CHUNK_SIZE, eos: int = 1, pad: int = 0) -> DataFrame:
    """C10 as a window, (key, chunk_no, masked ids). A row is a chunk of c ids, never a single id: a running count of EOS over a
    document's preceding chunks tells which chunks are all pad; in the chunk that has the first EOS, array functions mask what follows.
    The ids are shuffled once, as arrays, by the key. Rows of one key are taken as one document: ids of equal place stand together."""
    x = df.select(key, F.col(ids).alias("_ids"))
    n = F.ceil(F.size("_ids") / c).cast("int")
    parts = F.transform(F.array_repeat(F.lit(0), n), lambda _, i: F.slice("_ids", i * c + 1, c))
    x = x.select(key, F.posexplode(parts).alias("chunk_no", "_part"))
    w = Window.partitionBy(key).orderBy("chunk_no").rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_seen", F.coalesce(F.max(F.array_contains("_part", eos)).over(w), F.lit(False)))
    g = x.groupBy(key, "chunk_no").agg(F.max("_seen").alias("_seen"), F.collect_list("_part").alias("_parts"))
    whole = F.get("_parts", 0)
    placed = F.array_sort(F.flatten(F.transform("_parts", lambda p: F.transform(p, lambda v, i: F.struct(i.alias("pos"), v.alias("id"))))))
    cut = F.zip_with(placed, mask_after_eos(F.transform(placed, lambda s: s["id"]), eos, pad), lambda s, v: F.struct(s["pos"].alias("pos"), v.alias("id")))
    together = F.transform(F.array_sort(cut), lambda s: s["id"])
    masked = (F.when(F.col("_seen"), F.transform(F.flatten("_parts"), lambda v: F.lit(pad)))
              .when(F.size("_parts") == 1, mask_after_eos(whole, eos, pad)).otherwise(together))
    return g.select(key, "chunk_no", masked.alias(ids))
