"""Operator 11, ranked lexical search by Block-Max MaxScore.

``build_index`` cuts the documents, as they are read, into segments of about ``SEGMENT_BYTES`` of text and inverts
each: one row per (segment, term) with the postings in compressed blocks of ``BLOCK`` documents. No text is
shuffled. A block keeps its last document and its skyline: the (tf, length) pairs that no other pair of
the block beats in both. Whatever the statistics of the corpus are, one of them has the block's largest impact, so
block maxima are exact without decompressing anything and the index does not depend on the statistics.

``search`` takes statistics over all segments, joins the lists of the query terms with the queries that hold
them and searches every (segment, group of queries) on its own (``search_segment``):

1. Lists are ordered by their global bound in the segment. Those whose bounds together do not beat the tenth best score
   so far are non-essential: a document in these alone is no result.
2. The essential lists of a window of documents are decompressed and summed up.
3. A candidate goes through the non-essential lists from the largest bound down. It is rejected if its score and the
   bounds of the lists left don't beat the tenth best, and before a block is decompressed also if the
   block's maximum in place of the list's bound doesn't.
4. Each segment's heap of at most k documents per query is merged by rank.

A score is the sum over the query's terms, repeats included, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``.

Defined cases: null and empty texts (documents or queries) have no terms, a query without a term or match has no
rows; a very long text is read in slices; equal scores rank by doc_id; rows with equal ids are documents of their
own, and so are queries with equal ids; a document without an id counts in the statistics and can't be a result; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longdoc.llm.common import as_bytes, byte_slices, materialize, run_starts

#: Postings of a block.
BLOCK = 128
#: Bytes of text that one segment inverts (a longer document is a segment of its own).
SEGMENT_BYTES = 16 << 20
#: Queries that are searched together.
GROUP_QUERIES = 1024
#: Documents of the first window; each later one is four times as long.
FIRST_WINDOW = 512
UNIT = 1_000_000_000

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))

#: A row without a term holds a segment's documents: their ids and lengths.
INDEX = ("segment long, term string, df long, data binary, ends array<int>, lasts array<int>, sky_counts array<int>, "
         "sky_tf array<int>, sky_n array<long>, doc_ids array<long>, lengths array<long>")


# ---- postings --------------------------------------------------------------

def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes per value): seven bits a byte, the lowest first; the top bit says that more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for shift in (7, 14, 21, 28, 35, 42, 49, 56):
        size += v >= np.uint64(1 << shift)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        part = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = part | ((size[has] > k + 1).astype(np.uint64) << np.uint64(7))
    return out, size


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def invert(keys: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n_terms: int) -> dict[str, np.ndarray]:
    """Postings of a segment, given (term << 32 | document) in order with their frequencies: compressed blocks, where
    they end, their last documents and their skylines, each with the list's bounds in it."""
    term, doc = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    df = np.bincount(term, minlength=n_terms)
    first = np.cumsum(df) - df
    rank = np.arange(len(keys)) - first[term]
    starts = np.flatnonzero(rank % BLOCK == 0)  # of blocks
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    gap = doc - np.where(rank == 0, -1, np.concatenate([[0], doc[:-1]])) - 1
    data, size = varint(np.stack([gap, tf], 1).ravel())
    ends = np.cumsum(np.add.reduceat(size.reshape(-1, 2).sum(1), starts)) if len(starts) else np.zeros(0, np.int64)
    lasts = doc[np.append(starts[1:], len(keys)) - 1] if len(starts) else np.zeros(0, np.int64)
    # skyline: from the largest tf down, the documents that are shorter than all before
    n = lengths[doc]
    order = np.lexsort((n, -tf, block))
    b, m = block[order], n[order]
    level = m - b * (int(lengths.max(initial=0)) + 1)  # every block lies below the one before
    low = np.minimum.accumulate(level)
    keep = np.ones(len(order), bool)
    keep[1:] = (level[1:] < low[:-1]) | (b[1:] != b[:-1])
    sky = order[keep]
    per_block = np.bincount(b[keep], minlength=len(starts))
    blocks = -(-df // BLOCK)
    last_block = np.cumsum(blocks)
    byte_end = ends[last_block - 1] if len(ends) else ends
    byte_start = np.concatenate([[0], byte_end[:-1]]) if len(ends) else ends
    sky_end = np.cumsum(per_block)
    return {"df": df, "data": data, "byte_end": byte_end, "ends": ends - np.repeat(byte_start, blocks), "lasts": lasts,
            "last_block": last_block, "sky_counts": per_block, "sky_tf": tf[sky], "sky_n": n[sky],
            "sky_last": sky_end[last_block - 1] if len(sky_end) else sky_end}


class Segment:
    """Documents on their way into the index."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        number = len(self.ids)
        self.ids.append(doc_id)
        self.bytes += len(data) + 8
        terms = self.terms
        for part in byte_slices(data.translate(_FOLD)):
            found = np.array([terms.setdefault(w, len(terms)) for w in part.split()], np.uint64)
            if len(found):
                found.sort()
                at = run_starts(found)
                self.keys.append((found[at] << np.uint64(32)) | np.uint64(number))
                self.counts.append(np.diff(np.append(at, len(found))))

    def rows(self, name: int) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        # documents are numbered by their ids, so that of equal scores the smaller id comes first
        named = np.array([x is not None for x in self.ids])
        order = np.lexsort((np.array([x or 0 for x in self.ids], np.int64), ~named))
        new = np.empty(len(order), np.uint64)
        new[order] = np.arange(len(order), dtype=np.uint64)
        keys = (keys & ~np.uint64(0xFFFFFFFF)) | new[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        order2 = np.argsort(keys, kind="stable")
        keys, counts = keys[order2], counts[order2]
        at = run_starts(keys)
        keys, tf = keys[at], np.add.reduceat(counts, at)
        lengths = np.bincount((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), weights=tf, minlength=len(order)).astype(np.int64)
        p = invert(keys, tf, lengths, len(self.terms))
        n = len(self.terms)

        def lists(values, last, kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]), pa.int32()), pa.array(values, kind))

        byte_offsets = np.concatenate([[0], p["byte_end"]]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(byte_offsets.tobytes()), pa.py_buffer(p["data"].tobytes())])
        no_longs = pa.array([None] * n, pa.list_(pa.int64()))
        names = [f.split(" ")[0] for f in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, name)), pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string()), pa.array(p["df"], pa.int64()), data,
             lists(p["ends"], p["last_block"], pa.int32()), lists(p["lasts"], p["last_block"], pa.int32()),
             lists(p["sky_counts"], p["last_block"], pa.int32()), lists(p["sky_tf"], p["sky_last"], pa.int32()),
             lists(p["sky_n"], p["sky_last"], pa.int64()), no_longs, no_longs], names=names)
        ids = [self.ids[i] for i in order]
        none = [pa.array([None], t) for t in (pa.string(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *none, pa.array([ids], pa.list_(pa.int64())),
                                          pa.array([lengths.tolist()], pa.list_(pa.int64()))], names=names)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents, written to the shared folder."""
    size = SEGMENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, segment = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            for d, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment.add(d, as_bytes(value.as_py()))
                if segment.bytes >= size:
                    yield from segment.rows(name)
                    name, segment = name + 1, Segment()
        yield from segment.rows(name)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "lexical-index")


# ---- queries ---------------------------------------------------------------

def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query, item_id, term, repeats): ``query`` numbers the rows, so that equal ids stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                count: dict[bytes, int] = {}
                for part in byte_slices(as_bytes(value.as_py()).translate(_FOLD)):
                    for w in part.split():
                        count[w] = count.get(w, 0) + 1
                if count:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q] * len(count), pa.int64()), pa.array([item] * len(count), pa.int64()),
                         pa.array([w.decode("utf-8", "replace") for w in count], pa.string()), pa.array(list(count.values()), pa.int64())],
                        names=["query", "item_id", "term", "repeats"])

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, "query long, item_id long, term string, repeats long"), "lexical-queries")


class Lists:
    """One list of a segment: bounds from the skylines, blocks decompressed when first needed."""

    def __init__(self, row: dict, m: np.ndarray, weight: int, m_of):
        self.data, self.ends, self.lasts = row["data"], row["ends"], np.array(row["lasts"], np.int64)
        self.weight, self.m = weight, m
        tf, n = np.array(row["sky_tf"], np.int64), np.array(row["sky_n"], np.int64)
        counts = np.array(row["sky_counts"], np.int64)
        self.block_max = weight * np.maximum.reduceat(impact(tf, m_of(n)), np.cumsum(counts) - counts)
        self.bound = int(self.block_max.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        got = self.open.get(b)
        if got is None:
            pairs = unvarint(self.data[self.ends[b - 1] if b else 0:self.ends[b]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0] + 1) + (int(self.lasts[b - 1]) if b else -1)
            got = self.open[b] = docs, self.weight * impact(pairs[:, 1], self.m[docs])
        return got

    def window(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) from ``lo`` to below ``hi``."""
        a, b = np.searchsorted(self.lasts, [lo, hi])
        parts = [self.block(i) for i in range(a, min(b + 1, len(self.lasts)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if len(parts) > 1 else parts[0]
        x, y = np.searchsorted(docs, [lo, hi])
        return docs[x:y], values[x:y]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (1000 * tf + 8 * m)


def search_segment(lists: list[tuple[Lists, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a query's ``k`` best documents of a segment, given its lists with their repeats. Of equal
    scores the smaller document comes first."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    bounds = [x.bound * r for x, r in lists]
    sums = np.concatenate([[0], np.cumsum(bounds)])  # sums[i]: bounds of the lists before i
    best_docs, best, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lo, width = 0, FIRST_WINDOW
    while lo < n_docs:
        # documents come in order, so a later one must beat the floor: an equal score ranks behind
        essential = int(np.searchsorted(sums, floor, side="right")) - 1
        if essential == len(lists):
            break
        hi = min(lo + width, n_docs)
        score = np.zeros(hi - lo, np.int64)
        touched = np.zeros(hi - lo, bool)
        for x, r in lists[essential:]:
            docs, values = x.window(lo, hi)
            score[docs - lo] += values * r
            touched[docs - lo] = True
        docs = np.flatnonzero(touched)
        score, docs = score[docs], docs + lo
        for i in range(essential - 1, -1, -1):
            x, r = lists[i]
            alive = score + sums[i + 1] > floor
            score, docs = score[alive], docs[alive]
            if not len(docs):
                break
            at = np.searchsorted(x.lasts, docs)
            held = at < len(x.lasts)
            most = np.where(held, x.block_max[np.minimum(at, len(x.lasts) - 1)] * r, 0)
            alive = score + most + sums[i] > floor
            score, docs, at, held = score[alive], docs[alive], at[alive], held[alive]
            for b in np.unique(at[held]).tolist():  # only now a block is decompressed
                inside = np.flatnonzero(at == b)
                in_block, values = x.block(b)
                place = np.searchsorted(in_block, docs[inside])
                hit = in_block[place] == docs[inside]
                score[inside[hit]] += values[place[hit]] * r
        alive = score > floor
        if alive.any():
            best_docs, best = np.concatenate([best_docs, docs[alive]]), np.concatenate([best, score[alive]])
            order = np.lexsort((best_docs, -best))[:k]
            best_docs, best = best_docs[order], best[order]
            if len(best) == k:
                floor = int(best[-1])
        lo, width = hi, width * 4
    return best_docs, best


def _searcher(k: int, n_docs: int, n_terms: int):
    def m_of(n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_query, out_doc, out_score = [], [], []
        if right.num_rows:
            ids, lengths = right.column("doc_ids")[0].as_py(), right.column("lengths")[0].as_py()
            named = sum(x is not None for x in ids)  # those without an id come last
            m = m_of(np.array(lengths, np.int64))
            queries: dict[int, list[tuple[Lists, int]]] = {}
            for row in left.to_pylist():
                x = Lists(row, m, row["weight"], m_of)
                for q in row["queries"]:
                    queries.setdefault(q["query"], []).append((x, q["repeats"]))
            for q, lists in sorted(queries.items()):
                docs, scores = search_segment(lists, named, k)
                out_query += [q] * len(docs)
                out_doc += [ids[d] for d in docs.tolist()]
                out_score += scores.tolist()
        return pa.table({"query": pa.array(out_query, pa.int64()), "doc_id": pa.array(out_doc, pa.int64()),
                         "score": pa.array(out_score, pa.int64())})

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query."""
    terms = query_terms(queries, item_id, text)
    stats = (index.where("term is null").select(F.explode("lengths").alias("n"))
             .agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first())
    n_docs, n_terms = stats["docs"], stats["terms"]
    asked = (terms.groupBy(F.floor(F.col("query") / GROUP_QUERIES).alias("set"), "term")
             .agg(F.collect_list(F.struct("query", "repeats")).alias("queries")))
    lists = materialize(index.where("term is not null").join(asked, "term")
                        .select("segment", "set", "term", "df", "data", "ends", "lasts", "sky_counts", "sky_tf", "sky_n", "queries"), "lexical-lists")
    frequency = lists.groupBy("set", "term").agg(F.sum("df").alias("total"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("total") + 1).cast("double"))).cast("long")
    lists = lists.join(frequency.select("set", "term", weight.alias("weight")), ["set", "term"]).drop("df", "term")
    held = index.where("term is null").select("segment", "doc_ids", "lengths")
    wanted = lists.select(F.col("segment").alias("of"), F.col("set").alias("by")).distinct()
    held = held.join(wanted, F.col("segment") == F.col("of")).select("of", "by", "doc_ids", "lengths")
    found = (lists.groupBy("segment", "set").cogroup(held.groupBy("of", "by"))
             .applyInArrow(_searcher(k, n_docs, n_terms), "query long, doc_id long, score long"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(terms.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _sql_terms(table: str, key: str) -> str:
    return (f"SELECT r, {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            f"{_TERM})) AS t FROM (SELECT *, row_number() OVER () AS r FROM {table})")


SQL = f"""
WITH d AS ({_sql_terms("documents", "doc_id")}),
tf AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM d GROUP BY r, t),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
all_ AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM len),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT r AS q, any_value(item_id) AS item_id, t, count(*) AS c FROM ({_sql_terms("benchmark", "item_id")}) GROUP BY r, t),
w AS (SELECT q.*, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (t), all_),
s AS (SELECT w.q, w.item_id, tf.r, tf.doc_id,
        sum(w.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * len.n * nn) // l))))::BIGINT AS score
      FROM w JOIN tf USING (t) JOIN len ON len.r = tf.r, all_ WHERE tf.doc_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""
