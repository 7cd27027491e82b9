"""Inverted indexes of articles' chunks, and the exact top-k search in them.

``build`` turns each article's chunk array into blocks of ``BLOCK`` chunks, row by row and without a shuffle: the block's
terms, for each its postings (chunk, term frequency) and the largest impact tf / |chunk| of the block, and the
squared norms of its chunks. The table is written once and read by every search.

``search`` deals articles to tiles. Small ones share a tile; a larger one is cut into runs of ``TILE_BLOCKS`` query blocks and
key blocks, one tile for each two of them, so a tile's memory is bounded and no pair of chunks is ever a row. In
a tile, each query is scored over all its postings if these are few. A query with more (common terms of a long
article) is searched by MaxScore:

1. The first postings of its rarest terms give candidates, whose full scores give a floor.
2. Terms whose bounds together don't reach the floor are non-essential; only the other terms' postings are scored.
3. A candidate is dropped if its score, with the bounds of the non-essential terms in its own block, stays below the floor.
4. The others are scored in full.

All steps work on a whole tile's arrays at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.constants import N_NEIGHBORS
from longdoc.operators.chunks import terms_of
from longdoc.operators.retrieve import top_k
from longdoc.sources.io import written

#: Chunks of a block.
BLOCK = 128
#: Blocks of queries and of keys that a tile holds of one article, and about as many of small ones together.
TILE_BLOCKS = 64
#: Postings that a query may have and be scored over all of them.
FEW_POSTINGS = 4096
#: Postings of the rarest terms that a floor is taken from.
SEED_POSTINGS = 64
#: (query, key) parts held at a time.
PARTS = 1 << 21

#: A block's arrays are columns of little-endian bytes: no engine has to look into them on their way to a tile.
ARRAYS = {"terms": "<i8", "ends": "<i4", "nos": "<i4", "tfs": "<i4", "impacts": "<f8", "norms": "<i8"}
COLUMNS = "block int, n int, " + ", ".join(f"{name} binary" for name in ARRAYS)


def runs(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    new = np.ones(len(sorted_arrays[0]), bool)
    if len(new):
        new[1:] = np.any([a[1:] != a[:-1] for a in sorted_arrays], axis=0)
    return np.flatnonzero(new)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


# ---- the index ---------------------------------------------------------------

def _packed(name: str, values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value of bytes per block, which has ``counts`` of the values."""
    values = values.astype(ARRAYS[name])
    offsets = (np.r_[0, np.cumsum(counts)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(table: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all blocks one after the other, number of each block's)."""
    data = table.column(name).to_pylist()
    values = np.frombuffer(b"".join(data), ARRAYS[name])
    return values, np.fromiter(map(len, data), np.int64, len(data)) // values.itemsize


def index_batch(group: pa.Array, chunks: pa.ListArray, drop: int) -> pa.RecordBatch:
    """Blocks of a batch of articles; the last ``drop`` chunks of each are left out."""
    rows = pc.list_parent_indices(chunks).to_numpy(zero_copy_only=False)
    size = np.bincount(rows, minlength=len(chunks))
    no = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    keep = no < size[rows] - drop
    ids = pc.list_flatten(chunks).filter(pa.array(keep))
    rows, no = rows[keep], no[keep]
    chunk, term = terms_of(pc.list_parent_indices(ids).to_numpy(zero_copy_only=False), pc.list_flatten(ids).to_numpy(zero_copy_only=False))
    names, code = np.unique(term, return_inverse=True)
    key = np.sort((chunk.astype(np.int64) << 32) | code)
    at = runs(key)
    tf = np.diff(np.r_[at, len(key)])
    chunk, code = key[at] >> 32, key[at] & 0xFFFFFFFF
    norm = np.bincount(chunk, weights=tf.astype(np.float64) ** 2, minlength=len(rows)).astype(np.int64)
    begin = runs(rows, no // BLOCK)
    n = np.diff(np.r_[begin, len(rows)])
    block = np.repeat(np.arange(len(begin)), n)
    order = np.argsort(block[chunk] * max(1, len(names)) + code, kind="stable")  # block, term, chunk
    chunk, code, tf = chunk[order], code[order], tf[order]
    at = runs(block[chunk], code)
    lists = np.bincount(block[chunk[at]], minlength=len(begin))
    postings = np.bincount(block[chunk], minlength=len(begin))
    impact = np.maximum.reduceat(tf / np.sqrt(norm[chunk]), at) if len(at) else np.zeros(0)
    before = np.cumsum(postings) - postings
    ends = np.r_[at[1:], len(chunk)][:len(at)] - np.repeat(before, lists)
    return pa.RecordBatch.from_arrays(
        [group.take(pa.array(rows[begin])), pa.array(no[begin] // BLOCK, pa.int32()), pa.array(n, pa.int32()),
         _packed("terms", names[code[at]], lists), _packed("ends", ends, lists), _packed("nos", no[chunk], postings),
         _packed("tfs", tf, postings), _packed("impacts", impact, lists), _packed("norms", norm, n)],
        names=["g", *(c.split(" ")[0] for c in COLUMNS.split(", "))])


def build(articles: DataFrame, group: str = "article_id", chunks: str = "text_tokenized", drop: int = 0) -> DataFrame:
    """The index blocks of ``chunks`` (array<array<int>>), without the last ``drop`` chunks of each article. Chunks
    without a term are kept as keys; an article without chunks has no block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield index_batch(batch.column(0), batch.column(1), drop)

    rows = articles.select(F.col(group).alias("g"), F.coalesce(F.col(chunks), F.array()).alias("c"))
    return rows.mapInArrow(run, f"g {dict(rows.dtypes)['g']}, {COLUMNS}")


def postings(index: DataFrame) -> DataFrame:
    """(g, token_id, df, impact): an article's lists over all its blocks, with their bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, lists = _unpacked(batch, "terms")
            block = np.repeat(np.arange(len(lists)), lists)
            ends = _unpacked(batch, "ends")[0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(block)), pa.array(terms), pa.array(_counts(ends, block)),
                                              pa.array(_unpacked(batch, "impacts")[0])], names=["g", "token_id", "df", "impact"])

    each = index.mapInArrow(run, f"g {dict(index.dtypes)['g']}, token_id bigint, df bigint, impact double")
    return each.groupBy("g", "token_id").agg(F.sum("df").alias("df"), F.max("impact").alias("impact"))


def _counts(ends: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Postings of each list, from where lists end in their blocks."""
    begins = np.r_[0, ends[:-1]][:len(ends)]
    begins[runs(block)] = 0
    return ends - begins


# ---- a tile ------------------------------------------------------------------

class Blocks:
    """The blocks of a tile as flat arrays. Chunks are numbered over all blocks, which are in the order of
    (article, block)."""

    def __init__(self, table: pa.Table, groups: dict):
        g = np.array([groups.setdefault(x, len(groups)) for x in table.column("g").to_pylist()], np.int64)
        block = table.column("block").to_numpy()
        order = np.lexsort((block, g))
        table, g, block = table.take(pa.array(order)), g[order], block[order]

        n = table.column("n").to_numpy().astype(np.int64)
        self.norm = _unpacked(table, "norms")[0]
        base = np.cumsum(n) - n
        self.chunk_group = np.repeat(g, n)
        self.chunk_no = np.repeat(block.astype(np.int64) * BLOCK - base, n) + np.arange(int(n.sum()))
        self.chunk_block = np.repeat(np.arange(len(g)), n)
        self.term, lists = _unpacked(table, "terms")
        at = np.repeat(np.arange(len(g)), lists)
        self.impact, self.list_block, self.list_group = _unpacked(table, "impacts")[0], at, g[at]
        self.count = _counts(_unpacked(table, "ends")[0].astype(np.int64), at)
        self.tf = _unpacked(table, "tfs")[0].astype(np.int64)
        self.chunk = _unpacked(table, "nos")[0] - np.repeat(block[at] * BLOCK - base[at], self.count)


class Keys:
    """Postings of a tile's keys by (article, term)."""

    def __init__(self, blocks: Blocks, code: np.ndarray, n_codes: int):
        order = np.lexsort((blocks.list_block, code))
        self.list_code, self.list_block, self.list_impact = code[order], blocks.list_block[order], blocks.impact[order]
        begin = np.cumsum(blocks.count) - blocks.count
        at = spans(begin[order], blocks.count[order])
        self.chunk, self.tf = blocks.chunk[at], blocks.tf[at]
        self.df = np.bincount(code, weights=blocks.count, minlength=n_codes).astype(np.int64)
        self.first = np.cumsum(self.df) - self.df
        self.bound = np.zeros(n_codes)
        np.maximum.at(self.bound, code, blocks.impact)
        self.n_chunks = len(blocks.norm)
        self.posting = np.repeat(np.arange(n_codes), self.df) * self.n_chunks + self.chunk  # in order
        self.n_blocks = int(blocks.list_block.max(initial=-1)) + 1
        self.listed = self.list_code * self.n_blocks + self.list_block  # in order

    def frequency(self, code: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """tf of terms in chunks, 0 where a chunk has no such term."""
        want = code * self.n_chunks + chunk
        at = np.minimum(np.searchsorted(self.posting, want), len(self.posting) - 1)
        return np.where(self.posting[at] == want, self.tf[at], 0)

    def block_bound(self, code: np.ndarray, block: np.ndarray) -> np.ndarray:
        want = code * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.listed, want), len(self.listed) - 1)
        return np.where(self.listed[at] == want, self.list_impact[at], 0.0)


class Tile:
    """A search of ``queries`` in ``keys``; entries are (query, code, tf), in the order of queries."""

    def __init__(self, queries: Blocks, keys: Blocks, k: int, exclude_self: bool):
        self.q, self.blocks, self.k, self.exclude_self = queries, keys, k, exclude_self
        terms = np.concatenate([queries.term, keys.term])
        groups = np.concatenate([queries.list_group, keys.list_group])
        order = np.lexsort((terms, groups))
        at = runs(groups[order], terms[order])
        code = np.empty(len(terms), np.int64)
        code[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(terms)]))
        self.keys = Keys(keys, code[len(queries.term):], len(at))
        own = np.repeat(code[:len(queries.term)], queries.count)
        order = np.lexsort((own, queries.chunk))
        self.query, self.code, self.tf = queries.chunk[order], own[order], queries.tf[order]
        held = self.keys.df[self.code] > 0
        self.query, self.code, self.tf = self.query[held], self.code[held], self.tf[held]
        #: Postings read, for tests.
        self.scored = 0
        # keys of an article are consecutive: the first one and their number
        groups_n = int(max(queries.chunk_group.max(initial=-1), keys.chunk_group.max(initial=-1))) + 1
        self.group_keys = np.bincount(keys.chunk_group, minlength=groups_n)
        self.group_first = np.cumsum(self.group_keys) - self.group_keys

    def parts(self, entries: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, dot) over all postings of the entries (or the first ``count`` of each), one row per pair."""
        code = self.code[entries]
        count = self.keys.df[code] if count is None else count
        at = spans(self.keys.first[code], count)
        self.scored += len(at)
        return self.summed(np.repeat(self.query[entries], count), self.keys.chunk[at], np.repeat(self.tf[entries], count) * self.keys.tf[at])

    def summed(self, query: np.ndarray, key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = query * self.keys.n_chunks + key
        order = np.argsort(pair)
        pair = pair[order]
        at = runs(pair)
        dot = np.add.reduceat(part[order], at) if len(at) else part
        query, key = np.divmod(pair[at], max(1, self.keys.n_chunks))
        if self.exclude_self:
            other = self.q.chunk_no[query] != self.blocks.chunk_no[key]
            query, key, dot = query[other], key[other], dot[other]
        return query, key, dot

    def score(self, key: np.ndarray, dot: np.ndarray) -> np.ndarray:
        norm = self.blocks.norm[key]
        return np.where(dot == 0, 0.0, dot / np.sqrt(np.maximum(norm, 1)))

    def top(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Rows of the k best keys of each query, in order."""
        order = np.lexsort((key, -score, query))
        first = runs(query[order])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        return order[rank < self.k]

    def entries_of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``queries``, entry) of all entries of the queries."""
        a, b = np.searchsorted(self.query, queries), np.searchsorted(self.query, queries, side="right")
        return np.repeat(np.arange(len(queries)), b - a), spans(a, b - a)

    def full(self, query: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Dots of (query, key) pairs."""
        out = np.zeros(len(query), np.int64)
        of_query = np.searchsorted(self.query, query, side="right") - np.searchsorted(self.query, query)
        for a, b in _cuts(of_query):
            pair, entry = self.entries_of(query[a:b])
            found = self.keys.frequency(self.code[entry], key[a:b][pair]) * self.tf[entry]
            out[a:b] = np.bincount(pair, weights=found, minlength=b - a).astype(np.int64)
        return out

    def exhaustive(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, entries = self.entries_of(queries)
        query, key, dot = self.parts(entries)
        # the k lowest keys fill up; of 2k + 1 at most k are better placed and one is the query
        group = self.q.chunk_group[queries]
        low = np.minimum(self.group_keys[group], 2 * self.k + 1)
        query = np.r_[query, np.repeat(queries, low)]
        key = np.r_[key, spans(self.group_first[group], low)]
        query, key, dot = self.summed(query, key, np.r_[dot, np.zeros(int(low.sum()), np.int64)])
        score = self.score(key, dot)
        best = self.top(query, key, score)
        return query[best], key[best], score[best]

    def max_score(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, entry = self.entries_of(queries)
        df = self.keys.df[self.code[entry]]
        order = np.lexsort((df, place))
        begin = runs(place)
        size = np.diff(np.r_[begin, len(place)])

        def cumulated(values: np.ndarray) -> np.ndarray:
            total = np.cumsum(values)
            return total - np.repeat((total - values)[begin], size)

        # 1: a floor from the first postings of the rarest terms
        seeds = np.clip(SEED_POSTINGS - (cumulated(df[order]) - df[order]), 0, df[order])
        query, key, _ = self.parts(entry[order], seeds)
        score = self.score(key, self.full(query, key))
        best = self.top(query, key, score)
        count = np.bincount(np.searchsorted(queries, query[best]), minlength=len(queries))
        last = np.cumsum(count) - 1
        floor = np.where(count == self.k, score[best][np.maximum(last, 0)] if len(best) else 0.0, 0.0)
        # 2: terms whose bounds together stay below it; the margin is more than sums can be off by rounding
        bound = self.tf[entry] * self.keys.bound[self.code[entry]]
        order = np.lexsort((bound, place))
        sums = cumulated(bound[order]) * (1 + 1e-9)
        essential = np.ones(len(entry), bool)
        essential[order] = sums >= floor[place[order]]
        cost = np.bincount(place[essential], weights=df[essential], minlength=len(queries)).astype(np.int64)
        rest_entry, rest_count = entry[~essential], np.bincount(place[~essential], minlength=len(queries))
        rest_first = np.cumsum(rest_count) - rest_count
        found = []
        for a, b in _cuts(cost):
            mine = essential & (place >= a) & (place < b)
            found.append(self._refined(queries, floor, entry[mine], rest_entry, rest_first, rest_count))
        query, key, score = (np.concatenate(x) for x in zip(*found, strict=True))
        held = np.bincount(np.searchsorted(queries, query), minlength=len(queries))
        short = np.flatnonzero(held < np.minimum(self.k, self.group_keys[self.q.chunk_group[queries]] - self.exclude_self))
        if len(short):  # too few keys share a term: zeros fill up
            whole = self.exhaustive(queries[short])
            stay = ~np.isin(query, queries[short])
            return tuple(np.concatenate([x[stay], y]) for x, y in zip((query, key, score), whole, strict=True))
        return query, key, score

    def _refined(self, queries: np.ndarray, floor: np.ndarray, essential: np.ndarray, rest_entry: np.ndarray, rest_first: np.ndarray,
                 rest_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps 3 and 4 for the queries of the ``essential`` entries."""
        query, key, dot = self.parts(essential)
        # 3: what the other terms can add in the candidate's own block
        where = np.searchsorted(queries, query)
        partial = dot / np.sqrt(np.maximum(self.blocks.norm[key], 1))
        alive = np.zeros(len(query), bool)
        for a, b in _cuts(rest_count[where]):
            pair = np.repeat(np.arange(b - a), rest_count[where[a:b]])
            more = rest_entry[spans(rest_first[where[a:b]], rest_count[where[a:b]])]
            add = self.tf[more] * self.keys.block_bound(self.code[more], self.blocks.chunk_block[key[a:b]][pair])
            alive[a:b] = (partial[a:b] + np.bincount(pair, weights=add, minlength=b - a)) * (1 + 1e-9) >= floor[where[a:b]]
        query, key = query[alive], key[alive]
        # 4
        score = self.score(key, self.full(query, key))
        best = self.top(query, key, score)
        return query[best], key[best], score[best]

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of the k best keys of every query."""
        queries = np.flatnonzero(self.group_keys[self.q.chunk_group] > 0)
        cost = np.bincount(self.query, weights=self.keys.df[self.code], minlength=len(self.q.norm)).astype(np.int64)[queries]
        many = cost > FEW_POSTINGS
        found = [self.exhaustive(queries[~many][a:b]) for a, b in _cuts(cost[~many] + 2 * self.k + 1)]
        found += [self.max_score(queries[many][a:b]) for a, b in _cuts(np.full(int(many.sum()), FEW_POSTINGS))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cuts(cost: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive ranges of about ``PARTS`` summed cost, or of one item."""
    if not len(cost):
        return []
    which = (np.cumsum(cost) - cost) // PARTS
    at = runs(which).tolist()
    return list(zip(at, [*at[1:], len(cost)], strict=True))


def _search_tile(k: int, exclude_self: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        groups: dict = {}
        if left.num_rows and right.num_rows:
            queries, keys = Blocks(left, groups), Blocks(right, groups)
            query, found, score = Tile(queries, keys, k, exclude_self).search()
            group, qid, kid = queries.chunk_group[query], queries.chunk_no[query], keys.chunk_no[found]
        else:
            group = qid = kid = np.zeros(0, np.int64)
            score = np.zeros(0)
        names = pa.array(list(groups), left.schema.field("g").type)
        return pa.table({"g": names.take(pa.array(group)), "query_no": pa.array(qid, pa.int32()),
                         "chunk_no": pa.array(kid, pa.int32()), "score": pa.array(score, pa.float64())})

    return run


def search(queries: DataFrame, index: DataFrame, group: str = "article_id", k: int = N_NEIGHBORS, exclude_self: bool = False) -> DataFrame:
    """(group, query_no, chunk_no, score, rank): the k chunks of the same article with the largest dot(q, k) / |k| for every
    query chunk, as an exact index returns them: min(k, keys) each, keys without a common term last, ties by number.

    ``queries`` and ``index``: tables of ``build``, read more than once and so best written. ``exclude_self``: a query's own
    number is no key."""
    spark = index.sparkSession
    kind = dict(index.dtypes)["g"]
    itself = queries is index
    queries, index = queries.where("g is not null"), index.where("g is not null")
    nk = index.groupBy("g").agg(F.count(F.lit(1)).alias("k_blocks"))
    if itself:
        sizes = nk.withColumn("q_blocks", F.col("k_blocks"))
    else:
        sizes = queries.groupBy("g").agg(F.count(F.lit(1)).alias("q_blocks")).join(nk, "g")
    runs_of = lambda c: F.ceil(F.col(c) / TILE_BLOCKS).cast("int")
    sizes = sizes.select(F.col("g").alias("of"), runs_of("q_blocks").alias("q_runs"), runs_of("k_blocks").alias("k_runs"),
                         F.greatest("q_blocks", "k_blocks").alias("blocks"))
    small = (F.col("q_runs") == 1) & (F.col("k_runs") == 1)
    seen = sizes.agg(F.sum(F.when(small, F.col("blocks"))).alias("b"), F.count_if(~small).alias("large")).first()
    total = seen["b"] or 0
    shared = max(1, -(-total // TILE_BLOCKS), min(total, 2 * spark.sparkContext.defaultParallelism))
    # an article's tile follows from its id: blocks are dealt as they are. Only the larger articles, one at most for TILE_BLOCKS blocks of
    # a side, have to be known
    tile = F.pmod(F.xxhash64("g"), F.lit(shared))
    search_tile = _search_tile(k, exclude_self)
    schema = f"g {kind}, query_no int, chunk_no int, score double"
    large = F.broadcast(written(sizes.where(~small).drop("blocks"), "large_articles")) if seen["large"] else None

    def small_ones(blocks: DataFrame) -> DataFrame:
        own = blocks if large is None else blocks.join(large, F.col("g") == F.col("of"), "left_anti")
        return own.select(tile.alias("tile"), *blocks.columns)

    if itself:
        found = small_ones(index).groupBy("tile").applyInArrow(lambda key, table: search_tile(key, table, table), schema)
    else:
        right = small_ones(index).withColumnRenamed("tile", "tile_")
        found = small_ones(queries).groupBy("tile").cogroup(right.groupBy("tile_")).applyInArrow(search_tile, schema)
    if large is not None:
        def dealt(blocks: DataFrame, other: str, own_run: str, other_run: str) -> DataFrame:
            j = blocks.join(large, F.col("g") == F.col("of"))
            return j.select(F.xxhash64("g").alias("tile"), F.floor(F.col("block") / TILE_BLOCKS).cast("int").alias(own_run),
                            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_run), *blocks.columns)

        q = dealt(queries, "k_runs", "q_run", "k_run").select("tile", "q_run", "k_run", *queries.columns)
        i = dealt(index, "q_runs", "k_run", "q_run").select(F.col("tile").alias("tile_"), F.col("q_run").alias("q_run_"),
                                                            F.col("k_run").alias("k_run_"), *[F.col(c).alias(c) for c in index.columns])
        found = found.unionByName(q.groupBy("tile", "q_run", "k_run").cogroup(i.groupBy("tile_", "q_run_", "k_run_"))
                                  .applyInArrow(search_tile, schema))
    return top_k(found, ["g", "query_no"], "chunk_no", k).withColumnRenamed("g", group)
