"""D4, incremental form: generation that searches again after every full chunk of output.

One sequence per article. A round asks the caller's generator for the ids up to the next multiple of the chunk size,
masks what follows an EOS (C10), takes finished sequences out, searches the article's chunks with each other sequence's
last full chunk (C9) and appends the neighbours' pairs to what the next round's generator is given.

A sequence needs its own article's chunks only. The search by term frequencies therefore runs where they are: starts and articles are
joined once, and each task takes its sequences through all rounds, ``TASK_ROWS`` at a time, with the index blocks and tiles of
``sparse_index``. With an encoder, whose vectors are columns, every round is a search of its own and is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.constants import CHUNK_SIZE, EOS, MAX_LEN, N_NEIGHBORS, PAD
from longdoc.functions.arrays import full_chunks, last_full_chunk, mask_after_eos
from longdoc.operators import sparse_index
from longdoc.operators.retrieve import collect_retrieved, knn_within
from longdoc.sources.io import written

RETRIEVED = "array<array<array<int>>>"


#: Sequences that a task takes through their rounds at a time, and chunks of their articles (or one article).
TASK_ROWS = 256
TASK_CHUNKS = sparse_index.TILE_BLOCKS * sparse_index.BLOCK


class VectorSearch:
    """The k nearest chunks (but the last) of the same article by an encoder's vectors, for query chunks that come round by round. The
    articles' side is built and written once."""

    def __init__(self, articles: DataFrame, group: str, chunks: str, k: int, encoder):
        self.group, self.k, self.encoder = group, k, encoder
        own = articles.select(group, F.posexplode(F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))).alias("chunk_no", "_c"))
        self.keys = written(own.select(group, "chunk_no", encoder.encode("_c").alias("embedding")), "generation")

    def find(self, asked: DataFrame, chunks: str) -> DataFrame:
        """(group, query_no, rank, chunk_no) for the chunk arrays of ``asked``."""
        queries = asked.select(self.group, F.posexplode(chunks).alias("query_no", "_c"))
        queries = queries.select(self.group, "query_no", self.encoder.encode("_c").alias("embedding"))
        found = knn_within(queries, self.keys, self.group, "query_no", "chunk_no", k=self.k)
        return found.withColumn("query_no", F.col("query_no").cast("int")).withColumn("chunk_no", F.col("chunk_no").cast("int"))


class OwnChunks:
    """The chunks of some articles, one row each (null: none), and the search among an article's own but the last."""

    def __init__(self, chunks: pa.ListArray, k: int):
        self.k = k
        lists = pc.list_flatten(chunks)
        size = np.bincount(pc.list_parent_indices(chunks).to_numpy(zero_copy_only=False), minlength=len(chunks))
        self.first = np.cumsum(size) - size
        self.ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
        self.ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        self.keys = pa.Table.from_batches([sparse_index.index_batch(pa.array(np.arange(len(chunks))), chunks, 1)])
        self.of = self.keys.column("g").to_numpy()

    def find(self, asked: dict[int, list[list[int]]]) -> Iterator[tuple[int, list[list[int]]]]:
        """(row, [k][2c]: its neighbours with the chunks that follow them) for each query chunk of a row, in order."""
        rows = np.array(list(asked), np.int64)
        keys = self.keys.filter(pa.array(np.isin(self.of, rows)))
        chunks = pa.array(list(asked.values()), pa.list_(pa.list_(pa.int32())))
        queries = pa.Table.from_batches([sparse_index.index_batch(pa.array(rows), chunks, 0)])
        if not queries.num_rows or not keys.num_rows:
            return
        groups: dict = {}
        own, found = sparse_index.Blocks(queries, groups), []
        for at in range(0, keys.num_rows, sparse_index.TILE_BLOCKS):
            blocks = sparse_index.Blocks(keys.slice(at, sparse_index.TILE_BLOCKS), groups)
            query, key, score = sparse_index.Tile(own, blocks, self.k, False).search()
            found.append((query, blocks.chunk_no[key], score))
        query, no, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((no, -score, query))
        query, no = query[order], no[order]
        begin = sparse_index.runs(query).tolist()
        names = np.array(list(groups))
        for a, b in zip(begin, [*begin[1:], len(query)], strict=True):
            row = int(names[own.chunk_group[query[a]]])
            at = self.first[row] + no[a:b][:self.k]
            yield row, [self.ids[i:j].tolist() for i, j in zip(self.ends[at], self.ends[at + 2], strict=True)]


def _masked(ids: list[int], eos: int) -> list[int]:
    """``mask_after_eos`` of a list."""
    at = ids.index(eos) + 1 if eos in ids else len(ids)
    return ids[:at] + [PAD] * (len(ids) - at)


def _parts(chunks: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Consecutive rows, at most ``TASK_ROWS`` with at most ``TASK_CHUNKS``, or one."""
    size = pc.fill_null(pc.list_value_length(chunks), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(size):
        if i > begin and (i - begin == TASK_ROWS or held + n > TASK_CHUNKS):
            yield begin, i
            begin, held = i, 0
        held += n
    if size:
        yield begin, len(size)


def _rounds(factory: Callable, group: str, k: int, c: int, max_len: int, batch: int, eos: int):
    """All rounds of the sequences (group, start ids, own chunks) of a task."""
    def part(generator: Callable, b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.column(0).to_pylist()
        ids = [_masked(x, eos) for x in b.column(1).to_pylist()]
        search, retrieved = OwnChunks(b.column(2), k), [[] for _ in ids]

        def look_up(asked: dict[int, list[list[int]]]) -> None:
            for row, pairs in search.find(asked):
                retrieved[row].append(pairs)

        look_up({i: [x[j:j + c] for j in range(0, len(x) - c + 1, c)] for i, x in enumerate(ids) if len(x) >= c})
        live = [i for i, x in enumerate(ids) if len(x) < max_len and eos not in x]
        for _ in range(max_len // c + 2):
            if not live:
                break
            want = [min(c - len(ids[i]) % c, max_len - len(ids[i])) for i in live]
            rows = [{group: names[i], "ids": list(ids[i]), "retrieved": list(retrieved[i])} for i in live]
            new = [x for at in range(0, len(live), batch) for x in generator(rows[at:at + batch], want[at:at + batch])]
            going = []
            for i, x, n in zip(live, new, want, strict=True):
                x = list(x)[:n]
                ids[i] = _masked(ids[i] + x, eos)
                if x and eos not in x and len(ids[i]) < max_len:
                    going.append(i)
            look_up({i: [ids[i][-c:]] for i in going if len(ids[i]) % c == 0})
            live = going
        else:
            raise RuntimeError("sequences did not end")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())),
                                           pa.array(retrieved, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=[group, "ids", "retrieved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = factory()
        for b in batches:
            for begin, end in _parts(b.column(2)):
                yield part(generator, b.take(pa.array(np.arange(begin, end))))

    return run


def _step(factory: Callable, group: str, c: int, max_len: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = factory()
        for b in batches:
            rows, new = b.select([group, "ids", "retrieved"]).to_pylist(), []
            want = [min(c - len(r["ids"]) % c, max_len - len(r["ids"])) for r in rows]
            for i in range(0, len(rows), batch):
                made = generator(rows[i:i + batch], want[i:i + batch])
                new += [list(ids)[:n] for ids, n in zip(made, want[i:i + batch], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.list_(pa.int32()))], names=[*b.schema.names, "new"])

    return run


def generate_incremental(starts: DataFrame, articles: DataFrame, factory: Callable, k: int = N_NEIGHBORS, c: int = CHUNK_SIZE,
                         max_len: int = MAX_LEN, encoder=None, group: str = "article_id", start: str = "prompt_ids",
                         chunks: str = "text_tokenized", batch: int = 8, eos: int = EOS) -> DataFrame:
    """(group, ids, retrieved): the finished sequences with every neighbour that was retrieved for them, [chunk][k][2c].

    ``starts``: (group, start ids), one row per article; ``articles``: (group, chunk arrays). ``factory()`` makes, once per
    task, a callable (rows, want) -> lists of ids: each row has the group, its ``ids`` so far and ``retrieved``, and
    gets up to ``want`` more. A sequence ends with an EOS, at ``max_len`` ids, or when the generator gives none.
    Neighbours are searched by term frequencies, or with ``encoder`` by vectors. An article without a key chunk or without a row
    in ``articles`` has no neighbours; null start ids are empty ones. By term frequencies, of repeated ids each start goes on once with
    each row of its article."""
    ids = F.coalesce(F.col(start), F.array().cast("array<int>"))
    if encoder is None:
        own = articles.select(F.col(group).alias("_of"), F.col(chunks).cast("array<array<int>>").alias("_chunks"))
        both = starts.select(group, ids.alias("ids")).join(own, F.col(group) == F.col("_of"), "left").drop("_of")
        run = _rounds(factory, group, k, c, max_len, batch, eos)
        return written(both.mapInArrow(run, f"`{group}` {dict(starts.dtypes)[group]}, ids array<int>, retrieved {RETRIEVED}"), "generation")
    arrays = written(articles.select(group, F.col(chunks).alias("_chunks")), "generation")
    search = VectorSearch(arrays, group, "_chunks", k, encoder)
    state = starts.select(group, mask_after_eos(ids, eos).alias("ids"))
    state = state.withColumn("done", (F.size("ids") >= max_len) | F.array_contains("ids", eos))

    def with_neighbours(live: DataFrame, asked: DataFrame) -> DataFrame:
        """``live`` with the neighbours of all chunks ``asked`` (group, _q) of a sequence as ``found``, [n][k][2c]."""
        near = search.find(asked, "_q")
        own = collect_retrieved(near, arrays.join(asked.select(group), group, "left_semi"), group, "_chunks")
        own = own.select(F.col(group).alias("_of"), F.col("retrieved").alias("found"))
        return live.join(own, F.col(group) == F.col("_of"), "left").drop("_of").withColumn("found", F.coalesce("found", F.array().cast(RETRIEVED)))

    state = written(state, "generation")
    state = with_neighbours(state, state.select(group, full_chunks("ids", c).alias("_q"))).withColumnRenamed("found", "retrieved")
    finished = []
    for _ in range(max_len // c + 2):
        state = written(state.select(group, "ids", "done", "retrieved"), "generation")
        finished.append(state.where("done"))
        live = state.where("not done")
        if live.isEmpty():
            break
        stepped = written(live.mapInArrow(_step(factory, group, c, max_len, batch), _ddl(live) + ", new array<int>"), "generation")
        stepped = stepped.select(group, mask_after_eos(F.concat("ids", "new"), eos).alias("ids"), "retrieved",
                                 ((F.size("new") == 0) | F.array_contains("new", eos) | (F.size("ids") + F.size("new") >= max_len)).alias("done"))
        asked = stepped.where("not done").select(group, last_full_chunk("ids", c).alias("_last")).where("_last is not null")
        asked = written(asked.select(group, F.array("_last").alias("_q")), "generation")
        state = with_neighbours(stepped, asked).withColumn("retrieved", F.concat("retrieved", "found"))
    else:
        raise RuntimeError("sequences did not end")
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select(group, "ids", "retrieved")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
