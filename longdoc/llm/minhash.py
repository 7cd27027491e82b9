"""Operator 10, MinHash near-dedup by a multi-index Hamming join.

1. Every text becomes its set of distinct word shingles. Equal sets form a
   class that is represented by its smallest doc_id.
2. A class gets a signature of ``SYMBOLS`` b-bit MinHash symbols.
   Two sets of Jaccard similarity 0.8 differ in 20 % of the symbols on average;
   ``RADIUS`` leaves them more than four standard deviations of room.
3. The signature is split into ``CHUNKS`` chunks. By the pigeonhole
   principle two signatures within ``RADIUS`` have a chunk with at most
   ``CHUNK_ERRORS`` errors, as RADIUS < CHUNKS * (CHUNK_ERRORS + 1). The
   allowed errors are enumerated as masks: each chunk yields a key for every
   way to leave ``CHUNK_ERRORS`` symbols out, and every pair within the radius
   shares a key. No pair within the radius is missed.
4. Round 1 pairs each member of a key with the smallest member (a star per
   key) and confirms these pairs on the full shingle sets. That joins most of a
   group of near copies without listing its pairs.
5. Round 2 tests every pair of one key that is within the radius and whose ends
   are still in different components, in tiles of bounded size. Pairs never leave
   their tile: a first pass finds the rows that have such a pair, a second one
   gets their texts, compares the full sets and returns the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.llm.common import (as_bytes, materialize, mix, semi_join_ids, sorted_unique,
                                spread, window_hash, word_hashes)
from longdoc.llm.components import connected_components

#: Symbols of a signature, 16 bits each.
SYMBOLS = 48
#: Largest number of differing symbols of a candidate pair.
RADIUS = 21
CHUNKS = 11
#: Errors that a chunk of a pair within the radius may have: RADIUS < CHUNKS * 2.
CHUNK_ERRORS = 1
#: Rows of a bucket that meet as many in one task; larger buckets are cut into tiles.
TILE = 512

_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(1, 1 << 63, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, size=SYMBOLS, dtype=np.uint64)
_P1 = 0x9E3779B97F4A7C15


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of the text,
    A-Z in lower case; a shorter text is one shingle, no word gives none."""
    data = as_bytes(text).lower()
    h = word_hashes(data)[:, 0]
    if not len(h):
        return h
    if len(h) < words:
        return window_hash(h, len(h), _P1) ^ np.uint64(len(h))
    return sorted_unique(window_hash(h, words, _P1))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` 16-bit MinHash symbols of a non-empty set."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = shingles[None, at:at + 4096] * _MUL[:, None] + _ADD[:, None]
            np.minimum(low, part.min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2")


def _chunk_bounds() -> np.ndarray:
    return np.array([round(i * SYMBOLS / CHUNKS) for i in range(CHUNKS + 1)])


def _masks() -> list[np.ndarray]:
    """Symbol positions that make up each key: those of a chunk but one. The mask
    at place p leaves symbol p out."""
    edges = _chunk_bounds()
    chunk = np.repeat(np.arange(CHUNKS), np.diff(edges))
    return [np.array([q for q in range(SYMBOLS) if chunk[q] == chunk[p] and q != p]) for p in range(SYMBOLS)]


def _first_mask(differ: np.ndarray) -> np.ndarray:
    """Place of the first mask under which each pair of signatures agrees, given
    where they differ (n, SYMBOLS)."""
    edges = _chunk_bounds()[:-1]
    errors = np.add.reduceat(differ, edges, axis=1, dtype=np.int64)
    chunk = np.argmax(errors <= 1, axis=1)
    # without an error in the chunk its first mask agrees, with one the mask that leaves it out
    inside = differ & (np.repeat(np.arange(CHUNKS), np.diff(_chunk_bounds())) == chunk[:, None])
    return np.where(errors[np.arange(len(differ)), chunk] == 1, np.argmax(inside, axis=1), edges[chunk])


def signatures(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig) per row; the last three are null
    for a text without words. (set_a, set_b) is a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), words)
                n.append(len(s))
                if len(s):
                    with np.errstate(over="ignore"):
                        a.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                        b.append(int(mix(s ^ np.uint64(_P1)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(signature(s).tobytes())
                else:
                    a.append(None), b.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def signature_keys(classes: DataFrame) -> DataFrame:
    """(node, sig) -> (key, node): the masked chunks of each signature. The low
    six bits of a key are the place of its mask."""
    masks = _masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<u2").reshape(-1, SYMBOLS)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.empty((len(masks), len(sig)), np.uint64)
            with np.errstate(over="ignore"):
                for i, at in enumerate(masks):
                    h = np.full(len(sig), i + 1, np.uint64)
                    for p in at:
                        h = mix(h * np.uint64(_P1) + sig[:, p].astype(np.uint64) + np.uint64(1))
                    keys[i] = (h & ~np.uint64(63)) | np.uint64(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(node, len(masks)))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _distance_within(a, b):
    """Pairs of signature columns within the radius."""

    @F.arrow_udf("boolean")
    def within(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = (np.frombuffer(b"".join(v.as_py() for v in c), "<u2").reshape(-1, SYMBOLS) for c in (x, y))
        return pa.array((p != q).sum(axis=1) <= RADIUS)

    return within(a, b)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity. The texts of
    the nodes in ``pairs`` alone are shuffled."""
    ids = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ids")
    own = semi_join_ids(texts, "node", ids)
    joined = (pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
              .join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            keep = []
            a, b = batch.column(0), batch.column(1)
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                other = tb[i].as_py()
                if last_set is None or other != last:  # rows come sorted by b, so its set is mostly at hand
                    last, last_set = other, shingle_set(other, words)
                s = shingle_set(ta[i].as_py(), words)
                both = len(np.intersect1d(s, last_set, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(last_set) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _open_pairs(table: pa.Table, key: tuple, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile that are within the radius, in different components, of
    sizes that allow the similarity, and share no key before this one."""
    ti, tj = key[1].as_py(), key[2].as_py()
    mask = key[0].as_py() & 63
    node, comp, size, block = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "block"))
    sig = np.frombuffer(b"".join(x.as_py() for x in table.column("sig")), "<u2").reshape(-1, SYMBOLS)
    left, right = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
    # few against many: the rows outside the tile's largest component go first
    names, counts = np.unique(comp[left], return_counts=True)
    largest = names[np.argmax(counts)] if len(names) else -1
    rest = left[comp[left] != largest]
    todo = [(i, right[comp[right] != comp[i]]) for i in rest]
    if ti == tj:
        # a pair of two rows outside the largest component belongs to the first of them
        place = np.empty(len(node), np.int64)
        place[left] = np.arange(len(left))
        todo = [(i, r[(comp[r] == largest) | (place[r] > place[i])]) for i, r in todo]
    else:
        others = right[comp[right] != largest]
        todo += [(j, left[comp[left] == largest]) for j in others]
    for i, near in todo:
        low, high = np.minimum(size[near], size[i]), np.maximum(size[near], size[i])
        near = near[(100 * low >= percent * high) & (node[near] != node[i])]
        if len(near):
            differ = sig[near] != sig[i]
            ok = differ.sum(axis=1) <= RADIUS
            near, differ = near[ok], differ[ok]
            if len(near):
                near = near[_first_mask(differ) == mask]
                if len(near):
                    yield int(i), near


def _cross_links(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, n, node, comp, n_shingles, sig) -> links (a, b) between components. A key of
    more than ``TILE`` rows is cut into blocks, each pair of blocks being one tile."""
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the tiles of block i: (i, j) for j >= i and (j, i) for j < i
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
        "block", "node", "comp", "n_shingles", "sig")

    def involved(key: tuple, table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, near in _open_pairs(table, key, percent):
            hit[i] = hit[near] = True
        return table.filter(pa.array(hit))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        sets = [shingle_set(x.as_py(), words) for x in table.column("text")]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        flat = np.searchsorted(sorted_unique(every), every)  # shingles numbered within the tile
        mark = np.zeros(len(flat) + 1, bool)
        own = [flat[e - n:e] for e, n in zip(ends, sizes, strict=True)]
        node, a, b = table.column("node").to_numpy(), [], []
        for i, near in _open_pairs(table, key, percent):
            mark[own[i]] = True
            both = np.array([np.count_nonzero(mark[own[j]]) for j in near])
            mark[own[i]] = False
            near = near[100 * both >= percent * (sizes[near] + sizes[i] - both)]
            a.append(np.maximum(node[near], node[i])), b.append(np.minimum(node[near], node[i]))
        cat = lambda x: pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    tile = ["key", "ti", "tj"]
    schema = "key long, ti int, tj int, block int, node long, comp long, n_shingles long, sig binary"
    found = materialize(spread(tiles, *tile).groupBy(*tile).applyInArrow(involved, schema), "involved")
    ids = materialize(found.select("node").distinct(), "ids")
    return (spread(found.join(semi_join_ids(texts, "node", ids), "node"), *tile)
            .groupBy(*tile).applyInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Documents linked by shingle sets of ``words`` words with 100 * intersection
    >= ``percent`` * union.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included), kept (doc_id = component_id).

    Null and wordless texts have an empty set: linked with nothing, kept. A null
    doc_id links with nothing either: its component_id is null and the row is kept.
    Rows that repeat a doc_id are one document: what one of them is linked with, all are.
    Equal texts (ties) share a class, the smallest doc_id stays. An empty table
    gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(signatures(own, words), "signatures")
    member = rows.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull())
    classes = materialize(member.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"),
                                                               F.first("n_shingles").alias("n_shingles")), "classes")
    # keys of at least two classes
    keys = signature_keys(classes)
    shared = (keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .where(F.col("low") < F.col("high")).select("key", "low"))
    keyed = materialize(keys.join(shared, "key"), "keyed")

    sig_a = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    stars = (keyed.where(F.col("node") > F.col("low"))
             .select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
             .join(sig_a, "a").join(sig_b, "b"))
    stars = materialize(stars.where(_distance_within("sig_a", "sig_b")).select("a", "b").distinct(), "stars")
    texts = own.withColumnRenamed("doc_id", "node").where(F.col("node").isNotNull())
    # rows of one doc_id with different sets
    several = (member.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y"))
               .where("x <> y").select("doc_id"))
    same = (member.join(several, "doc_id").join(classes, ["set_a", "set_b"])
            .select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    links = materialize(_confirm(stars, texts, words, percent).union(same), "links")
    first = connected_components(links)

    # round 2: pairs between the components of the stars
    comp = (keyed.join(first, "node", "left")
            .select("key", "node", F.coalesce("component", "node").alias("comp")))
    mixed = (comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                     F.count(F.lit(1)).alias("n"))
             .where(F.col("low") < F.col("high")).select("key", "n"))
    open_rows = comp.join(mixed, "key").join(classes.select("node", "n_shingles", "sig"), "node")
    found = connected_components(links.union(_cross_links(open_rows, texts, words, percent)))

    named = classes.join(found, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
    joined = rows.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull()).join(named, ["set_a", "set_b"])
    alone = rows.where(F.col("doc_id").isNull() | F.col("set_a").isNull())
    return (joined.select("doc_id", "n_shingles", "component_id")
            .union(alone.select("doc_id", "n_shingles", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
