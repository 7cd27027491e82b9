"""Operator 3, embedding near-dedup by E8 lattice hashing.

Unit vectors are projected by random matrices to ``BLOCKS`` times eight dimensions per
table. Each eight are decoded to the nearest point of the E8 lattice; the points of a
table make up a vector's cell. Two near vectors are found when in some table one of them
lies in a cell that is the other's own or one it probes: in each block its own
point or one of the ``PROBES`` neighbouring lattice points closest to it. Found pairs are
verified by their cosine in double precision.

A bucket is one cell of one table and one label. Its rows are the vectors of
the cell and those that probe it. Buckets without two rows, most of them, go before
any vector is moved; a bucket of more than ``TILE`` rows is cut into tiles, so a third
of all vectors in one cell are many bounded tasks. Pairs never leave their tile: a tile
returns the number of links of each vector and a spanning forest of them. A pair that
several buckets find is counted in the first of them, which each tile knows as it
can compute every table's cells of its vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.llm.common import materialize, mix, spread
from longdoc.llm.components import connected_components

THRESHOLD = 0.98
#: A pair at the threshold is found in one block with probability 0.93, in one table
#: with 0.86, in any of the tables with 0.99999 (simulated; closer pairs more often). Two unrelated
#: vectors share a cell of a table with probability 1e-9, so that cells stay
#: small for a thousand million vectors of a label.
TABLES = 6
BLOCKS = 2
#: Neighbouring lattice points that a vector probes in each block.
PROBES = 6
#: Probed cells of a table besides the own one.
CELLS = (PROBES + 1) ** BLOCKS - 1
#: Scale of the projection: at the threshold, two projected unit vectors are
#: about 0.2 * SCALE * sqrt(8) apart in a block; E8 cells have an inner radius of 0.71.
SCALE = 1.0
SEED = 7
#: Rows of a bucket that meet another as many in one task.
TILE = 1024
#: Rows of a matrix of cosines.
STEP = 256


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the rounded sum is odd, the
    coordinate that was rounded furthest is rounded the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        at = np.argmax(np.abs(gap), axis=1)
        r[odd, at] += np.where(gap[np.arange(len(odd)), at] < 0, -1.0, 1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of (n, 8): the better of D8 and D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """The projections of every table for vectors of ``dim`` components."""

    def __init__(self, dim: int):
        rng = np.random.default_rng([SEED, dim])
        self.matrix = rng.standard_normal((TABLES, BLOCKS, dim, 8)) * SCALE
        self.shift = rng.random((TABLES, BLOCKS, 8))
        self.neighbours = minimal_vectors()
        self.odd = rng.integers(1, 1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _points(self, unit: np.ndarray, table: int, block: int) -> np.ndarray:
        """Keys (n, 1 + PROBES) of the nearest lattice point and of the neighbours in whose
        direction the vector lies off it."""
        y = unit @ self.matrix[table, block] + self.shift[table, block]
        p = nearest_e8(y)
        near = np.argpartition(-((y - p) @ self.neighbours.T), PROBES - 1, axis=1)[:, :PROBES]
        points = np.concatenate([p[:, None, :], p[:, None, :] + self.neighbours[near]], axis=1)
        coords = np.rint(points * 2).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return mix((coords * self.odd).sum(axis=2, dtype=np.uint64) + np.uint64(table * BLOCKS + block + 1))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (n, TABLES) and probed cells (n, TABLES, CELLS)."""
        out = np.empty((len(unit), TABLES, 1 + CELLS), np.uint64)
        for t in range(TABLES):
            cell = self._points(unit, t, 0)
            for b in range(1, BLOCKS):
                point = self._points(unit, t, b)
                with np.errstate(over="ignore"):
                    cell = mix(cell[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + point[:, None, :]).reshape(len(unit), -1)
            out[:, t] = cell
        out = out.view(np.int64)
        return out[:, :, 0], out[:, :, 1:]


def _unit(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    # scaled first, so that squares of very large or small components stay finite
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, dim, vec) -> (cell, label, dim, node, own)."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            rows = batch.take(pa.array(at))
            own, probed = Lattice(int(dim)).cells(_unit(rows.column(3).to_pylist()))
            per = TABLES * (1 + CELLS)
            cell = np.concatenate([own[:, :, None], probed], axis=2).reshape(-1)
            mine = np.zeros((TABLES, 1 + CELLS), bool)
            mine[:, 0] = True
            index = pa.array(np.repeat(np.arange(len(at)), per))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), rows.column(1).take(index), rows.column(2).take(index), rows.column(0).take(index),
                 pa.array(np.tile(mine.reshape(-1), len(at)))], names=["cell", "label", "dim", "node", "own"])


def _first_found(i: np.ndarray, j: np.ndarray, node: np.ndarray, own: np.ndarray, probed: np.ndarray, cell: int) -> np.ndarray:
    """Whether the bucket ``cell`` is the first that finds each pair (i, j).

    Buckets of a pair are ordered by table, in a table the own cell of the smaller
    node comes before the larger node's."""
    low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    here = np.zeros(len(i), bool)
    left = np.arange(len(i))  # pairs that no table so far has found; few after the first
    for t in range(TABLES):
        a, b = low[left], high[left]
        own_a, own_b = own[a, t], own[b, t]
        at_low = (own_a == own_b) | (probed[b, t] == own_a[:, None]).any(axis=1)
        at_high = (probed[a, t] == own_b[:, None]).any(axis=1)
        here[left] = np.where(at_low, own_a == cell, at_high & (own_b == cell))
        left = left[~(at_low | at_high)]
        if not len(left):
            break
    return here


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of pairs (i, j)."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    label, a, b = np.arange(len(node)), rank[i], rank[j]
    while True:
        before, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    by_rank = node[order]
    moved = np.flatnonzero(label != np.arange(len(node)))
    return by_rank[moved], by_rank[label[moved]]


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell, ti, tj = key[0].as_py(), key[2].as_py(), key[3].as_py()
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        own_row, copies = table.column("own").to_numpy(), table.column("copies").to_numpy()
        unit = _unit(table.column("vec").to_pylist())
        left, right = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
        pairs = []
        for at in range(0, len(left), STEP):
            rows = left[at:at + STEP]
            near = unit[rows] @ unit[right].T >= threshold - 1e-9
            near &= own_row[rows][:, None] | own_row[right][None, :]  # one of them lies in the cell
            a, b = np.nonzero(near)
            i, j = rows[a], right[b]
            keep = node[i] < node[j] if ti == tj else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold  # one formula for every pair
            i, j = i[keep], j[keep]
            if len(i):  # most buckets hold no link at all
                rows, at_row = np.unique(np.concatenate([i, j]), return_inverse=True)
                keep = _first_found(*np.split(at_row, 2), node[rows], *Lattice(unit.shape[1]).cells(unit[rows]), cell)
                pairs.append((i[keep], j[keep]))
        none = np.empty(0, np.int64)
        i, j = (np.concatenate([none, *x]) for x in (zip(*pairs, strict=True) if pairs else (none, none)))
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        a, b = _forest(node, i, j)
        linked = np.flatnonzero(links)
        return pa.table({"node": pa.array(np.concatenate([node[linked], a]), pa.int64()),
                         "root": pa.array(np.concatenate([node[linked], b]), pa.int64()),
                         "links": pa.array(np.concatenate([links[linked], np.zeros(len(a))]).astype(np.int64), pa.int64())})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """Links between vectors of one label with a cosine of ``threshold`` or more.

    Returns per row: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows
    with a null label or vec_id, link with nothing: n_links 0, component_id their own id, kept (a
    null id is kept too). Vectors of different length link with none of each other. Equal
    vectors (ties, repeated rows) of a label are linked with one another and found as
    one. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite
                        & F.exists("vec", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = materialize(rows.withColumn("usable", usable)
                       .withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))), "vectors")
    good = rows.where("usable")
    # equal vectors are one node, the smallest id
    nodes = materialize(good.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
                        .withColumn("dim", F.size("vec")), "nodes")

    kinds = f"cell long, label {vectors.schema[label].dataType.simpleString()}, dim int, node long, own boolean"
    entries = nodes.select("node", "label", "dim", "vec").mapInArrow(_cells_of, kinds)
    # buckets with a vector of their own and a second row
    bucket = ["cell", "label", "dim"]
    met = (entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("has_own"))
           .where("has_own and n > 1").drop("has_own"))
    rows_met = entries.join(met, bucket)
    cut = rows_met.withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", "label", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
        "block", "node", "own", "dim")
    filled = tiles.join(nodes.select("node", "label", "dim", "vec", "copies"), ["node", "label", "dim"])
    tile = ["cell", "label", "ti", "tj", "dim"]
    found = materialize(spread(filled, *tile).groupBy(*tile).applyInArrow(
        _tile(threshold), "node long, root long, links long"), "tiles")

    component = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.join(links, "node", "left").join(component, "node", "left")
             .select("label", "vec", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("component_id")))
    joined = good.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
