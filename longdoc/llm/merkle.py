"""Operator 13, Merkle dataset manifest: a persistent tree with path copying.

Every row of a table is a leaf. Per source the leaves in order of their id form a tree of
``FAN`` children a node; the sources' roots, in order of the source, form the tree above.
The tree is never changed: a tampered leaf creates a version that copies the leaf's
ancestors and shares every other node with the original.

1. ``leaves``: the digests, row by row (JVM). Texts go no further.
2. ``place``: gapless places per source. Range partitions are sorted and numbered on
   their own and get their offsets from one count per (partition, source), so a source that holds
   a third of all rows is spread over many tasks.
3. ``blocks``: aligned blocks of ``FAN ** DEPTH`` leaves, one row each. A block's subtree
   depends on no other block.
4. ``paths``: the blocks' roots are the leaves of the next tier, again in aligned blocks, and so on
   to the root. Each node gets its path: what stands left and right of it (and of its ancestors)
   in their runs. A tier has 1/729 of the rows of the one below.
5. ``versions``: a block's task builds its subtree once. For each tampered leaf it copies the ancestors
   within the block and continues the version along the block's path through the tiers above:
   versions stay where their leaves are and never meet in an upper task.

Defined cases: a null field is hashed as ``-``; rows without an id come first in their source and are
never tampered with; rows with equal ids are ordered by their digests, so repeated rows are
interchangeable; a null source is a source of its own and comes first; an empty table gives no rows;
a text of any length is one digest; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longdoc.llm.common import materialize

#: Children of a node.
FAN = 3
#: Levels of an aligned block.
DEPTH = 6
WIDTH = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def grow(nodes: list[str], full: bool) -> list[list[str]]:
    """Levels of a block's subtree from its leaves up: ``DEPTH`` levels where the tree goes on
    above the block (``full``), else until one node is left."""
    levels = [nodes]
    while len(levels) <= DEPTH if full else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i:i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf and of each of its ancestors in their runs."""
    out = []
    for low in levels[:-1]:
        run = at - at % FAN
        out.append(("".join(low[run:at]), "".join(low[at + 1:run + FAN])))
        at //= FAN
    return out


def copy_path(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with ``node`` in the path's place has as copies of its own, the
    lowest first; the last one is the version's root."""
    out = []
    for before, after in path:
        node = digest(before + node + after)
        out.append(node)
    return out


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, order: str = "doc_id",
           group: str = "source", text: str = "text") -> DataFrame:
    """(group, id, leaf, altered): digests as bytes; ``altered`` is the leaf's after the line breaks of
    ``text`` are deleted where ``tampered`` holds, else null."""
    cut = F.translate(F.col(text), "\n", "")
    altered = leaf_digest([cut if f == text else F.col(f) for f in fields])
    return docs.select(F.col(group).alias("group"), F.col(order).cast("long").alias("id"),
                       F.unhex(leaf_digest([F.col(f) for f in fields])).alias("leaf"),
                       F.when(tampered, F.unhex(altered)).alias("altered"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row in its partition."""
    seen = 0
    for batch in batches:
        place = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
        seen += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "place"])


def place(rows: DataFrame) -> DataFrame:
    """(group, id, leaf, altered) -> these and ``gid`` (place of the group, null first), ``idx`` (place in its
    group by id, then leaf) and ``size`` (rows of the group); places are gapless from 0."""
    # the last key spreads equal rows over partitions
    keys = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("copy")]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select("group", "id", "leaf", "altered", F.spark_partition_id().alias("part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", place long"
    numbered = materialize(dealt.mapInArrow(_number, schema), "places")

    # one row per partition and group that meet: as many as partitions and groups together
    counts = materialize(numbered.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")),
                         "counts")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "group", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # groups are ordered by the partition they begin in, then by their place there
    groups = (counts.groupBy("group").agg(F.sum("n").alias("size"), F.min(F.struct("part", "first")).alias("start"))
              .select("group", "size", F.col("start.part").alias("begin"), F.col("start.first").alias("first")))
    begun = groups.groupBy("begin").agg(F.count(F.lit(1)).alias("k"))  # at most one row per partition
    earlier = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("begin", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("begin").orderBy("first")) - 1
    gids = (groups.withColumn("inside", inside).join(begun, "begin")
            .select(F.col("group").alias("named"), "size", (F.col("inside") + F.col("earlier")).cast("long").alias("gid")))
    spans = offsets.join(gids, F.col("group").eqNullSafe(F.col("named"))).select(
        F.col("part").alias("at"), "named", "first", "offset", "size", "gid")
    return (numbered.join(spans, (F.col("part") == F.col("at")) & F.col("group").eqNullSafe(F.col("named")))
            .select("group", "id", "leaf", "altered", "gid", (F.col("place") - F.col("first") + F.col("offset")).alias("idx"), "size"))


def blocks(placed: DataFrame) -> DataFrame:
    """One row per aligned block: (gid, block, size, leaves), at most ``WIDTH`` leaves in order."""
    leaf = F.struct("idx", "group", "id", "leaf", "altered")
    return (placed.groupBy("gid", F.floor(F.col("idx") / WIDTH).alias("block"))
            .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(leaf)).alias("leaves")))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, block, size, leaf digests) -> (gid, idx, size, node): the block's root and the blocks of its group."""
    for batch in batches:
        size = batch.column(2).to_pylist()
        nodes = [grow([x.hex() for x in row], n > WIDTH)[-1][0] for row, n in zip(batch.column(3).to_pylist(), size, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-n // WIDTH) for n in size], pa.int64()),
                                          pa.array(nodes, pa.string())], names=["gid", "idx", "size", "node"])


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a tier -> one row per node: its path within the block, and the block's root."""
    for batch in batches:
        for gid, block, size, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels = grow([x["node"] for x in nodes], size > WIDTH)
            n = len(nodes)
            steps = [[{"before": b, "after": a} for b, a in path_of(levels, i)] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([gid] * n, pa.int64()), pa.array([x["idx"] for x in nodes], pa.int64()), pa.array([block] * n, pa.int64()),
                 pa.array([size] * n, pa.int64()),
                 pa.array(steps, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                 pa.array([levels[-1][0]] * n, pa.string())], names=["gid", "idx", "up", "size", "path", "top"])


def paths(nodes: DataFrame) -> DataFrame:
    """(gid, idx, size, node) -> (gid, idx, path, top): each node's path through its group's tree, whose
    root is ``top``. One tier per factor of ``WIDTH`` in the largest group's size."""
    tier = (nodes.groupBy("gid", F.floor(F.col("idx") / WIDTH).alias("block"))
            .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("nodes")))
    tier = materialize(tier.mapInArrow(_climb, f"gid long, idx long, up long, size long, path {STEP}, top string"), "tier")
    if (tier.agg(F.max("size").alias("n")).first()["n"] or 0) <= WIDTH:
        return tier.select("gid", "idx", "path", "top")
    roots = tier.groupBy("gid", F.col("up").alias("idx")).agg(
        F.ceil(F.first("size") / WIDTH).alias("size"), F.first("top").alias("node"))
    above = paths(roots).select("gid", F.col("idx").alias("up"), F.col("path").alias("rest"), F.col("top").alias("root"))
    return tier.join(above, ["gid", "up"]).select("gid", "idx", F.concat("path", "rest").alias("path"), F.col("root").alias("top"))


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their paths -> one row per leaf, with its whole path and its version's copied nodes."""
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        for size, rows, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels = grow([x["leaf"].hex() for x in rows], size > WIDTH)
            above = [(s["before"], s["after"]) for s in path]
            whole, copies, folded = [], [], []
            for i, x in enumerate(rows):
                steps_up = path_of(levels, i) + above
                node = (x["leaf"] if x["altered"] is None else x["altered"]).hex()
                climbed = copy_path(node, steps_up)
                whole.append([{"before": b, "after": a} for b, a in steps_up])
                copies.append(None if x["altered"] is None else climbed)
                folded.append(climbed[-1] if climbed else node)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["id"] for x in rows], pa.int64()), pa.array([x["group"] for x in rows], pa.string()),
                 pa.array([x["idx"] for x in rows], pa.int64()), pa.array([x["leaf"].hex() for x in rows], pa.string()),
                 pa.array([x["altered"] and x["altered"].hex() for x in rows], pa.string()), pa.array(whole, steps),
                 pa.array(copies, pa.list_(pa.string())), pa.array([subroot] * n, pa.string()),
                 pa.array([root] * n, pa.string()), pa.array(folded, pa.string())],
                names=["id", "group", "idx", "leaf", "altered", "path", "copies", "subroot", "root", "folded"])


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, order: str = "doc_id",
             group: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, group, idx, leaf, altered, path, copies, subroot, root, folded).

    ``path`` is the proof: per level up to the root what stands left and right of the node in its run.
    ``copies`` are the nodes that the version of a tampered leaf has for itself, its root last; all its other nodes
    are the original's. ``folded`` is the root recomputed from the leaf (the altered one, if there is one) and
    the path."""
    rows = materialize(leaves(docs, tampered, fields, order, group, text), "leaves")
    packed = materialize(blocks(place(rows)), "blocks")
    tops = packed.select("gid", "block", "size", F.col("leaves.leaf").alias("leaf"))
    within = materialize(paths(tops.mapInArrow(_tops, "gid long, idx long, size long, node string")), "paths")
    # the subroots are the leaves of one more tree
    subroots = materialize(within.groupBy("gid").agg(F.first("top").alias("node")), "subroots")
    forest = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(subroots.count()).cast("long").alias("size"), "node")
    over = paths(forest).select(F.col("idx").alias("gid"), F.col("path").alias("rest"), F.col("top").alias("root"))
    known = within.join(over, "gid").select("gid", F.col("idx").alias("block"), F.concat("path", "rest").alias("path"),
                                            F.col("top").alias("subroot"), "root")
    full = packed.join(known, ["gid", "block"]).select("size", "leaves", "path", "subroot", "root")
    return full.mapInArrow(_versions, f"id long, group string, idx long, leaf string, altered string, path {STEP}, "
                           "copies array<string>, subroot string, root string, folded string")


def even_crc(c: Column) -> Column:
    """The rows that the query tampers with."""
    return F.crc32(c.cast("string").cast("binary")) % 2 == 0


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of a manifest."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
                       F.size(F.coalesce("copies", F.array())).alias("n_copied"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


# the state of crc32 after the decimal doc_id; the complement that ends it turns the lowest bit
_SQL_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384)))"""

SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS altered, {_SQL_CRC} AS crc
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM d),
low(g, lvl, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM l
  UNION ALL
  SELECT g, lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, lvl, i // 3),
sub AS (SELECT g, h, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, i, n, h) AS (
  SELECT 0, g, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3),
nodes AS (SELECT 0 AS tree, g, lvl, i, n, h FROM low UNION ALL SELECT 1, 0, lvl, i, n, h FROM high),
steps AS (SELECT a.tree, a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before,
            coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3
          WHERE a.n > 1 GROUP BY a.tree, a.g, a.lvl, a.i),
climb(doc_id, leaf, up, copied, tree, g, lvl, i, h, proof) AS (
  SELECT doc_id, leaf, g, crc & 1, 0, g, 0, i, CASE WHEN crc & 1 = 1 THEN altered ELSE leaf END, '' FROM l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.up, c.copied, CASE WHEN s.i IS NULL THEN 1 ELSE c.tree END, CASE WHEN s.i IS NULL THEN 0 ELSE c.g END,
    CASE WHEN s.i IS NULL THEN 0 ELSE c.lvl + 1 END, CASE WHEN s.i IS NULL THEN c.up ELSE c.i // 3 END,
    CASE WHEN s.i IS NULL THEN c.h ELSE sha256(s.before || c.h || s.after) END,
    CASE WHEN s.i IS NULL THEN c.proof ELSE c.proof || s.before || s.after END
  FROM climb c LEFT JOIN steps s ON s.tree = c.tree AND s.g = c.g AND s.lvl = c.lvl AND s.i = c.i
  WHERE s.i IS NOT NULL OR c.tree = 0),
top AS (SELECT h AS root, lvl FROM high WHERE n = 1),
tall AS (SELECT g, max(lvl) AS lvl FROM low GROUP BY g)
SELECT c.doc_id, c.leaf, sub.h AS subroot, top.root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = top.root AS verified,
  CASE WHEN c.copied = 1 THEN tall.lvl + top.lvl ELSE 0 END AS n_copied
FROM climb c JOIN top ON c.tree = 1 AND c.lvl = top.lvl JOIN sub ON sub.g = c.up JOIN tall ON tall.g = c.up"""
