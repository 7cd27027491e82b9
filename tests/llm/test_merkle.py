"""Operator 13 against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from longdoc.llm import merkle
from tests.llm.conftest import DOCS, edge_rows


def _h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_h(low[i:i + 3]) for i in range(0, len(low), 3)])
    return levels


def _walk(levels, at, node, proof):
    for low in levels[:-1]:
        run = at // 3 * 3
        before, after = low[run:at], low[at + 1:run + 3]
        proof += before + after
        node = _h(before + [node] + after)
        at //= 3
    return node


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    fields = [(d, s, lang, n, t) for d, t, lang, s, n in rows]
    groups = {}
    for f in fields:
        groups.setdefault(f[1], []).append(f)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda f: (f[0] is not None, f[0] or 0, _leaf(f)))
        trees.append(_levels([_leaf(f) for f in groups[s]]))
    top = _levels([t[-1][0] for t in trees]) if trees else None
    out = []
    for g, s in enumerate(names):
        for i, f in enumerate(groups[s]):
            cut = f[0] is not None and zlib.crc32(str(f[0]).encode()) % 2 == 0
            node = _leaf((*f[:4], f[4] and f[4].replace("\n", ""))) if cut else trees[g][0][i]
            proof = []
            node = _walk(top, g, _walk(trees[g], i, node, proof), proof)
            out.append((f[0], trees[g][0][i], trees[g][-1][0], top[-1][0], _h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def _query(df):
    rows = merkle.digests(merkle.manifest(df, merkle.even_crc(F.col("doc_id")))).collect()
    return sorted((tuple(r)[:7] for r in rows), key=repr)


def test_edges(ship):
    rows = edge_rows() + [(20, "a\nb\n", "en", "é", 4), (21, "\n", "en", "Z", 1), (23, "c\nd", None, "z", None)]
    df = ship.createDataFrame(rows, DOCS).withColumn("gid", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("part", F.lit(2))
    assert _query(df) == brute(rows)
    assert _query(df.limit(0)) == []
    assert _query(ship.createDataFrame(rows[:1], DOCS)) == brute(rows[:1])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 728, 729, 730])
def test_blocks_grow_as_one_tree(n):
    nodes = [str(i) for i in range(n)]
    whole = merkle.grow(nodes, False)
    assert whole[-1][0] == _levels(nodes)[-1][0] and whole[0] == nodes


def test_many_blocks_and_many_sources(ship):
    """A source of several aligned blocks (the last one short) and more sources than a block holds."""
    rows = [(i, f"text\n{i}", "en", "hot" if i < 1600 else f"s{i % 800}", i) for i in range(3000)]
    df = ship.createDataFrame(rows, DOCS).repartition(7)
    assert _query(df) == brute(rows)


def test_versions_share_all_but_the_copied_nodes(ship):
    """Each version's copies are the ancestors of its leaf alone, and rebuilding the whole table with that one
    leaf changed gives the version's root."""
    rows = [(i, f"line\n{i}", "en", f"s{i % 3}", i) for i in range(40)]
    df = ship.createDataFrame(rows, DOCS)
    out = merkle.manifest(df, merkle.even_crc(F.col("doc_id"))).collect()
    tampered = [r for r in out if r.copies is not None]
    assert tampered and len(tampered) < len(out)
    for r in tampered[:6]:
        assert len(r.copies) == len(r.path) and r.copies[-1] == r.folded != r.root
        changed = [(d, t.replace("\n", "") if d == r.id else t, *rest) for d, t, *rest in rows]
        assert {x[3] for x in brute(changed)} == {r.folded}
    assert all(r.folded == r.root for r in out if r.copies is None)
