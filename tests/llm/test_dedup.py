"""Operators 3, 8 and 10 against brute force, on the data and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longdoc.llm import lattice, minhash, substring
from longdoc.llm.common import read_table, window_hash
from longdoc.llm.components import connected_components
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import DOCS, edge_rows


def test_window_hash_is_the_polynomial():
    h = np.random.default_rng(0).integers(0, 1 << 63, 40, dtype=np.uint64)
    for k in (1, 2, 5, 13):
        own = [int(x) for x in window_hash(h, k, minhash._P1)]
        again = [int(window_hash(h[i:i + k], k, minhash._P1)[0]) for i in range(40 - k + 1)]
        assert own == again and len(set(own)) == len(own)


def test_masks_cover_every_pair_within_the_radius():
    assert minhash.RADIUS < minhash.CHUNKS * (minhash.CHUNK_ERRORS + 1)
    rng, masks = np.random.default_rng(1), minhash._masks()
    a = rng.integers(0, 9, minhash.SYMBOLS)
    for _ in range(300):
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] += 100
        agree = [i for i, m in enumerate(masks) if (a[m] == b[m]).all()]
        assert agree and minhash._first_mask((a != b)[None])[0] == agree[0]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(ship, documents, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           minhash.near_duplicates(read_table(ship, SF_SMALL, "documents"), k).collect()}
    assert got == brute.near_duplicates(documents, k)


def test_near_duplicates_in_tiles(ship, monkeypatch):
    """A group whose members aren't all similar to its first one, in tiles of a few rows."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        for p in rng.choice(60, rng.integers(1, 6), replace=False):
            own[p] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "TILE", 8)
    df = ship.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2).collect()}
    assert got == brute.near_duplicates(rows, 2)


def test_near_duplicates_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("component_id", F.lit("x")).withColumn("kept", F.lit(0))
    out = minhash.near_duplicates(df, 5).collect()
    assert len(out) == len(edge_rows())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[2] == [(36, 1, False)] * 2 and by[1] == [(36, 1, True)]
    assert sorted(by[10]) == [(1, 1, False), (37, 1, False)]  # one document
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5))
    assert by[None] == [(36, None, True)] and by[7] == [(1, 7, True)]
    assert minhash.near_duplicates(df.limit(0), 5).collect() == []


@pytest.mark.parametrize("block, shard", [(4 << 20, 1 << 21), (1 << 14, 1 << 10)])
def test_repeats_match_brute_force(ship, documents, monkeypatch, block, shard):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "SHARD_WINDOWS", shard)
    cut = substring.remove_repeats(read_table(ship, SF_SMALL, "documents"), joined=True)
    got = sorted(map(tuple, cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()))
    assert got == sorted(brute.cut_repeats(documents)) and sum(r[2] for r in got) > 0


def test_repeats_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("n_words", F.lit("clash"))
    cut = substring.remove_repeats(df, joined=True)
    assert set(cut.columns) == set(df.columns) | {"n_removed"}
    got = [tuple(r) for r in cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(brute.cut_repeats([r[:2] for r in edge_rows()]), key=lambda r: str(key(r)))
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_cut_text_keeps_its_white_space(ship):
    same = " ".join(f"w{i}" for i in range(13))
    rows = [(1, same), (2, f"begin\n\n{same}\t the  end"), (3, f"{same}"), (4, "short text")]
    got = {r.doc_id: (r.text, r.n_removed) for r in
           substring.remove_repeats(ship.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (same, 0), 2: ("begin\n\nthe  end", 13), 3: ("", 13), 4: ("short text", 0)}


def test_e8_decoding():
    nb = lattice.minimal_vectors()
    assert len(nb) == 240 and np.allclose((nb ** 2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    own = ((x - p) ** 2).sum(axis=1)
    # no neighbouring cell's point is nearer, which holds for the nearest point alone
    assert (own[:, None] <= ((x[:, None] - p[:, None] - nb) ** 2).sum(axis=2) + 1e-9).all()


def test_near_vectors_match_brute_force(ship, monkeypatch):
    rng, rows = np.random.default_rng(5), []
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=16) * 0.09], g % 3))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 1), (1004, [], 1),
             (1005, rows[0][1], None), (1006, rows[0][1], rows[0][2]), (1007, [2 * x for x in rows[0][1]], rows[0][2]),
             (1008, [1e300] * 16, 2), (1009, [1e-300] * 16, 2), (1010, [1.0, 2.0], 0), (1011, [1.0, 2.0], 0)]
    want = brute.near_vectors([r for r in rows if r[0] not in (1008, 1009)])
    want |= {1008: (1, 1008), 1009: (1, 1008)}
    monkeypatch.setattr(lattice, "TILE", 6)
    df = ship.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * there > 0
    assert all(got[i] == want[i] for i in want if i >= 1000 and i != 1006 and i != 1007)
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_components(ship):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (300, 300), (150, 200)]
    got = {r.node: r.component for r in connected_components(ship.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 150: 100, 200: 100}
