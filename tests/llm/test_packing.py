"""Operator 5: the heuristic step by step, and padding over many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longdoc.llm import packing
from longdoc.llm.common import read_table
from longdoc.llm.queries import tokenizer_path


def _follows_the_heuristic(bins, demand, limits):
    """Every placed row had the largest dot product of shares of all rows that fitted; a bin ends when none fits."""
    left = set(range(len(demand)))
    for own in bins:
        room = list(limits)

        def value(i):
            return sum(d / m * (r / m) for d, m, r in zip(demand[i], limits, room, strict=True))

        def fitting():
            return [i for i in left if all(d <= r for d, r in zip(demand[i], room, strict=True))]

        for chosen in own:
            fits = fitting()
            if chosen not in fits or value(chosen) < max(map(value, fits)) - 1e-9:
                return False
            left.remove(chosen)
            room = [r - d for r, d in zip(room, demand[chosen], strict=True)]
        if fitting():
            return False
    return not left


@pytest.mark.parametrize("seed", range(6))
def test_bins_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    tokens = rng.integers(1, 100, n)
    demand = np.stack([tokens, np.ones(n, int), (tokens * rng.random(n)).astype(int)], 1)
    limits = np.array([100, int(rng.integers(2, 6)), 70])
    demand[:, 2] = np.minimum(demand[:, 2], 70)
    assert _follows_the_heuristic(packing.fill_bins(demand, limits), demand.tolist(), limits.tolist())


def _check(rows, n_docs):
    """Every id lies in one piece, sequences are gapless and within their limits; the share of them in use."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append((r.start, r.length, r.n_ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_doc) == n_docs
    for pieces in by_doc.values():
        at = 0
        for start, length, n in sorted(pieces):
            assert start == at and n == pieces[0][2]
            at += length
        assert at == pieces[0][2]
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and len(pieces) <= packing.MAX_SEGMENTS
    return sum(r.length for r in rows) / (1024 * len(by_sequence))


@pytest.mark.parametrize("partitions", [1, 64, 211])
def test_little_padding_with_many_partitions(ship, partitions):
    docs = read_table(ship, "/root/testdata/sf0.01", "documents").repartition(partitions, "doc_id")
    rows = packing.pack_texts(docs, tokenizer_path("byte_bpe_50k.json")).drop("ids").collect()
    assert _check(rows, 1000) >= 0.97


def test_second_pass_takes_open_bins_only(ship):
    df = ship.createDataFrame([(i, [7] * 1000, None) for i in range(40)] + [(100 + i, [7] * 10, None) for i in range(40)],
                              "id long, ids array<int>, loss array<boolean>").repartition(8, F.col("id") % 8)
    rows = packing.pack_examples(df).drop("ids").collect()
    assert sum(r.length for r in rows) == 40 * 1010 and len({r.sequence_id for r in rows}) <= 41
    second = packing.SECOND << 40
    assert all(r.length == 10 or r.sequence_id < second for r in rows)
    assert packing.pack_examples(df.limit(0)).collect() == []


def test_ids_are_not_stored_on_the_way(ship):
    """Pieces go to their sequences in the task that makes them: nothing is written before the result."""
    import glob

    from longdoc.session import scratch_path
    df = ship.createDataFrame([(i, f"word{i} " * 50) for i in range(60)], "doc_id long, text string").repartition(6)
    folder = scratch_path(ship, "llm").removeprefix("file:") + "/packed-*"
    before = set(glob.glob(folder))
    rows = packing.pack_texts(df, tokenizer_path("byte_bpe_50k.json")).drop("ids").collect()
    assert _check(rows, 60) > 0 and set(glob.glob(folder)) == before
