"""D4, incremental: against a plain loop over each sequence."""

import math
from collections import Counter

import numpy as np
import pytest

from longdoc.operators.generation import generate_incremental
from longdoc.operators.retrieve import HashEncoder, hash_embed_batch

P = 260  # first word id
SCHEMA = "article_id long, text_tokenized array<array<int>>"


def _factory():
    def run(rows, want):
        out = []
        for r, n in zip(rows, want, strict=True):
            if r["article_id"] == 5:
                out.append([P + 1] if len(r["ids"]) < 6 else [])  # gives up in the middle of a chunk
            elif r["retrieved"]:
                seen = [x for q in r["retrieved"] for pair in q for x in pair]
                out.append([*r["retrieved"][-1][0][4:], P + len(seen) % 7][:n])
            else:
                out.append(([P + 3, P + 4, P + 3, P + 9] * 2)[:n])
        return out
    return run


def _plain(starts, articles, k, c, max_len, vectors):
    step, out = _factory(), {}
    for a, start in starts:
        ids, found, chunks = list(start or []), [], articles.get(a, [])
        keys = chunks[:-1]

        def search(q):
            def score(j):
                if vectors:
                    m = hash_embed_batch(np.array([0, len(q), len(q) + len(keys[j])]), np.array(q + keys[j]), 64, 42).astype(float)
                    return float(m[0] @ m[1])
                x, y = (Counter(t for t in z if t >= P) for z in (q, keys[j]))
                dot = sum(x[t] * y[t] for t in x)
                return dot / math.sqrt(sum(v * v for v in y.values())) if dot else 0.0
            best = sorted(range(len(keys)), key=lambda j: (-score(j), j))[:k]
            return [chunks[j] + chunks[j + 1] for j in best]

        def mask():
            if 1 in ids:
                ids[ids.index(1) + 1:] = [0] * (len(ids) - ids.index(1) - 1)

        mask()
        for i in range(len(ids) // c):
            if keys:
                found.append(search(ids[i * c:(i + 1) * c]))
        while 1 not in ids and len(ids) < max_len:
            want = min(c - len(ids) % c, max_len - len(ids))
            new = step([{"article_id": a, "ids": ids, "retrieved": found}], [want])[0][:want]
            ids += new
            mask()
            if not new or 1 in ids or len(ids) >= max_len:
                break
            if len(ids) % c == 0 and keys:
                found.append(search(ids[-c:]))
        out[a] = (ids, found)
    return out


@pytest.mark.parametrize("vectors", [False, True])
def test_rounds_equal_a_plain_loop(spark, vectors):
    rng = np.random.default_rng(2)
    articles = {a: rng.integers(P, P + 12, (n, 4)).tolist() for a, n in ((1, 9), (2, 3), (3, 6), (4, 2), (5, 5), (8, 1))}
    articles[3][5] = [P, 1, 0, 0]  # an EOS that a continuation can reach
    starts = [(1, [P + 1, P + 2]), (2, [P + 1] * 9), (3, [P, P + 5, P + 6, P + 7]), (4, None), (5, [P, P + 1, P + 2, P + 3, P + 4]),
              (6, [P + 1]), (7, [P, 1, P + 1]), (8, [P + 2] * 4), (9, [P] * 30)]
    df = spark.createDataFrame(list(articles.items()), SCHEMA)
    st = spark.createDataFrame(starts, "article_id long, prompt_ids array<int>")
    out = generate_incremental(st, df, _factory, k=2, c=4, max_len=19, batch=2, encoder=HashEncoder() if vectors else None).collect()
    got = {r.article_id: (list(r.ids), [[list(p) for p in q] for q in r.retrieved]) for r in out}
    assert len(out) == len(starts)
    assert got == _plain(starts, articles, 2, 4, 19, vectors)
    assert max(len(f) for _, f in got.values()) >= 4


def test_no_sequences(spark):
    st = spark.createDataFrame([], "article_id long, prompt_ids array<int>")
    assert generate_incremental(st, spark.createDataFrame([(1, [[P] * 4] * 3)], SCHEMA), _factory, c=4).collect() == []


def test_rounds_write_the_result_only(spark):
    """Neither a round nor the articles' chunks are written, and a repeated article isn't multiplied by each round."""
    import glob

    from longdoc.session import scratch_path
    folder = scratch_path(spark, "generation").removeprefix("file:") + "/*"
    articles = [(1, [[P + i, P + 1, P, P] for i in range(5)])] * 2 + [(2, [[P] * 4] * 3)]
    st = spark.createDataFrame([(1, [P]), (2, [P] * 5), (None, [P])], "article_id long, prompt_ids array<int>")
    before = set(glob.glob(folder))
    out = generate_incremental(st, spark.createDataFrame(articles, SCHEMA), _factory, k=2, c=4, max_len=19).collect()
    assert len(set(glob.glob(folder)) - before) == 1
    assert sorted((r.article_id or 0, len(r.ids), len(r.retrieved)) for r in out) == [(0, 19, 0), (1, 19, 4), (1, 19, 4), (2, 19, 4)]


def test_an_article_of_several_tiles():
    """The best chunks of an article with more key blocks than a tile holds."""
    import pyarrow as pa

    from longdoc.operators import generation, sparse_index
    n = (sparse_index.TILE_BLOCKS + 3) * sparse_index.BLOCK
    chunks = [[P + i % 5, P + 7, P + 7, P] for i in range(n)]
    chunks[n - 9] = chunks[3] = [P + 9] * 4
    own = generation.OwnChunks(pa.array([None, chunks], pa.list_(pa.list_(pa.int32()))), 3)
    assert list(own.find({0: [[P + 9] * 4], 1: [[P + 9] * 4]})) == [(1, [chunks[3] + chunks[4], chunks[n - 9] + chunks[n - 8], chunks[0] + chunks[1]])]
