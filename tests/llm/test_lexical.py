"""Operator 11 against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longdoc.llm import lexical as lex
from tests.llm.conftest import DOCS, edge_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    tf = [(d, Counter(_terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), n in zip(tf, lengths, strict=True):
            score = 0
            for t, r in Counter(_terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * w * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * n * n_docs) // n_terms)))
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _rank(ship, docs, items, k=10):
    rows = [r if len(r) == 5 else (*r, "en", "a", 1) for r in docs]
    d = ship.createDataFrame(rows, DOCS)
    for clash in ("term", "segment", "lengths", "query"):
        d = d.withColumn(clash, d["lang"])
    q = ship.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lex.search(lex.build_index(d), q.withColumn("term", q["text"]), k).collect()), key=repr)


ITEMS = [(1, "w1 w2 W3, w3"), (2, None), (3, ""), (4, "word5 other7 word5 one"), (1, "日本語 one 12345"), (None, "one tail"), (5, "!!"), (6, "nowhere")]


def test_edges(ship):
    docs = [r[:2] for r in edge_rows()] + [(20, "w1"), (21, "W1 w1!w1"), (22, "w1-x")]
    assert _rank(ship, docs, ITEMS) == brute(docs, ITEMS)
    assert _rank(ship, docs, ITEMS, k=2) == brute(docs, ITEMS, 2)
    assert _rank(ship, docs[:0], ITEMS) == [] and _rank(ship, docs, ITEMS[:0]) == []
    assert _rank(ship, [(3, None), (None, "x")], ITEMS) == []


def test_segments_and_ties(ship, monkeypatch):
    """Many segments, ties beyond k spread over them, two groups of queries."""
    monkeypatch.setattr(lex, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(lex, "GROUP_QUERIES", 2)
    docs = [(i * 7 % 300, f"common t{i % 5} " + "pad " * (i % 3)) for i in range(300)] + [(300 + i, "copy of one text") for i in range(60)]
    items = [(i, f"t{i} common copy") for i in range(5)]
    assert _rank(ship, docs, items) == brute(docs, items)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lex, "BLOCK", 4)
    monkeypatch.setattr(lex, "FIRST_WINDOW", 8)


def _lists(texts):
    segment = lex.Segment()
    for i, t in enumerate(texts):
        segment.add(i, t.encode())
    term_rows, doc_rows = [b.to_pylist() for b in segment.rows(0)]
    lengths = np.array(doc_rows[0]["lengths"], np.int64)
    n_docs, n_terms = int((lengths > 0).sum()), int(lengths.sum())

    def m_of(n):
        return 25 + (75 * n * n_docs) // n_terms

    def weight(df):
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    return {r["term"]: lex.Lists(r, m_of(lengths), weight(r["df"]), m_of) for r in term_rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aabbcdefgh"), max_size=12).map(" ".join), min_size=1, max_size=120), st.integers(1, 5))
def test_segment_search_equals_scoring_all(texts, k):
    old = lex.BLOCK, lex.FIRST_WINDOW
    lex.BLOCK, lex.FIRST_WINDOW = 4, 8
    try:
        if not any(texts):
            return
        lists = _lists(texts)
        for query in ("a b", "c d e", "a h h"):
            used = [(lists[t], c) for t, c in Counter(query.split()).items() if t in lists]
            if used:
                docs, scores = lex.search_segment(used, len(texts), k)
                got = [(1, i + 1, d, s) for i, (d, s) in enumerate(zip(docs.tolist(), scores.tolist(), strict=True))]
                assert sorted(got, key=repr) == brute(list(enumerate(texts)), [(1, query)], k)
    finally:
        lex.BLOCK, lex.FIRST_WINDOW = old


def test_blocks_are_rejected_before_they_are_decompressed(small_blocks):
    """A rare term decides; the blocks of the common one are opened only where a candidate can still win."""
    texts = ["common " * (1 + i % 3) + ("rare " * 5 if i % 400 == 7 else "pad ") for i in range(4000)]
    lists = _lists(texts)
    docs, _ = lex.search_segment([(lists["common"], 1), (lists["rare"], 1)], len(texts), 3)
    assert [(1, i + 1, d) for i, d in enumerate(docs.tolist())] == [x[:3] for x in brute(list(enumerate(texts)), [(1, "common rare")], 3)]
    assert len(lists["common"].open) < len(lists["common"].lasts) / 20


@given(st.lists(st.integers(0, (1 << 62) - 1)))
def test_varint_round_trip(values):
    data, size = lex.varint(np.array(values, np.int64))
    assert lex.unvarint(data.tobytes()).tolist() == values and int(size.sum()) == len(data)


def test_skyline_gives_exact_block_maxima(small_blocks):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(1, 30))) for _ in range(200)]
    for x in _lists(texts).values():
        for b, most in enumerate(x.block_max.tolist()):
            assert x.block(b)[1].max() == most
