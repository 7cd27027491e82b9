"""Operator 8, substring dedup behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. A word goes when a
window that covers it has its word sequence also starting in a document with a
smaller doc_id. Documents are dealt into blocks of bounded size by a hash; three
passes over the blocks share one shuffle of the texts:

1. *Sketch.* Each block marks the cells of its distinct windows in a count-min
   sketch of ``DEPTH`` rows. The sketch grows with the corpus, so it is sharded:
   a block sends each shard its sorted cells, and a shard adds the blocks up and
   answers with one bit per cell sent: does another block count it too?
2. *Exact.* A window is a candidate when every row of the sketch says so. A
   sketch only overestimates, so no repeated window is lost. Candidates go, as
   128-bit hashes with their smallest doc_id in the block, to the partition of
   their hash, which finds the windows that a smaller doc_id of another block owns
   and sends those back.
3. *Cut.* A block cuts the windows sent back, and those that a smaller doc_id of
   the block itself has.

What a block sends of a window is the same however many of its documents
hold it, so a passage that a third of all documents share is one entry per
block. No whole sketch, list of windows or result passes through one task or the driver.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.llm.common import (as_bytes, byte_slices, fresh, run_starts, sorted_unique, split_words, text_bytes,
                                window_hash, word_hashes)

WINDOW = 13
#: Rows of the count-min sketch.
DEPTH = 2
#: Cells of a sketch row per expected window.
CELLS_PER_WINDOW = 4
#: Text bytes of a block; sets the number of blocks.
BLOCK_BYTES = 4 << 20
#: Windows that a sketch shard or an exact partition expects.
SHARD_WINDOWS = 1 << 21
#: Bytes of a word with its separator, as an estimate for sizing.
WORD_BYTES = 6

_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (high planes of small numbers vanish)."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _by_both(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h1, h2) and where in it each run of equal pairs begins."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # one hash alone hardly ever collides
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


class Block:
    """The windows of one block of documents, in an order that depends on the
    block's set of rows only."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window = window
        h1, h2, doc = [], [], []
        self.n_words = []
        for i, text in enumerate(texts):
            h = word_hashes(as_bytes(text))
            self.n_words.append(len(h))
            if len(h) >= window:
                h1.append(window_hash(h[:, 0], window, _P1))
                h2.append(window_hash(h[:, 1], window, _P2))
                doc.append(np.full(len(h1[-1]), i, np.int32))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.h1, self.h2, self.doc = cat(h1, np.uint64), cat(h2, np.uint64), cat(doc, np.int32)
        self.starts = np.cumsum([0] + [max(0, n - window + 1) for n in self.n_words])
        # a null doc_id has no place in the order: it neither owns a window nor loses words
        self.ids = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64)
        self.has_id = np.array([x is not None for x in ids], bool)
        order, first = _by_both(self.h1, self.h2)
        #: Distinct windows in the order of (h1, h2), and each window's place among them.
        self.u1, self.u2 = self.h1[order[first]], self.h2[order[first]]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        self.low = (np.minimum.reduceat(self.ids[self.doc[order]], first) if len(first)
                    else np.empty(0, np.int64))

    def cells(self, row: int, bits: int) -> np.ndarray:
        """The sketch cell of each distinct window in one row."""
        with np.errstate(over="ignore"):
            h = self.u1 if row == 0 else self.u2 * np.uint64(2 * row + 1)
        return h >> np.uint64(64 - bits)


def _split_by(sorted_values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the runs of equal ``value >> shift``."""
    if not len(sorted_values):
        return []
    part = sorted_values >> np.uint64(shift) if shift < 64 else np.zeros(len(sorted_values), np.uint64)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return [(int(part[i]), int(i), int(j)) for i, j in zip(at, np.r_[at[1:], len(part)], strict=True)]


def _sketch(doc_id: str, text: str, window: int, bits: int, shard_bits: int):
    """Pass 1 of a block: its distinct cells, by shard."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _block(table, doc_id, text, window)
        shard, data = [], []
        for row in range(DEPTH):
            cells = sorted_unique(block.cells(row, bits))
            for part, i, j in _split_by(cells, bits - shard_bits):
                gaps = np.diff(cells[i:j], prepend=np.uint64(part) << np.uint64(bits - shard_bits))
                shard.append(row << shard_bits | part)
                wide = int(gaps.max()) >> 16 > 0
                data.append(_pack(gaps.astype("<u4" if wide else "<u2")) + bytes([wide]))
        return pa.table({"shard": pa.array(shard, pa.int64()), "data": pa.array(data, pa.binary()),
                         "block": pa.array([key[0].as_py()] * len(shard), pa.int64())}).select(["shard", "block", "data"])

    return run


def _merge_sketch(key: tuple, table: pa.Table) -> pa.Table:
    """A shard: the blocks' cells added up; one bit per cell sent, set where the count is 2 or more."""
    rows = [x.as_py() for x in table.column("data")]
    cells = [np.cumsum(_unpack(x[:-1], "<u4" if x[-1] else "<u2"), dtype=np.uint64) for x in rows]
    every = np.concatenate(cells)
    order = np.argsort(every)
    count = np.diff(np.r_[run_starts(every[order]), len(every)])
    repeated = np.empty(len(every), bool)
    repeated[order] = np.repeat(count > 1, count)
    hit = np.split(repeated, np.cumsum([len(c) for c in cells])[:-1])
    return pa.table({"block": table.column("block"), "shard": table.column("shard"),
                     "data": pa.array([np.packbits(h).tobytes() for h in hit], pa.binary())})


def _candidates(doc_id: str, text: str, window: int, bits: int, shard_bits: int):
    """Pass 2 of a block: the windows that all sketch rows call repeated."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, doc_id, text, window)
        answer = dict(zip(right.column("shard").to_pylist(), right.column("data").to_pylist(), strict=True))
        keep = np.ones(len(block.u1), bool)
        for row in range(DEPTH):
            own = block.cells(row, bits)
            order = np.argsort(own)
            first = run_starts(own[order])
            hit = np.zeros(len(first), bool)
            for part, i, j in _split_by(own[order[first]], bits - shard_bits):
                hit[i:j] = np.unpackbits(np.frombuffer(answer[row << shard_bits | part], np.uint8), count=j - i)
            keep[order] &= np.repeat(hit, np.diff(np.r_[first, len(own)]))
        u1, u2, low = block.u1[keep], block.u2[keep], block.low[keep]
        cols: dict = {"part": [], "block": [], "h1": [], "h2": [], "low": []}
        for part, i, j in _split_by(u1, 64 - shard_bits):
            for name, x in zip(cols, (part, int(key[0].as_py()), u1[i:j].astype("<u8").tobytes(),
                                      u2[i:j].astype("<u8").tobytes(), _pack(low[i:j].astype("<i8"))), strict=True):
                cols[name].append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(x, t) for (n, x), t in zip(cols.items(), kinds, strict=True)})

    return run


def _owners(key: tuple, table: pa.Table) -> pa.Table:
    """An exact partition: per block, the windows that a smaller doc_id of another block has."""
    h1 = [np.frombuffer(x.as_py(), "<u8") for x in table.column("h1")]
    h2 = [np.frombuffer(x.as_py(), "<u8") for x in table.column("h2")]
    low = [_unpack(x.as_py(), "<i8") for x in table.column("low")]
    ends = np.cumsum([len(x) for x in h1])
    a, b, low = np.concatenate(h1), np.concatenate(h2), np.concatenate(low)
    order, first = _by_both(a, b)
    low = low[order]
    owned = np.empty(len(a), bool)
    owned[order] = low > np.repeat(np.minimum.reduceat(low, first), np.diff(np.r_[first, len(a)]))
    pieces = np.split(owned, ends[:-1])
    data = [np.stack([x[p], y[p]], 1).tobytes() for x, y, p in zip(h1, h2, pieces, strict=True)]
    return pa.table({"block": table.column("block"), "data": pa.array(data, pa.binary())})


def _block(table: pa.Table, doc_id: str, text: str, window: int) -> Block:
    return Block(table.column(doc_id).to_pylist(), table.column(text).to_pylist(), window)


def _removed(block: Block, owned: np.ndarray) -> list[np.ndarray]:
    """Per document the mask of words that go, given (n, 2) hashes of the owned windows."""
    order, first = _by_both(owned[:, 0], owned[:, 1])
    owned = owned[order[first]]
    own1, own2 = np.ascontiguousarray(owned[:, 0]), owned[:, 1]
    gone_window = np.zeros(len(block.u1), bool)
    low, high = np.searchsorted(own1, block.u1), np.searchsorted(own1, block.u1, side="right")
    for k in range(int((high - low).max(initial=0))):  # more than once only where first halves collide
        some = np.flatnonzero(low + k < high)
        gone_window[some] |= own2[low[some] + k] == block.u2[some]
    if len(block.u1):
        gone = (gone_window[block.place] | (block.ids[block.doc] > block.low[block.place])) & block.has_id[block.doc]
    else:
        gone = np.empty(0, bool)
    masks = []
    for i, n in enumerate(block.n_words):
        own = gone[block.starts[i]:block.starts[i + 1]]
        step = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(own)
        step[at] += 1
        step[at + block.window] -= 1
        masks.append(np.cumsum(step[:-1]) > 0)
    return masks


def _joined(text: str | None, gone: np.ndarray) -> str:
    """The kept words joined by one space."""
    words = [w for s in byte_slices(as_bytes(text)) for w in split_words(s)]
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")


def _spaced(text: str | None, gone: np.ndarray) -> str | None:
    """The text without the removed words; what stays keeps its own white space."""
    if text is None or not gone.any():
        return text
    data = as_bytes(text)
    raw = np.frombuffer(data, np.uint8)
    is_word = ~(((raw >= 9) & (raw <= 13)) | (raw == 32))
    begin = np.flatnonzero(is_word & ~np.r_[False, is_word[:-1]])
    # a word goes with the white space behind it
    bounds = np.r_[begin, len(raw)]
    stay = np.repeat(np.r_[True, ~gone], np.diff(np.r_[0, bounds]))
    return raw[stay].tobytes().decode("utf-8", "surrogatepass").rstrip("\x20\t\n\r\x0b\x0c")


def remove_repeats(docs: DataFrame, window: int = WINDOW, joined: bool = False, doc_id: str = "doc_id",
                   text: str = "text", counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Cut the repeated windows of every whole text.

    Returns the rows and columns of ``docs`` with the text cut (kept words joined
    by one space if ``joined``, else with their own white space) and two more
    columns, named by ``counts``: the input text's words and those removed (long); columns of
    ``docs`` with these names, in any case, are replaced.

    Null texts and texts shorter than a window lose nothing (null stays null, or
    is empty if ``joined``). A window repeated inside one document only is no repeat, nor is one
    shared by rows of the same doc_id (ties): only a smaller doc_id owns it. A null
    doc_id neither owns nor loses windows. An empty table stays empty.
    """
    size = text_bytes(docs, text)
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    expected = max(1, size // WORD_BYTES)
    shard_bits = max(0, math.ceil(math.log2(expected / SHARD_WINDOWS)))
    bits = max(16, math.ceil(math.log2(expected * CELLS_PER_WINDOW)), shard_bits + 1)
    bits = min(bits, shard_bits + 32)

    extra = [c for c in docs.columns if c.lower() not in [n.lower() for n in counts]]
    own_id, block_no = fresh(extra, "own_id", "block_no")
    dealt = docs.select(*extra, F.col(doc_id).cast("long").alias(own_id), F.pmod(
        F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(text)), F.lit(blocks)).cast("long").alias(block_no))

    cells = dealt.groupBy(block_no).applyInArrow(_sketch(own_id, text, window, bits, shard_bits), "shard long, block long, data binary")
    repeated = cells.groupBy("shard").applyInArrow(_merge_sketch, "block long, shard long, data binary")
    found = dealt.groupBy(block_no).cogroup(repeated.groupBy("block")).applyInArrow(
        _candidates(own_id, text, window, bits, shard_bits), "part long, block long, h1 binary, h2 binary, low binary")
    owned = found.groupBy("part").applyInArrow(_owners, "block long, data binary")

    out = T.StructType([docs.schema[c] for c in extra] + [T.StructField(n, T.LongType()) for n in counts])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, own_id, text, window)
        sent = [np.frombuffer(x.as_py(), "<u8").reshape(-1, 2) for x in right.column("data")]
        masks = _removed(block, np.concatenate(sent) if sent else np.empty((0, 2), np.uint64))
        values = left.column(text).to_pylist()
        texts = [(_joined if joined else _spaced)(t, m) for t, m in zip(values, masks, strict=True)]
        cols = {c: left.column(c) for c in extra}
        cols[text] = pa.array(texts, left.schema.field(text).type)
        cols[counts[0]] = pa.array(block.n_words, pa.int64())
        cols[counts[1]] = pa.array([int(m.sum()) for m in masks], pa.int64())
        return pa.table({f.name: cols[f.name] for f in out})

    return dealt.groupBy(block_no).cogroup(owned.groupBy("block")).applyInArrow(cut, out)
