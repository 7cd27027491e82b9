"""Operator 5, packing as vector bin packing by the dot-product heuristic.

A sequence is a bin with three limits at once: tokens, segments (pieces in
it) and loss-bearing tokens. Pieces are vectors of the same three numbers. One
bin is open at a time; of the pieces that still fit, the one with the largest dot
product of its demand and the bin's remaining room, both as shares of the
limits, goes in next. When none fits, the next bin opens.

Documents longer than a sequence are cut: their full pieces fill bins alone, the
rests are packed. Each task packs its rows in lots of ``LOT``
pieces, so its memory doesn't grow with the input. Small partitions share a task, so that each task but the only one has about
``TASK_BYTES`` of input and few of its sequences stay open; ids are never stored and read again. Texts
are tokenized with the byte-level BPE vocabulary of a ``tokenizers`` JSON file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.functions.byte_bpe import load_encoder
from longdoc.llm.common import text_bytes

#: Limits of a sequence.
MAX_TOKENS = 1024
MAX_SEGMENTS = 32
MAX_LOSS_TOKENS = 1024
#: Share of a limit from which on a bin is full.
FULL = 0.97
#: Sequences that a task leaves open are numbered behind the full ones of this many tasks.
SECOND = 1 << 22
#: Bytes of text, or of ids, that a task packs at least, if partitions are smaller.
TASK_BYTES = 4 << 20
#: Id that ends every document.
END_ID = 0
#: Pieces that are packed together.
LOT = 4096
#: Rows of an Arrow batch on its way out.
OUT_ROWS = 2048

PIECES = "id long, start long, length long, ids binary, n_ids long, n_loss long, sequence_id long, offset long"


def encode(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, special token strings included (null: none)."""
    if not text:
        return np.empty(0, "<u4")
    enc = load_encoder(path)
    if any(s in text for s in enc.special_tokens_set):
        return np.array(enc.encode(text, allowed_special="all"), "<u4")
    return np.array(enc.encode_ordinary(text), "<u4")


def fill_bins(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of ``demand`` (n, 3); every row alone fits the limits."""
    share = demand / limits
    alive = np.arange(len(demand))
    bins = []
    while len(alive):
        room, placed = limits.astype(np.int64).copy(), []
        open_rows = np.ones(len(alive), bool)
        while True:
            fits = open_rows & (demand[alive] <= room).all(axis=1)
            at = np.flatnonzero(fits)
            if not len(at):
                break
            best = at[np.argmax(share[alive[at]] @ (room / limits))]  # a tie goes to the first
            open_rows[best] = False
            placed.append(int(alive[best]))
            room -= demand[alive[best]]
        bins.append(placed)
        alive = alive[open_rows]
    return bins


class _Packer:
    """Pieces (id, start, length, ids, n_ids, n_loss) on their way into sequences, a lot at a time."""

    def __init__(self, limits: np.ndarray, lot: int, task: int):
        self.limits, self.lot, self.sequence, self.open_sequence = limits, lot, task << 40, (SECOND + 1 + task) << 40
        self.pool: list[tuple] = []
        self.out: list[tuple] = []

    def alone(self, piece: tuple) -> None:
        self.out.append((*piece, self.sequence, 0))
        self.sequence += 1

    def add(self, piece: tuple) -> None:
        self.pool.append(piece)
        if len(self.pool) >= self.lot:
            self.place()

    def place(self, last: bool = False) -> None:
        """Pack the pool. Of the ``last`` one, bins that no limit fills are numbered apart."""
        demand = np.array([(p[2], 1, p[5]) for p in self.pool], np.int64).reshape(-1, 3)
        for members in fill_bins(demand, self.limits):
            if last and (demand[members].sum(axis=0) < FULL * self.limits).all():
                sequence, self.open_sequence = self.open_sequence, self.open_sequence + 1
            else:
                sequence, self.sequence = self.sequence, self.sequence + 1
            offset = 0
            for i in members:
                self.out.append((*self.pool[i], sequence, offset))
                offset += self.pool[i][2]
        self.pool = []

    def flush(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        while len(self.out) > keep:
            part, self.out = self.out[:OUT_ROWS], self.out[OUT_ROWS:]
            cols = list(zip(*part, strict=True))
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=[f.split()[0] for f in PIECES.split(", ")])


def _pack_rows(rows: Iterator[tuple], limits: np.ndarray, lot: int, task: int) -> Iterator[pa.RecordBatch]:
    """``rows``: (id, ids, loss mask). Yields pieces with their places."""
    most = int(limits[0])
    packer = _Packer(limits, lot, task)
    for key, ids, loss in rows:
        for start, end in cut(loss, most, int(limits[2])):
            part = ids[start:end]
            piece = (key, start, len(part), part.tobytes(), len(ids), int(loss[start:end].sum()))
            (packer.alone if len(part) == most else packer.add)(piece)
        yield from packer.flush(OUT_ROWS)
    packer.place(last=True)
    yield from packer.flush()


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` of ``size`` bytes in as many tasks as have ``TASK_BYTES`` each, or in fewer if there are fewer partitions."""
    return rows.coalesce(max(1, size // TASK_BYTES))


def cut(loss: np.ndarray, most: int, most_loss: int) -> Iterator[tuple[int, int]]:
    """Consecutive pieces of an example, each as long as both limits allow."""
    if most_loss >= most:
        yield from ((at, min(at + most, len(loss))) for at in range(0, len(loss), most))
        return
    total, at = np.cumsum(loss), 0
    while at < len(loss):
        before = int(total[at - 1]) if at else 0
        end = min(at + most, int(np.searchsorted(total, before + most_loss, side="right")), len(loss))
        yield at, end
        at = end


def _limits(max_tokens: int, max_segments: int, max_loss: int) -> np.ndarray:
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be 1 or more")
    return np.array([max_tokens, max_segments, max_loss], np.int64)


def pack_texts(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
               max_loss: int = MAX_LOSS_TOKENS, end_id: int = END_ID, lot: int = LOT, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Pack whole texts, each followed by ``end_id``; every id is loss-bearing.

    One row per piece: id, start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit), n_ids (of the whole document), n_loss,
    sequence_id, offset (in the sequence, gapless from 0). A null or empty text is
    its end id alone; a repeated or null doc_id is packed row by row like any
    other; an empty table gives no row; other columns are not read.
    """
    limits = _limits(max_tokens, max_segments, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            end = np.array([end_id], "<u4")
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for i, key in enumerate(keys):
                    ids = np.concatenate([encode(vocabulary, batch.column(1)[i].as_py()), end])
                    yield key, ids, np.ones(len(ids), bool)

        yield from _pack_rows(rows(), limits, lot, TaskContext.get().partitionId())

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return _dealt(rows, text_bytes(docs, text)).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                  max_loss: int = MAX_LOSS_TOKENS, lot: int = LOT, example_id: str = "id", ids: str = "ids",
                  loss: str = "loss") -> DataFrame:
    """Pack tokenized instruction examples: ``ids`` array<int>, ``loss``
    array<boolean> of the same length (true: the token bears loss; null: all do).
    Only examples over a limit are cut. Null or empty ids give no piece. Same
    result columns as ``pack_texts``."""
    limits = _limits(max_tokens, max_segments, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, own, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    own = np.array(own or [], "<u4")
                    mask = np.ones(len(own), bool) if mask is None else np.array(mask, bool)
                    if len(mask) != len(own):
                        raise ValueError(f"example {key}: {len(own)} ids, {len(mask)} loss flags")
                    yield key, own, mask

        yield from _pack_rows(rows(), limits, lot, TaskContext.get().partitionId())

    rows = examples.select(F.col(example_id).cast("long").alias("id"), F.col(ids).alias("ids"), F.col(loss).alias("loss"))
    size = rows.agg(F.sum(F.size(F.coalesce("ids", F.array())).cast("long")).alias("n")).first()["n"] or 0
    return _dealt(rows, 4 * size).mapInArrow(run, PIECES)
