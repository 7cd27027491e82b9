"""Operator 1, SentencePiece encoding and decoding by max-plus transfer matrices.

The pieces and scores of a SentencePiece model file are read as a unigram model:
the encoding of a text is the segmentation with the largest sum of scores (of
equal ones, read from the end, the one with the longer piece). Characters without a piece
become byte pieces. Decoding joins the pieces.

A document of up to ``CHUNK`` characters is encoded by one task at a time. A giant one
is cut into chunks that are encoded in parallel. A piece may cross the cut, so the
state at a cut is where the first piece boundary at or behind it lies: 0 to L - 1
characters further, L being the longest piece.

1. Each chunk yields its transfer matrix: the best score from every entry
   state to every exit state.
2. A parallel scan (``scan``) gives the best scores with which every chunk is entered: blocks of ``SCAN_BLOCK``
   consecutive matrices are multiplied with each other, each block in a task of its own, the products again in
   blocks and so on, until a document has one block. From there the entry scores go back down.
3. With these a chunk yields, for every exit state, the entry state that the best path
   comes from. These maps are composed by the same scan, from the end of the
   document back, which gives every chunk its exit state.
4. Each chunk is backtraced on its own.

No task holds more than ``SCAN_BLOCK`` matrices or maps of a document. Scores are sums of single-precision numbers in
double precision, so the order of combination changes no sum of fewer than 2^29 pieces of like size. In the usual vocabularies no piece holds white
space behind other characters, so words are encoded one by one and memoised; this is
checked when the model is loaded, and whole chunks are words if it doesn't hold.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.llm.common import materialize

#: Characters of a chunk.
CHUNK = 1 << 16
#: Words that a worker remembers.
MEMO = 150_000
#: Words that are encoded at a time; longer ones than ``LONG_WORD`` characters are encoded alone and not remembered.
WORDS = 4_000
LONG_WORD = 64
#: Characters of texts that are encoded at a time.
TOGETHER = 1 << 20
#: Consecutive matrices or maps of a document that one task combines.
SCAN_BLOCK = 64
SPACE = "▁"
#: What an unknown character costs beyond the worst piece, as in the format's own encoder.
UNKNOWN_PENALTY = 10.0

_LOST = float("-inf")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Pieces of a model file, as a trie, with their scores and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.processor = sp
        self.trie: dict = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        self.longest, worst, splits = 1, 0.0, True
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (sp.get_score(i), i)
                worst = min(worst, sp.get_score(i))
                self.longest = max(self.longest, len(piece))
                splits &= not re.search(f"[^{SPACE}]{SPACE}", piece)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.unknown = worst - UNKNOWN_PENALTY
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if splits else "(?s).+")
        self.splits = splits
        self._flatten()
        self.memo: defaultdict[str, int] = defaultdict()
        self.memo.default_factory = self.memo.__len__  # a word that is not remembered gets the next number
        self.forget()
        self.shown = pa.array(self.bytes_of, pa.large_binary())

    def _flatten(self) -> None:
        """The trie as arrays: numbered nodes, and a hash table of its edges."""
        edges, ends, todo, chars = [], [(0.0, -1)], [(self.trie, 0)], {}
        while todo:
            node, number = todo.pop()
            for c, below in node.items():
                if c:
                    edges.append((number, chars.setdefault(ord(c), len(chars) + 1), len(ends)))
                    todo.append((below, len(ends)))
                    ends.append(below.get("", (0.0, -1)))
        self.node_scores, self.node_ids = np.array([x for x, _ in ends]), np.array([i for _, i in ends], np.int64)
        self.char_ids = np.zeros(0x110000, np.int64)
        self.char_ids[list(chars)] = list(chars.values())
        self.n_chars = len(chars) + 1
        bits = max(4, (2 * len(edges)).bit_length())
        self.edge_shift = np.uint64(64 - bits)
        self.edge_keys, self.edge_nodes = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for a, c, b in edges:
            key = a * self.n_chars + c + 1
            at = (key * int(_MUL) & (1 << 64) - 1) >> 64 - bits
            while self.edge_keys[at]:
                at = at + 1 & (1 << bits) - 1
            self.edge_keys[at], self.edge_nodes[at] = key, b

    def normalize(self, text: str) -> str:
        return self.processor.normalize(text)

    def forward(self, s: str, entry: dict[int, float], stop: int) -> tuple[list[float], list[tuple[int, int]]]:
        """Best score of reaching every position of ``s`` from the entry
        positions by pieces that start before ``stop``, and the piece it ends with as
        (start, id). Of equal scores the smaller start wins."""
        best, last = [_LOST] * (len(s) + 1), [(-1, -1)] * (len(s) + 1)
        for at, score in entry.items():
            best[at] = score
        trie, n = self.trie, len(s)
        # a piece never ends at or before its start, so positions are final in order
        for at in range(min(stop, n)):
            here = best[at]
            if here == _LOST:
                continue
            node, i, single = trie, at, False
            while i < n:
                node = node.get(s[i])
                if node is None:
                    break
                i += 1
                if "" in node:
                    score, piece = node[""]
                    single = single or i == at + 1
                    if here + score > best[i]:
                        best[i], last[i] = here + score, (at, piece)
            if not single and here + self.unknown > best[at + 1]:  # a character without a piece
                best[at + 1], last[at + 1] = here + self.unknown, (at, -1)
        return best, last

    def ids_of(self, s: str, start: int, end: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.byte_ids[b] for b in s[start:end].encode("utf-8", "surrogatepass")]

    def back(self, s: str, last: list[tuple[int, int]], end: int) -> tuple[int, bytes]:
        """The entry position that the best path to ``end`` comes from, and its ids
        (little-endian unsigned 32-bit numbers, as everywhere here)."""
        parts = []
        while last[end][0] >= 0:
            start, piece = last[end]
            parts.append(self.ids_of(s, start, end, piece))
            end = start
        ids = [i for p in reversed(parts) for i in p]
        return end, struct.pack(f"<{len(ids)}I", *ids)

    # ---- words: the same recursion over many words at once ----

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie node behind each (node, character), 0 where there is none."""
        key = node * self.n_chars + char + 1
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * _MUL) >> self.edge_shift).astype(np.int64)
        out = np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        while len(left):
            held = self.edge_keys[at]
            out[left[held == key]] = self.edge_nodes[at[held == key]]
            go = (held != key) & (held != 0)  # another key's place: look at the next one
            left, key, at = left[go], key[go], (at[go] + 1) & (len(self.edge_keys) - 1)
        return out

    def arcs(self, codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, score, id) of every piece at every position that ends by its ``limit``; id -1 for a
        character without a piece."""
        char = self.char_ids[codes]
        at, node, length = np.arange(len(codes)), self.child(np.zeros(len(codes), np.int64), char), 1
        found = []
        while len(at):
            inside = node > 0
            at, node = at[inside], node[inside]
            ends = self.node_ids[node] >= 0
            found.append((at[ends], np.full(int(ends.sum()), length), self.node_scores[node[ends]], self.node_ids[node[ends]]))
            more = at + length < limit[at]
            at, node = at[more], node[more]
            node = self.child(node, char[at + length])
            length += 1
        alone = np.ones(len(codes), bool)
        if found:
            alone[found[0][0]] = False
        lost = np.flatnonzero(alone)
        found.append((lost, np.ones(len(lost), np.int64), np.full(len(lost), self.unknown), np.full(len(lost), -1)))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(4))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of ids and (all words' one after the other) ids of each word: as ``forward`` and ``back``
        give them, one step for all words at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        start, length, score, piece = self.arcs(codes, end[word])
        step = start - (end - size)[word[start]]
        order = np.argsort(step.astype(np.int32), kind="stable")
        # a word has a state before each character and one behind the last
        start, score, piece, step = start[order], score[order], piece[order], step[order]
        source = start + word[start]
        target = source + length[order]
        best, last = np.full(len(codes) + len(words), _LOST), np.full(len(codes) + len(words), -1)
        best[end - size + np.arange(len(words))] = 0.0
        bounds = np.cumsum(np.bincount(step))
        for i, j in zip(np.r_[0, bounds[:-1]].tolist(), bounds.tolist(), strict=True):
            reach = best[source[i:j]] + score[i:j]
            better = np.flatnonzero(reach > best[target[i:j]])
            best[target[i:j][better]] = reach[better]
            last[target[i:j][better]] = better + i
        at, which = end + np.arange(len(words)), np.arange(len(words))
        total = best[at]
        taken, owner = [], []
        while len(at):
            arc = last[at]
            on = arc >= 0
            arc, which = arc[on], which[on]
            taken.append(arc)
            owner.append(which)
            at = source[arc]
        taken, owner = np.concatenate(taken[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        taken, owner = taken[order], owner[order]
        ids, code = piece[taken], codes[start[taken]]
        if len(ids) and ids.min() < 0:  # characters without a piece: the bytes of their code points
            n = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
            ids, code, owner, width = (np.repeat(x, n) for x in (ids, code, owner, n))
            place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            rest = (code >> (6 * (width - 1 - place)).astype(np.uint32)) & 0x3F | 0x80
            lead = np.select([width == 1, width == 2, width == 3], [code, 0xC0 | code >> 6, 0xE0 | code >> 12], 0xF0 | code >> 18)
            ids = np.where(ids >= 0, ids, np.array(self.byte_ids)[np.where(place == 0, lead, rest) & 0xFF])
        return total, np.bincount(owner, minlength=len(words)), ids.astype("<i4")

    def remember(self, words: list[str]) -> None:
        """Encode words whose numbers follow those of the ones remembered."""
        parts = [self.encode_words(words[i:i + WORDS]) for i in range(0, len(words), WORDS)]
        scores, counts, ids = (np.concatenate([held, *(p[i] for p in parts)])
                               for i, held in enumerate((self.word_scores, self.word_counts, self.word_ids)))
        self.word_scores, self.word_counts, self.word_ids = scores, counts, ids
        self.word_first = np.cumsum(counts) - counts

    def forget(self) -> None:
        self.memo.clear()
        self.word_scores, self.word_counts = np.zeros(0), np.zeros(0, np.int64)
        self.word_ids, self.word_first = np.zeros(0, "<i4"), np.zeros(0, np.int64)

    def encode(self, s: str) -> tuple[float, bytes]:
        """Score and ids of a whole normalized text."""
        return self.encode_all([s])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[float, bytes]]:
        """Of several texts: their words that are not remembered are encoded together. Long words are encoded
        alone and not remembered."""
        if len(self.memo) > MEMO:
            self.forget()
        known = len(self.memo)
        split = [self.word.findall(s) for s in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for own in split for w in own] if len(split) > 1 else split[0]
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        alone = [words[i] for i in long]
        for i in long:
            words[i] = SPACE  # a place that the word's own ids take
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if len(self.memo) > known:
            self.remember(list(islice(self.memo, known, None)))
        scores, counts = self.word_scores[number], self.word_counts[number]
        own = [self._long(w) for w in alone]
        if own:
            scores[long], counts[long] = [x for x, _ in own], [len(x) for _, x in own]
        ends = np.cumsum(counts)
        at = np.repeat(self.word_first[number] - (ends - counts), counts) + np.arange(int(counts.sum()))
        ids = self.word_ids[np.minimum(at, max(0, len(self.word_ids) - 1))]
        for i, (_, x) in zip(long, own, strict=True):
            ids[ends[i] - counts[i]:ends[i]] = x
        data = ids.tobytes()
        stop = np.r_[0, np.cumsum(sizes)]
        cut = (4 * np.r_[0, ends][stop]).tolist()
        return [(float(scores[a:b].sum()), data[i:j]) for a, b, i, j in zip(stop[:-1], stop[1:], cut[:-1], cut[1:], strict=True)]

    def _long(self, word: str) -> tuple[float, np.ndarray]:
        best, last = self.forward(word, {0: 0.0}, len(word))
        return best[-1], np.frombuffer(self.back(word, last, len(word))[1], "<i4")

    # ---- a chunk: s[:n] with up to L - 1 characters of what follows ----

    def cuts(self, s: str, n: int) -> tuple[int, int] | None:
        """The first and last place in the chunk that every path passes: a white
        space mark behind another character, at or behind the entry states."""
        if not self.splits:
            return None
        first = next((m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", s[:n]) if m.start() + 1 >= self.longest - 1), None)
        if first is None:
            return None
        at = n
        while at > first and not (s[at - 1] != SPACE and s[at:at + 1] == SPACE):
            at -= 1
        return first, at

    def exits(self, best: list[float], n: int, final: bool) -> np.ndarray:
        """Scores of the exit states; the end of the document is state 0 alone."""
        out = np.full(self.longest, _LOST)
        own = best[n:n + (1 if final else self.longest)]
        out[:len(own)] = own
        return out

    def matrix(self, s: str, n: int, final: bool, first: bool) -> np.ndarray:
        """Transfer matrix: entry states x exit states. The last chunk alone may
        be shorter than an entry state; it is then never entered there."""
        out = np.full((self.longest, self.longest), _LOST)
        entries = range(1 if first else min(self.longest, n + 1))
        cut = self.cuts(s, n)
        if cut is None:
            for i in entries:
                out[i] = self.exits(self.forward(s, {i: 0.0}, n)[0], n, final)
            return out
        a, b = cut
        rest = self.encode(s[a:b])[0] + self.exits(self.forward(s[b:], {0: 0.0}, n - b)[0], n - b, final)
        for i in entries:
            out[i] = self.forward(s[:a], {i: 0.0}, a)[0][a] + rest
        return out

    def traced(self, s: str, n: int, entry: np.ndarray, exits: list[int]) -> list[tuple[int, float, bytes]]:
        """Backtrace from exit states, given the scores of the entry states:
        (entry state, score of the path, ids)."""
        inside = {i: float(x) for i, x in enumerate(entry) if x > _LOST}
        cut = self.cuts(s, n)
        if cut is None:
            best, last = self.forward(s, inside, n)
            found = [(best[n + j], *self.back(s, last, n + j)) for j in exits]
            return [(start, score - inside[start], ids) if start in inside else (0, _LOST, b"") for score, start, ids in found]
        a, b = cut
        best, last = self.forward(s[:a], inside, a)
        start, head = self.back(s[:a], last, a)
        middle, ids = self.encode(s[a:b])
        tail_best, tail_last = self.forward(s[b:], {0: 0.0}, n - b)
        out = []
        for j in exits:
            at, tail = self.back(s[b:], tail_last, n + j - b)
            reached = at == 0  # an exit state that no piece leads to has no path
            out.append((start, best[a] - inside[start] + middle + tail_best[n + j - b], head + ids + tail)
                       if reached else (0, _LOST, b""))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Pieces of ids joined, one value per range that ``ends`` closes; ids without a piece
        give nothing."""
        known = np.where(ids < len(self.shown), ids, 0)  # id 0 is the unknown piece, which shows nothing
        taken = self.shown.take(pa.array(known.astype(np.int64)))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b"")
        bounds = offsets[np.concatenate([[0], ends])].tolist()
        return [bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


SLIM = "row long, at long, data binary"


def scan(items: DataFrame, start: bytes, product: Callable[[bytes, bytes], bytes], step: Callable[[bytes, bytes], bytes],
         backward: bool = False) -> DataFrame:
    """(row, at, data) -> (row, at, state): ``start`` led by ``step`` through the data before each place of its
    row (behind it, if ``backward``). ``at`` is gapless from 0 in a row. ``product`` of two neighbours, the one that comes
    first first, is associative and steps like both. Depth and size of every task depend on ``SCAN_BLOCK``, not on
    the length of a row."""
    width = SCAN_BLOCK
    state = "row long, at long, state binary"

    def ordered(table: pa.Table) -> tuple[list[int], list[bytes]]:
        table = table.sort_by([("at", "descending" if backward else "ascending")])
        return table.column("at").to_pylist(), table.column("data").to_pylist()

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        _, data = ordered(table)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()),
                         "data": pa.array([reduce(product, data)], pa.binary())})

    def spread(key: tuple, table: pa.Table, above: pa.Table | None = None) -> pa.Table:
        at, data = ordered(table)
        now, out = start if above is None else above.column("state")[0].as_py(), []
        for x in data:
            out.append(now)
            now = step(now, x)
        return pa.table({"row": pa.array([key[0].as_py()] * len(at), pa.int64()), "at": pa.array(at, pa.int64()),
                         "state": pa.array(out, pa.binary())})

    items = materialize(items, "scan")
    longest = items.agg(F.max("at").alias("at")).first()["at"]
    if longest is None or longest < width:
        return items.groupBy("row").applyInArrow(lambda key, table: spread(key, table), state)
    blocks = items.groupBy("row", F.floor(F.col("at") / width).alias("block"))
    above = scan(blocks.applyInArrow(multiply, SLIM), start, product, step, backward)
    above = above.select(F.col("row").alias("of"), F.col("at").alias("in_block"), "state")
    return blocks.cogroup(above.groupBy("of", "in_block")).applyInArrow(spread, state)


CHUNKS = "id long, row long, copies long, chunk long, last long, text string, n long"


def _split(model: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for key, row, copies, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = m.normalize(value)
                count = max(1, -(-len(s) // size))
                for c in range(count):
                    part = s[c * size:(c + 1) * size + m.longest - 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip(
                            (key, row, copies, c, count - 1, part, len(s[c * size:(c + 1) * size])),
                            (pa.int64(),) * 5 + (pa.string(), pa.int64()), strict=True)],
                        names=[f.split()[0] for f in CHUNKS.split(", ")])

    return run


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, part, ids, score): ids as little-endian unsigned 32-bit numbers; a
    document of over ``chunk`` characters gives one row per chunk, in the order of
    ``part``; ``score`` is the sum over the row's pieces.

    A null text gives null ids and score; an empty one no ids; repeated rows and null ids
    are encoded each; an empty table gives no row; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    giant = F.char_length("text") > chunk

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            values = batch.column(1).to_pylist()
            ids, scores = [None] * len(values), [None] * len(values)
            held, room = [], TOGETHER

            def flush() -> None:
                for i, (score, own) in zip(held, m.encode_all([m.normalize(values[i]) for i in held]), strict=True):
                    ids[i], scores[i] = own, score

            for i, value in enumerate(values):
                if value is not None:
                    held.append(i)
                    room -= len(value)
                    if room <= 0:
                        flush()
                        held, room = [], TOGETHER
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([0] * len(ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(scores, pa.float64())],
                names=["doc_id", "part", "ids", "score"])

    schema = "doc_id long, part long, ids binary, score double"
    short = rows.where(F.col("text").isNull() | ~giant).mapInArrow(small, schema)
    return short.union(_encode_giant(rows.where(giant), model, chunk).select("doc_id", "part", "ids", "score"))


def _encode_giant(rows: DataFrame, model: str, size: int) -> DataFrame:
    if size < load(model).longest:
        raise ValueError("a chunk must hold the longest piece")
    # equal rows are encoded once; a hash of the content names a row, the same whenever a task runs
    # again after a lost executor
    keyed = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")).select(
        "id", F.xxhash64("id", "text").alias("row"), "copies", "text")
    chunks = materialize(keyed.mapInArrow(_split(model, size), CHUNKS).repartition("row", "chunk"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            rows = batch.to_pylist()
            data = [m.matrix(r["text"], r["n"], r["chunk"] == r["last"], r["chunk"] == 0).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in ("row", "chunk")]
                                             + [pa.array(data, pa.binary())], names=["row", "at", "data"])

    def matrix(data: bytes) -> np.ndarray:
        length = load(model).longest
        return np.frombuffer(data).reshape(-1, length)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every exit state of a chunk the entry state it comes from."""
        m = load(model)
        for batch in batches:
            rows, data = batch.to_pylist(), []
            for r in rows:
                final = r["chunk"] == r["last"]
                exits = list(range(1 if final else min(m.longest, len(r["text"]) - r["n"] + 1)))
                came = np.zeros(m.longest, np.int64)
                for j, (i, _, _) in zip(exits, m.traced(r["text"], r["n"], np.frombuffer(r["entry"]), exits), strict=True):
                    came[j] = i
                data.append(came.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in ("row", "chunk")]
                                             + [pa.array(data, pa.binary())], names=["row", "at", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            rows, ids, scores = batch.to_pylist(), [], []
            for r in rows:
                state = int(np.frombuffer(r["exit"], np.int64)[0])
                (_, score, own), = m.traced(r["text"], r["n"], np.frombuffer(r["entry"]), [state])
                ids.append(own), scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in rows], pa.int64()) for c in ("id", "chunk", "copies")),
                 pa.array(ids, pa.binary()), pa.array(scores, pa.float64())], names=["doc_id", "part", "copies", "ids", "score"])

    begin = np.full(load(model).longest, _LOST)
    begin[0] = 0.0
    times = lambda a, b: compose(matrix(a), matrix(b)).tobytes()  # noqa: E731 - a vector is a matrix of one row
    entry = scan(chunks.mapInArrow(matrices, SLIM), begin.tobytes(), times, times)
    entered = materialize(chunks.join(entry.select("row", F.col("at").alias("chunk"), F.col("state").alias("entry")), ["row", "chunk"]),
                          "entered")
    # from the end back: a map takes the exit states of what is behind it, so of two neighbours the later one comes first
    through = lambda later, sooner: np.frombuffer(sooner, np.int64)[np.frombuffer(later, np.int64)].tobytes()
    left = scan(entered.mapInArrow(maps, SLIM), np.zeros(1, np.int64).tobytes(), through, through, backward=True)
    state = left.select("row", F.col("at").alias("chunk"), F.col("state").alias("exit"))
    done = entered.join(state, ["row", "chunk"]).mapInArrow(
        finish, "doc_id long, part long, copies long, ids binary, score double")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def decode(encoded: DataFrame, model: str, ids: str = "ids", part: str = "part") -> DataFrame:
    """Add ``decoded`` to a table of ``encode``'s columns: the text of each row
    (null ids: null). The rows of a document, in order, give its text back where
    normalizing changes nothing; the space that encoding sets before a text goes."""

    @F.arrow_udf("string")
    def run(values: pa.Array, parts: pa.Array) -> pa.Array:
        raw = values.to_pylist()
        ids = np.frombuffer(b"".join(x or b"" for x in raw), "<u4")
        found = load(model).decode(ids, np.cumsum([len(x or b"") // 4 for x in raw], dtype=np.int64))
        out = []
        for x, text, p in zip(raw, found, parts.to_pylist(), strict=True):
            text = text.decode("utf-8", "replace")  # bytes that are no UTF-8 show as U+FFFD
            out.append(None if x is None else text[1:] if p == 0 and text.startswith(" ") else text)
        return pa.array(out, pa.string())

    return encoded.withColumn("decoded", run(F.col(ids), F.col(part)))
