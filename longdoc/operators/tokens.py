"""Vocabulary and tokenizer.

The pretrained subword tokenizer of the reference is not available, so the
built-in tokenizer is a whitespace tokenizer that loses no word:

* C0 ``build_vocab``: the ``size`` most frequent pieces get ids of their own, by
  (count desc, token asc), after the special and byte ids. The table handed to
  every task is bounded by ``size``, which decides the compression only.
* C1/C2 ``tokenize``: a piece of the vocabulary is its id; any other piece is spelled
  as WORD and its UTF-8 bytes. EOS is appended; with ``max_len`` the ids are cut to
  ``max_len - 1`` and EOS is kept inside the limit.
* C6 ``decode``: the words back, in order; the decoded text of uncut ids is the
  text's words joined by a space.

Lookup and spelling run row-locally inside an Arrow UDF, so tokenizing needs no
shuffle. The vocabulary reaches the tasks as a Parquet table in the shared folder,
the way a tokenizer file would; it never passes through the driver. Flows take any
object with the two methods of ``VocabTokenizer`` in its place.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.constants import (EOS, FIRST_BYTE_ID, FIRST_PIECE_ID, FIRST_REAL_ID,
                               SPECIAL_TOKENS, VOCAB_SIZE, WORD, WS_REGEX)
from longdoc.functions.byte_bpe import byte_of, load_encoder
from longdoc.functions.parts import by_parts
from longdoc.session import scratch_path


def pieces(col) -> Column:
    """Tokenizer pieces: special token strings stand alone, then whitespace split."""
    c = F.col(col) if isinstance(col, str) else col
    spaced = F.regexp_replace(c, "(<pad>|</s>|<unk>)", " $1 ")
    return F.filter(F.split(spaced, WS_REGEX), lambda t: t != "")


def build_vocab(df: DataFrame, col: str = "text", size: int = VOCAB_SIZE) -> DataFrame:
    """(token, token_id, cnt). Pieces are counted by Arrow batch, then by Spark; the bound is a top-``size`` (TakeOrderedAndProject), so the ranked set that is
    numbered afterwards is bounded by ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = split_pieces(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "cnt"])

    counts = (df.select(F.col(col).cast("string").alias("text")).mapInArrow(run, "token string, cnt long")
              .where(~F.col("token").isin(*SPECIAL_TOKENS))
              .groupBy("token").agg(F.sum("cnt").alias("cnt")))
    top = counts.orderBy(F.col("cnt").desc(), F.col("token").asc()).limit(size)
    w = Window.orderBy(F.col("cnt").desc(), F.col("token").asc())
    return top.select("token",
                      (F.row_number().over(w) + (FIRST_PIECE_ID - 1)).cast("int").alias("token_id"),
                      F.col("cnt").cast("bigint").alias("cnt"))


def materialize_vocab(spark: SparkSession, vocab: DataFrame, key: str) -> str:
    """Write the (bounded) vocabulary once to the shared folder; reuse it after."""
    path = scratch_path(spark, "vocab", hashlib.sha1(key.encode()).hexdigest()[:16])
    if not _exists(spark, path + "/_SUCCESS"):
        vocab.select("token", "token_id").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def corpus_vocab(spark: SparkSession, df: DataFrame, col: str, key: str,
                 size: int = VOCAB_SIZE) -> str:
    return materialize_vocab(spark, build_vocab(df, col, size), f"{key}|{col}|{size}|v2")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


# ---- task side -----------------------------------------------------------

_VOCAB_CACHE: dict = {}
_VOCAB_LOCK = threading.Lock()


def _load_vocab(path: str) -> tuple[dict, pa.Array]:
    """(piece -> id, bytes that each id decodes to); read once per worker."""
    with _VOCAB_LOCK:
        hit = _VOCAB_CACHE.get(path)
        if hit is not None:
            return hit
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        if "://" in path:
            fs, rel = pafs.FileSystem.from_uri(path)
        else:
            fs, rel = pafs.LocalFileSystem(), path[len("file:"):] if path.startswith("file:") else path
        t = pq.read_table(rel, columns=["token", "token_id"], filesystem=fs).sort_by("token_id")
        ids = t.column("token_id").to_numpy()
        if len(ids) and (ids[0] != FIRST_PIECE_ID or ids[-1] != FIRST_PIECE_ID + len(ids) - 1):
            raise ValueError(f"vocabulary ids not contiguous in {path}")
        tokens = t.column("token").to_pylist()
        table = {tok: FIRST_PIECE_ID + i for i, tok in enumerate(tokens)}
        table.update({tok: i for i, tok in enumerate(SPECIAL_TOKENS)})
        # specials give nothing, WORD a space, a byte itself, a piece a space and its text
        shown = ([b""] * len(SPECIAL_TOKENS) + [b" "] + [bytes([i]) for i in range(256)]
                 + [b" " + tok.encode() for tok in tokens])
        _VOCAB_CACHE[path] = table, pa.array(shown, pa.binary())
        return _VOCAB_CACHE[path]


_BLANK = np.zeros(256, bool)
_BLANK[[ord(x) for x in " \t\n\r"]] = True


def split_pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, row of each, bytes of each, all their bytes) of an Arrow batch of texts, as ``pieces`` has them: special strings set
    apart, cut at [ \t\n\r]+. The texts' bytes are cut by one pass of numpy; no regular expression runs but on rows with special strings."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    special = pc.match_substring(text, SPECIAL_TOKENS[0])
    for token in SPECIAL_TOKENS[1:]:
        special = pc.or_(special, pc.match_substring(text, token))
    if pc.any(special).as_py():
        spaced = pc.replace_substring_regex(text.filter(special), pattern="(<pad>|</s>|<unk>)", replacement=" \\1 ")
        text = pc.replace_with_mask(text, special, spaced)
    text = text.cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    solid = ~_BLANK[data]
    first = np.ones(len(data), bool)
    first[1:] = ~solid[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True
    first &= solid
    at = np.flatnonzero(first)
    rows = np.searchsorted(ends, at, side="right") - 1
    size = np.add.reduceat(solid, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
    data = data[solid]
    if len(data) >= 1 << 31:
        raise ValueError("a batch of over 2 GB of text")
    begins = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=begins[1:])
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(begins), pa.py_buffer(data)]), rows, size, data


def _split_lookup(text: pa.Array, table: dict) -> pa.Array:
    """Pieces and ids in Arrow and numpy; pieces outside ``table`` spelled."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    kept, krows, size, data = split_pieces(text)
    coded = kept.dictionary_encode()
    of_piece = np.array([table.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], dtype=np.int64)
    piece = of_piece[coded.indices.to_numpy(zero_copy_only=False)] if len(kept) else np.empty(0, np.int64)
    spelled = piece < 0
    width = np.ones(len(piece), np.int64)
    n_bytes = size[spelled]
    width[spelled] += n_bytes
    ends = np.cumsum(width)
    starts = ends - width
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    ids[starts] = np.where(spelled, WORD, piece)
    if len(n_bytes):
        raw = data[np.repeat(spelled, size)]
        inside = np.arange(len(raw)) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
        ids[np.repeat(starts[spelled] + 1, n_bytes) + inside] = raw.astype(np.int32) + FIRST_BYTE_ID
    counts = np.bincount(krows, weights=width, minlength=len(text)) if len(krows) else np.zeros(len(text))
    offsets = np.zeros(len(text) + 1, dtype=np.int32)
    offsets[1:] = np.cumsum(counts)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=text.is_null())


def _lookup_udf(path: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def token_ids(text: pa.Array) -> pa.Array:
        table = _load_vocab(path)[0]
        return by_parts(lambda part: _split_lookup(part, table), text)

    # non-deterministic: keeps Catalyst from copying the call into pushed-down
    # filters (which would tokenize every document twice)
    return token_ids.asNondeterministic()


def token_ids(col, vocab_path: str) -> Column:
    """Pieces -> ids, without EOS; a piece outside the vocabulary is spelled."""
    c = F.col(col) if isinstance(col, str) else col
    return _lookup_udf(vocab_path)(c)


def tokenize(col, vocab_path: str, max_len: int | None = None) -> Column:
    """C1 (``max_len`` set) / C2 (``max_len`` None): ids with a trailing EOS."""
    ids = token_ids(col, vocab_path)
    if max_len is not None:
        ids = F.slice(ids, 1, max_len - 1)
    return F.concat(ids, F.array(F.lit(EOS)))


def _shown_text(ids: pa.Array, shown: pa.Array) -> pa.Array:
    flat = pc.list_flatten(ids).cast(pa.int64())
    # an id outside this vocabulary is dropped, like UNK
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(shown)))
    kept_rows = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False)[inside.to_numpy(zero_copy_only=False)]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum(np.bincount(kept_rows, minlength=len(ids)), out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pc.take(shown, pc.filter(flat, inside)), mask=ids.is_null())
    # a chunk border can cut a spelled character: its bytes go
    return pa.array([None if x is None else " ".join(w for w in x.decode("utf-8", "ignore").split(" ") if w)
                     for x in pc.binary_join(lists, b"").to_pylist()], pa.string())


def _decode_udf(path: str):
    @F.arrow_udf(T.StringType())
    def decode_text(ids: pa.Array) -> pa.Array:
        shown = _load_vocab(path)[1]
        return by_parts(lambda part: _shown_text(part, shown), ids)

    return decode_text.asNondeterministic()


def decode(ids, vocab_path: str, clean: bool = True, strip_special: bool = True) -> Column:
    """Ids -> text. Words are joined by a space, then the space before . , ! ?
    is removed (our clean-up rule; ``clean=False`` keeps the words as they are).
    Special ids (PAD, EOS, UNK) give nothing, or with ``strip_special=False`` their
    strings. Row-local: a ``take`` on the vocabulary, no join or shuffle."""
    c = F.col(ids) if isinstance(ids, str) else ids
    if strip_special:
        text = _decode_udf(vocab_path)(F.filter(c, lambda x: x >= FIRST_REAL_ID))
    else:
        text = _decode_udf(vocab_path)(F.flatten(F.transform(c, _spell_special)))
    return F.regexp_replace(text, r" ([.,!?])", "$1") if clean else text


def _spell_special(x: Column) -> Column:
    spelled = F.array(x)
    for i, tok in enumerate(SPECIAL_TOKENS):
        spelled = F.when(x == i, F.array(*[F.lit(v) for v in (WORD, *(b + FIRST_BYTE_ID for b in tok.encode()))])).otherwise(spelled)
    return spelled


class VocabTokenizer:
    """The built-in tokenizer as flows take it: ``encode`` and ``decode`` columns."""

    def __init__(self, vocab_path: str):
        self.vocab_path = vocab_path

    def encode(self, col, max_len: int | None = None) -> Column:
        return tokenize(col, self.vocab_path, max_len)

    def decode(self, ids) -> Column:
        return decode(ids, self.vocab_path)


class UserTokenizer:
    """H1: a tokenizer of the caller's. ``encoder()`` makes a callable list[str] ->
    list[list[int]] (ids ending in EOS), ``decoder()`` one list[list[int]] -> list[str];
    each is made once per task and called on Arrow batches."""

    def __init__(self, encoder, decoder, eos: int = EOS):
        self.encoder, self.decoder, self.eos = encoder, decoder, eos

    def encode(self, col, max_len: int | None = None) -> Column:
        return tokenize_with(col, self.encoder, max_len, self.eos)

    def decode(self, ids) -> Column:
        factory = self.decoder

        @F.pandas_udf(T.StringType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fn = factory()
            for s in batches:
                yield pd.Series(fn([[] if x is None else list(x) for x in s]), dtype="object")

        return run(F.col(ids) if isinstance(ids, str) else ids)


@lru_cache(maxsize=4)
def _load_subwords(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=4)
def _load_bytes(path: str):
    """(encoding, bytes that each id decodes to) of a byte-level BPE file whose text is cut by the usual pattern only and whose merges are in
    the order of its ids, so that ids rank them; None for any other file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, to_byte = spec["model"], spec.get("pre_tokenizer") or {}, byte_of()
    plain = (model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
             and (spec.get("decoder") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and all(t.get("special") for t in spec["added_tokens"]))
    if not plain:
        return None
    special, vocab = {t["content"]: t["id"] for t in spec["added_tokens"]}, model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    ordinary = set(vocab) - set(special)
    if (merged != sorted(set(merged)) or not set(to_byte) <= ordinary or any(c not in to_byte for t in ordinary for c in t)
            or len(pairs) != sum(len(t) > 1 for t in ordinary) or max(vocab[c] for c in to_byte) > min(merged, default=1 << 31)):
        return None
    ids = vocab | special
    shown = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        shown[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
    return load_encoder(path), pa.array(shown, pa.large_binary())


class SubwordTokenizer:
    """H1 with a public subword vocabulary: a ``tokenizer.json`` that every task can read at ``path``. Ids are the file's own
    from ``FIRST_PIECE_ID`` on, so PAD, EOS and the other special ids keep their places and each subword is a term of the sparse
    search; every text ends with EOS. A null text gives a null array, an empty one EOS alone. With a byte-level vocabulary decoding gives
    the text back exactly. Plain byte-level BPE files are encoded by tiktoken and decoded by a take on their bytes; any other file by its library."""

    def __init__(self, path: str, eos: int = EOS):
        self.path, self.eos = path, eos

    def encode(self, col, max_len: int | None = None) -> Column:
        path = self.path

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def run(texts: pa.Array) -> pa.Array:
            if plain := _load_bytes(path):
                each = [plain[0].encode_to_numpy(x, disallowed_special=()) for x in pc.fill_null(texts, "").to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in each]).astype(np.int32)
                ids = np.concatenate([np.empty(0, np.uint32), *each]).astype(np.int32) + FIRST_PIECE_ID
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), mask=texts.is_null())
            coded = _load_subwords(path).encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
            ends = np.cumsum([0] + [len(x.ids) for x in coded]).astype(np.int32)
            ids = np.fromiter((i for x in coded for i in x.ids), np.int32, int(ends[-1])) + FIRST_PIECE_ID
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), mask=texts.is_null())

        ids = run.asNondeterministic()(F.col(col) if isinstance(col, str) else col)
        return F.concat(ids if max_len is None else F.slice(ids, 1, max_len - 1), F.array(F.lit(self.eos)))

    def decode(self, ids) -> Column:
        path = self.path

        @F.arrow_udf(T.StringType())
        def run(values: pa.Array) -> pa.Array:
            if plain := _load_bytes(path):
                ids = pc.subtract(pc.list_flatten(values).cast(pa.int64()), FIRST_PIECE_ID)
                known = pc.less(ids, len(plain[1])).to_numpy(zero_copy_only=False)
                rows = pc.list_parent_indices(values).to_numpy(zero_copy_only=False)[known]
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(values)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), plain[1].take(ids.filter(pa.array(known))))
                return pa.array([x.decode("utf-8", "replace") for x in pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()], pa.string())
            return pa.array(_load_subwords(path).decode_batch([[i - FIRST_PIECE_ID for i in x or []] for x in values.to_pylist()],
                                                              skip_special_tokens=False), pa.string())

        c = F.col(ids) if isinstance(ids, str) else ids
        return run.asNondeterministic()(F.filter(c, lambda x: x >= FIRST_PIECE_ID))


def tokenize_with(col, factory, max_len: int | None = None, eos: int = EOS) -> Column:
    """C1/C2 with a user tokenizer (the reference injects its own): ``factory()``
    returns a callable list[str] -> list[list[int]] (ids ending in EOS, as
    the pretrained tokenizer does); it is built once per task in an iterator
    pandas UDF and called on whole Arrow batches. ``max_len`` truncates and
    keeps EOS inside the limit."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for s in batches:
            out = []
            for ids in fn(s.fillna("").tolist()):
                ids = list(ids)
                if max_len is not None and len(ids) > max_len:
                    ids = ids[:max_len - 1] + [eos]
                out.append(ids)
            yield pd.Series(out)

    c = F.col(col) if isinstance(col, str) else col
    return run(c)
