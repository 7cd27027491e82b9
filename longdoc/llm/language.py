"""Operator 4, language identification: multinomial naive Bayes over hashed
character n-grams.

The model is a matrix of log probabilities (n-gram slots x languages). It is fitted
on at most ``TRAIN_DOCS`` labelled documents per language, drawn by a hash of the
doc_id; their n-grams are counted by Spark. The matrix (``SLOTS`` x languages, 4
bytes each) is broadcast. Scoring takes whole texts, many at a time, in numpy: a
gather of matrix rows for the n-grams that occur, summed per document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the character n-grams.
ORDERS = (2, 3)
#: Slots that n-grams are hashed into.
SLOTS = 1 << 16
#: Bound of the training sample: documents per language.
TRAIN_DOCS = 4000
#: Bound of the model: languages (the labels are few; more raise an error). Their log matrix, and what reaches the
#: driver, has 4 * SLOTS bytes a language: 64 MB at most.
MAX_LANGUAGES = 256
#: Added to every count.
SMOOTHING = 0.5
#: Code points scored at a time.
SLICE = 1 << 20
UNKNOWN = "und"

_ALPHABETIC = re.compile(r"[^\W\d_]")
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray  # log, per language
    weight: np.ndarray  # log, SLOTS x languages


def code_points(text: str) -> np.ndarray:
    """Code points in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def ngram_slots(codes: np.ndarray) -> np.ndarray:
    """Slots of all n-grams: for each order those that start at each position."""
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i:len(codes) - n + 1 + i].astype(np.uint32)) * _MUL[i % len(_MUL)]
                h ^= h >> np.uint32(15)
            out.append((h * _MUL[0]) >> shift)
    return np.concatenate(out)


def slices(text: str) -> Iterator[np.ndarray]:
    """Slots of all n-grams of a whole text, about ``SLICE`` code points at a time."""
    codes, overlap = code_points(text), max(ORDERS) - 1
    for at in range(0, max(1, len(codes)), SLICE):
        part = codes[at:at + SLICE + overlap]
        if at + SLICE >= len(codes):
            yield ngram_slots(part)
        else:  # those that begin in the slice; the next one has the others
            slots, first, keep = ngram_slots(part), 0, []
            for n in ORDERS:
                size = max(0, len(part) - n + 1)
                keep.append(slots[first:first + min(size, SLICE)])
                first += size
            yield np.concatenate(keep)


def log_likelihoods(texts: list[str], weight: np.ndarray) -> np.ndarray:
    """(texts, languages) summed log probabilities. The texts of a batch are the rows of one sparse matrix
    of n-gram slots, which is multiplied by the dense one of the model about ``SLICE`` entries at a time."""
    out = np.zeros((len(texts), weight.shape[1]))
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def multiply() -> None:
        nonlocal held
        if parts:
            begin = np.cumsum([0] + [len(x) for x in parts[:-1]])
            sums = np.add.reduceat(weight[np.concatenate(parts)], begin, axis=0, dtype=np.float64)
            np.add.at(out, rows, sums)
            rows.clear(), parts.clear()
            held = 0

    for i, text in enumerate(texts):
        for slots in slices(text):
            if len(slots):
                rows.append(i), parts.append(slots)
                held += len(slots)
                if held >= SLICE // 4:
                    multiply()
    multiply()
    return out


def log_likelihood(text: str, weight: np.ndarray) -> np.ndarray:
    return log_likelihoods([text], weight)[0]


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L is in the text (signs for numbers are alphabetic in Python's
    patterns, but no letters)."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _ALPHABETIC.finditer(text))


def held_out(doc_id: Column) -> Column:
    """Documents that never train: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a hash sample of at most about ``train_docs`` documents of each
    language (in expectation; the sample is exact when a language has fewer).

    Rows with a null text or language don't train. Without any training row the
    model has no language, and every text is ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                           F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.empty(0), np.empty((SLOTS, 0), np.float32))
    share = spark.createDataFrame([(x, min(1.0, train_docs / sizes[x])) for x in languages], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(draw < F.col("share"))

    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(place), SLOTS), np.int64)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table[place[name]] += np.bincount(ngram_slots(code_points(value)), minlength=SLOTS)
        which, slot = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(slot, pa.int64()),
                                          pa.array(table[which, slot], pa.int64())], names=["which", "slot", "n"])

    def column(key: tuple, rows: pa.Table) -> pa.Table:
        """The log probabilities of a language."""
        table = np.full(SLOTS, SMOOTHING)
        table[rows.column("slot").to_numpy()] += rows.column("n").to_numpy()
        return pa.table({"which": pa.array([key[0].as_py()], pa.int64()),
                         "weight": pa.array([np.log(table / table.sum()).astype("<f4").tobytes()], pa.binary())})

    counts = (sample.select("lang", "text").mapInArrow(count, "which long, slot long, n long")
              .groupBy("which", "slot").agg(F.sum("n").alias("n")))
    weight = np.full((SLOTS, len(languages)), np.float32(-np.log(SLOTS)))  # of a language without an n-gram
    for r in counts.groupBy("which").applyInArrow(column, "which long, weight binary").toLocalIterator():
        weight[:, r["which"]] = np.frombuffer(r["weight"], "<f4")
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return Model(languages, prior, weight)


def predictor(spark: SparkSession, model: Model):
    """Text column -> struct(lang_pred, score): the most probable language and its
    posterior probability. Null and letterless texts are ``und`` with score 0; a tie
    goes to the first language in order."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m, values = shared.value, texts.to_pylist()
        names, scores = [UNKNOWN] * len(values), [0.0] * len(values)
        known = [i for i, x in enumerate(values) if x is not None and has_letter(x)] if m.languages else []
        for i, row in zip(known, m.prior + log_likelihoods([values[i] for i in known], m.weight), strict=True):
            best = int(np.argmax(row))
            names[i] = m.languages[best]
            scores[i] = float(1.0 / np.exp(row - row[best]).sum())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang_pred", "score"])

    return predict.asNondeterministic()  # else a filter on the result would run it twice


def identify(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """The language of every whole text of ``docs``, learnt from ``labelled``.

    Returns doc_id, lang_pred, score per row of ``docs``. Null, empty and letterless
    texts are ``und``; repeated rows are scored each; an empty table gives an empty
    result; only id and text of ``docs`` are read.
    """
    predict = predictor(docs.sparkSession, fit(labelled, doc_id, text, lang))
    found = docs.select(F.col(doc_id).alias("doc_id"), predict(F.col(text)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
