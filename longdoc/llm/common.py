"""Helpers the operators share: table access, materialised steps, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.session import scratch_path

#: Ids up to this count are small enough to broadcast (8 bytes each, so 16 MB).
BROADCAST_IDS = 2_000_000
#: Texts are split into words this many bytes at a time.
SPLIT_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with
    a table that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores in front as it takes to be names that no column has in any case."""
    taken = {c.lower() for c in columns}
    lead = ""
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes blocks and buckets, never cuts anything."""
    return docs.select(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def semi_join_ids(df: DataFrame, on: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in the one-column materialised ``ids``
    (same column name): by broadcast only while the counted ids are few, by a
    shuffle join beyond that."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` over all shuffle partitions. For tiles: they are small in bytes and
    large in work, so adaptive execution would put too many into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def byte_slices(data: bytes, size: int = SPLIT_BYTES) -> Iterator[bytes]:
    """Consecutive slices of about ``size`` bytes that end before a separator,
    so that no word is cut (a longer run without separators stays whole)."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def split_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` cuts at exactly these bytes."""
    return data.split()


def word_hashes(data: bytes) -> np.ndarray:
    """(n_words, 2) uint64: a 128-bit hash of every word."""
    parts = [np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, split_words(s))), dtype="<u8")
             for s in byte_slices(data)]
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return flat.reshape(-1, 2)


def window_hash(h: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values of the uint64 array
    ``h``, mod 2^64, by doubling: log2(k) passes instead of k."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, width, block, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        bits = k
        while bits:
            if bits & 1:
                if out is None:
                    out, width = block, size
                else:  # out covers the first `width` values, block the next `size`
                    m = np.uint64(pow(multiplier, size, 1 << 64))
                    tail = block[width:]
                    out = out[:len(tail)] * m + tail[:len(out)]
                    width += size
            bits >>= 1
            if bits:
                m = np.uint64(pow(multiplier, size, 1 << 64))
                block = block[:-size] * m + block[size:]
                size *= 2
    return mix(out[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads the polynomial hash over all 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order: numpy's sort is many times as fast as its unique."""
    x = np.sort(x)
    return x[run_starts(x)]


def as_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")
