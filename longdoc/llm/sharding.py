"""Operator 2, sharding by a two-pass external shuffle.

Pass 1 scatters the records over buckets of ``BUCKET_BYTES`` by seeded hashes:
the shard by rendezvous hashing of (seed, doc_id, shard), the bucket in the shard by a
hash of the seed and the whole record. Pass 2 shuffles each bucket in memory by
Fisher-Yates, seeded by the bucket, and writes it. Buckets in order, and records
in order within them, are the shuffled shard.

The ``key`` law holds: doc_id and the number of shards decide the shard. With one
more shard a record stays or goes to the new one, as rendezvous hashing gives
each record the shard of its largest hash.

Every choice is a function of seed and record, never of arrival order or of the
number of partitions, so a task that runs again after a lost executor
gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.llm.common import fresh
from longdoc.session import scratch_path

SHARDS = 24
SEED = 42
#: Bytes of a bucket: what one task holds at a time. A bucket that repeated
#: records swell further is shuffled in runs of this size.
BUCKET_BYTES = 16 << 20
#: Size of a record besides its text.
RECORD_BYTES = 8

OWN = ("shard", "bucket", "run", "place", "grown_shard")


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the largest hash (a tie: the larger
    shard). A null doc_id hashes like any other value."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
        F.xxhash64(F.lit(seed), doc_id, s).alias("h"), s.alias("s"))))["s"]


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _shuffle_buckets(shard_at: int, bucket_at: int, size_at: int, seed: int):
    """Rows sorted by (shard, bucket, hash) -> each bucket in Fisher-Yates order."""

    def fisher_yates(rows: pa.Table, shard: int, bucket: int, run: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        rng = np.random.default_rng([seed, shard, bucket, run])
        order = list(range(n))
        draws = rng.integers(0, np.arange(n, 0, -1)) if n else []
        for i in range(n - 1):  # swap the last open place with a drawn one
            last, j = n - 1 - i, int(draws[i])
            order[last], order[j] = order[j], order[last]
        out = rows.take(pa.array(order, pa.int64()))
        out = out.append_column("run", pa.array(np.full(n, run, np.int64))).append_column(
            "place", pa.array(np.arange(n, dtype=np.int64)))
        yield from out.combine_chunks().to_batches(max_chunksize=1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes, current, runs = 0, None, 0

        def release() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_bytes, runs
            if held:
                rows, held, held_bytes = pa.Table.from_batches(held), [], 0
                yield from fisher_yates(rows, *current, runs)
                runs += 1

        for batch in batches:
            shard, bucket = (batch.column(i).to_numpy() for i in (shard_at, bucket_at))
            size = batch.column(size_at).to_numpy()
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for i, j in zip(np.r_[0, new], np.r_[new, batch.num_rows], strict=True):
                i, j = int(i), int(j)
                if i == j:
                    continue
                key = (int(shard[i]), int(bucket[i]))
                if key != current:
                    yield from release()
                    current, runs = key, 0
                while i < j:  # up to the bucket's bound
                    fit = int(np.searchsorted(np.cumsum(size[i:j]), 2 * BUCKET_BYTES - held_bytes, side="right"))
                    fit = max(fit, 0 if held else 1)
                    if fit:
                        held.append(batch.slice(i, fit))
                        held_bytes += int(size[i:i + fit].sum())
                        i += fit
                    if i < j:
                        yield from release()
        yield from release()

    return run


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id",
                 text: str = "text") -> T.StructType:
    """Shuffle ``docs`` into ``shards`` shards below ``path`` (Parquet, one folder
    per shard): the columns of ``docs`` and shard, bucket, run, place,
    grown_shard. (bucket, run, place) orders a shard. Returns the schema to read
    the folder with.

    Null texts have no bytes; null doc_ids share a shard; repeated rows are all
    kept (equal records share a bucket); an empty table writes no row. Columns
    of ``docs`` that are named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in OWN]
    total = docs.select(F.sum(record_size(F.col(text))).alias("b")).first()["b"] or 0
    buckets = max(1, round(total / shards / BUCKET_BYTES))
    key = F.col(doc_id)
    # null-safe: an id that is null hashes as the text 'null' beside the seed
    ident = F.coalesce(key.cast("string"), F.lit("null"))
    shard, grown, hashed, size, bucket = fresh(kept, "shard_", "grown_", "hash_", "size_", "bucket_")
    rows = docs.select(*kept, shard_of(ident, shards, seed).alias(shard),
                       shard_of(ident, shards + 1, seed).alias(grown),
                       F.xxhash64(F.lit(seed), ident, F.col(text)).alias(hashed), record_size(F.col(text)).alias(size))
    rows = rows.withColumn(bucket, F.pmod(F.shiftright(hashed, 16), F.lit(buckets)).cast("long"))
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards * buckets, 1 << 16))
    dealt = rows.repartition(tasks, shard, bucket).sortWithinPartitions(shard, bucket, hashed)
    schema = T.StructType([*dealt.schema.fields, T.StructField("run", T.LongType()), T.StructField("place", T.LongType())])
    at = dealt.columns.index
    placed = dealt.mapInArrow(_shuffle_buckets(at(shard), at(bucket), at(size), seed), schema)
    out = placed.select(*kept, F.col(bucket).alias("bucket"), "run", "place",
                        F.col(grown).alias("grown_shard"), F.col(shard).alias("shard"))
    out.write.partitionBy("shard").parquet(path)
    return out.schema


def read_shards(spark: SparkSession, path: str, schema: T.StructType, columns: list[Column]) -> DataFrame:
    """The written shards: ``columns`` and shard, grown_shard and slot (gapless
    from 0 in each shard). Slots come from the buckets' counted rows, of which
    there are few per shard."""
    rows = spark.read.schema(schema).parquet(path)
    cell = ["shard", "bucket", "run"]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (rows.select(*columns, *cell, "place", "grown_shard").join(first, cell)
            .withColumn("slot", F.col("first") + F.col("place")).drop("bucket", "run", "place", "first"))


def shard_path(spark: SparkSession) -> str:
    return scratch_path(spark, "llm", f"shards-{uuid.uuid4().hex}")
