"""Operator 6, document fingerprints of closed syncmers, in DataFrame functions only.

A text is a sequence of units (runs of up to ``UNIT`` characters that are not white space). Of
every ``K`` consecutive units the hashes of the inner ``S``-unit substrings
are compared; the k-mer is a closed syncmer when its smallest one lies at
an edge, at the first or last place. Whether a k-mer is chosen depends on
nothing but itself, so two texts that share a passage share its anchors wherever it
stands. ``anchors`` lists them with their positions for matching; the
fingerprint keeps the ``SIZE`` smallest distinct anchor hashes, and the
likeness of two fingerprints estimates the Jaccard similarity of the anchor sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longdoc.llm.common import materialize

UNIT = 16
#: Units of a k-mer and of its inner substrings. The expressions below are
#: written out for the K - S + 1 = 4 inner substrings of a k-mer.
K, S = 5, 2
#: Anchors that a fingerprint keeps.
SIZE = 64
#: Stands for a null doc_id (and is read as one).
NULL_KEY = -(1 << 63)


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([^\s]{{1,{UNIT}}})"), F.lit(1))


def _unit_hashes(text: Column) -> Column:
    return F.transform(units(text), lambda u: F.xxhash64(u))


def _to_int(h: Column) -> Column:
    """32 bits of a hash, in the order of unsigned numbers."""
    return (h.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")


def _shifted(x: Column, by: int, less: int) -> Column:
    """``x`` without its first ``by`` items, ``less`` items shorter in all."""
    return F.slice(x, by + 1, F.greatest(F.size(x) - less, F.lit(0)))


def _inner(h: Column) -> Column:
    """Hashes of all S-unit substrings."""
    return F.zip_with(_shifted(h, 0, 1), _shifted(h, 1, 1), lambda a, b: F.xxhash64(a, b))


def _chosen(z: Column) -> Column:
    """Per k-mer: its hash when it is a closed syncmer, else null."""
    cut = K - S
    edges = F.arrays_zip(*[_shifted(z, i, cut).alias(f"z{i}") for i in range(cut + 1)])
    return F.transform(edges, lambda e: F.when(
        F.least(e["z0"], e["z3"]) <= F.least(e["z1"], e["z2"]),
        _to_int(F.xxhash64(e["z0"], e["z1"], e["z3"]))))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: per k-mer its anchor hash (int) or null. A text without a chosen k-mer
    (of fewer than K units, or by chance of K or K + 1) has one anchor, the hash of all
    its units; without units the array is empty."""
    h, z, c = f"__h_{out}", f"__z_{out}", f"__c_{out}"
    hashed = df.withColumn(h, _unit_hashes(F.coalesce(F.col(text), F.lit(""))))
    inner = hashed.withColumn(z, _inner(F.col(h)))
    chosen = inner.withColumn(c, _chosen(F.col(z)))
    short = F.when(F.size(h) > 0, F.array(_to_int(F.xxhash64(F.col(h))))).otherwise(F.array().cast("array<int>"))
    return chosen.withColumn(out, F.when(F.exists(c, lambda x: x.isNotNull()), F.col(c)).otherwise(short)).drop(h, z, c)


def sketch(chosen: Column) -> Column:
    """The SIZE smallest distinct anchors."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(chosen, lambda x: x.isNotNull()))), 1, SIZE)


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per anchor."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the SIZE smallest anchors of both that are in both: 1 for equal
    fingerprints (two empty ones too), 0 for disjoint ones."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(F.array_intersect(smallest, a), b))
    return F.when(F.size(smallest) == 0, F.lit(1.0)).otherwise(both / F.size(smallest))


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, anchor, position): every anchor of every text with the number of
    its first unit, for positional matching."""
    rows = with_anchors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "chosen")
    return (rows.select("doc_id", F.posexplode("chosen").alias("position", "anchor"))
            .where(F.col("anchor").isNotNull()).select("doc_id", "anchor", "position"))


def match_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shift, n_anchors): anchors that two anchor tables share,
    counted by how far the passage has moved. Only anchors that occur once in each
    text are matched, as a repeated one has no single position."""
    once = [t.groupBy("doc_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
            .where("n = 1").select("anchor", F.col("doc_id").alias(f"{side}_id"), F.col("position").alias(f"{side}_at"))
            for side, t in (("left", left), ("right", right))]
    return (once[0].join(once[1], "anchor")
            .groupBy("left_id", "right_id", (F.col("right_at") - F.col("left_at")).alias("shift"))
            .agg(F.count(F.lit(1)).alias("n_anchors")))


def successors(ids: DataFrame) -> DataFrame:
    """One column of distinct ids -> (k, next): the next smaller id, after the
    smallest the largest. The ids are range-partitioned; the ends of the ranges, of
    which there are as many as partitions, are joined up by a second small window."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.select(F.col(ids.columns[0]).alias("k"))
                         .repartitionByRange(parts, F.desc("k")).withColumn("part", F.spark_partition_id()), "order")
    heads = ranged.groupBy("part").agg(F.max("k").alias("head"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(ring), F.max("head").over(whole)).alias("next_head"))
    inside = ranged.withColumn("inner", F.lead("k").over(Window.partitionBy("part").orderBy(F.desc("k"))))
    return inside.join(F.broadcast(heads), "part").select("k", F.coalesce("inner", "next_head").alias("next"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last
    floor(n/3) code points replaced by the first as many (or all) of the next
    document in descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; a null doc_id comes after all
    others in the order; of rows that repeat a doc_id each gets its own result, and
    the one with the smallest text stands for them as the next document; a
    single document is its own next one; an empty table gives an empty result;
    other columns are not read.
    """
    # a null id is the smallest key; both joins below read the same two columns, so
    # that the texts are shuffled once
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_KEY))
    rows = docs.select(key.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    need = rows.groupBy("k").agg(F.max(third).alias("need"))
    ring = successors(need.select("k"))
    # what each document must hand to the one before it
    wanted = need.join(ring, "k").select(F.col("k").alias("to"), F.col("next").alias("k"), "need")
    given = with_anchors(rows.join(wanted, "k"), "text", "__next")
    given = given.select(F.col("to").alias("k"), F.substring("text", F.lit(1), F.col("need")).alias("piece"),
                         sketch(F.col("__next")).alias("next_fp"))
    given = given.groupBy("k").agg(F.min(F.struct("piece", "next_fp")).alias("given"))

    both = rows.join(given, "k").select(F.nullif("k", F.lit(NULL_KEY)).alias("doc_id"), "text", F.col("given.piece").alias("piece"),
                                        F.col("given.next_fp").alias("next_fp"))
    both = both.withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("cut")),
                                              F.substring("piece", F.lit(1), F.col("cut"))))
    both = with_anchors(both, "text", "__own").withColumn("fp", sketch(F.col("__own"))).drop("__own", "text", "piece")
    both = with_anchors(both, "edited", "__edited").withColumn("edited_fp", sketch(F.col("__edited"))).drop("__edited")
    return both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
