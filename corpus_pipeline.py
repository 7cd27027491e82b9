"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns the columns of ``documents``; the last one returns the packed pieces. ``run``
writes what a stage returns to the shared folder and hands the next one the
written table, so a lost executor repeats tasks of one stage at most.

Rows with nulls stay wherever they can: a null text has no language and goes in
the first stage; a null doc_id is never a duplicate and loses no words. An empty table
passes through; more columns of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.llm import language, minhash, packing, substring
from longdoc.llm.common import BROADCAST_IDS, fresh, materialize, read_table
from longdoc.llm.queries import tokenizer_path
from longdoc.session import ship_package

#: Documents whose language is less probable than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (4): rejects texts without a letter and those of which no
    language is probable. A null lang is filled in with the one found. Where no
    language can be learnt, all texts with a letter stay as they are."""
    ship_package(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = language.predictor(spark, model)
    own, = fresh(docs.columns, "found_language")
    found = docs.withColumn(own, predict(F.col("text")))
    kept = found.where((F.col(f"{own}.lang_pred") != language.UNKNOWN) & (F.col(f"{own}.score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", f"{own}.lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (10): of each group of texts that are linked by 5-word
    shingles with a similarity of 0.8 or more the smallest doc_id stays; of repeated rows (same doc_id and text) the one
    whose columns come first as JSON. Texts without words and rows without a doc_id are linked with
    nothing and stay; a text of any length is compared as a whole; other columns, whatever their names, come through."""
    ship_package(spark)
    found = minhash.near_duplicates(docs, words=5, percent=80)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.where("not kept or n > 1"), "dropped")
    gone, repeated = ids.where("not kept").select("doc_id"), ids.where("kept and n > 1").select("doc_id")
    small = ids.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    if not repeated.isEmpty():
        again = F.broadcast(repeated) if small else repeated
        row, others = F.struct(*docs.columns), F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
        one = (kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, others).alias("row"))
               .select("row.*"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (8): cuts windows of 13 words that a smaller doc_id has too.
    A document that is cut altogether goes; n_chars follows the text. Null, empty and short texts lose nothing, rows of the
    same doc_id cut nothing from each other, rows without one neither cut nor are cut; a text of any length is cut
    as a whole; other columns, whatever their names, come through unchanged."""
    ship_package(spark)
    words, removed = fresh(docs.columns, "all_words", "removed_words")
    cut = substring.remove_repeats(docs, counts=(words, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (5): sequences of 1024 tokens; one row per piece with its ids.
    A null or empty text is its end mark alone; a long one fills several sequences; rows with null or repeated ids are
    packed like others; other columns are not read."""
    ship_package(spark)
    pieces = packing.pack_texts(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "sequence_id", "offset", "start", "length", "n_loss",
                         F.col("n_ids").alias("doc_tokens"), "ids")


STAGES = [("language", keep_language), ("near copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

# the stages are models, signatures and a tokenizer, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
