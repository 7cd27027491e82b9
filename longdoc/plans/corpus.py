"""Shared derivations from the driver tables (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.constants import CHUNK_SIZE, VOCAB_SIZE
from longdoc.functions.arrays import chunk_array
from longdoc.operators import sparse_index as sparse
from longdoc.operators.chunks import chunk_documents, filter_min_chunks
from longdoc.operators.tokens import VocabTokenizer, corpus_vocab, tokenize
from longdoc.session import ensure_parallelism, scratch_path
from longdoc.sources.io import input_stamp, materialize
from longdoc.sources.tables import read_table


TEXT_TABLES = ("documents", "pages", "conversations")


_SPREAD: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread over the cores when the scan has
    too few partitions (decided once per table and session settings)."""
    from longdoc.session import ship_package
    ship_package(spark)
    df = read_table(spark, sf_dir, name)
    if name not in TEXT_TABLES:
        return df
    target = spark.sparkContext.defaultParallelism * 2
    key = (sf_dir, name, spark.sparkContext.applicationId, target,
           spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if key not in _SPREAD:
        _SPREAD[key] = df.rdd.getNumPartitions() < target
    return df.repartition(target) if _SPREAD[key] else df


def _stamp(spark: SparkSession, path: str) -> str:
    return input_stamp(spark, path)


def vocab_path(spark: SparkSession, sf_dir: str, size: int = VOCAB_SIZE) -> str:
    """C0 over the document corpus, materialised once per input."""
    docs = table(spark, sf_dir, "documents")
    key = _stamp(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return corpus_vocab(spark, docs, "text", key, size)


def tokenizer(spark: SparkSession, sf_dir: str) -> VocabTokenizer:
    return VocabTokenizer(vocab_path(spark, sf_dir))


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, token_ids) of every document body, EOS-terminated; tokenized once per
    input and config and kept in the shared folder (A6), which also cuts the lineage."""
    vp = vocab_path(spark, sf_dir)
    cfg = {"docs": _stamp(spark, f"{sf_dir.rstrip('/')}/documents.parquet"), "vocab": vp, "v": 3}
    return ensure_parallelism(materialize(
        spark, lambda: table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("article_id"), tokenize("text", vp).alias("token_ids")),
        scratch_path(spark, "doc_ids"), cfg))


def doc_chunks(spark: SparkSession, sf_dir: str, c: int = CHUNK_SIZE) -> DataFrame:
    """The chunk rows (C4, C5), row-local from the token ids."""
    return chunk_documents(doc_ids(spark, sf_dir), "article_id", "token_ids", c)


def doc_arrays(spark: SparkSession, sf_dir: str, c: int = CHUNK_SIZE) -> DataFrame:
    """(article_id, text_tokenized [n][c], n_chunks) per document."""
    d = doc_ids(spark, sf_dir).select("article_id", chunk_array("token_ids", c).alias("text_tokenized"))
    return d.withColumn("n_chunks", F.size("text_tokenized"))


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index (D2) of every chunk of a document but the last, of documents with k + 1 chunks or more; written
    once per input and config."""
    cfg = {"docs": _stamp(spark, f"{sf_dir.rstrip('/')}/documents.parquet"), "vocab": vocab_path(spark, sf_dir), "block": sparse.BLOCK, "v": 2}
    return materialize(spark, lambda: sparse.build(filter_min_chunks(doc_arrays(spark, sf_dir)), drop=1),
                       scratch_path(spark, "sparse_index"), cfg)


def self_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the index searched among the others of its document."""
    index = sparse_index(spark, sf_dir)
    return sparse.search(index, index, exclude_self=True)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longdoc.sources.testdata import articles_from_documents
    return articles_from_documents(table(spark, sf_dir, "documents"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longdoc.sources.testdata import titles_from_pages
    return titles_from_pages(table(spark, sf_dir, "pages"))


def titles_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longdoc.sources.testdata import titles_with_duplicates
    return titles_with_duplicates(table(spark, sf_dir, "pages"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 up to the prompt: articles with a title, abstract, body, prompt,
    model input (B1-B3, J2)."""
    from longdoc.plans.prepare import prepare_articles
    return prepare_articles(articles(spark, sf_dir), titles(spark, sf_dir))


def trunc_ids(spark: SparkSession, sf_dir: str, max_len: int) -> DataFrame:
    """Document ids cut to max_len with EOS kept inside."""
    vp = vocab_path(spark, sf_dir)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), tokenize("text", vp, max_len).alias("token_ids"))
