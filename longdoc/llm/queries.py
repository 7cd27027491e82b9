"""The registered queries of the operators: thin digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.llm import (chat, fingerprint, language, lattice, lexical, licenses, merkle, minhash, packing,
                         sentencepiece_scan, sharding, substring, urls)
from longdoc.llm.common import read_table
from longdoc.llm.oracle import SQL  # noqa: F401 - registered with the queries


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again; long ones in parts."""
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_scan.decode(encoded, model)
    return decoded.select("doc_id", "part", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                          "score", F.char_length("decoded").cast("long").alias("decoded_chars"),
                          F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 written shards (law: key), with their place there."""
    path = sharding.shard_path(spark)
    schema = sharding.write_shards(read_table(spark, sf_dir, "documents"), path)
    text = F.coalesce(F.col("text"), F.lit(""))
    shards = sharding.read_shards(spark, path, schema, [
        F.col("doc_id"), sharding.record_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")])
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    aside = language.held_out(F.col("doc_id"))
    found = language.identify(docs, docs.where(~aside))
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.pack_texts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         F.col("n_ids").alias("doc_tokens"), "sequence_id", "offset", "n_loss")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered from every participant's perspective."""
    return chat.digest(chat.render(read_table(spark, sf_dir, "conversations")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 13 words cut from all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.remove_repeats(docs, joined=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, Jaccard 0.8, over all documents."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = lexical.build_index(read_table(spark, sf_dir, "documents"))
    return lexical.search(index, read_table(spark, sf_dir, "benchmark"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wording in all documents."""
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and the version of each tampered one."""
    docs = read_table(spark, sf_dir, "documents")
    return merkle.digests(merkle.manifest(docs, merkle.even_crc(F.col("doc_id"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_sharding, op3_embedding_neardup, op4_language_id, op5_packing,
                            op6_fingerprints, op7_chat_format, op8_substring_dedup, op9_url_filter, op10_minhash,
                            op11_lexical_search, op12_licenses, op13_merkle)
}
