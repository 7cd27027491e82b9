"""How the driver's tables stand in for the reference's inputs.

articles  <- documents: article_id = ord = doc_id; split by doc_id % 10
             (0 test, 1 val, else train); the abstract is made of all words
             of the text, cut at ". " into "<S> ... </S>" sentences; the body lines
             are the text split at newlines.
titles    <- pages: id = ord = page_id, title = text inside <title>.
vectors   <- embeddings, ``label`` plays the article.
pairs     <- conversations: user turn t is the reference, the assistant turn
             t+1 of the same conversation the prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longdoc.functions.text import words

TITLE_RE = "<title>([^<]*)</title>"
DUPLICATE_ORD_OFFSET = 1_000_000_000_000


def split_of(doc_id: Column) -> Column:
    m = F.pmod(doc_id, F.lit(10))
    return F.when(m == 0, "test").when(m == 1, "val").otherwise("train")


def articles_from_documents(docs: DataFrame) -> DataFrame:
    whole = F.array_join(words("text"), " ")
    return docs.select(
        split_of(F.col("doc_id")).alias("split"),
        F.col("doc_id").alias("article_id"),
        F.col("doc_id").alias("ord"),
        F.transform(F.split(whole, r"\. "), lambda s: F.concat(F.lit("<S> "), s, F.lit(" </S>")))
        .alias("abstract_text"),
        F.split(F.col("text"), "\n").alias("article_text"),
    )


def titles_from_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"),
                        F.regexp_extract("html", TITLE_RE, 1).alias("title"),
                        F.col("page_id").alias("ord"))


def titles_with_duplicates(pages: DataFrame) -> DataFrame:
    """Every title line twice: the original, then a changed copy further down."""
    t = titles_from_pages(pages)
    dup = t.select("id", F.concat("title", F.lit(" (revised)")).alias("title"),
                   (F.col("ord") + F.lit(DUPLICATE_ORD_OFFSET)).alias("ord"))
    return t.unionByName(dup)


def prediction_pairs(conv: DataFrame) -> DataFrame:
    u = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return (u.join(a, ["conv_id", "turn"])
            .select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("id"), "conv_id", "turn", "reference", "prediction"))
