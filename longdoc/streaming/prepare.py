"""Incremental article preparation with Structured Streaming.

New article files (JSON lines) are picked up as they land; each micro-batch
gets the flattened abstract/body, token ids and chunks (row-local, no
shuffle) and is appended to Parquet. Progress lives in a checkpoint inside
the shared folder, so a restarted query resumes where it stopped. The title
join is a stream-static join against the (static) title map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from longdoc.constants import CHUNK_SIZE
from longdoc.functions.text import flatten_abstract, flatten_text
from longdoc.operators.chunks import chunk_documents
from longdoc.operators.tokens import tokenize

STREAM_SCHEMA = "article_id STRING, abstract_text ARRAY<STRING>, article_text ARRAY<STRING>"


def article_stream(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", max_files)
            .json(directory))


def prepared_chunks(stream: DataFrame, vocab_path: str, c: int = CHUNK_SIZE,
                    titles: DataFrame | None = None) -> DataFrame:
    s = stream.select("article_id", flatten_abstract("abstract_text").alias("abstract"),
                      flatten_text("article_text").alias("text"))
    if titles is not None:
        s = s.join(titles, "article_id", "inner")
    ids = s.select("article_id", tokenize("text", vocab_path).alias("ids"))
    return chunk_documents(ids, "article_id", "ids", c, with_pairs=True)


def start(df: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = (df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()

