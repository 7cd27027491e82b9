"""Scoring predictions as they arrive: the reference adds metric inputs batch
by batch and computes the corpus score at the end. Here every micro-batch of
(id, reference, prediction) rows is scored with the batch operators inside
``foreachBatch`` and appended per epoch (overwriting that epoch's folder, so
a replayed epoch after a failure writes the same rows once); the corpus
record is a batch aggregate over what has been written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAIR_SCHEMA = "id STRING, reference STRING, prediction STRING"


def pair_stream(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", max_files)
            .json(directory))


def score_stream(pairs: DataFrame, out_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    from longdoc.plans.evaluate import score_pairs

    def write_batch(batch: DataFrame, epoch: int) -> None:
        (score_pairs(batch).withColumn("epoch", F.lit(epoch))
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch}"))

    w = pairs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def corpus_scores(spark: SparkSession, out_path: str) -> DataFrame:
    from longdoc.plans.evaluate import score_record
    return score_record(spark.read.parquet(out_path))
