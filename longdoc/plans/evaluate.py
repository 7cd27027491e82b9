"""L2 (test: retrieve, generate, score) and L3 (score a result file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.constants import CHUNK_SIZE, N_NEIGHBORS
from longdoc.functions.arrays import chunk_array, drop_last
from longdoc.functions.text import strip_text
from longdoc.operators import metrics as M
from longdoc.operators.chunks import filter_min_chunks
from longdoc.operators.retrieve import HashEncoder
from longdoc.operators.sampling import extractive_draft, generate
from longdoc.plans.prepare import written, search_chunks
from longdoc.sources.io import read_results, read_samples, write_results

ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def score_pairs(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Every per-pair metric, row by row (G1-G4): one Arrow stage, no shuffle."""
    return M.all_scores(pairs, [id_col])


def score_record(per_pair: DataFrame, digits: int = 4, id_col: str = "id") -> DataFrame:
    """The result header: F1 and Exact match as corpus means, ROUGE{rouge1, rouge2, rougeL,
    rougeLsum} as midpoints of the bootstrap (G5), as the reference's scorer reports them. The scores are
    written first, so that a task that makes them doesn't also hold the worker that draws weights."""
    per_pair = written(per_pair.sparkSession, per_pair.select(id_col, "f1", "exact_match", *ROUGE))
    a = per_pair.agg(F.avg("f1").alias("F1"), F.avg("exact_match").alias("Exact match")).withColumn("_k", F.lit(0))
    mid = M.bootstrap_mid(per_pair, list(ROUGE), id_col, digits=digits)
    b = mid.agg(*[F.max(F.when(F.col("metric") == c, F.col("mid"))).alias(c) for c in ROUGE]).withColumn("_k", F.lit(0))
    return a.join(b, "_k").select("F1", "`Exact match`", F.struct(*ROUGE).alias("ROUGE"))


def _cut(ids, max_len: int | None):
    return ids if max_len is None else F.slice(ids, 1, max_len)


def evaluate(samples: DataFrame, tokenizer, c: int = CHUNK_SIZE, k: int = N_NEIGHBORS, max_len: int | None = None,
             exclude_prompt: bool = False, encoder=None) -> tuple[DataFrame, DataFrame]:
    """L2 with the extractive stand-in generator (E4): every chunk of the
    prompt-plus-abstract (the last one padded) searches the article's own
    chunks; the best pair per query chunk, decoded and stripped, is the prediction; the
    reference is the decoded input (F1 side) and the raw model input (ROUGE side, Q2).
    As in the reference, generation starts from the prompt, so the prediction
    begins with it (Q3) unless ``exclude_prompt``. ``max_len`` cuts inputs and predictions;
    without it they stay whole. Returns (per-pair scores, predictions)."""
    spark = samples.sparkSession
    ids = samples.select("article_id", tokenizer.encode("text").alias("_b"), tokenizer.encode("model_input", max_len).alias("_q"))
    arrays = written(spark, ids.select("article_id", chunk_array("_b", c).alias("text_tokenized"),
                                       chunk_array("_q", c).alias("query_chunks")))
    enough = filter_min_chunks(arrays.withColumn("n_chunks", F.size("text_tokenized")), k)
    nbrs = search_chunks(enough, k, encoder, last_query=True)
    draft = extractive_draft(nbrs, enough, max_len)
    body_ids = F.coalesce("draft_ids", F.array().cast("array<int>"))
    if not exclude_prompt:
        body_ids = _cut(F.concat(drop_last(tokenizer.encode("prompt", max_len)), body_ids), max_len)
    preds = (samples.join(draft, "article_id", "left")
             .select(F.col("article_id").cast("string").alias("id"), "ord",
                     tokenizer.decode(tokenizer.encode("model_input", max_len)).alias("reference"),
                     F.col("model_input").alias("rouge_reference"),
                     strip_text(tokenizer.decode(body_ids)).alias("prediction")))
    # written, so that a task that scores doesn't also hold the workers that encode and decode
    preds = written(spark, preds)
    return M.all_scores(preds, ["id"], rouge_ref="rouge_reference"), preds


def score_result_file(spark: SparkSession, path: str, first_n: int | None = None, array: bool = False,
                      encoder=M.char_ngram_vectors) -> DataFrame:
    """L3: read a result set, split off the header, greedy-match the tokens of every
    candidate against its reference's; corpus mean P/R/F1 over all pairs. ``first_n`` scores only the
    first n samples of the file (the reference's script uses 200); by default every sample is scored."""
    _, samples = read_results(spark, path, array)
    if first_n is not None:
        samples = samples.where(F.col("ordinal") <= first_n)
    g = M.greedy_text_match(samples, ["id"], "truth_output", "model_answer", encoder)
    return g.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n"))


def evaluate_dataset(spark: SparkSession, prepared, results_path: str, tokenizer,
                     split: str = "test", c: int = CHUNK_SIZE, k: int = N_NEIGHBORS,
                     max_len: int | None = None, generator=None, encoder=None, inputs: str | list[str] = "prompt",
                     batch: int = 1, per_task: bool = False) -> DataFrame:
    """L2 on prepared samples (a path or the DataFrame ``prepare_dataset``
    returns): for each article of ``split``, every chunk of its input (the last one padded)
    searches its own body chunks (dense, exact, tiled); the prediction is the prompt followed by
    the best pairs (extractive stand-in), or what ``generator`` makes of the ``inputs`` columns
    (E5: say prompt_ids, id, text_tokenized, retrieved). Scores per pair, then the result set
    (score record first, samples in their order) is written (A8). Returns the score record."""
    src = read_samples(spark, prepared) if isinstance(prepared, str) else prepared
    s = src.where(F.col("split") == split)
    if generator is None:
        arrays = written(spark, s.select(F.col("id").alias("article_id"), "text_tokenized",
                                          chunk_array("input_ids", c).alias("query_chunks")))
        nbrs = search_chunks(arrays, k, encoder or HashEncoder(), last_query=True)
        draft = extractive_draft(nbrs, arrays, max_len).withColumnRenamed("article_id", "id")
        body_ids = _cut(F.concat("prompt_ids", F.coalesce("draft_ids", F.array().cast("array<int>"))), max_len)
        preds = s.join(draft, "id", "left").withColumn("prediction", strip_text(tokenizer.decode(body_ids)))
    else:
        g = generate(s.drop("ord"), generator, inputs, "prediction", batch, per_task)
        preds = s.select("id", "ord").join(g, "id").withColumn("prediction", strip_text("prediction"))
    preds = preds.select(F.col("id").cast("string").alias("id"), "ord", tokenizer.decode("input_ids").alias("reference"),
                         F.col("model_input").alias("rouge_reference"), "prediction")
    preds = written(spark, preds)
    head = score_record(M.all_scores(preds, ["id"], rouge_ref="rouge_reference"))
    write_results(head, preds.select("id", "ord", F.col("reference").alias("truth_output"),
                                     F.col("prediction").alias("model_answer")), results_path, ["ord", "id"])
    return head
