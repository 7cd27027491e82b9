"""L1, prepare data: read -> title join -> prompt -> tokens -> chunks ->
search -> neighbour expansion -> samples.

The article key is the only shuffle key the flow needs: the title join, the
query/key search join and the per-article collection of neighbours all key on
it; chunking and pair building are row-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.constants import CHUNK_SIZE, N_NEIGHBORS, VOCAB_SIZE
from longdoc.functions.arrays import chunk_array, drop_last
from longdoc.functions.text import build_prompt, flatten_abstract, flatten_text
from longdoc.operators import sparse_index
from longdoc.operators.chunks import filter_min_chunks
from longdoc.operators.lookup import join_titles, quarantine, title_map
from longdoc.operators.retrieve import HashEncoder, collect_retrieved, knn_within
from longdoc.operators.tokens import VocabTokenizer, corpus_vocab
from longdoc.sources import io
from longdoc.sources.io import cap_per_split, input_stamp, materialize, read_articles, read_titles


def prepare_articles(articles: DataFrame, titles: DataFrame) -> DataFrame:
    """J2 + B1-B3: (split, article_id, ord, title, abstract, text, prompt, model_input)."""
    j = join_titles(articles, titles)
    return j.select("split", "article_id", "ord", "title",
                    flatten_abstract("abstract_text").alias("abstract"),
                    flatten_text("article_text").alias("text"),
                    build_prompt("title").alias("prompt"),
                    F.concat(build_prompt("title"), flatten_abstract("abstract_text")).alias("model_input"))


def tokenize_samples(samples: DataFrame, tokenizer, max_len: int | None = None) -> DataFrame:
    """C1 + C3: prompt_ids (without EOS) and input_ids (with EOS); cut only when ``max_len`` is given."""
    # in one step, so that a task has one Python worker for both
    ids = samples.withColumns({"_p": tokenizer.encode("prompt", max_len), "input_ids": tokenizer.encode("model_input", max_len)})
    return ids.withColumn("prompt_ids", drop_last("_p")).select(*[c for c in samples.columns if c not in ("prompt_ids", "input_ids")], "prompt_ids", "input_ids")


def search_chunks(articles: DataFrame, k: int, encoder=None, query_chunks: str = "query_chunks",
                  chunks: str = "text_tokenized", last_query: bool = False) -> DataFrame:
    """Neighbours (article_id, query_no, rank, chunk_no, score) of every query chunk among the
    chunks of its own article but the last (C7). ``articles`` should be a materialised table,
    as it is read for the queries, the keys and their counts. With ``encoder``: vectors and the
    exact tiled search (D1, D3); without: term frequencies (D1b, D3b)."""
    drop = lambda x, n: F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0)))
    q = articles.select("article_id", (F.size(chunks) - 1).alias("n_keys"),
                        F.posexplode(drop(query_chunks, 0 if last_query else 1)).alias("query_no", "token_ids"))
    keys = articles.select("article_id", F.posexplode(drop(chunks, 1)).alias("chunk_no", "token_ids"))
    if encoder is None:
        spark = articles.sparkSession
        asked = written(spark, sparse_index.build(articles, chunks=query_chunks, drop=0 if last_query else 1))
        return sparse_index.search(asked, written(spark, sparse_index.build(articles, chunks=chunks, drop=1)), k=k)
    qv = q.select("article_id", "query_no", encoder.encode("token_ids").alias("embedding"))
    kv = keys.select("article_id", "chunk_no", encoder.encode("token_ids").alias("embedding"))
    found = knn_within(qv, kv, "article_id", "query_no", "chunk_no", k=k)
    return found.withColumn("query_no", F.col("query_no").cast("int")).withColumn("chunk_no", F.col("chunk_no").cast("int"))


def retrieval_samples(samples: DataFrame, tokenizer, query_col: str = "model_input", c: int = CHUNK_SIZE,
                      k: int = N_NEIGHBORS, max_len: int | None = None, method: str = "dense",
                      encoder=None) -> DataFrame:
    """Chunks of the body, query chunks of the model input (all but the last),
    top-k chunks within the article, neighbour pairs collected per article.

    ``method="dense"`` (default, as the reference: embeddings and an exact index) embeds chunks
    with ``encoder`` (default the built-in one); ``"sparse"`` ranks by term frequencies. Either way
    every query has min(k, keys) neighbours. ``tokenizer``: see ``VocabTokenizer``. Articles with
    fewer than k+1 body chunks are dropped (B4); an article without query chunks keeps
    ``retrieved = []`` (Q8). Each text is tokenized once: the arrays are written to the shared
    folder and the searches and the expansion read them there."""
    if method not in ("dense", "sparse"):
        raise ValueError(f"unknown method {method}")
    spark = samples.sparkSession
    ids = samples.select("article_id", tokenizer.encode("text").alias("_b"), tokenizer.encode(query_col, max_len).alias("_q"))
    arrays = ids.select("article_id", chunk_array("_b", c).alias("text_tokenized"), chunk_array("_q", c).alias("query_chunks"))
    # filtered after writing: a filter pushed below the arrays would tokenize once more
    arrays = filter_min_chunks(written(spark, arrays).withColumn("n_chunks", F.size("text_tokenized")), k).drop("n_chunks")
    nbrs = search_chunks(arrays, k, (encoder or HashEncoder()) if method == "dense" else None)
    found = collect_retrieved(nbrs, arrays.select("article_id", "text_tokenized"))
    return samples.join(found, "article_id", "inner")


def written(spark, df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: computed once, lineage cut."""
    return io.written(df, "prepared_arrays")


def checked_articles(articles: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B6 in L1: (good, bad) article lines; ``bad`` keeps the line with its reasons: not JSON, no
    id, no title for the id."""
    t = title_map(titles).withColumnRenamed("id", "article_id").withColumn("_titled", F.lit(True)).drop("title")
    tagged = articles.join(t, "article_id", "left")
    corrupt = F.col("_corrupt_record").isNotNull()
    good, bad = quarantine(tagged, {"not_json": corrupt, "no_id": ~corrupt & F.col("article_id").isNull(),
                                    "no_title": F.col("article_id").isNotNull() & F.col("_titled").isNull()})
    return good.drop("_titled"), bad.select("split", "article_id", F.col("_corrupt_record").alias("line"), "error")


def prepare_dataset(spark, articles_dir: str, metadata_path: str, out_base: str,
                    vocab_path: str | None = None, c: int = CHUNK_SIZE, k: int = N_NEIGHBORS,
                    max_len: int | None = None, cap: int | None = None, retrieval: bool = True,
                    vocab_size: int = VOCAB_SIZE, tokenizer=None, encoder=None, hooks_key: str = "",
                    method: str = "dense") -> DataFrame:
    """L1 from raw files to the prepared samples, written per split (A4) and
    reused when the same inputs and config were prepared before (A6).

    read split files (A1) and metadata (A2) -> bad lines to ``<out>/quarantine`` (B6) -> title join,
    last line wins (J1, J2) -> abstract, body, prompt (B1-B3) -> [retrieval: chunks, top-k within
    the article, neighbour pairs (C, D, J4, D4); articles with < k+1 chunks
    dropped (B4)] -> first ``cap`` survivors per split (F8) -> prompt_ids,
    input_ids (C1, C3). Without retrieval, ``text_tokenized``/``retrieved``
    are NULL (quirk Q4 made explicit). ``tokenizer`` and ``encoder`` take the place of the built-in
    ones; ``hooks_key`` names their version for the reuse."""
    articles, titles = read_articles(spark, articles_dir), read_titles(spark, metadata_path)
    good, bad = checked_articles(articles, titles)
    samples = prepare_articles(good, titles)
    inputs = input_stamp(spark, articles_dir, metadata_path)
    if tokenizer is None:
        if vocab_path is None:
            vocab_path = corpus_vocab(spark, samples, "text", inputs, vocab_size)
        tokenizer = VocabTokenizer(vocab_path)
    config = {"inputs": inputs, "vocab": vocab_path, "chunk_size": c, "k": k, "max_len": max_len, "cap": cap,
              "retrieval": retrieval, "method": method, "hooks": hooks_key, "v": 3}

    def compute() -> DataFrame:
        s = retrieval_samples(samples, tokenizer, c=c, k=k, max_len=max_len, method=method, encoder=encoder) if retrieval else (
            samples.withColumn("text_tokenized", F.lit(None).cast("array<array<int>>"))
            .withColumn("retrieved", F.lit(None).cast("array<array<array<int>>>")))
        if cap is not None:
            s = cap_per_split(s, cap, ["ord", "article_id"])
        t = tokenize_samples(s, tokenizer, max_len)
        return t.select("split", F.col("article_id").alias("id"), "ord", "prompt", "model_input",
                        "prompt_ids", "input_ids", "text_tokenized", "retrieved")

    materialize(spark, lambda: bad, f"{out_base.rstrip('/')}/quarantine", {"inputs": inputs, "v": 1})
    return materialize(spark, compute, out_base, config, partition_by=["split"])


def read_quarantine(spark, articles_dir: str, metadata_path: str, out_base: str) -> DataFrame:
    """The bad lines that ``prepare_dataset`` set aside for these inputs."""
    from longdoc.sources.io import config_key
    key = config_key({"inputs": input_stamp(spark, articles_dir, metadata_path), "v": 1})
    return spark.read.parquet(f"{out_base.rstrip('/')}/quarantine/{key}")
