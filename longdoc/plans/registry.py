"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Outputs are shaped for comparison with ``longdoc.plans.oracle``: integers as
BIGINT, scores rounded, arrays rendered as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.functions.arrays import ids_text
from longdoc.operators.chunks import chunk_tf, drop_last_chunk, filter_min_chunks
from longdoc.operators.tokens import build_vocab, pieces
from longdoc.plans import corpus
from longdoc.functions import arrays as A
from longdoc.functions import text as TX
from longdoc.operators import batches as B
from longdoc.operators import chunks as CH
from longdoc.operators import generation as GN
from longdoc.operators import lookup as LK
from longdoc.operators import metrics as M
from longdoc.operators import retrieve as R
from longdoc.operators import sampling as S
from longdoc.operators import sparse_index
from longdoc.operators.tokens import decode, tokenize
from longdoc.session import scratch_path
from longdoc.sources import io as IO
from longdoc.sources import reuse as RU
from longdoc.sources import testdata as TD

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def out(df: DataFrame) -> DataFrame:
    """Integers -> BIGINT, floats -> DOUBLE (comparison form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@register("vocab")
def q_vocab(spark, sf):
    return out(build_vocab(corpus.table(spark, sf, "documents"), "text"))


@register("tokenize_full")
def q_tokenize_full(spark, sf):
    d = corpus.doc_ids(spark, sf)
    return out(d.select("article_id", F.size("token_ids").alias("n_ids"),
                        ids_text("token_ids").alias("token_ids")))


@register("tokenize_roundtrip")
def q_tokenize_roundtrip(spark, sf):
    """C2 + C6: every document's words back from its ids."""
    vp = corpus.vocab_path(spark, sf)
    d = corpus.table(spark, sf, "documents")
    t = d.select("doc_id", F.size(pieces("text")).alias("n_words"), tokenize("text", vp).alias("ids"))
    return out(t.select("doc_id", "n_words", F.size(F.filter("ids", lambda x: x == 2)).alias("n_unk"),
                        decode("ids", vp, clean=False).alias("words")))


@register("chunk_documents")
def q_chunk_documents(spark, sf):
    ch = corpus.doc_chunks(spark, sf)
    return out(ch.select("article_id", "chunk_no", "n_chunks",
                         ids_text("token_ids").alias("token_ids")))


def key_tf(spark, sf):
    keys = drop_last_chunk(filter_min_chunks(corpus.doc_chunks(spark, sf)))
    return chunk_tf(keys, ["article_id", "chunk_no"])


@register("chunk_tf")
def q_chunk_tf(spark, sf):
    return out(key_tf(spark, sf).select("article_id", "chunk_no", "token_id", "tf", "norm2"))


@register("chunk_idf")
def q_chunk_idf(spark, sf):
    """D1b with its optional weight."""
    n = drop_last_chunk(filter_min_chunks(corpus.doc_chunks(spark, sf))).count()
    t = CH.idf_weights(key_tf(spark, sf), ["article_id", "chunk_no"], n)
    return out(t.select("article_id", "chunk_no", "token_id", F.round(F.col("tf") * F.col("idf"), 6).alias("weight")))


@register("chunk_postings")
def q_chunk_postings(spark, sf):
    """The lists of the inverted index, with the bound that a search prunes by."""
    p = sparse_index.postings(corpus.sparse_index(spark, sf))
    return out(p.select(F.col("g").alias("article_id"), "token_id", "df", F.round("impact", 6).alias("impact")))


@register("knn_sparse")
def q_knn_sparse(spark, sf):
    r = corpus.self_search(spark, sf)
    return out(r.select("article_id", "query_no", "rank", "chunk_no",
                        F.round("score", 6).alias("score")))


# ---- B: projections and filters ------------------------------------------


@register("abstract_flatten")
def q_abstract_flatten(spark, sf):
    return out(corpus.articles(spark, sf).select("article_id",
                                                 TX.flatten_abstract("abstract_text").alias("abstract")))


@register("text_flatten")
def q_text_flatten(spark, sf):
    return out(corpus.articles(spark, sf).select("article_id", TX.flatten_text("article_text").alias("text")))


@register("prompt_build")
def q_prompt_build(spark, sf):
    return out(corpus.samples(spark, sf).select("article_id", "split", "prompt", "model_input"))


@register("min_chunks")
def q_min_chunks(spark, sf):
    return out(CH.filter_min_chunks(corpus.doc_arrays(spark, sf)).select("article_id", "n_chunks"))

@register("id_filter")
def q_id_filter(spark, sf):
    d = corpus.table(spark, sf, "documents").select("doc_id", TX.words("text").alias("w"))
    ids = F.filter(F.transform("w", lambda x: TX.new_style_id(x)), lambda x: x.isNotNull())
    return out(d.select("doc_id", F.size("w").alias("n_words"), F.size(ids).alias("n_new_ids"),
                        F.get(ids, 0).alias("first_new_id")))


@register("quarantine")
def q_quarantine(spark, sf):
    a = corpus.articles(spark, sf)
    t = LK.title_map(corpus.titles(spark, sf)).withColumnRenamed("id", "article_id")
    j = a.join(t, "article_id", "left")
    checks = {"missing_title": F.col("title").isNull(),
              "short_body": F.size(TX.words(TX.flatten_text("article_text"))) < 64}
    return out(LK.tag_errors(j, checks).select("article_id", "error"))


@register("strip_predictions")
def q_strip(spark, sf):
    c = corpus.table(spark, sf, "conversations")
    return out(c.select("conv_id", "turn", TX.strip_text("text").alias("text")))


@register("trim_sections")
def q_trim_sections(spark, sf):
    d = corpus.table(spark, sf, "documents")
    lines = F.split("text", "\n")
    names = F.transform(lines, lambda l: F.lower(F.coalesce(F.get(TX.words(l), 0), F.lit(""))))
    sections = F.transform(lines, lambda l: F.split(l, r"\. "))
    kept = TX.trim_sections(names, sections, start="the", end="and")
    return out(d.select("doc_id", F.array_join(kept, "|").alias("kept")))


# ---- C: tokens and chunks ------------------------------------------------

@register("tokenize_truncate")
def q_tokenize_truncate(spark, sf):
    d = corpus.trunc_ids(spark, sf, 512)
    return out(d.select("article_id", F.size("token_ids").alias("n_ids"), A.ids_text("token_ids").alias("token_ids")))


@register("prompt_ids")
def q_prompt_ids(spark, sf):
    vp = corpus.vocab_path(spark, sf)
    s = corpus.samples(spark, sf)
    return out(s.select("article_id", A.ids_text(A.drop_last(tokenize("prompt", vp))).alias("prompt_ids")))


@register("pad_multiple")
def q_pad_multiple(spark, sf):
    d = corpus.doc_ids(spark, sf)
    p = A.pad_to_multiple("token_ids", 64)
    return out(d.select("article_id", F.size("token_ids").alias("n_ids"),
                        (F.size(p) - F.size("token_ids")).alias("n_pad"), A.ids_text(p).alias("padded")))


@register("decode_chunks")
def q_decode_chunks(spark, sf):
    vp = corpus.vocab_path(spark, sf)
    ch = corpus.doc_chunks(spark, sf)
    return out(ch.select("article_id", "chunk_no", decode("token_ids", vp).alias("text")))


@register("drop_last_chunk")
def q_drop_last_chunk(spark, sf):
    return out(CH.drop_last_chunk(corpus.doc_chunks(spark, sf)).select("article_id", "chunk_no"))


@register("full_chunks")
def q_full_chunks(spark, sf):
    r = CH.full_chunk_rows(corpus.doc_ids(spark, sf), "article_id", "token_ids", 64)
    return out(r.select("article_id", "query_no", A.ids_text("token_ids").alias("token_ids")))


@register("last_full_chunk")
def q_last_full_chunk(spark, sf):
    d = corpus.doc_ids(spark, sf)
    return out(d.select("article_id", A.ids_text(A.last_full_chunk("token_ids", 64)).alias("last_chunk")))


def doubled_ids(spark, sf):
    """Every document's ids twice, so that ids follow an EOS."""
    return corpus.doc_ids(spark, sf).select("article_id", F.concat("token_ids", "token_ids").alias("ids"))


@register("mask_after_eos")
def q_mask_after_eos(spark, sf):
    return out(doubled_ids(spark, sf).select("article_id", A.ids_text(A.mask_after_eos("ids")).alias("masked")))


@register("sequence_windows")
def q_sequence_windows(spark, sf):
    return out(CH.sequence_windows(corpus.doc_arrays(spark, sf), "article_id", "n_chunks", 2048, 64))


@register("lm_shift")
def q_lm_shift(spark, sf):
    d = corpus.doc_ids(spark, sf)
    return out(d.select("article_id", A.ids_text(A.lm_shift_input("token_ids")).alias("input"),
                        A.ids_text(A.lm_shift_label("token_ids")).alias("label")))


@register("chunk_pairs")
def q_chunk_pairs(spark, sf):
    p = CH.chunk_documents(corpus.doc_ids(spark, sf), "article_id", "token_ids", with_pairs=True)
    return out(p.select("article_id", "chunk_no", A.ids_text("pair_ids").alias("pair_ids")))


# ---- J: joins and lookups ------------------------------------------------

@register("title_map_last")
def q_title_map_last(spark, sf):
    return out(LK.title_map(corpus.titles_dup(spark, sf)))


@register("title_join")
def q_title_join(spark, sf):
    j = LK.join_titles(corpus.articles(spark, sf), corpus.titles_dup(spark, sf))
    return out(j.select("article_id", "split", "title"))


@register("title_lookup_first")
def q_title_lookup_first(spark, sf):
    ids = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return out(LK.lookup_title(ids, corpus.titles_dup(spark, sf)).select("article_id", "title"))


def expanded(spark, sf):
    return R.expand_neighbors(corpus.self_search(spark, sf), corpus.doc_arrays(spark, sf))


@register("neighbor_expand")
def q_neighbor_expand(spark, sf):
    return out(expanded(spark, sf).select("article_id", "query_no", "rank", "chunk_no", A.ids_text("pair_ids").alias("pair_ids")))


@register("neighbor_text")
def q_neighbor_text(spark, sf):
    """Only what is found is decoded; chunk i and chunk i+1 apart, joined by a space."""
    vp = corpus.vocab_path(spark, sf)
    text = F.concat_ws(" ", decode(F.slice("pair_ids", 1, 64), vp), decode(F.slice("pair_ids", 65, 64), vp))
    return out(expanded(spark, sf).select("article_id", "query_no", "rank", "chunk_no", text.alias("pair_text")))


# ---- D: dense retrieval, collection, report ------------------------------


@register("knn_within_label")
def q_knn_within_label(spark, sf):
    e = corpus.table(spark, sf, "embeddings")
    q = e.select("label", F.col("vec_id").alias("query_id"), "embedding")
    k = e.select("label", F.col("vec_id").alias("key_id"), "embedding")
    r = R.knn_within(q, k, "label", "query_id", "key_id", "embedding", k=2, exclude_self=True)
    return out(r.select("label", "query_id", "rank", "key_id", F.round("score", 6).alias("score")))


@register("retrieved_tokens")
def q_retrieved_tokens(spark, sf):
    r = R.collect_retrieved(corpus.self_search(spark, sf), CH.filter_min_chunks(corpus.doc_arrays(spark, sf)))
    txt = F.array_join(F.transform("retrieved", lambda q: A.nested_text(q, "|", " ")), "#")
    return out(r.select("article_id", txt.alias("retrieved")))


def written_vectors(spark, sf):
    """(source, index): the vectors, and what their written index (A10) gives back."""
    e = corpus.table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    path = scratch_path(spark, "vector_index", corpus._stamp(spark, f"{sf.rstrip('/')}/embeddings.parquet"))
    if not IO.path_exists(spark, f"{path}/_SUCCESS"):
        IO.write_chunk_index(e, path, key="label", chunk="vec_id")
    return e, IO.read_chunk_index(spark, path, key="label")


@register("index_report")
def q_index_report(spark, sf):
    e, index = written_vectors(spark, sf)
    r = R.index_report(index, "label", e, "vec_id")
    return out(r.select("label", "index_key", "nb_vectors", "dim", "size_bytes",
                        F.round("compression_ratio", 6).alias("compression_ratio"),
                        F.round("reconstruction_error", 6).alias("reconstruction_error")))


@register("embed_chunks")
def q_embed_chunks(spark, sf):
    ch = corpus.doc_chunks(spark, sf)
    e = R.embed(ch.select("article_id", "chunk_no", "token_ids"), "token_ids", dim=64)
    return out(e.select("article_id", "chunk_no", F.posexplode("embedding").alias("d", "value")))


# ---- E: generation steps -------------------------------------------------

def logits(spark, sf):
    e = corpus.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("grp"), F.posexplode("embedding").alias("cand", "logit")) \
        .withColumn("logit", F.col("logit").cast("double"))


@register("topk_fraction")
def q_topk_fraction(spark, sf):
    r = S.topk_fraction(logits(spark, sf))
    return out(r.select("grp", "cand", F.round("logit", 6).alias("logit")))


@register("nucleus_filter")
def q_nucleus(spark, sf):
    r = S.nucleus(logits(spark, sf), p=0.9)
    return out(r.select("grp", "cand", F.round("prob", 6).alias("prob")))


@register("gumbel_sample")
def q_gumbel(spark, sf):
    return out(S.gumbel_sample(S.topk_fraction(logits(spark, sf)), temperature=1.0))


@register("extractive_draft")
def q_extractive_draft(spark, sf):
    d = S.extractive_draft(corpus.self_search(spark, sf), corpus.doc_arrays(spark, sf), None)
    return out(d.select("article_id", A.ids_text("draft_ids").alias("draft_ids")))


def _echo_generator(texts):
    # stand-in model: continues the prompt with its own last word
    return [t + " " + (t.split()[-1] if t.split() else "") for t in texts]


@register("generate")
def q_generate(spark, sf):
    s = corpus.samples(spark, sf).select("article_id", "prompt")
    return out(S.generate(s, _echo_generator, "prompt", "prediction", batch=4))


def _pairs_generator():
    # a generator that reads the retrieval input: the first and last id of every neighbour pair of every query
    def run(rows):
        return [" ".join(f"{pair[0]}:{pair[-1]}" for query in r["retrieved"] for pair in query) + f" #{r['article_id']}" for r in rows]
    return run


@register("generate_retrieval")
def q_generate_retrieval(spark, sf):
    """E5/H5: the generator gets the sample's row with its body chunks and neighbours."""
    s = R.collect_retrieved(corpus.self_search(spark, sf), CH.filter_min_chunks(corpus.doc_arrays(spark, sf)))
    g = S.generate(s.select("article_id", "text_tokenized", "retrieved"), _pairs_generator,
                   ["article_id", "text_tokenized", "retrieved"], "prediction", batch=4, per_task=True)
    return out(g.select("article_id", "prediction"))


def _continuation_generator():
    # goes on with what followed the best neighbour of the last full chunk; before the first one, with the start over again
    def run(rows, want):
        return [r["retrieved"][-1][0][64:][:n] if r["retrieved"] else [r["ids"][j % len(r["ids"])] for j in range(n)]
                for r, n in zip(rows, want, strict=True)]
    return run


@register("generate_incremental")
def q_generate_incremental(spark, sf):
    """D4, incremental: retrieval after every full chunk of output, from the prompts on, 512 ids at most."""
    from longdoc.plans.prepare import tokenize_samples
    own = CH.filter_min_chunks(corpus.doc_arrays(spark, sf))
    starts = tokenize_samples(corpus.samples(spark, sf), corpus.tokenizer(spark, sf)).select("article_id", "prompt_ids")
    g = GN.generate_incremental(starts.join(own.select("article_id"), "article_id"), own, _continuation_generator)
    return out(g.select("article_id", F.size("ids").alias("n_ids"), F.md5(A.ids_text("ids").cast("binary")).alias("ids_md5"),
                        F.size("retrieved").alias("n_retrieved"), F.md5(_nested("retrieved").cast("binary")).alias("retrieved_md5")))


# ---- F: batches -----------------------------------------------------------

SPLIT_BATCH = {"train": 8, "val": 8, "test": 1}


def ranked_articles(spark, sf):
    a = corpus.articles(spark, sf).select("split", "article_id", "ord")
    return B.shuffle_seeded(a)


def tokenized_samples(spark, sf):
    from longdoc.plans.prepare import tokenize_samples
    return tokenize_samples(corpus.samples(spark, sf), corpus.tokenizer(spark, sf))


def batched_samples(spark, sf):
    """Rank and batch the samples first, then tokenize row-locally."""
    from longdoc.plans.prepare import tokenize_samples
    ranked = B.batch_assign(B.shuffle_seeded(corpus.samples(spark, sf)), SPLIT_BATCH)
    return tokenize_samples(ranked, corpus.tokenizer(spark, sf))


@register("shuffle_seeded")
def q_shuffle_seeded(spark, sf):
    return out(ranked_articles(spark, sf).select("split", "article_id", "pos"))


@register("batch_assign")
def q_batch_assign(spark, sf):
    b = B.batch_assign(ranked_articles(spark, sf), SPLIT_BATCH)
    return out(b.select("split", "article_id", "pos", "batch_no"))


def _batch_text(df, cols, more=()):
    sel = ["split", "batch_no", *more, F.array_join(F.transform("article_id", lambda x: x.cast("string")), ",").alias("ids")]
    for c in cols:
        sel.append(A.nested_text(c, "|", " ").alias(c))
    return out(df.select(*sel))


@register("collate_decoder")
def q_collate_decoder(spark, sf):
    c = B.collate_decoder(batched_samples(spark, sf))
    return _batch_text(c, ["prompt_ids", "input_ids"])


@register("collate_mask")
def q_collate_mask(spark, sf):
    vp = corpus.vocab_path(spark, sf)
    b = batched_samples(spark, sf).withColumn("labels", tokenize("abstract", vp))
    c = B.collate_by_name(b, "encdec")
    mask = F.array_join(F.transform("attention_mask", lambda row: F.array_join(
        F.transform(row, lambda v: v.cast("string")), " ")), "|")
    return _batch_text(c.withColumn("mask", mask), ["input_ids", "labels"], [F.col("mask").alias("attention_mask")])


@register("pad_left")
def q_pad_left(spark, sf):
    c = B.collate(batched_samples(spark, sf), ["split", "batch_no"], "pos", {"prompt_ids": 0},
                  ["article_id"], side="left")
    return _batch_text(c, ["prompt_ids"])


@register("collate_all")
def q_collate_all(spark, sf):
    b = batched_samples(spark, sf).select("split", "batch_no", "pos", "article_id", "prompt_ids", "input_ids")
    return _batch_text(B.collate_all(b), ["prompt_ids", "input_ids"])


@register("shard_assign")
def q_shard_assign(spark, sf):
    return out(B.shard_assign(ranked_articles(spark, sf), 4).select("split", "article_id", "shard"))


@register("cap_per_split")
def q_cap_per_split(spark, sf):
    s = corpus.samples(spark, sf).select("split", "article_id", "ord")
    return out(B.first_n_per_group(s, 100, "split", ["ord", "article_id"]).select("split", "article_id"))


@register("flatten_batches")
def q_flatten_batches(spark, sf):
    c = B.collate_decoder(batched_samples(spark, sf))
    f = B.flatten_batches(c, ["split", "batch_no"], ["article_id"])
    return out(f.select("split", "batch_no", "pos_in_batch", "article_id"))


def retrieval_batches(spark, sf):
    """Samples with >= 3 body chunks, their neighbour pairs and chunks. Ranked first: a sample's
    arrays are joined to its batch number, not ranked along."""
    ranked = corpus.samples(spark, sf).select("split", "article_id", "ord").join(
        CH.filter_min_chunks(corpus.doc_arrays(spark, sf)).select("article_id"), "article_id")
    ranked = B.batch_assign(B.shuffle_seeded(ranked), 8)
    tt = CH.filter_min_chunks(corpus.doc_arrays(spark, sf)).drop("n_chunks")
    return ranked.join(R.collect_retrieved(corpus.self_search(spark, sf), tt), "article_id")


@register("collate_retrieved")
def q_collate_retrieved(spark, sf):
    b = retrieval_batches(spark, sf)
    c = B.collate_nested(b, ["split", "batch_no"], "pos",
                         {"retrieved": (2, 128), "text_tokenized": 64}, keep=["article_id"])
    rt = F.array_join(F.transform("retrieved", lambda smp: F.array_join(
        F.transform(smp, lambda q: A.nested_text(q, "|", " ")), "#")), ";")
    tt = F.array_join(F.transform("text_tokenized", lambda smp: A.nested_text(smp, "|", " ")), ";")
    return out(c.select("split", "batch_no", rt.alias("retrieved"), tt.alias("text_tokenized")))


# ---- G: metrics -----------------------------------------------------------

def pairs(spark, sf):
    return TD.prediction_pairs(corpus.table(spark, sf, "conversations"))


def _r6(df, cols):
    return out(df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns]))


@register("qa_f1_em")
def q_qa_f1_em(spark, sf):
    return _r6(M.qa_f1_em(pairs(spark, sf)), ["f1", "exact_match"])


@register("rouge1")
def q_rouge1(spark, sf):
    return _r6(M.rouge_n(pairs(spark, sf), 1), ["precision", "recall", "fmeasure"])


@register("rouge2")
def q_rouge2(spark, sf):
    return _r6(M.rouge_n(pairs(spark, sf), 2), ["precision", "recall", "fmeasure"])


@register("rouge_l")
def q_rouge_l(spark, sf):
    return _r6(M.rouge_l(pairs(spark, sf)), ["precision", "recall", "fmeasure"])


@register("rouge_lsum")
def q_rouge_lsum(spark, sf):
    return _r6(M.rouge_lsum(pairs(spark, sf)), ["precision", "recall", "fmeasure"])


@register("rouge_corpus_mean")
def q_rouge_corpus_mean(spark, sf):
    p = pairs(spark, sf)
    r1 = M.corpus_mean(M.rouge_n(p, 1)).select(F.lit("rouge1").alias("metric"), "mean", "n")
    r2 = M.corpus_mean(M.rouge_n(p, 2)).select(F.lit("rouge2").alias("metric"), "mean", "n")
    return out(r1.unionByName(r2))


@register("rouge_bootstrap")
def q_rouge_bootstrap(spark, sf):
    return M.bootstrap_mid(M.rouge_n(pairs(spark, sf), 1)).drop("metric")


@register("greedy_match")
def q_greedy_match(spark, sf):
    e = corpus.table(spark, sf, "embeddings")
    cands = e.select("label", "vec_id", "embedding")
    refs = e.select((F.col("label") + 1).alias("label"), "vec_id", "embedding")
    g = M.greedy_match(cands, refs, "label", "vec_id")
    return _r6(g, ["precision", "recall", "f1"])


@register("classification_prf")
def q_classification_prf(spark, sf):
    lab = corpus.table(spark, sf, "labels")
    d = lab.select(F.array(F.col("toxic").cast("double"), (1 - F.col("toxic")).cast("double")).alias("logits"),
                   F.col("quality").alias("truth"))
    return _r6(M.classification_prf(d), ["precision", "recall", "f1"])


@register("weighted_mean")
def q_weighted_mean(spark, sf):
    lab = corpus.table(spark, sf, "labels")
    per = lab.groupBy(F.pmod("doc_id", F.lit(16)).alias("b")).agg(
        F.avg("quality").alias("value"), F.count(F.lit(1)).alias("weight"))
    return _r6(M.weighted_mean(per), ["weighted_mean"])


@register("corpus_stats")
def q_corpus_stats(spark, sf):
    vp = corpus.vocab_path(spark, sf)
    j = corpus.articles(spark, sf).select(
        "split", F.size(TX.words(TX.flatten_abstract("abstract_text"))).alias("n_abstract"),
        F.size(tokenize(F.array_join("article_text", "\n"), vp)).alias("n_tokens")).withColumn(
        "n_chunks", F.ceil(F.col("n_tokens") / 64))
    return _r6(M.corpus_stats(j), ["mean_tokens", "p50_tokens", "p90_tokens", "mean_chunks", "mean_abstract"])


# ---- A: sources and sinks -------------------------------------------------


def _scratch(spark, sf, name):
    return scratch_path(spark, name, IO.config_key({"src": corpus._stamp(spark, f"{sf.rstrip('/')}/documents.parquet"),
                                                    "pages": corpus._stamp(spark, f"{sf.rstrip('/')}/pages.parquet")}))


def raw_article_files(spark, sf) -> str:
    """The articles as the reference's raw input: JSON lines per split file."""
    base = _scratch(spark, sf, "raw_articles")
    if not IO.path_exists(spark, f"{base}/test.txt/_SUCCESS"):
        a = corpus.articles(spark, sf).select(
            "split", F.col("article_id").cast("string").alias("article_id"), "abstract_text", "article_text")
        for s in IO.SPLITS:
            a.where(F.col("split") == s).drop("split").write.mode("overwrite").json(f"{base}/{s}.txt")
    return base


def raw_title_file(spark, sf) -> str:
    base = _scratch(spark, sf, "raw_titles")
    if not IO.path_exists(spark, f"{base}/_SUCCESS"):
        p = corpus.table(spark, sf, "pages")
        (p.select(F.col("page_id").cast("string").alias("id"),
                  F.regexp_extract("html", TD.TITLE_RE, 1).alias("title"), "url")
         .write.mode("overwrite").json(base))
    return base


@register("src_articles")
def q_src_articles(spark, sf):
    a = IO.read_articles(spark, raw_article_files(spark, sf))
    return out(a.select("split", F.col("article_id").cast("bigint").alias("article_id"),
                        F.array_join("abstract_text", "|").alias("abstract"),
                        F.array_join("article_text", "\n").alias("body")))


@register("src_titles")
def q_src_titles(spark, sf):
    t = IO.read_titles(spark, raw_title_file(spark, sf))
    return out(t.select(F.col("id").cast("bigint").alias("id"), "title"))


@register("roundtrip_samples")
def q_roundtrip_samples(spark, sf):
    path = _scratch(spark, sf, "samples")
    s = tokenized_samples(spark, sf).select("split", "article_id", "prompt", "model_input", "input_ids")
    IO.write_samples(s, path)
    r = IO.read_samples(spark, path)
    return out(r.select("split", "article_id", "prompt", "model_input", A.ids_text("input_ids").alias("input_ids")))


@register("export_first_n")
def q_export_first_n(spark, sf):
    path = _scratch(spark, sf, "export")
    s = corpus.samples(spark, sf).select("split", "article_id", "ord", "prompt")
    IO.export_first_n(s, 20, path, ".first20", ["ord", "article_id"])
    parts = [spark.read.parquet(f"{path}/{x}.first20").select(F.lit(x).alias("split"), "*")
             for x in IO.SPLITS if IO.path_exists(spark, f"{path}/{x}.first20")]
    r = parts[0]
    for p in parts[1:]:
        r = r.unionByName(p)
    return out(r.select("split", "article_id", "prompt"))


@register("subword_roundtrip")
def q_subword_roundtrip(spark, sf):
    """H1 with a public subword vocabulary: every text encoded and decoded."""
    import public_tokenizers

    from longdoc.operators.tokens import SubwordTokenizer
    tok = SubwordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = corpus.table(spark, sf, "documents").select("doc_id", tok.encode("text").alias("ids"))
    text = ids.select("doc_id", tok.decode("ids").alias("text"))
    return out(text.select("doc_id", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")))


@register("materialize_chunks")
def q_materialize_chunks(spark, sf):
    base = scratch_path(spark, "chunks")
    cfg = {"src": corpus._stamp(spark, f"{sf.rstrip('/')}/documents.parquet"), "chunk_size": 64, "v": 3}
    return out(IO.materialize(spark, lambda: corpus.doc_chunks(spark, sf), base, cfg).select(
        "article_id", "chunk_no", "n_chunks", A.ids_text("token_ids").alias("token_ids")))


@register("materialize_files")
def q_materialize_files(spark, sf):
    """A6 per input file: the body of every raw article, kept for each file it is in."""
    raw = raw_article_files(spark, sf)

    def compute(files):
        a = spark.read.schema(IO.ARTICLE_SCHEMA).json(files)
        return a.select("article_id", TX.flatten_text("article_text").alias("body"), F.col("_metadata.file_path").alias(RU.INPUT_FILE))

    m = RU.materialize_files(spark, compute, raw, scratch_path(spark, "article_bodies"), {"raw": raw, "v": 1})
    return out(m.select(F.col("article_id").cast("bigint").alias("article_id"), F.md5(F.col("body").cast("binary")).alias("body_md5")))


@register("chunk_index")
def q_chunk_index(spark, sf):
    path = _scratch(spark, sf, "chunk_index")
    ch = corpus.doc_chunks(spark, sf)
    IO.write_chunk_index(R.embed(ch.select("article_id", "chunk_no", "token_ids"), "token_ids"), path)
    return out(IO.read_chunk_index(spark, path).select("article_id", "chunk_no", F.posexplode("embedding").alias("d", "value")))


RESULT_ORDER = ["conv_id", "turn"]


def result_preds(spark, sf):
    return pairs(spark, sf).select("id", "conv_id", "turn", F.col("reference").alias("truth_output"),
                                   F.col("prediction").alias("model_answer"))


@register("results_roundtrip")
def q_results_roundtrip(spark, sf):
    from longdoc.plans.evaluate import score_pairs, score_record
    path = _scratch(spark, sf, "results")
    IO.write_results(score_record(score_pairs(pairs(spark, sf))), result_preds(spark, sf), path, RESULT_ORDER)
    _, samples = IO.read_results(spark, path)
    return out(samples.select("id", "truth_output", "model_answer", "ordinal"))


@register("score_record")
def q_score_record(spark, sf):
    """The header of a result set: means and bootstrap midpoints."""
    from longdoc.plans.evaluate import score_pairs, score_record
    h = score_record(score_pairs(pairs(spark, sf)))
    return h.select(F.round("F1", 6).alias("f1"), F.round("`Exact match`", 6).alias("exact_match"), "ROUGE.rouge1", "ROUGE.rouge2")


@register("mask_after_eos_window")
def q_mask_after_eos_window(spark, sf):
    m = CH.mask_after_eos_rows(doubled_ids(spark, sf), "article_id", "ids")
    return out(m.select("article_id", "chunk_no", A.ids_text("ids").alias("masked")))


@register("read_documents")
def q_read_documents(spark, sf):
    path = _scratch(spark, sf, "document_lines")
    if not IO.path_exists(spark, f"{path}/_SUCCESS"):
        IO.write_documents(corpus.table(spark, sf, "documents"), path, "doc_id")
    return out(IO.read_packed_documents(spark, path).select(F.col("id").cast("bigint").alias("doc_id"), "text"))


@register("index_report_timed")
def q_index_report_timed(spark, sf):
    """D5 with measured search times: each label's vectors searched by each
    of its vectors (tiled exact search), per-query time -> mean and p99."""
    e, index = written_vectors(spark, sf)
    q = e.select("label", F.col("vec_id").alias("query_id"), "embedding")
    k = index.select("label", F.col("vec_id").alias("key_id"), "embedding")
    r = R.knn_within(q, k, "label", "query_id", "key_id", k=2, exclude_self=True, with_timing=True)
    t = r.where(F.col("rank") == 1).select("label", F.col("search_ms").alias("ms"))
    return R.index_report(index, "label", e, "vec_id", timings=t)


# ---- the reference's three flows, end to end (rows-only) ------------------

def _nested(col):
    return F.array_join(F.transform(col, lambda q: A.nested_text(q, "|", " ")), "#")


@register("prepare_samples")
def q_prepare_samples(spark, sf):
    """L1: title join -> prompt -> tokens -> chunks -> top-k within the article
    -> neighbour pairs -> samples with prompt_ids, input_ids, retrieved."""
    from longdoc.plans.prepare import retrieval_samples, tokenize_samples
    tok = corpus.tokenizer(spark, sf)
    t = tokenize_samples(retrieval_samples(corpus.samples(spark, sf), tok, method="sparse"), tok)
    return out(t.select("split", "article_id", F.size("prompt_ids").alias("n_prompt"),
                        F.size("input_ids").alias("n_input"), F.size("text_tokenized").alias("n_chunks"),
                        F.size("retrieved").alias("n_retrieved"), F.md5(_nested("retrieved").cast("binary")).alias("retrieved_md5")))


class _CharTokenizer:
    """A caller's tokenizer (H1): one id per character, code point + 3, then EOS; row-local SQL."""

    def encode(self, col, max_len=None):
        c = F.col(col) if isinstance(col, str) else col
        ids = F.transform(F.split(c, ""), lambda x: F.ascii(x) + 3)
        return F.concat(ids if max_len is None else F.slice(ids, 1, max_len - 1), F.array(F.lit(1)))

    def decode(self, ids):
        c = F.col(ids) if isinstance(ids, str) else ids
        return F.array_join(F.transform(F.filter(c, lambda x: x >= 3), lambda x: F.char(x - 3)), "")


class _BinEncoder:
    """A caller's chunk encoder (H3): how many ids leave each remainder by 8."""

    def encode(self, ids):
        c = F.col(ids) if isinstance(ids, str) else ids
        # the remainders as digits, one pass over the ids; a negative one is none of the eight
        digits = F.array_join(F.transform(c, lambda x: F.when(x % 8 >= 0, x % 8)).cast("array<string>"), "")

        def held(b):
            return (F.length(digits) - F.length(F.replace(digits, F.lit(str(b)), F.lit("")))).cast("float")

        return F.array(*[held(b) for b in range(8)])


@register("prepare_hooks")
def q_prepare_hooks(spark, sf):
    """L1 with the caller's tokenizer and encoder (H1, H3)."""
    from longdoc.plans.prepare import retrieval_samples
    s = corpus.samples(spark, sf)
    for c in ("text", "model_input"):
        s = s.withColumn(c, F.regexp_replace(c, "[^ -~]", "?"))
    r = retrieval_samples(s, _CharTokenizer(), encoder=_BinEncoder())
    return out(r.select("article_id", F.size("text_tokenized").alias("n_chunks"), F.size("retrieved").alias("n_queries"),
                        F.md5(_nested("retrieved").cast("binary")).alias("retrieved_md5")))


@register("quarantine_flow")
def q_quarantine_flow(spark, sf):
    """B6 in L1: of article lines, some of them cut off, the bad ones with their reasons."""
    from longdoc.plans.prepare import prepare_dataset, read_quarantine
    raw, titles = broken_article_files(spark, sf), raw_title_file(spark, sf)
    base = _scratch(spark, sf, "quarantine_flow")
    prepare_dataset(spark, raw, titles, base, vocab_path=corpus.vocab_path(spark, sf), retrieval=False)
    bad = read_quarantine(spark, raw, titles, base)
    return out(bad.select("split", F.col("article_id").cast("bigint").alias("article_id"), F.length("line").alias("line_chars"), "error"))


def broken_article_files(spark, sf) -> str:
    """The article files with the line of every 7th article cut after 20 characters."""
    base = _scratch(spark, sf, "broken_articles")
    if not IO.path_exists(spark, f"{base}/test.txt/_SUCCESS"):
        a = corpus.articles(spark, sf).select("split", "article_id", F.to_json(F.struct(
            F.col("article_id").cast("string").alias("article_id"), "abstract_text", "article_text")).alias("line"))
        a = a.withColumn("line", F.when(F.col("article_id") % 7 == 0, F.substring("line", 1, 20)).otherwise(F.col("line")))
        for x in IO.SPLITS:
            a.where(F.col("split") == x).select("line").write.mode("overwrite").text(f"{base}/{x}.txt")
    return base


def evaluated(spark, sf):
    from longdoc.plans.evaluate import evaluate
    return evaluate(corpus.samples(spark, sf), corpus.tokenizer(spark, sf))[0]


@register("evaluate_flow")
def q_evaluate_flow(spark, sf):
    """L2 with the extractive stand-in generator: per-pair F1/EM/ROUGE-1/2 of whole documents."""
    return _r6(evaluated(spark, sf).select("id", "f1", "exact_match", "rouge1", "rouge2"), ["f1", "exact_match", "rouge1", "rouge2"])


@register("evaluate_flow_lcs")
def q_evaluate_flow_lcs(spark, sf):
    """The same flow's ROUGE-L and ROUGE-Lsum."""
    return _r6(evaluated(spark, sf).select("id", "rougeL", "rougeLsum"), ["rougeL", "rougeLsum"])


@register("score_result_file")
def q_score_result_file(spark, sf):
    """L3: write a result set of the prediction pairs, read it back, score it
    by greedy matching of token vectors."""
    from longdoc.plans.evaluate import score_pairs, score_record, score_result_file
    path = _scratch(spark, sf, "results_l3")
    IO.write_results(score_record(score_pairs(pairs(spark, sf))), result_preds(spark, sf), path, RESULT_ORDER)
    return _r6(score_result_file(spark, path), ["precision", "recall", "f1"])


@register("greedy_text")
def q_greedy_text(spark, sf):
    """G6 per pair."""
    return _r6(M.greedy_text_match(pairs(spark, sf), ["id"]), ["precision", "recall", "f1"])
