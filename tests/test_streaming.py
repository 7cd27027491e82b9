import json
import os
import tempfile

from longdoc.operators.tokens import build_vocab, materialize_vocab
from longdoc.streaming.prepare import article_stream, prepared_chunks, start


def test_stream_chunks_equal_batch(spark):
    d = tempfile.mkdtemp(prefix="ld-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    rows = [{"article_id": str(i), "abstract_text": ["<S> a . </S>"],
             "article_text": [" ".join(f"w{j % 17}" for j in range(i * 40))]} for i in range(1, 6)]
    with open(os.path.join(src, "part.json"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    text = spark.createDataFrame([(r["article_text"][0],) for r in rows], "text string")
    vp = materialize_vocab(spark, build_vocab(text, "text", 100), "stream-test-" + d)
    q = start(prepared_chunks(article_stream(spark, src), vp, 64), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(d, "out"))
    batch = prepared_chunks(spark.read.schema("article_id STRING, abstract_text ARRAY<STRING>, "
                                              "article_text ARRAY<STRING>").json(src), vp, 64)
    key = lambda r: (r.article_id, r.chunk_no, tuple(r.token_ids))
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_stream_scores_equal_batch(spark):
    from longdoc.plans.evaluate import score_pairs, score_record
    from longdoc.streaming.score import corpus_scores, pair_stream, score_stream
    d = tempfile.mkdtemp(prefix="ld-sscore-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    rows = [{"id": str(i), "reference": f"the cat sat on mat {i}", "prediction": f"a cat sat {i % 3}"}
            for i in range(30)]
    for part in range(3):
        with open(os.path.join(src, f"p{part}.json"), "w") as f:
            for r in rows[part * 10:(part + 1) * 10]:
                f.write(json.dumps(r) + "\n")
    q = score_stream(pair_stream(spark, src, max_files=1), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(180)
    got = corpus_scores(spark, os.path.join(d, "out")).first()
    batch = spark.createDataFrame([(r["id"], r["reference"], r["prediction"]) for r in rows],
                                  "id string, reference string, prediction string")
    exp = score_record(score_pairs(batch)).first()
    assert abs(got.F1 - exp.F1) < 1e-12 and got.ROUGE == exp.ROUGE
    assert spark.read.parquet(os.path.join(d, "out")).select("epoch").distinct().count() == 3


def test_stream_with_static_title_join(spark):
    d = tempfile.mkdtemp(prefix="ld-stream-titles-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    rows = [{"article_id": str(i), "abstract_text": ["<S> a . </S>"],
             "article_text": [" ".join(f"w{j % 11}" for j in range(130))]} for i in range(4)]
    with open(os.path.join(src, "part.json"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    text = spark.createDataFrame([(r["article_text"][0],) for r in rows], "text string")
    vp = materialize_vocab(spark, build_vocab(text, "text", 50), "stream-titles-" + d)
    titles = spark.createDataFrame([("1", "t1"), ("3", "t3")], "article_id string, title string")
    q = start(prepared_chunks(article_stream(spark, src), vp, 64, titles=titles),
              os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(d, "out"))
    assert sorted({r.article_id for r in got.collect()}) == ["1", "3"]
    assert got.where("article_id = '1'").count() == 3  # 130 ids + EOS -> 3 chunks of 64
