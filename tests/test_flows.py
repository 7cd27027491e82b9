"""The reference's three flows end to end on the smallest data."""

import tempfile

from pyspark.sql import functions as F

from longdoc.plans import corpus
from longdoc.plans.evaluate import evaluate, score_record, score_result_file
from longdoc.plans.prepare import retrieval_samples, tokenize_samples
from longdoc.sources import io as IO
from tests.conftest import SF_SMALL


def test_prepare_flow(spark):
    vp = corpus.tokenizer(spark, SF_SMALL)
    s = corpus.samples(spark, SF_SMALL)
    t = tokenize_samples(s, vp)
    r = t.first()
    assert r.prompt_ids[0] == 0 and r.input_ids[-1] == 1
    assert all(len(x.input_ids) <= 512 for x in tokenize_samples(s, vp, 512).collect())
    rs = retrieval_samples(s, vp).collect()
    assert rs, "some articles keep >= 3 chunks"
    assert sum(len(x.retrieved) for x in rs) > len(rs)
    for x in rs:
        assert all(len(c) == 64 for c in x.text_tokenized)
        assert len(x.text_tokenized) >= 3
        assert x.retrieved
        for q in x.retrieved:
            assert len(q) == min(2, len(x.text_tokenized) - 1) and all(len(p) == 128 for p in q)
    sparse = retrieval_samples(s, vp, method="sparse").collect()
    assert {x.article_id: len(x.retrieved) for x in sparse} == {x.article_id: len(x.retrieved) for x in rs}
    assert {x.article_id for x in sparse} == {x.article_id for x in rs}


def test_dense_retrieval_gives_k_per_query_chunk(spark):
    from longdoc.operators.tokens import VocabTokenizer, build_vocab, materialize_vocab
    rows = [(i, "train", i, "t", "a", " ".join(f"w{(i + j) % 23}" for j in range(400)),
             "<pad>title: t abstract: ", "<pad>title: t abstract: " + " ".join(f"w{j % 23}" for j in range(150)))
            for i in range(4)]
    s = spark.createDataFrame(rows, "article_id long, split string, ord long, title string, abstract string, "
                                    "text string, prompt string, model_input string")
    vp = VocabTokenizer(materialize_vocab(spark, build_vocab(s, "text", 100), "dense-flow-test-2"))
    r = retrieval_samples(s, vp).collect()
    assert len(r) == 4
    for x in r:
        # <pad>, three spelled words (title:, t, abstract:), 150 pieces, EOS -> 3 chunks or more
        assert len(x.retrieved) == 2
        assert all(len(q) == 2 for q in x.retrieved)


def test_evaluate_and_score_file(spark):
    per, preds = evaluate(corpus.samples(spark, SF_SMALL), corpus.tokenizer(spark, SF_SMALL))
    rows = per.collect()
    assert rows and all(0.0 <= r.rouge1 <= 1.0 and 0.0 <= r.rougeL <= 1.0 for r in rows)
    head = score_record(per)
    path = tempfile.mkdtemp(prefix="ld-eval-") + "/results"
    IO.write_results(head, preds.select("id", "ord", F.col("reference").alias("truth_output"),
                                        F.col("prediction").alias("model_answer")), path, ["ord", "id"])
    h, samples = IO.read_results(spark, path)
    assert samples.count() == preds.count() and h.count() == 1
    g = score_result_file(spark, path).first()
    assert g.n == preds.count() and 0.0 <= g.f1 <= 1.0
    assert score_result_file(spark, path, first_n=3).first().n == 3
    order = [r.id for r in samples.orderBy("ordinal").collect()]
    assert order == [r.id for r in preds.orderBy("ord").collect()]


def test_prepare_dataset_from_raw_files(spark):
    import json
    import os

    from longdoc.plans.prepare import prepare_dataset
    from longdoc.sources.tables import read_table
    d = tempfile.mkdtemp(prefix="ld-prep-")
    docs = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").limit(120).collect()
    pages = read_table(spark, SF_SMALL, "pages").collect()
    os.makedirs(os.path.join(d, "raw"))
    for split, mod in (("train", (2, 3, 4, 5, 6, 7, 8, 9)), ("val", (1,)), ("test", (0,))):
        with open(os.path.join(d, "raw", f"{split}.txt"), "w") as f:
            for r in docs:
                if r.doc_id % 10 in mod:
                    f.write(json.dumps({"article_id": str(r.doc_id), "abstract_text": ["<S> x y . </S>"],
                                        "article_text": r.text.split("\n")}) + "\n")
    import re
    with open(os.path.join(d, "meta.json"), "w") as f:
        for p in pages:
            m = re.search("<title>([^<]*)</title>", p.html)
            f.write(json.dumps({"id": str(p.page_id), "title": m.group(1) if m else ""}) + "\n")
    out = os.path.join(d, "prepared")
    a = prepare_dataset(spark, os.path.join(d, "raw"), os.path.join(d, "meta.json"), out, cap=5,
                        vocab_size=5000)
    rows = a.collect()
    assert rows and all(r.input_ids[-1] == 1 for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.split, []).append(r.ord)
    assert all(len(v) <= 5 for v in per.values())
    b = prepare_dataset(spark, os.path.join(d, "raw"), os.path.join(d, "meta.json"), out, cap=5,
                        vocab_size=5000)
    assert b.count() == len(rows)
    # a changed input is prepared anew, and what can't be read is set aside
    from longdoc.plans.prepare import read_quarantine
    raw, meta = os.path.join(d, "raw"), os.path.join(d, "meta.json")
    with open(os.path.join(raw, "test.txt"), "w") as f:
        f.write('{"article_id": "0", "abstract_text": ["<S> changed . </S>"], "article_text": ["' + "word " * 300 + '"]}\n{"article_id": "1", \n')
        f.write('{"article_id": "999999", "abstract_text": [], "article_text": []}\n{"abstract_text": []}\n')
    c = prepare_dataset(spark, raw, meta, out, cap=5, vocab_size=5000).where("split = 'test'").collect()
    assert [r.id for r in c] == ["0"] and "changed" in c[0].model_input
    bad = {r.error: r for r in read_quarantine(spark, raw, meta, out).where("split = 'test'").collect()}
    assert set(bad) == {"not_json", "no_title", "no_id"} and bad["not_json"].line.startswith('{"article_id": "1"')


def test_evaluate_dataset_after_prepare(spark):
    import os

    from longdoc.plans.evaluate import evaluate_dataset
    from longdoc.plans.prepare import tokenize_samples, retrieval_samples
    from longdoc.sources.io import read_results, write_samples
    vp = corpus.tokenizer(spark, SF_SMALL)
    s = tokenize_samples(retrieval_samples(corpus.samples(spark, SF_SMALL), vp), vp)
    d = tempfile.mkdtemp(prefix="ld-evalds-")
    write_samples(s.select("split", F.col("article_id").alias("id"), "ord", "prompt", "model_input",
                           "prompt_ids", "input_ids", "text_tokenized", "retrieved"), os.path.join(d, "p"))
    n_train = s.where("split = 'train'").count()
    head = evaluate_dataset(spark, os.path.join(d, "p"), os.path.join(d, "r"), vp, split="train").first()
    assert 0.0 <= head.F1 <= 1.0 and 0.0 <= head.ROUGE.rouge1 <= 1.0
    h, preds = read_results(spark, os.path.join(d, "r"))
    assert preds.count() == n_train
    # the prediction starts with the decoded prompt (Q3), word for word
    got = {r.id: r.model_answer for r in preds.collect()}
    titles = {str(r.article_id): r.title for r in s.where("split = 'train'").select("article_id", "title").collect()}
    assert all(got[i].split()[:2] == ["title:", *titles[i].split()[:1]] for i in got)
    assert [r.id for r in preds.orderBy("ordinal").collect()] == [str(r.article_id) for r in s.where("split = 'train'").orderBy("ord").collect()]
    g = evaluate_dataset(spark, os.path.join(d, "p"), os.path.join(d, "r2"), vp, split="train",
                         generator=lambda xs: [x + " hello" for x in xs]).first()
    assert g.F1 >= 0.0

    def reader():
        return lambda rows: [f"{len(r['retrieved'])} {len(r['text_tokenized'])} {r['prompt_ids'][0]}" for r in rows]
    g = evaluate_dataset(spark, os.path.join(d, "p"), os.path.join(d, "r3"), vp, split="train", generator=reader,
                         inputs=["id", "prompt_ids", "text_tokenized", "retrieved"], batch=4, per_task=True)
    assert g.count() == 1
    _, preds = read_results(spark, os.path.join(d, "r3"))
    want = {str(r.article_id): f"{len(r.retrieved)} {len(r.text_tokenized)} 0" for r in s.where("split = 'train'").collect()}
    assert {r.id: r.model_answer for r in preds.collect()} == want


def test_lcs_scores_of_whole_documents(spark):
    """ROUGE-L and ROUGE-Lsum of evaluated documents against plain tables."""
    import re

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t

    def f(hits, n, m):
        p, r = hits / m if m else 0.0, hits / n if n else 0.0
        return 2 * p * r / (p + r) if p + r else 0.0

    from collections import Counter
    tok = lambda x: re.findall("[a-z0-9]+", x.lower())
    s = corpus.samples(spark, SF_SMALL).where("length(model_input) < 1500")
    per, preds = evaluate(s, corpus.tokenizer(spark, SF_SMALL))
    got = {r.id: (r.rougeL, r.rougeLsum) for r in per.collect()}
    assert got
    for r in preds.collect():
        a, b = tok(r.rouge_reference), tok(r.prediction)
        rl = f(table(a, b)[-1][-1], len(a), len(b))
        left, right, hits = Counter(a), Counter(b), 0
        for x in filter(None, map(tok, r.rouge_reference.split("\n"))):
            found = set()
            for y in filter(None, map(tok, r.prediction.split("\n"))):
                t, i, j = table(x, y), len(x), len(y)
                while i and j:
                    if x[i - 1] == y[j - 1]:
                        found.add(i - 1)
                        i, j = i - 1, j - 1
                    elif t[i][j - 1] > t[i - 1][j]:
                        j -= 1
                    else:
                        i -= 1
            for i in sorted(found):
                if left[x[i]] > 0 and right[x[i]] > 0:
                    hits, left[x[i]], right[x[i]] = hits + 1, left[x[i]] - 1, right[x[i]] - 1
        assert abs(got[r.id][0] - rl) < 1e-9 and abs(got[r.id][1] - f(hits, len(a), len(b))) < 1e-9


def test_flows_take_the_callers_tokenizer_and_encoder(spark):
    """H1, H3: character ids and a vector of two counts, made once per task."""
    from longdoc.operators.retrieve import UserEncoder
    from longdoc.operators.tokens import UserTokenizer

    def encoder():
        return lambda texts: [[ord(c) + 3 for c in t] + [1] for t in texts]

    def decoder():
        return lambda rows: ["".join(chr(i - 3) for i in ids if i >= 3) for ids in rows]

    def vectors():
        return lambda rows: [[float(sum(i == ord("a") + 3 for i in ids)), 1.0] for ids in rows]

    text = "".join(("a" if (i // 64) % 5 == 2 else "b") for i in range(64 * 11))
    rows = [(i, "test", i, "t", "abstract", text, "p", "p" + "a" * 150) for i in range(3)]
    s = spark.createDataFrame(rows, "article_id long, split string, ord long, title string, abstract string, "
                                    "text string, prompt string, model_input string")
    tok = UserTokenizer(encoder, decoder)
    r = retrieval_samples(s, tok, encoder=UserEncoder(vectors)).collect()
    assert len(r) == 3
    for x in r:
        # chunks 2 and 7 are all a's; every one of the two query chunks finds them
        assert len(x.retrieved) == 2 and all([p[0] for p in q] == [ord("a") + 3] * 2 for q in x.retrieved)
        assert x.retrieved[0][0] == x.text_tokenized[2] + x.text_tokenized[3]
    per, preds = evaluate(s, tok, encoder=UserEncoder(vectors))
    p = preds.first()
    assert p.prediction.startswith("p" + "a" * 64 + "b" * 64) and p.reference == rows[0][-1] and per.count() == 3
