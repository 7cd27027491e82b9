"""Readers and writers round-trip; missing split skipped; corrupt line kept."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from longdoc.sources import io as IO


def test_read_articles_and_titles(spark):
    d = tempfile.mkdtemp(prefix="ld-io-")
    with open(os.path.join(d, "train.txt"), "w") as f:
        f.write(json.dumps({"article_id": "0704.0001", "abstract_text": ["<S> a . </S>"], "article_text": ["x"]}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"article_id": "0704.0002", "abstract_text": [], "article_text": ["y", "z"]}) + "\n")
    a = IO.read_articles(spark, d)
    rows = a.orderBy("ord").collect()
    assert [r.article_id for r in rows] == ["0704.0001", None, "0704.0002"]
    assert rows[1]._corrupt_record == "{not json"
    assert {r.split for r in rows} == {"train"}
    meta = os.path.join(d, "meta.json")
    with open(meta, "w") as f:
        for i, t in [("1", "a"), ("1", "b"), ("2", "c")]:
            f.write(json.dumps({"id": i, "title": t, "authors": "x"}) + "\n")
    from longdoc.operators.lookup import title_map
    t = title_map(IO.read_titles(spark, meta))
    assert {r.id: r.title for r in t.collect()} == {"1": "b", "2": "c"}


def test_read_documents(spark):
    d = tempfile.mkdtemp(prefix="ld-docs-")
    for i in range(3):
        with open(os.path.join(d, f"07{i}.json"), "w") as f:
            json.dump({"text": f"doc {i}\nline"}, f, indent=2)
    r = IO.read_documents(spark, d + "/*.json")
    assert {x.id: x.text for x in r.collect()} == {f"07{i}": f"doc {i}\nline" for i in range(3)}


def test_materialize_reuses(spark):
    base = tempfile.mkdtemp(prefix="ld-mat-")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2)

    a = IO.materialize(spark, compute, base, {"c": 64})
    b = IO.materialize(spark, compute, base, {"c": 64})
    c = IO.materialize(spark, compute, base, {"c": 32})
    assert len(calls) == 2 and a.count() == b.count() == c.count() == 5


def test_results_roundtrip(spark):
    p = tempfile.mkdtemp(prefix="ld-res-") + "/r"
    head = spark.createDataFrame([(0.5, 0.0)], "F1 double, `Exact match` double").withColumn(
        "ROUGE", F.struct(F.lit(0.1).alias("rouge1"), F.lit(0.2).alias("rouge2"),
                          F.lit(0.3).alias("rougeL"), F.lit(0.4).alias("rougeLsum")))
    preds = spark.createDataFrame([("b", "t", "m"), ("a", "t2", "m2")], "id string, truth_output string, model_answer string")
    IO.write_results(head, preds.withColumn("ord", F.when(F.col("id") == "b", 1).otherwise(10)), p, ["ord"])
    h, s = IO.read_results(spark, p)
    assert h.first().ROUGE.rougeL == 0.3
    assert [r.id for r in s.orderBy("ordinal").collect()] == ["b", "a"]  # their own order, not the ids'


def test_results_of_an_indented_array(spark):
    d = tempfile.mkdtemp(prefix="ld-arr-")
    rec = {"F1": 0.5, "Exact match": 0.0, "ROUGE": {"rouge1": 0.1, "rouge2": 0.2, "rougeL": 0.3, "rougeLsum": 0.4}}
    with open(d + "/r.json", "w") as f:
        json.dump([rec] + [{"truth_output": f"t {i}", "model_answer": "" if i == 2 else f"m {i}"} for i in range(12)], f, indent=2)
    h, s = IO.read_results(spark, d + "/r.json", array=True)
    assert h.count() == 1 and h.first().ROUGE.rouge2 == 0.2
    assert [(r.ordinal, r.truth_output) for r in s.orderBy("ordinal").collect()] == [(i + 1, f"t {i}") for i in range(12)]
    from longdoc.plans.evaluate import score_result_file
    g = score_result_file(spark, d + "/r.json", array=True).first()
    assert g.n == 12 and 0 < g.f1 < 1
    with open(d + "/bad.json", "w") as f:
        f.write('[{"F1": ')
    import pytest
    with pytest.raises(Exception):
        IO.read_results(spark, d + "/bad.json", array=True)[1].collect()


def test_samples_of_an_indented_array_and_json_lines(spark):
    d = tempfile.mkdtemp(prefix="ld-sarr-")
    with open(d + "/train.json", "w") as f:
        json.dump([{"id": str(i), "input_ids": [i, 1]} for i in range(3)], f, indent=2)
    s = IO.import_array(spark, d + "/train.json", "id string, input_ids array<int>")
    assert [(r.ordinal, r.id, r.input_ids) for r in s.collect()] == [(i, str(i), [i, 1]) for i in range(3)]
    IO.write_samples(s.withColumn("split", F.lit("train")), d + "/lines", "json")
    back = IO.read_samples(spark, d + "/lines", "json", "id string, input_ids array<int>, ordinal long, split string")
    assert back.count() == 3 and back.where("split = 'train'").count() == 3


def test_stamp_changes_with_the_input(spark):
    d = tempfile.mkdtemp(prefix="ld-stamp-")
    open(d + "/a", "w").write("x")
    one = IO.input_stamp(spark, d)
    open(d + "/b", "w").write("y")
    assert one != IO.input_stamp(spark, d) and IO.input_stamp(spark, d) == IO.input_stamp(spark, d)


def test_chunk_index_and_samples(spark):
    d = tempfile.mkdtemp(prefix="ld-idx-")
    ch = spark.createDataFrame([(a, c, [float(a), float(c)]) for a in range(5) for c in range(4)],
                               "article_id long, chunk_no int, embedding array<double>")
    IO.write_chunk_index(ch, d + "/idx", n_files=3)
    sel = spark.createDataFrame([(2,)], "article_id long")
    assert IO.read_chunk_index(spark, d + "/idx", sel).count() == 4
    s = spark.createDataFrame([("train", 1, [1, 2]), ("test", 2, [3])], "split string, id int, ids array<int>")
    IO.write_samples(s, d + "/s")
    assert IO.read_samples(spark, d + "/s").where("split = 'test'").first().id == 2


def test_read_articles_no_split_present(spark):
    d = tempfile.mkdtemp(prefix="ld-empty-")
    a = IO.read_articles(spark, d)
    assert a.count() == 0 and "split" in a.columns and "ord" in a.columns
