from pyspark.sql import functions as F

from longdoc.functions import text as TX
from longdoc.operators.lookup import lookup_title, quarantine, title_map


def test_abstract_and_prompt(spark):
    df = spark.createDataFrame([(["<S> a b . </S>", "<S> c . </S>"], "T")], "s array<string>, t string")
    r = df.select(TX.flatten_abstract("s").alias("a"), TX.build_prompt("t").alias("p")).first()
    assert r.a == "a b . c ."
    assert r.p == "<pad>title: T abstract: "


def test_new_style_id_and_strip(spark):
    df = spark.createDataFrame([("0704.0021",), ("hep-ph",)], "i string")
    assert [r[0] for r in df.select(TX.new_style_id("i")).collect()] == ["0704.0021", None]
    s = spark.createDataFrame([(" \t x y \n ",)], "t string").select(TX.strip_text("t")).first()[0]
    assert s == "x y"


def test_title_map_last_and_lookup_first(spark):
    meta = spark.createDataFrame([("1", "a", 0), ("1", "b", 1)], "id string, title string, ord int")
    assert title_map(meta).first()["title"] == "b"
    ids = spark.createDataFrame([("1",), ("2",)], "article_id string")
    got = {r.article_id: r.title for r in lookup_title(ids, meta).collect()}
    assert got == {"1": "a", "2": None}


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    good, bad = quarantine(df, {"missing_t": F.col("t").isNull()})
    assert [r.id for r in good.collect()] == [1]
    assert [(r.id, r.error) for r in bad.collect()] == [(2, "missing_t")]


def test_trim_sections(spark):
    df = spark.createDataFrame([(["Abstract", "Introduction", "Method", "Conclusion", "Refs"],
                                 [["a"], ["i"], ["m"], ["c"], ["r"]])],
                               "n array<string>, s array<array<string>>")
    assert df.select(TX.trim_sections("n", "s")).first()[0] == ["i", "m", "c"]
    df2 = spark.createDataFrame([(["A", "B"], [["a"], ["b"]])], "n array<string>, s array<array<string>>")
    assert df2.select(TX.trim_sections("n", "s")).first()[0] == ["a", "b"]
