"""Shuffle, global rank, batches, shards: properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from longdoc.operators import batches as B


def frame(spark, n=500):
    rows = [("train" if i % 10 > 1 else ("val" if i % 10 == 1 else "test"), i, i) for i in range(n)]
    return spark.createDataFrame(rows, "split string, article_id long, ord long")


def test_global_rank_equals_row_number(spark):
    df = frame(spark)
    g = B.global_rank(df, ["split"], ["ord"], n_parts=7)
    w = Window.partitionBy("split").orderBy("ord")
    ref = df.withColumn("pos", F.row_number().over(w))
    assert sorted(map(tuple, g.select("split", "article_id", "pos").collect())) == \
        sorted(map(tuple, ref.select("split", "article_id", "pos").collect()))


def test_shuffle_is_seeded_and_keeps_val_order(spark):
    df = frame(spark)
    a = {(r.split, r.article_id): r.pos for r in B.shuffle_seeded(df).collect()}
    b = {(r.split, r.article_id): r.pos for r in B.shuffle_seeded(df.repartition(5)).collect()}
    assert a == b
    val = sorted((p, i) for (s, i), p in a.items() if s == "val")
    assert [i for _, i in val] == sorted(i for _, i in val)
    train = sorted((p, i) for (s, i), p in a.items() if s == "train")
    assert [i for _, i in train] != sorted(i for _, i in train)
    other = {(r.split, r.article_id): r.pos for r in B.shuffle_seeded(df, seed=7).collect()}
    assert other != a


def test_batches_and_shards(spark):
    df = B.batch_assign(B.shuffle_seeded(frame(spark)), 8)
    sizes = [r["count"] for r in df.groupBy("split", "batch_no").count().collect()]
    assert max(sizes) == 8
    sh = B.shard_assign(df, 4)
    parts = [set(r.article_id for r in sh.where(F.col("shard") == s).collect()) for s in range(4)]
    assert sum(len(p) for p in parts) == 500 and len(set().union(*parts)) == 500


def test_first_n_and_flatten(spark):
    df = frame(spark)
    f = B.first_n_per_group(df, 3, "split", ["ord"])
    got = sorted((r.split, r.article_id) for r in f.collect())
    assert got == sorted([("test", 0), ("test", 10), ("test", 20), ("val", 1), ("val", 11), ("val", 21),
                          ("train", 2), ("train", 3), ("train", 4)])
    b = B.batch_assign(B.shuffle_seeded(df.withColumn("ids", F.array(F.col("ord").cast("int")))), 8)
    c = B.collate_all(b.select("split", "batch_no", "pos", "article_id", "ids"))
    flat = B.flatten_batches(c, ["split", "batch_no"], ["article_id"])
    assert flat.count() == 500


def test_global_rank_of_slim_columns(spark):
    df = frame(spark, 200).withColumn("text", F.lit("long text")).withColumn(
        "split", F.when(F.col("ord") % 9 != 0, F.col("split")))  # a null split is a group of its own
    g = B.global_rank(df, ["split"], ["ord"], n_parts=5)
    assert g.columns == [*df.columns, "pos"]
    w = Window.partitionBy("split").orderBy("ord")
    ref = df.withColumn("pos", F.row_number().over(w))
    assert sorted(map(str, g.select("split", "article_id", "pos").collect())) == \
        sorted(map(str, ref.select("split", "article_id", "pos").collect()))


def test_collate_by_name(spark):
    import pytest
    df = spark.createDataFrame([("train", 0, i, i, [7] * i, [8] * i, [9], [[5] * 2] * i) for i in (1, 2)],
                               "split string, batch_no int, pos int, article_id int, prompt_ids array<int>, input_ids array<int>, "
                               "labels array<int>, text_tokenized array<array<int>>")
    dec, enc = B.collate_by_name(df, "decoder").first(), B.collate_by_name(df, "encdec").first()
    assert dec.input_ids == [[8, 1], [8, 8]] and "text_tokenized" not in dec.asDict()
    assert enc.input_ids == [[8, 0], [8, 8]] and enc.attention_mask == [[True, False], [True, True]]
    test = B.collate_by_name(df, "decoder", test_mode=True, c=2).first()
    assert test.text_tokenized == [[[5, 5], [1, 1]], [[5, 5], [5, 5]]]
    with pytest.raises(ValueError):
        B.collate_by_name(df, "beam")


def test_recommended_conf_scales_partitions():
    from longdoc.session import recommended_conf
    small = recommended_conf(1 << 30, "hdfs://x/ckpt")
    big = recommended_conf(100 << 40, "hdfs://x/ckpt")
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.checkpoint.dir"] == "hdfs://x/ckpt"


def test_write_shards_disjoint_and_complete(spark):
    import tempfile
    df = B.shard_assign(B.shuffle_seeded(frame(spark, 100)), 3)
    path = tempfile.mkdtemp(prefix="ld-shards-") + "/s"
    B.write_shards(df.select("article_id", "split", "shard"), path)
    back = spark.read.parquet(path)
    per = {s: {r.article_id for r in back.where(F.col("shard") == s).collect()} for s in range(3)}
    assert sum(map(len, per.values())) == 100 and len(set().union(*per.values())) == 100


def test_global_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [("a", i) for i in range(3)],
                               "split string, ord long")
    g = B.global_rank(df, ["split"], ["ord"], n_parts=3)
    got = sorted((r.split or "", r.ord, r.pos) for r in g.collect())
    assert got == sorted([("", i, i + 1) for i in range(5)] + [("a", i, i + 1) for i in range(3)])


def test_global_rank_keeps_repeated_and_hot_keys(spark):
    """Rows that tie on all order columns stay as many as they are, each in a place of its own."""
    hot = spark.range(2000).select(F.lit("train").alias("split"), F.lit(7).cast("long").alias("article_id"),
                                   F.lit(1).cast("long").alias("ord"), F.col("id").alias("row"))
    twice = frame(spark, 300).crossJoin(spark.range(2).withColumnRenamed("id", "row"))
    null = hot.limit(5).withColumn("ord", F.lit(None).cast("long")).withColumn("article_id", F.lit(None).cast("long"))
    df = hot.unionByName(twice).unionByName(null)
    for ranked in (B.global_rank(df, ["split"], ["ord", "article_id"], n_parts=7), B.shuffle_seeded(df)):
        got = ranked.collect()
        assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (tuple(r) for r in df.collect())))
        for split in ("train", "val", "test"):
            pos = sorted(r.pos for r in got if r.split == split)
            assert pos == list(range(1, len(pos) + 1))
    # in order of the keys
    own = [(r.ord is not None, r.ord or 0) for r in sorted(
        B.global_rank(df, ["split"], ["ord", "article_id"]).where("split = 'train'").collect(), key=lambda r: r.pos)]
    assert own == sorted(own)
    first = B.first_n_per_group(df, 10, "split", ["ord", "article_id"])
    assert {r["split"]: r["count"] for r in first.groupBy("split").count().collect()} == {"train": 10, "val": 10, "test": 10}
    assert first.distinct().count() == 30


def test_write_results_of_repeated_ids(spark):
    import tempfile

    from longdoc.sources.io import read_results, write_results
    preds = spark.createDataFrame([(1, "a", "t", "m")] * 40 + [(2, "b", "t", "m")], "ord int, id string, truth_output string, model_answer string")
    path = tempfile.mkdtemp(prefix="ld-results-") + "/r"
    write_results(spark.createDataFrame([(0.5,)], "f1 double"), preds, path, ["ord", "id"])
    rows = [r.ordinal for r in read_results(spark, path)[1].collect()]
    assert sorted(rows) == list(range(1, 42))


def test_first_n_moves_only_kept_rows(spark, monkeypatch):
    """Ties, nulls, hot keys and groups of fewer rows; only the order columns of all rows are ranked."""
    from longdoc.operators import batches as B
    rows = ([("a", i, None, f"x{i}") for i in range(50)] + [("b", 7, "k", f"y{i}") for i in range(400)] + [("c", 1, "k", "z")]
            + [(None, i % 3, None, f"n{i}") for i in range(9)] + [("d", None if i < 4 else i, "q", f"d{i}") for i in range(20)])
    df = spark.createDataFrame(rows, "split string, ord int, tie string, body string").repartition(6)
    ranked = []
    plain = B.global_rank
    monkeypatch.setattr(B, "global_rank", lambda d, *a, **k: ranked.append((d.columns, d.count())) or plain(d, *a, **k))
    for n in (1, 5, 40, 1000):
        got = [tuple(r) for r in B.first_n_per_group(df, n, "split", ["ord", "tie"]).collect()]
        assert len(got) == len(set(got)) == sum(min(n, sum(r[0] == s for r in rows)) for s in ("a", "b", "c", "d", None))
        for s in ("a", "b", "c", "d", None):
            key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
            assert sorted(key(r) for r in got if r[0] == s) == sorted(key(r) for r in rows if r[0] == s)[:n]
    whole = [c for c, m in ranked if "body" in c]
    assert all("body" not in c for c, m in ranked if m == len(rows)) and len(whole) == 3  # ties alone are ranked as rows
    assert B.first_n_per_group(df, 0, "split").collect() == []
    assert B.first_n_per_group(df.limit(0), 3, "split").collect() == []
