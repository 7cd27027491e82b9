"""Steps that have to grow no faster than their input."""

import time

from pyspark.sql import functions as F

from longdoc.functions import text as TX
from longdoc.operators import chunks as CH
from longdoc.operators import sparse_index as SI
from longdoc.operators import tokens as TK
from longdoc.sources.io import written


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_masked_chunks_are_shuffled_once_as_arrays(spark):
    docs = [(1, [5, 6, 1, 7, 8]), (2, [5, 6, 7]), (3, [5, 6, 7, 8, 9, 1, 4]), (4, []), (5, None), (6, [5, 1]), (6, [5, 1])]
    df = spark.createDataFrame(docs, "k long, ids array<int>")
    m = CH.mask_after_eos_rows(df, "k", "ids", 2)
    assert exchanges(m) == 1
    got = {(r.k, r.chunk_no): r.ids for r in m.collect()}
    assert got == {(1, 0): [5, 6], (1, 1): [1, 0], (1, 2): [0], (2, 0): [5, 6], (2, 1): [7],
                   (3, 0): [5, 6], (3, 1): [7, 8], (3, 2): [9, 1], (3, 3): [0], (6, 0): [5, 5, 0, 1]}


def test_masked_chunks_of_null_keys(spark):
    df = spark.createDataFrame([(None, [1, 5]), (None, [6, 7, 8, 9])], "k long, ids array<int>")
    got = {r.chunk_no: r.ids for r in CH.mask_after_eos_rows(df, "k", "ids", 2).collect()}
    assert got[1] == [0, 0] and len(got[0]) == 4


def test_sections_are_trimmed_in_linear_time(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(29999)), lambda i: F.concat(F.lit("name"), i.cast("string"))).alias("n"))
    t0 = time.time()
    r = df.select(F.size(TX.trim_sections("n", F.transform("n", lambda x: F.array(x)), start="name20000", end="name2999")).alias("s")).first()
    assert r.s == 9991 and time.time() - t0 < 20  # name20000 .. name29990


def test_trimmed_sections_without_a_marker(spark):
    rows = [(["Intro", "b", "Concl"],), (["concl", "b", None],), (["x", "intro"],), ([],), (None,), (["intro concl", "concl"],)]
    df = spark.createDataFrame(rows, "n array<string>").withColumn("s", F.transform("n", lambda x, i: F.array(i)))
    got = [r.k for r in df.select(TX.trim_sections("n", "s", start="intro", end="concl").alias("k")).collect()]
    assert got == [[0, 1, 2], [0], [1], [], None, [0]]


def test_pieces_of_odd_texts(spark):
    texts = ["a  b\tc", None, "", " \n", "x<pad>y </s>", "é\x0bü\x0cz 世", "<unk><unk>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    want = [r.p or [] for r in df.orderBy("i").select(TK.pieces("text").alias("p")).collect()]
    import pyarrow as pa
    kept, rows, size, data = TK.split_pieces(pa.array(["cut off", *texts], pa.string())[1:])
    got = [[] for _ in texts]
    for row, piece in zip(rows.tolist(), kept.to_pylist(), strict=True):
        got[row].append(piece)
    assert got == want and [len(x.encode()) for p in want for x in p] == size.tolist()
    assert data.tobytes() == "".join(x for p in want for x in p).encode()
    counts = {r.token: r.cnt for r in TK.build_vocab(df, "text", 100).collect()}
    assert counts == {x: 1 for p in want for x in p if x not in ("<pad>", "</s>", "<unk>")}


def test_search_of_an_index_in_itself_shuffles_its_blocks_once(spark, monkeypatch):
    arts = [(i, [[300 + (i * 7 + j * j) % 11, 300 + j % 5, 300 + j] for j in range(6)]) for i in range(20)] + [(None, [[300], [300]])]
    index = written(SI.build(spark.createDataFrame(arts, "article_id long, text_tokenized array<array<int>>")), "test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = SI.search(index, index, exclude_self=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(tile") == 1
        key = lambda r: (r.article_id, r.query_no, r["rank"], r.chunk_no, round(r.score, 9))
        got = sorted(map(key, found.collect()))
        assert len(got) == 20 * 6 * 2
        other = index.select("*")  # the search of two tables
        assert got == sorted(map(key, SI.search(other, index, exclude_self=True).collect()))
        monkeypatch.setattr(SI, "TILE_BLOCKS", 1)
        monkeypatch.setattr(SI, "BLOCK", 2)  # every article is larger than a tile
        small = written(SI.build(spark.createDataFrame(arts, "article_id long, text_tokenized array<array<int>>")), "test")
        assert got == sorted(map(key, SI.search(small, small, exclude_self=True).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_session_bounds_its_arrow_batches(spark):
    """A later session of an application, left at Spark's default, gets batches as small as the first one's; a number of its own stays."""
    from longdoc.session import ARROW_BATCH_ROWS, ship_package
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    def largest(session, rows):
        session.conf.set(name, rows)
        ship_package(session)
        return max(r.n for r in session.range(0, 12_000, 1, 1).mapInArrow(sizes, "n long").collect())

    ship_package(spark)
    assert largest(spark.newSession(), "10000") == ARROW_BATCH_ROWS
    assert largest(spark.newSession(), "3000") == 3000
