import math

import pytest

from longdoc.operators import sampling as S


def cands(spark, groups=3000, logits=(0.0, 1.0, 2.0, 3.0)):
    rows = [(g, c, l) for g in range(groups) for c, l in enumerate(logits)]
    return spark.createDataFrame(rows, "grp long, cand long, logit double")


def test_gumbel_frequencies_follow_softmax(spark):
    df = cands(spark)
    s = S.gumbel_sample(df, seed=3)
    freq = {r.sampled: r["count"] / 3000 for r in s.groupBy("sampled").count().collect()}
    z = sum(math.exp(x) for x in (0, 1, 2, 3))
    for c, l in enumerate((0, 1, 2, 3)):
        assert freq.get(c, 0) == pytest.approx(math.exp(l) / z, abs=0.03)


def test_topk_and_nucleus(spark):
    df = cands(spark, 2, (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0))
    top = S.topk_fraction(df, thres=0.75)  # k = floor(0.25 * 10) = 2
    assert sorted(r.cand for r in top.where("grp = 0").collect()) == [8, 9]
    nuc = S.nucleus(df, p=0.9)
    kept = sorted(r.cand for r in nuc.where("grp = 0").collect())
    assert kept == [7, 8, 9]
    with pytest.raises(ValueError):
        S.filter_candidates(df, "beam")


def test_generate_batches(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id int, prompt string")
    out = S.generate(df, lambda xs: [x.upper() for x in xs], batch=3)
    assert {r.id: r.prediction for r in out.collect()} == {i: f"P{i}" for i in range(10)}


def test_extractive_draft(spark):
    nb = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 1, 2), (1, 2, 1, 0), (1, 0, 2, 1)],
                               "article_id long, query_no int, rank int, chunk_no int")
    art = spark.createDataFrame([(1, [[1], [2], [5], [6]])], "article_id long, text_tokenized array<array<int>>")
    assert S.extractive_draft(nb, art, max_len=3).first().draft_ids == [5, 6, 1]
    assert S.extractive_draft(nb, art, None).first().draft_ids == [5, 6, 1, 2]  # chunk 2 once


def test_filters_by_name(spark):
    df = spark.createDataFrame([(g, c, float((c * 7 + g) % 10)) for g in range(3) for c in range(10)], "grp int, cand int, logit double")
    rows = lambda x: sorted((r.grp, r.cand) for r in x.collect())
    assert rows(S.filter_candidates(df, "top_k", thres=0.7)) == rows(S.topk_fraction(df, thres=0.7)) != []
    assert rows(S.filter_candidates(df, "top_p", thres=0.5)) == rows(S.nucleus(df, p=0.5)) != []


@pytest.mark.parametrize("bins", [3, 64])
def test_selection_in_hot_groups(spark, monkeypatch, bins):
    """Groups over the bound, with ties, equal logits, nulls, infinities and NaN: the rows that sorting the group gives, and no
    window over a hot group."""
    import random

    from longdoc.operators import sampling as S
    rng = random.Random(bins)
    rows = [("a", i, rng.gauss(0, 3)) for i in range(500)] + [("b", i, 1.0) for i in range(400)]
    rows += [("c", i, rng.choice([0.0, 1.0, 2.0])) for i in range(300)] + [("d", i, float(i)) for i in range(9)]
    rows += [(None, i, rng.gauss(0, 1) if i % 7 else None) for i in range(200)]
    odd = rows + [("e", i, rng.choice([float("inf"), float("-inf"), float("nan"), 1e308, -1e308, 0.5, None])) for i in range(150)]
    key = lambda r: (str(r[0]), r[1])
    for data, run in ((odd, lambda d: S.topk_fraction(d, thres=0.7)), (rows, lambda d: S.nucleus(d, p=0.8011)), (rows, lambda d: S.nucleus(d, p=0.3107)),
                      (odd, lambda d: S.topk_fraction(d, thres=1.0))):
        df = spark.createDataFrame(data, "grp string, cand int, logit double").repartition(5)
        monkeypatch.setattr(S, "HOT_GROUP", 10 ** 6)
        whole = sorted((tuple(r)[:2] for r in run(df).collect()), key=key)
        monkeypatch.setattr(S, "HOT_GROUP", 20)
        monkeypatch.setattr(S, "BINS", bins)
        got = run(df)
        assert got.columns[:3] == ["grp", "cand", "logit"]
        assert sorted((tuple(r)[:2] for r in got.collect()), key=key) == whole


def test_hot_group_gives_bounded_tasks(spark, monkeypatch):
    """A third of all rows in one group: what is ranked is the cut interval, not the group."""
    from pyspark.sql import functions as F

    from longdoc.operators import sampling as S
    monkeypatch.setattr(S, "HOT_GROUP", 2000)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("grp"),
                                    F.col("id").alias("cand"), F.rand(1).alias("logit"))
    ranked = []
    plain = S.global_rank
    monkeypatch.setattr(S, "global_rank", lambda d, *a, **k: ranked.append(d.count()) or plain(d, *a, **k))
    out = S.topk_fraction(df).groupBy("grp").count().where("grp = -1").first()["count"]
    assert out == 1999 and max(ranked) <= 2000
