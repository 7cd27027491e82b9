"""Golden numbers of the one published result and metric properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longdoc.operators import metrics as M


def lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_bit_parallel_lcs_matches_dp(a, b):
    assert M.lcs_length(a, b) == lcs_dp(a, b)
    assert len(M.lcs_positions(a, b)) == lcs_dp(a, b)


def pairs_df(spark, rows):
    return spark.createDataFrame(rows, "id string, reference string, prediction string")


def test_golden_f1(spark):
    # overlap 5, reference 6 tokens, prediction 186 tokens -> 2*5/(6+186)
    ref = "w0 w1 w2 w3 w4 x"
    pred = " ".join(["w0", "w1", "w2", "w3", "w4"] + [f"y{i}" for i in range(181)])
    r = M.qa_f1_em(pairs_df(spark, [("1", ref, pred)])).first()
    assert r.f1 == pytest.approx(0.0520833, abs=1e-7)
    assert r.exact_match == 0.0


def test_golden_rouge(spark):
    # ROUGE-1: overlap 6 of 8 / 204; ROUGE-2: 5 of 7 / 203; LCS 6 -> ROUGE-L as ROUGE-1
    ref = "pad a b c d e f z"
    pred = " ".join(["pad", "a", "b", "c", "d", "e"] + [f"q{i}" for i in range(198)])
    p = pairs_df(spark, [("1", ref, pred)])
    assert round(M.rouge_n(p, 1).first().fmeasure, 4) == 0.0566
    assert round(M.rouge_n(p, 2).first().fmeasure, 4) == 0.0476
    assert round(M.rouge_l(p).first().fmeasure, 4) == 0.0566
    assert round(M.rouge_lsum(p).first().fmeasure, 4) == 0.0566


def test_identical_and_empty(spark):
    p = pairs_df(spark, [("1", "The cat sat.", "the cat sat"), ("2", "", ""), ("3", "", "x")])
    f = {r.id: (r.f1, r.exact_match) for r in M.qa_f1_em(p).collect()}
    assert f == {"1": (1.0, 1.0), "2": (1.0, 1.0), "3": (0.0, 0.0)}
    r1 = {r.id: r.fmeasure for r in M.rouge_n(p, 1).collect()}
    assert r1["1"] == 1.0 and r1["3"] == 0.0
    assert {r.id: r.fmeasure for r in M.rouge_l(p).collect()}["1"] == 1.0


def test_rouge_bounds_on_random_text(spark):
    rnd = random.Random(1)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = [(str(i), " ".join(rnd.choices(words, k=rnd.randint(0, 30))),
             " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(50)]
    p = pairs_df(spark, rows)
    for df in (M.rouge_n(p, 1), M.rouge_n(p, 2), M.rouge_l(p), M.rouge_lsum(p)):
        for r in df.collect():
            assert 0.0 <= r.fmeasure <= 1.0
    lcs = {r.id: r.fmeasure for r in M.rouge_l(p).collect()}
    for i, a, b in rows:
        ta, tb = a.split(), b.split()
        l = lcs_dp(ta, tb)
        exp = 0.0 if not l else 2 * (l / len(tb)) * (l / len(ta)) / (l / len(tb) + l / len(ta))
        assert lcs[i] == pytest.approx(exp)


def test_bootstrap_mid_near_mean(spark):
    rnd = random.Random(7)
    scores = spark.createDataFrame([(str(i), rnd.random()) for i in range(400)], "id string, fmeasure double")
    mean = scores.groupBy().avg("fmeasure").first()[0]
    b = M.bootstrap_mid(scores, reps=300).first()
    assert b.low < b.mid < b.high
    assert abs(b.mid - mean) < 0.02


def test_classification_and_weighted_mean(spark):
    df = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1), ([0.3, 0.7], 0), ([0.6, 0.4], 0)],
                               "logits array<double>, truth int")
    r = M.classification_prf(df).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    w = spark.createDataFrame([(1.0, 2), (4.0, 1)], "value double, weight int")
    assert M.weighted_mean(w).first()[0] == pytest.approx(2.0)


def test_repeated_and_null_ids_score_by_row(spark):
    from longdoc.operators import metrics as M
    from longdoc.plans.evaluate import score_pairs
    rows = [("x", "a1 b c d", "a1 b"), ("x", "e f", "g h"), (None, "same words", "same words"), ("y", None, "z"), ("z", None, None)]
    df = spark.createDataFrame(rows, "id string, reference string, prediction string")
    got = [(r.id, round(r.f1, 3), round(r.rouge1, 3)) for r in score_pairs(df).collect()]
    assert got == [("x", 0.667, 0.667), ("x", 0.0, 0.0), (None, 1.0, 1.0), ("y", 0.0, 0.0), ("z", 1.0, 0.0)]
    assert "Exchange" not in score_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert [round(r.fmeasure, 3) for r in M.rouge_n(df, 1).collect()] == [0.667, 0.0, 1.0, 0.0, 0.0]


def test_every_pair_of_a_result_file_counts(spark):
    from longdoc.operators.metrics import greedy_text_match
    rows = [("1", "identical words here", "identical words here"), ("2", "something", ""), ("3", "qzx wvk", "qzx wvk"), ("4", None, None)]
    df = spark.createDataFrame(rows, "id string, reference string, prediction string")
    got = {r.id: round(r.f1, 6) for r in greedy_text_match(df, ["id"]).collect()}
    assert got == {"1": 1.0, "2": 0.0, "3": 1.0, "4": 1.0}


def test_unrelated_texts_score_low(spark):
    import random

    from longdoc.operators.metrics import greedy_text_match
    rng = random.Random(0)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    rows = [(str(i), " ".join(word("abcdefghijklm") for _ in range(200)), " ".join(word("nopqrstuvwxyz") for _ in range(200))) for i in range(5)]
    near = [("n", "the walking dogs", "the walked dog")]
    got = {r.id: r.f1 for r in greedy_text_match(spark.createDataFrame(rows + near, "id string, reference string, prediction string"), ["id"]).collect()}
    assert all(got[str(i)] < 0.15 for i in range(5)) and 0.5 < got["n"] < 1


def test_bootstrap_is_of_the_rows(spark):
    import numpy as np

    from longdoc.operators.metrics import bootstrap_mid, bootstrap_weights, replicate_factors
    w = bootstrap_weights(np.random.default_rng(0).integers(0, 1 << 52, 4000), replicate_factors(50, 42))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    df = spark.createDataFrame([(str(i), float(i % 7)) for i in range(500)], "id string, fmeasure double")
    a, b = (bootstrap_mid(x).first() for x in (df, df.repartition(5)))
    assert abs(a.mid - 2.99) < 0.05 and a.low < a.mid < a.high and (a.low, a.mid, a.high) == (b.low, b.mid, b.high)


def test_greedy_text_match_without_laid_out_vectors(spark):
    """The n-gram postings give what the laid-out vectors give."""
    import random

    from longdoc.operators import metrics as M
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aabcdeé😀") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(40, None, "a"), (41, "", ""), (42, "same words here", "same words here"), (43, "abc", "xyz")]
    df = spark.createDataFrame(rows, "id int, reference string, prediction string").repartition(3)
    own = {r.id: r for r in M.greedy_text_match(df, ["id"]).collect()}
    laid = {r.id: r for r in M.greedy_text_match(df, ["id"], encoder=lambda tokens: M.char_ngram_vectors(tokens)).collect()}
    for i in range(44):
        for c in ("precision", "recall", "f1"):
            assert own[i][c] == pytest.approx(laid[i][c], abs=1e-12)


def test_greedy_match_of_a_long_pair_in_bounded_memory():
    """Two texts of 5 MB with some 24000 different tokens each, half of them shared: laid out as vectors of their 15000 n-grams
    they would be over 4 GB."""
    import subprocess
    import sys
    code = """
import random, resource
import numpy as np
from longdoc.operators import metrics as M
rng = random.Random(1)
vocab = list({"".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randint(2, 10))) for _ in range(36_000)})
x, y = (rng.choices(v, k=700_000) for v in (vocab[:24_000], vocab[12_000:]))
assert len(" ".join(x + y)) > 9_000_000
a, b = list(dict.fromkeys(x)), list(dict.fromkeys(y))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = M.best_by_ngrams(a, b)
row, gram, n = M._ngram_rows(b)
norms = np.sqrt(np.bincount(row, weights=n.astype(float) ** 2))
for i in range(0, len(a), 1999):
    _, g, c = M._ngram_rows([a[i]])
    q = dict(zip(g.tolist(), c.tolist()))
    dots = np.bincount(row, weights=[q.get(t, 0) * k for t, k in zip(gram.tolist(), n.tolist())], minlength=len(b))
    assert abs((dots / norms).max() / np.sqrt((c.astype(float) ** 2).sum()) - s[i]) < 1e-12, a[i]
print(len(a), len(set(gram.tolist())), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr[-2000:]
    tokens, grams, mb = map(int, out.stdout.split())
    assert tokens > 20_000 and grams > 10_000 and mb < 700


def test_summary_hits_equal_the_plain_union():
    """Repeated and disjoint sentences, against the union over all of them."""
    import random
    from collections import Counter

    from longdoc.operators import metrics as M
    rng = random.Random(3)
    for _ in range(200):
        sents = lambda: [[rng.randint(0, 9) for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(0, 6))]
        ref, cand = sents(), sents()
        cand += cand[:2]
        cr, cc, want = Counter(x for s in ref for x in s), Counter(x for s in cand for x in s), 0
        for r in ref:
            for i in sorted({i for c in cand for i in M.lcs_positions(r, c)}):
                if cr[r[i]] > 0 and cc[r[i]] > 0:
                    want, cr[r[i]], cc[r[i]] = want + 1, cr[r[i]] - 1, cc[r[i]] - 1
        assert M.summary_lcs_hits(ref, cand) == want


def test_bootstrap_holds_a_block_of_weights():
    """The weights of a batch of any size are drawn a block at a time; a task gives one sum per metric and replicate."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    rng, factors = np.random.default_rng(1), M.replicate_factors(200, 42)
    bits, x, y = rng.integers(0, 1 << 52, 20_000), rng.random(20_000), rng.random(20_000)
    table = pa.table({"_b": bits, "x": x, "y": y})
    tracemalloc.start()
    got = list(M.bootstrap_sums(iter(table.to_batches()), ["x", "y"], factors))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6 < 20_000 * 200 * 8
    w = M.bootstrap_weights(bits, factors)
    for batch, name, values in zip(got, ("x", "y"), (x, y), strict=True):
        assert batch.column("metric").unique().to_pylist() == [name] and batch.column("rep").to_pylist() == list(range(200))
        assert np.allclose(batch.column("s").to_numpy(), values @ w) and np.array_equal(batch.column("w").to_numpy(), w.sum(axis=0))
    parts = list(M.bootstrap_sums(iter(table.to_batches(max_chunksize=777)), ["x", "y"], factors))
    assert [len(b) for b in parts] == [200, 200] and np.allclose(parts[1].column("s").to_numpy(), got[1].column("s").to_numpy())
    assert list(M.bootstrap_sums(iter(table.slice(0, 0).to_batches()), ["x", "y"], factors)) == []


def test_score_record_reads_written_scores(spark):
    """The header's tasks read scores that are written: none of them makes scores and draws weights at once."""
    from longdoc.plans.evaluate import score_pairs, score_record
    rows = [(str(i), "the cat sat", "the cat sat" if i % 2 else "a dog") for i in range(40)] + [(None, None, "x")]
    pairs = spark.createDataFrame(rows, "id string, reference string, prediction string")
    head = score_record(score_pairs(pairs))
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got, per = head.first(), score_pairs(pairs).collect()
    assert got["Exact match"] == pytest.approx(20 / 41) and got["F1"] == pytest.approx(sum(r.f1 for r in per) / 41)
    assert 0.2 < got.ROUGE.rouge1 < 0.8
