"""Batches in parts of bounded size."""

import pyarrow as pa
import pytest

from longdoc.functions.parts import by_parts


@pytest.mark.parametrize("rows", [0, 1, 7, 1000])
def test_a_function_gets_bounded_parts(rows):
    words, seen = pa.array([None if i % 5 == 4 else ["ab"] * (i % 9) for i in range(rows)], pa.list_(pa.string())), []

    def sizes(x, y):
        seen.append((len(x), x.nbytes + y.nbytes))
        return pa.array([(len(a or []), b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.list_(pa.int64()))

    out = by_parts(sizes, words, pa.array(range(rows), pa.int64()), most=400)
    assert out.to_pylist() == [[len(x or []), i] for i, x in enumerate(words.to_pylist())]
    assert all(n <= 1 or size <= 500 for n, size in seen)


def test_flows_hold_a_part_of_a_batch(spark, monkeypatch):
    """Tokens, decoded text and scores of a batch are made from parts of it."""
    from longdoc.operators import metrics as M
    from longdoc.operators import tokens as T
    vocabulary = pa.array([b"", b"", b"", b" ", *(bytes([i]) for i in range(256)), b" w"], pa.binary())
    texts, seen = pa.array(["w x " * 400] * 300), []
    for owner, name in ((T, "_split_lookup"), (T, "_shown_text"), (M, "_coded")):
        def spy(a, b, own=getattr(owner, name)):
            seen.append(a.nbytes)
            return own(a, b)
        monkeypatch.setattr(owner, name, spy)
    monkeypatch.setattr(T, "_load_vocab", lambda path: ({"w": 260}, vocabulary))
    ids = T._lookup_udf("").func(texts)
    back = T._decode_udf("").func(ids)
    assert back.to_pylist() == [("w x " * 400).strip()] * 300
    lists = pa.array([x.split() for x in texts.to_pylist()])
    assert M._lcs_udf.func(lists, lists).to_pylist() == [800] * 300
    assert len(seen) > 3 and max(seen) <= 1 << 20


def _python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_flows_hold_few_workers(spark):
    """Prompt and input are encoded by one worker; scoring isn't chained to the workers that encode and decode."""
    from longdoc.plans import corpus
    from longdoc.plans.evaluate import evaluate
    from longdoc.plans.prepare import tokenize_samples
    from tests.conftest import SF_SMALL
    samples, tok = corpus.samples(spark, SF_SMALL), corpus.tokenizer(spark, SF_SMALL)
    assert _python_steps(tokenize_samples(samples, tok)) == 1
    assert _python_steps(evaluate(samples, tok)[0]) == 1


def test_bin_encoder_passes_over_the_ids_once(spark):
    from longdoc.plans.registry import _BinEncoder
    df = spark.createDataFrame([([0, 8, 3, 11, 1, 7, None, -3, -8],), ([],), (None,)], "ids array<int>")
    rows = df.select(_BinEncoder().encode("ids").alias("v"))
    assert [r.v for r in rows.limit(2).collect()] == [[3, 1, 0, 2, 0, 0, 0, 1], [0] * 8]
    assert "filter(" not in rows._jdf.queryExecution().analyzed().toString()
