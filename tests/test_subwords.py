"""H1 with a public subword vocabulary."""

import pytest
from pyspark.sql import functions as F

from longdoc.constants import EOS, FIRST_PIECE_ID

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok():
    from longdoc.operators.tokens import SubwordTokenizer
    return SubwordTokenizer(P.path("byte_bpe_50k.json"))


def test_round_trip_and_limits(spark, tok):
    texts = ["", "hello world", " two  spaces\n", "日本語 😀 é", "<|endoftext|> </s> <pad>", None, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", tok.encode("t").alias("ids"), tok.encode("t", 4).alias("cut")).withColumn("back", tok.decode("ids")).collect()
    for r in rows:
        if texts[r.id] is None:
            assert r.ids is None and r.cut is None
            continue
        assert r.back == texts[r.id] and r.ids[-1] == EOS and all(i >= FIRST_PIECE_ID for i in r.ids[:-1])
        assert len(r.cut) <= 4 and r.cut[-1] == EOS and r.cut[:-1] == r.ids[:len(r.cut) - 1]


def test_preparation_with_subwords(spark, tok):
    """L1: the chunks of a body, decoded, are the body; each neighbour pair is two of its chunks in a row."""
    from longdoc.plans import corpus
    from longdoc.plans.prepare import retrieval_samples
    from tests.conftest import SF_SMALL
    r = retrieval_samples(corpus.samples(spark, SF_SMALL), tok, method="sparse").select(
        "text", "text_tokenized", "retrieved", tok.decode(F.flatten("text_tokenized")).alias("back")).collect()
    assert len(r) > 10 and all(x.text == x.back for x in r)
    for x in r:
        chunks = [list(c) for c in x.text_tokenized]
        pairs = {tuple(a + b) for a, b in zip(chunks, chunks[1:], strict=False)}
        assert all(tuple(p) in pairs for q in x.retrieved for p in q)


def test_byte_level_files_are_read_as_their_library_does(tmp_path):
    """The fast path takes plain byte-level files only, and gives the library's ids and texts."""
    import json

    import pyarrow as pa

    from longdoc.operators import tokens as T
    path = P.path("byte_bpe_50k.json")
    slow, (fast, shown) = T._load_subwords(path), T._load_bytes(path)
    texts = ["", "it's  we'LL\n\n \t x", "日本語 é😀 123 4,5", "<|endoftext|>a", "\u2003\x00\x85 b", "ab" * 3000, " " * 300]
    ids = [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]
    assert [fast.encode_to_numpy(x, disallowed_special=()).tolist() for x in texts] == ids
    cut = [x[:n] for x in ids for n in (1, 2, 3, 5, 8)] + [[50256, 5]]
    assert [b"".join(shown.take(pa.array(x, pa.int64())).to_pylist()).decode("utf-8", "replace") for x in cut] == slow.decode_batch(cut, skip_special_tokens=False)
    assert T._load_bytes(P.path("word_bpe_49k.json")) is None
    with open(path) as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert T._load_bytes(str(tmp_path / "t.json")) is None
