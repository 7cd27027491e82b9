"""Hand-computed chunking, masking and padding cases (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from longdoc.functions import arrays as A
from longdoc.operators.chunks import chunk_documents, drop_last_chunk, filter_min_chunks


def one(spark, expr, data, schema="ids array<int>"):
    return spark.createDataFrame([(data,)], schema).select(expr.alias("r")).first()["r"]


def test_pad_and_chunk(spark):
    ids = list(range(3, 14))
    assert one(spark, A.pad_to_multiple("ids", 4), ids) == ids + [0]
    assert one(spark, A.chunk_array("ids", 4), ids) == [[3, 4, 5, 6], [7, 8, 9, 10], [11, 12, 13, 0]]
    assert one(spark, A.pad_to_multiple("ids", 4), list(range(3, 11))) == list(range(3, 11))


def test_pairs_and_min_chunks(spark):
    df = spark.createDataFrame([(1, list(range(3, 14))), (2, list(range(3, 11))), (3, [3, 4, 5])],
                               "article_id long, ids array<int>")
    ch = chunk_documents(df, "article_id", "ids", 4, with_pairs=True)
    kept = filter_min_chunks(ch, 2)
    assert sorted({r.article_id for r in kept.collect()}) == [1]
    keys = {r.chunk_no: r.pair_ids for r in drop_last_chunk(kept).collect()}
    assert keys == {0: list(range(3, 11)), 1: [7, 8, 9, 10, 11, 12, 13, 0]}
    one_chunk = ch.where("article_id = 3").collect()
    assert len(one_chunk) == 1 and one_chunk[0].pair_ids is None
    assert drop_last_chunk(ch.where("article_id = 3")).count() == 0


def test_last_full_chunk(spark):
    assert one(spark, A.last_full_chunk("ids", 4), list(range(3, 11))) == [7, 8, 9, 10]
    assert one(spark, A.last_full_chunk("ids", 4), list(range(3, 12))) is None
    assert one(spark, A.full_chunks("ids", 4), list(range(3, 12))) == [[3, 4, 5, 6], [7, 8, 9, 10]]


def test_mask_after_eos(spark):
    assert one(spark, A.mask_after_eos("ids"), [5, 1, 7, 1, 9]) == [5, 1, 0, 0, 0]
    assert one(spark, A.mask_after_eos("ids"), [5, 6]) == [5, 6]


def test_shift_and_prompt(spark):
    assert one(spark, A.lm_shift_input("ids"), [1, 2, 3]) == [1, 2]
    assert one(spark, A.lm_shift_label("ids"), [1, 2, 3]) == [2, 3]
    assert one(spark, A.drop_last("ids"), [7, 8, 1]) == [7, 8]


def test_padding_sides_and_mask(spark):
    from longdoc.operators.batches import collate
    df = spark.createDataFrame([(0, 1, [5]), (0, 2, [6, 7])], "b int, pos int, ids array<int>")
    right = collate(df, ["b"], "pos", {"ids": 1}).first()["ids"]
    left = collate(df, ["b"], "pos", {"ids": 0}, side="left").first()["ids"]
    assert right == [[5, 1], [6, 7]]
    assert left == [[0, 5], [6, 7]]
    m = collate(df, ["b"], "pos", {"ids": 0}, mask_of="ids").first()["attention_mask"]
    assert m == [[True, False], [True, True]]
    empty = spark.createDataFrame([(0, 1, []), (0, 2, [6, 7])], "b int, pos int, ids array<int>")
    assert collate(empty, ["b"], "pos", {"ids": 0}, side="left").first()["ids"] == [[0, 0], [6, 7]]


def test_chunks_concat_back_to_tokens(spark):
    df = spark.createDataFrame([(i, list(range(3, 3 + n))) for i, n in enumerate([1, 63, 64, 65, 200])],
                               "article_id long, ids array<int>")
    ch = chunk_documents(df, "article_id", "ids", 64, with_pairs=True)
    back = (ch.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "token_ids"))).alias("c"))
            .select("article_id", F.filter(F.flatten(F.transform("c", lambda s: s["token_ids"])), lambda x: x != 0)
                    .alias("ids")))
    got = {r.article_id: r.ids for r in back.collect()}
    assert got == {r.article_id: r.ids for r in df.collect()}
    assert all(len(r.pair_ids) == 128 for r in ch.where("pair_ids is not null").collect())


def test_tokenize_with_user_tokenizer(spark):
    from longdoc.operators.tokens import tokenize_with

    def factory():
        table = {"a": 5, "b": 6}
        return lambda texts: [[table.get(w, 2) for w in t.split()] + [1] for t in texts]

    df = spark.createDataFrame([("a b c",), ("b " * 10,)], "t string")
    r = [x[0] for x in df.select(tokenize_with("t", factory, max_len=4)).collect()]
    assert r == [[5, 6, 2, 1], [6, 6, 6, 1]]


def test_tokenizer_special_tokens_and_decode(spark):
    from longdoc.operators.tokens import build_vocab, decode, materialize_vocab, tokenize
    corpus = spark.createDataFrame([("a b a c .",)], "text string")
    v = {r.token: r.token_id for r in build_vocab(corpus, "text", 10).collect()}
    assert v["a"] == 260 and sorted(v.values()) == list(range(260, 260 + len(v)))
    vp = materialize_vocab(spark, build_vocab(corpus, "text", 10), "special-test-2")
    df = spark.createDataFrame([("<pad>a </s>b <unk>zz",)], "t string")
    ids = df.select(tokenize("t", vp).alias("ids")).first().ids
    # a word outside the vocabulary is WORD and its bytes
    assert ids == [0, v["a"], 1, v["b"], 2, 3, 4 + ord("z"), 4 + ord("z"), 1]
    cut = df.select(tokenize("t", vp, max_len=3).alias("ids")).first().ids
    assert cut == [0, v["a"], 1]
    txt = spark.createDataFrame([([v["a"], v["."], 0, 1, v["b"]],)], "ids array<int>")
    assert txt.select(decode("ids", vp)).first()[0] == "a. b"


def test_decode_ignores_ids_outside_the_vocabulary(spark):
    from longdoc.operators.tokens import build_vocab, decode, materialize_vocab
    corpus = spark.createDataFrame([("a b",)], "text string")
    vp = materialize_vocab(spark, build_vocab(corpus, "text", 10), "decode-range-test-2")
    df = spark.createDataFrame([([260, 99999, 261],)], "ids array<int>")
    assert df.select(decode("ids", vp)).first()[0] in ("a b", "b a")


def test_no_word_is_lost(spark):
    """Any text's words come back from its ids, whatever the vocabulary; a cut character goes."""
    from longdoc.operators.tokens import build_vocab, decode, materialize_vocab, tokenize
    vp = materialize_vocab(spark, build_vocab(spark.createDataFrame([("the the of",)], "text string"), "text", 2), "no-word-lost")
    texts = ["the  unseen of\n日本語 😀 é the", "", "  ", "x" * 500, "of the", "\u00a0the \x0b. ! a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize("t", vp).alias("ids"))
    for r in df.select("t", "ids", decode("ids", vp, clean=False).alias("d")).collect():
        assert r.d == " ".join(w for w in __import__("re").split("[ \t\n\r]+", r.t) if w) and 2 not in r.ids
    cut = spark.createDataFrame([(["the"], [260, 3, 4 + 0xE6, 4 + 0x97]), (["x"], [4 + 0xA5, 3, 4 + ord("a")])], "a array<string>, ids array<int>")
    assert sorted(r[0] for r in cut.select(decode("ids", vp)).collect()) == ["a", "the"]


def test_special_ids_can_be_shown(spark):
    from longdoc.operators.tokens import build_vocab, decode, materialize_vocab
    vp = materialize_vocab(spark, build_vocab(spark.createDataFrame([("a",)], "text string"), "text", 2), "show-special")
    df = spark.createDataFrame([([0, 260, 1],)], "ids array<int>")
    assert df.select(decode("ids", vp, strip_special=False)).first()[0] == "<pad> a </s>"


def test_terms_of_spelled_words():
    import hashlib

    import numpy as np

    from longdoc.operators.chunks import SPELLED, terms_of, tf_batch
    b = lambda w: [4 + x for x in w.encode()]
    term = lambda w: SPELLED + int(hashlib.md5(w.encode().hex().upper().encode()).hexdigest()[:15], 16)
    # row 0 begins inside a word; rows 0 and 1 end and begin with bytes, which don't run together
    flat = [[*b("il"), 300, 3, *b("zz"), 3, *b("zz"), 1, 0], [*b("zz"), 260, 260, 2], []]
    rows = np.repeat(np.arange(3), [len(x) for x in flat])
    r, t = terms_of(rows, np.array([y for x in flat for y in x]))
    assert sorted(zip(r.tolist(), t.tolist())) == sorted([(0, term("il")), (0, 300), (0, term("zz")), (0, term("zz")),
                                                          (1, term("zz")), (1, 260), (1, 260)])
    offs, tok, tf, norm2 = tf_batch(r, t, 3)
    assert offs.tolist() == [0, 3, 5, 5] and norm2.tolist() == [6, 5, 0]
    assert dict(zip(tok[:3].tolist(), tf[:3].tolist())) == {300: 1, term("il"): 1, term("zz"): 2}
