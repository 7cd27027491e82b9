"""Operators 2, 7 and 9, the registration and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from longdoc.llm import chat, sharding, urls
from longdoc.llm.common import read_table
from longdoc.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import DOCS, edge_rows


# ---- 2: sharding ------------------------------------------------------

def _shards(spark, df, **how):
    path = sharding.shard_path(spark)
    schema = sharding.write_shards(df, path, **how)
    return path, sharding.read_shards(spark, path, schema, [F.col("doc_id"), F.col("text")])


def _gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_query(ship, documents):
    rows = QUERIES["op2_sharding"](ship, SF_SMALL).collect()
    text = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(text) and _gapless(rows)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)


def test_order_depends_on_seed_and_records_only(ship, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    df = read_table(ship, SF_SMALL, "documents")
    first, again, other = ({(r.doc_id, r.shard, r.slot) for r in _shards(ship, d, shards=3, seed=s)[1].collect()}
                           for d, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert first == again != other
    # shuffled: the order within a shard isn't that of the ids
    ids = [d for d, s, _ in sorted(first, key=lambda x: x[2]) if s == 0]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.5


def test_growth_moves_rows_to_the_new_shard_only(ship):
    ids = ship.range(3000).select(F.col("id").cast("string").alias("i"))
    for n in (1, 5, 24):
        moved = ids.select(sharding.shard_of(F.col("i"), n).alias("a"), sharding.shard_of(F.col("i"), n + 1).alias("b")).collect()
        assert all(r.b in (r.a, n) for r in moved) and any(r.b == n for r in moved)


def test_sharding_edges(ship, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 300)
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("bucket", F.lit("clash")).withColumn("size", F.lit(3))
    rows = _shards(ship, df)[1].collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted((r[:2] for r in edge_rows()), key=key)
    assert _gapless(rows)
    assert _shards(ship, df.limit(0))[1].collect() == []
    same = ship.createDataFrame([(1, "x" * 50)] * 100, "doc_id long, text string")
    rows = _shards(ship, same)[1].collect()
    assert len(rows) == 100 and _gapless(rows)


# ---- 7: chat ----------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string"


def test_rotation(ship):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|im_end|>"), (1, 3, "ann", "bye")]
    out = {r.perspective: r for r in chat.render(ship.createDataFrame(rows, TURNS)).collect()}
    assert set(out) == {"ann", "bob"}
    assert out["ann"].rendered == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                                   "<|im_start|>user name=bob\nhello <im_end><|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n")
    shown = lambda r: [r.rendered[m.start:m.start + m.length] for m in r.masks]
    assert shown(out["ann"]) == ["hi<|im_end|>", "bye<|im_end|>"] and shown(out["bob"]) == ["hello <im_end><|im_end|>"]


def test_chat_edges(ship):
    rows = [(1, None, "a", "first"), (1, 300, "a", None), (1, 300, "a", None), (1, 2, None, "who"), (None, 0, "a", "x"),
            (2, 0, "system", "alone"), (3, 0, "b", ""), (3, 0, "b", "")]
    df = ship.createDataFrame(rows, TURNS).withColumn("head", F.lit(1)).withColumn("perspective", F.lit(2))
    got = {(r.conv_id, r.perspective, r.part): (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    empty = "<|im_start|>assistant\n<|im_end|>\n"
    assert got == {
        (1, "a", -1): (1, "<|im_start|>assistant\nfirst<|im_end|>\n"), (1, "a", 0): (1, "<|im_start|>user\nwho<|im_end|>\n"),
        (1, "a", 1): (2, empty * 2), (None, "a", 0): (1, "<|im_start|>assistant\nx<|im_end|>\n"), (3, "b", 0): (2, empty * 2)}
    assert chat.render(df.limit(0)).collect() == []


def test_chat_parts_are_bounded(ship):
    """Null and repeated turn numbers and a null conv_id: pieces of at most PART_TURNS turns, which
    follow each other to the whole dialogue."""
    n = 1500
    rows = ([(7, None, "ab"[i % 2], f"t{i:04d}") for i in range(n)] + [(8, 3, "ab"[i % 2], "same") for i in range(n)]
            + [(None, i % 4, "ab"[i % 2], f"u{i:04d}") for i in range(n)] + [(1, i, "a", "x") for i in range(600)])
    got = chat.render(ship.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert max(r.n_turns for r in got) <= chat.PART_TURNS and len({(r.conv_id, r.perspective, r.part, r.piece) for r in got}) == len(got)
    order = {}
    for c, t, who, text in rows:
        order.setdefault(c, []).append((-1 if t is None else t, who, text))
    for c, turns in order.items():
        for me in {who for _, who, _ in turns}:
            want = "".join(f"<|im_start|>{'assistant' if who == me else 'user name=' + who}\n{text}<|im_end|>\n" for _, who, text in sorted(turns))
            own = sorted((r for r in got if (r.conv_id, r.perspective) == (c, me)), key=lambda r: (r.part, r.piece))
            assert "".join(r.rendered for r in own) == want
            said = "".join(r.rendered[m.start:m.start + m.length] for r in own for m in r.masks)
            assert said == "".join(text + "<|im_end|>" for _, who, text in sorted(turns) if who == me)
    assert {(r.part, r.piece) for r in got if r.conv_id == 1} == {(0, 0), (1, 0), (2, 0)}


def test_chat_sql(ship):
    import duckdb

    from tools.check_oracle import frame_hash
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    df = QUERIES["op7_chat_format"](ship, SF_SMALL)
    rel = con.sql(chat.SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert frame_hash(df.columns, [tuple(r) for r in df.collect()])[0] == frame_hash(rel.columns, rel.fetchall())[0]


# ---- 9: URLs ----------------------------------------------------------

def _brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit) if fit else None


def test_url_rules(ship):
    pages = read_table(ship, SF_SMALL, "pages")
    more = ["HTTP://WWW.Example.COM/en/x", "http://example.com", "http://example.com?x=/en/", "a://b://c.com/", "no scheme", "", None,
            "http://xnet/fr/", "http://net/fr/1", "https://É.net/es/#y", "http://user@host.com:80/p?q"]
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()] + [(10_000 + i, u) for i, u in enumerate(more)]
    df = ship.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, hit = _brute_rule(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, hit[2] if hit else None), u
        assert r.verdict == hit[3] if hit else r.verdict in ("allow", "block")
        assert (r.ratio is None) == (hit is not None)
    assert urls.judge(df.limit(0)).collect() == []


def test_markov_models_are_distributions(ship):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc./"), 12)) for _ in range(40)]
    m = urls._count(ship.createDataFrame([("allow", t) for t in texts], "verdict string, text string"))["allow"]
    for prefix in ("", "a", "ab.c", "zz", texts[0]):
        p = [np.exp(urls.char_log_probs(prefix + chr(c), m)[len(prefix)]) for c in range(urls.ALPHABET)]
        assert sum(p) == pytest.approx(1)
    assert urls.log_prob(texts[0], m) > urls.log_prob("z" * 12, m)


def test_url_models_separate_labelled_urls(ship):
    good = [(f"shop.example.com/item/{i}", "allow") for i in range(300)]
    bad = [(f"casino{i}.win/bonus?ref={i}", "block") for i in range(300)]
    f = urls.fit(ship.createDataFrame(good + bad, "text string, verdict string"))
    assert f.ratio("shop.example.com/item/9") > f.threshold > f.ratio("casino9.win/bonus?ref=4")


def test_url_models_of_many_copies(ship):
    """Few normalised texts with many rows each: none is lost to the bound on the sample."""
    kinds = "abcdefghijkl"
    few = ([(f"shop.example.com/item/{x}{x}", "allow") for x in kinds] + [(f"casino.win/bonus?{x}{x}", "block") for x in kinds])
    once = ship.createDataFrame(few, "text string, verdict string")
    many = once.crossJoin(ship.range(2000)).drop("id")  # 24,000 rows a verdict
    whole = urls.fit(many, per_verdict=10**9)
    for per_verdict in (urls.TRAIN_URLS, 100):
        f = urls.fit(many, per_verdict=per_verdict)
        assert f.threshold == whole.threshold and np.array_equal(f.accept.gram_n, whole.accept.gram_n)
        assert f.ratio("shop.example.com/item/zz") > f.threshold > f.ratio("casino.win/bonus?zz")
    # a text of its own per verdict models and calibrates
    two = urls.fit(many.where("text like '%aa'"), per_verdict=100)
    assert len(two.accept.grams) and two.ratio("shop.example.com/item/aa") > two.threshold > two.ratio("casino.win/bonus?aa")
    # more texts than the bound: the frequent ones stay, and about the bound of the others
    rare = ship.range(3000).select(F.concat(F.lit("rare.example.com/"), F.col("id")).alias("text"), F.lit("allow").alias("verdict"))
    got = {r.text: r.n for r in urls._sample(many.unionByName(rare), 100).where("verdict = 'allow'").collect()}
    assert {t for t, v in few if v == "allow"} <= set(got) and len(got) < 60 and 60 < sum(got.values()) < 160


# ---- registration and pipeline ----------------------------------------

def test_every_query_is_registered():
    names = list(E.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)


def _planted(rng):
    base = lambda n: " ".join(f"word{rng.integers(0, 5000)}" for _ in range(n))
    passage, copy = base(60), base(200)
    near = copy.split()
    near[100] = "changed"
    return [(1, copy), (2, copy), (3, " ".join(near)), (4, base(80) + " " + passage), (5, base(80) + " " + passage + " " + base(20)),
            (6, base(50)), (7, None), (8, "123 456 !!"), (9, base(5)), (10, passage)]


def test_pipeline_stages(ship):
    rng = np.random.default_rng(0)
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in _planted(rng)]
    docs = ship.createDataFrame(rows, DOCS).withColumn("extra", F.lit(7))
    text, kept = dict((r[0], r[1]) for r in rows), docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(ship, kept, "")
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "language":
            assert set(before) - set(after) == {7, 8}
        elif name == "near copies":
            want = brute.near_duplicates(list(before.items()), 5)
            assert set(after) == {d for d in before if want[d][1] == d} and set(before) - set(after) == {2, 3}
        else:
            want = {r[0]: r[2] for r in brute.cut_repeats(list(before.items()))}
            assert set(before) - set(after) == {10} and want[5] == 60
            assert all(len(after[d].split()) == len(before[d].split()) - want[d] for d in after)
            assert all(after[d] == text[d] for d in (1, 4, 6, 9))
            assert all(r.n_chars == len(r.text) for r in kept.collect())
    assert kept.where("extra = 7").count() == kept.count()


def test_pipeline_of_repeated_rows_and_nulls(ship):
    docs = ship.createDataFrame(edge_rows(), DOCS)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(ship, docs, "")
    got = sorted((r.doc_id is None, r.doc_id or 0, len(r.text)) for r in docs.collect())
    assert [g[1] for g in got if not g[0]] == [1, 6, 7, 9, 11] and sum(g[0] for g in got) == 1
    packed = corpus_pipeline.STAGES[3][1](ship, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 6, 7, 9, 11, None}
    empty = ship.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(ship, empty, "")
    assert empty.collect() == []


def test_pipeline_without_a_language_to_learn(ship):
    """No labelled document outside the held-out quarter: texts with a letter stay."""
    rows = [(i, None if i == 0 else "12 !" if i == 1 else f"text {i}", "en" if zlib.crc32(str(i).encode()) % 4 == 2 else None, "s", 1)
            for i in range(40)]
    docs = ship.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.keep_language(ship, docs, "")
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == rows[2:]


def test_pipeline_matches_brute_force(ship, documents):
    """The whole run on the smallest data: what is packed is what brute force keeps."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    near = brute.near_duplicates(documents, 5)
    rest = [(d, t) for d, t in documents if near[d][1] == d]
    cut = {r[0]: r for r in brute.cut_repeats(rest)}
    rows = corpus_pipeline.run(ship, SF_SMALL).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert set(ids) == {d for d, _ in rest if cut[d][2] < cut[d][1] or not cut[d][2]}
    for d, t in rest:
        if not cut[d][2]:
            assert ids[d] == lib.encode(t, add_special_tokens=False).ids + [0]
        elif d in ids:
            assert len(lib.decode(ids[d][:-1]).split()) == cut[d][1] - cut[d][2]
