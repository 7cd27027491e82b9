"""Column clashes, letters, bounds, and the classifiers against plain versions of themselves."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from longdoc.llm import chat, language, sharding, substring, urls
from longdoc.llm.common import fresh, read_table
from longdoc.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import DOCS, edge_rows

TURNS = "conv_id long, turn int, role string, text string"


def test_fresh_names():
    assert fresh(["a", "B"], "c", "d") == ["c", "d"]
    assert fresh(["A", "_b", "__a"], "a", "b") == ["___a", "___b"]


# ---- 7 ----------------------------------------------------------------

def _same_as_sql(spark, rows):
    import duckdb

    from tools.check_oracle import frame_hash
    df = chat.digest(chat.render(spark.createDataFrame(rows, TURNS)))
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, TURNS).toArrow())
    rel = con.sql(chat.SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    got = [tuple(r) for r in df.collect()]
    assert frame_hash(df.columns, got)[0] == frame_hash(rel.columns, rel.fetchall())[0]
    return got


def test_chat_sql_of_one_turn_number(ship):
    got = _same_as_sql(ship, [(1, 5, "ab"[i % 2], f"t{i % 7}") for i in range(600)] + [(1, None, "a", "x")] * 300 + [(None, 1, "c", None)] * 257)
    assert len(got) == len({r[:5] for r in got}) == 2 * (3 + 2) + 2


def test_chat_slices_of_long_turns(ship):
    long = "x" * (5 << 20)
    got = _same_as_sql(ship, [(1, i, "ab"[i % 2], f"{i}{long}") for i in range(9)])
    assert {r[4] for r in got} == {0, 1, 2} and len(got) == 6
    pieces = chat.render(ship.createDataFrame([(1, i, "a", "x" * 100) for i in range(50)], TURNS), piece_bytes=1000).collect()
    assert max(r.n_turns for r in pieces) == 10 and sum(r.n_turns for r in pieces) == 50


# ---- 2 and 8: working columns ------------------------------------------

def test_clashing_columns(ship):
    rows = edge_rows()
    df = ship.createDataFrame(rows, DOCS)
    for c in ("__hash", "__shard", "__bucket", "__size", "__grown", "hash_", "SHARD_", "__id", "__block", "own_id", "BLOCK_NO"):
        df = df.withColumn(c, F.lit(c))
    path = sharding.shard_path(ship)
    schema = sharding.write_shards(df, path, shards=3)
    out = sharding.read_shards(ship, path, schema, [F.col("doc_id"), F.col("__hash"), F.col("SHARD_")]).collect()
    assert len(out) == len(rows) and {(r["__hash"], r["SHARD_"]) for r in out} == {("__hash", "SHARD_")}
    cut = substring.remove_repeats(df.withColumn("N_words", F.lit(-7)))
    assert [c.lower() for c in cut.columns].count("n_words") == 1
    key = lambda x: (str(x[0]), str(x[1:]))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in cut.collect()), key=key)
    assert got == sorted(((d, n, k) for d, n, k, _ in brute.cut_repeats([r[:2] for r in rows])), key=key)
    assert {(r["__id"], r["BLOCK_NO"]) for r in cut.collect()} == {("__id", "BLOCK_NO")}


def test_named_counts(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("n_words", F.lit(-7))
    out = substring.remove_repeats(df, counts=("all_words", "gone_words")).collect()
    assert {r.n_words for r in out} == {-7} and max(r.all_words for r in out) == 80_000


def test_windows_are_compared_by_both_hashes():
    """A sent window with the same first half and another second half removes nothing."""
    block = substring.Block([5], [" ".join(f"w{i}" for i in range(20))], 13)
    own = np.stack([block.u1, block.u2], 1)
    assert substring._removed(block, own[:1])[0].sum() == 13
    other = own[:1].copy()
    other[0, 1] ^= np.uint64(1)
    assert substring._removed(block, other)[0].sum() == 0
    assert substring._removed(block, np.concatenate([other, own[:1], other]))[0].sum() == 13
    assert substring._removed(block, own[:0])[0].sum() == 0


# ---- 2: every place ----------------------------------------------------

def test_sharding_against_brute_force(ship, documents, monkeypatch):
    """Shard, bucket and place of every record, computed again one by one."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    docs = read_table(ship, SF_SMALL, "documents").select("doc_id", "text")
    path = sharding.shard_path(ship)
    schema = sharding.write_shards(docs, path, shards=5, seed=3)
    got = {(r.doc_id, r.shard, r.slot, r.grown_shard)
           for r in sharding.read_shards(ship, path, schema, [F.col("doc_id")]).collect()}
    seed = F.lit(3)
    hashes = docs.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64(seed, F.col("doc_id").cast("string"), "text").alias("h"),
                         *[F.xxhash64(seed, F.col("doc_id").cast("string"), F.lit(s)).alias(f"s{s}") for s in range(6)]).collect()
    total = sum(r.n + 8 for r in hashes)
    buckets = max(1, round(total / 5 / 20_000))
    cells = {}
    for r in hashes:
        shard = max(range(5), key=lambda s: (r[f"s{s}"], s))
        cells.setdefault((shard, (r.h >> 16) % buckets), []).append((r.h, r.doc_id, r.n + 8))
    grown = {r.doc_id: max(range(6), key=lambda s: (r[f"s{s}"], s)) for r in hashes}
    want, slot = set(), [0] * 5
    for shard, bucket in sorted(cells):
        held, size, run = [], 0, 0
        runs = []
        for h, d, n in sorted(cells[shard, bucket]):
            if held and size + n > 40_000:
                runs.append(held)
                held, size = [], 0
            held.append(d)
            size += n
        for run, held in enumerate([*runs, held]):
            rng = np.random.default_rng([3, shard, bucket, run])
            for i, j in enumerate(rng.integers(0, np.arange(len(held), 0, -1))):
                if i < len(held) - 1:
                    held[len(held) - 1 - i], held[j] = held[j], held[len(held) - 1 - i]
            for d in held:
                want.add((d, shard, slot[shard], grown[d]))
                slot[shard] += 1
    assert got == want


# ---- 4 ----------------------------------------------------------------

def test_letters():
    for text in ("½ ²", "Ⅷ ①", "12 ٣ _", "", "!?", "𝟙"):
        assert not language.has_letter(text)
    for text in ("½a", "ʰ", "ß", "日", "ǅ"):
        assert language.has_letter(text)


def test_number_signs_are_undetermined(ship):
    train = ship.createDataFrame([(1, "hello there", "en"), (2, "guten tag", "de")], "doc_id long, text string, lang string")
    docs = ship.createDataFrame([(1, "½ ²"), (2, "Ⅷ ①"), (3, "hello")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, train).collect()} == {1: "und", 2: "und", 3: "en"}


def _slot(chars, n):
    """The slot of one n-gram, in plain integers."""
    mask, h = (1 << 32) - 1, n
    for i, c in enumerate(chars):
        h = ((h ^ ord(c)) * int(language._MUL[i % 3])) & mask
        h ^= h >> 15
    return ((h * int(language._MUL[0])) & mask) >> 16


def test_naive_bayes_against_brute_force(ship):
    rows = [r for r in read_table(ship, SF_SMALL, "documents").select("doc_id", "text", "lang").collect()]
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names = sorted({r.lang for r in train if r.lang})
    grams = lambda t: [_slot(t[i:i + n], n) for n in (2, 3) for i in range(len(t) - n + 1)]
    memo = {r.doc_id: grams(r.text.lower()) for r in rows}
    counts = {x: np.full(1 << 16, 0.5) for x in names}
    for r in train:
        if r.lang:
            np.add.at(counts[r.lang], memo[r.doc_id], 1)
    prior = {x: sum(r.lang == x for r in train) for x in names}
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](ship, SF_SMALL).collect()}
    for r in rows:
        logits = {x: np.log(prior[x] / sum(prior.values())) + np.log(counts[x][memo[r.doc_id]] / counts[x].sum()).sum() for x in names}
        best = max(names, key=lambda x: logits[x])
        if language.has_letter(r.text):
            assert got[r.doc_id].lang_pred == best
            assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(v - logits[best]) for v in logits.values()), rel=1e-2, abs=1e-9)
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_batches_slices_and_single_texts_agree(monkeypatch):
    rng = np.random.default_rng(0)
    weight = rng.normal(size=(language.SLOTS, 3)).astype(np.float32)
    texts = ["", "a", "ab", "x" * 1000, *("".join(rng.choice(list("abcdé "), 500)) for _ in range(5))]
    plain = np.array([weight[language.ngram_slots(language.code_points(t))].sum(axis=0, dtype=np.float64) for t in texts])
    assert np.allclose(language.log_likelihoods(texts, weight), plain)
    for size in (7, 64, 500):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.allclose(language.log_likelihoods(texts, weight), plain)


# ---- 9 ----------------------------------------------------------------

def _witten_bell(texts, text):
    """log P(text) by the definition, over strings."""
    k = urls.ORDER
    pad = lambda t: chr(2) * k + t + chr(3)
    grams, follow = {}, {}
    for t in map(pad, texts):
        for i in range(k, len(t)):
            for o in range(k + 1):
                ctx = t[i - o:i]
                grams[ctx, t[i]] = grams.get((ctx, t[i]), 0) + 1
                follow.setdefault(ctx, {}).setdefault(t[i], 0)
                follow[ctx][t[i]] += 1
    total, t = 0.0, pad(text)
    for i in range(k, len(t)):
        p = 1 / urls.ALPHABET
        for o in range(k + 1):
            seen = follow.get(t[i - o:i])
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                p = (seen.get(t[i], 0) + kinds * p) / (n + kinds)
        total += np.log(p)
    return total


def test_markov_against_brute_force(ship, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab/.c"), rng.integers(0, 30))) for _ in range(60)]
    m = urls._count(ship.createDataFrame([("allow", t) for t in texts], "verdict string, text string"))["allow"]
    for t in [*texts[:10], "", "zzz", "ab" * 200]:
        want = _witten_bell(texts, t)
        assert urls.log_prob(t, m) == pytest.approx(want)
        monkeypatch.setattr(urls, "SLICE", 9)
        assert urls.log_prob(t, m) == pytest.approx(want)
        monkeypatch.undo()


def test_url_sample_is_bounded_by_characters(ship, monkeypatch):
    rows = ship.createDataFrame([("allow", f"{i:05d}" + "x" * 95) for i in range(2000)], "verdict string, text string")
    monkeypatch.setattr(urls, "TRAIN_TOTAL", 20_000)
    n = urls._sample(rows, 1000).count()
    assert 120 < n < 300
    monkeypatch.setattr(urls, "TRAIN_TOTAL", 1_000_000)
    assert urls._sample(rows, 5000).count() == 2000


# ---- pipeline ----------------------------------------------------------

def test_pipeline_keeps_columns_of_any_name(ship):
    import corpus_pipeline
    df = ship.createDataFrame(edge_rows(), DOCS)
    for c in ("n_words", "N_REMOVED", "__found", "found_language", "ALL_words"):
        df = df.withColumn(c, F.lit(-7))
    cur = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        cur = stage(ship, cur, SF_SMALL)
        assert cur.columns == df.columns
    rows = cur.collect()
    assert rows and all(r[c] == -7 for r in rows for c in ("n_words", "N_REMOVED", "__found", "found_language", "ALL_words"))


def test_one_of_repeated_rows_stays_and_it_is_defined(ship):
    import corpus_pipeline
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", s, 1) for s in ("c", None, "a", "b")]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.drop_near_copies(ship, ship.createDataFrame(order, DOCS), SF_SMALL).collect()
        assert [r.source for r in out] == ["a"]
