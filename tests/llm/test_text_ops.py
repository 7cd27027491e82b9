"""Operators 1, 4, 5 and 6."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from longdoc.llm import fingerprint, language, packing
from longdoc.llm import sentencepiece_scan as spm
from longdoc.llm.common import read_table
from longdoc.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS, edge_rows

MODEL = tokenizer_path("piece_bpe_32k.model")
VOCABULARY = tokenizer_path("byte_bpe_50k.json")


# ---- 1: SentencePiece -------------------------------------------------

def _viterbi(m, s):
    """The plain left-to-right recursion over all pieces, without trie or words."""
    score = {}
    for i, _ in enumerate(m.bytes_of):
        p = m.processor.id_to_piece(i)
        if not (m.processor.is_byte(i) or m.processor.is_control(i) or m.processor.is_unknown(i)):
            score[p] = (m.processor.get_score(i), i)
    best = [(0.0, [])] + [(float("-inf"), [])] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - m.longest), end):
            p = s[start:end]
            found = score.get(p)
            if found is None and end == start + 1:
                own = (m.unknown, [m.byte_ids[b] for b in p.encode()])
            elif found is None:
                continue
            else:
                own = (found[0], [found[1]])
            if best[start][0] + own[0] > best[end][0]:
                best[end] = (best[start][0] + own[0], best[start][1] + own[1])
    return best[-1]


def test_encode_is_the_best_segmentation():
    m, rng = spm.load(MODEL), random.Random(1)
    for _ in range(60):
        letters = rng.choice(["ab", "aaa", "the ", "abc 日本x", "▁▁a", "thenr ▁"])
        s = m.normalize("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))
        score, ids = m.encode(s)
        assert (score, np.frombuffer(ids, "<u4").tolist()) == _viterbi(m, s)


def test_encode_equals_the_library_on_a_unigram_model(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # unigram
    for p in proto.pieces:
        p.score = max(p.score, -60000.0)
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    library, m = sentencepiece.SentencePieceProcessor(model_file=path), spm.Model(path)
    for word in "the segmentation of a word isn't unique, Straßenbahn élève mañana 12345".split():
        assert library.encode(word) == np.frombuffer(m.encode(m.normalize(word))[1], "<u4").tolist()


@pytest.mark.parametrize("size", [16, 17, 64])
def test_chunks_equal_the_whole(ship, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(size, 400)))
             for a in ("ab", "the ", "abc 日本x", "thenr \n", "aaaaaaaaaaaaaaaa ") for _ in range(4)]
    m = spm.load(MODEL)
    df = ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = spm.decode(spm.encode(df, MODEL, chunk=size), MODEL)
    parts = {}
    for r in sorted(encoded.collect(), key=lambda r: (r.doc_id, r.part)):
        ids, score, text = parts.get(r.doc_id, ([], 0.0, ""))
        parts[r.doc_id] = (ids + np.frombuffer(r.ids, "<u4").tolist(), score + r.score, text + r.decoded)
    for i, text in enumerate(texts):
        score, ids = m.encode(m.normalize(text))
        assert parts[i] == (np.frombuffer(ids, "<u4").tolist(), score, text)


def test_words_together_equal_words_alone():
    rng = random.Random(3)
    m = spm.Model(MODEL)
    words = {"".join(rng.choice(a) for _ in range(rng.randint(1, 64))) for a in ("ab", "thener", "abc日本x😀é", "▁▁the", "\u0100\u07ff\u0800")
             for _ in range(60)}
    words = sorted(words)
    total, counts, ids = m.encode_words(words)
    at = 0
    for i, w in enumerate(words):
        best, last = m.forward(w, {0: 0.0}, len(w))
        assert total[i] == best[-1] and ids[at:at + counts[i]].tobytes() == m.back(w, last, len(w))[1]
        at += counts[i]
    assert at == len(ids)


def test_encoding_together_equals_alone(monkeypatch):
    rng = random.Random(4)
    m = spm.Model(MODEL)
    texts = [m.normalize(" ".join("".join(rng.choice("thenr日") for _ in range(rng.choice([1, 3, 9, 80]))) for _ in range(n))) for n in (0, 1, 7, 0, 40)]
    alone = [m.encode(t) for t in texts]
    assert m.encode_all(texts) == alone == [(a, struct_ids(m, t)) for t, (a, _) in zip(texts, alone)]
    monkeypatch.setattr(spm, "MEMO", 3)
    assert m.encode_all(texts) == alone and m.encode_all(texts[::-1]) == alone[::-1]


def struct_ids(m, text):
    best, last = m.forward(text, {0: 0.0}, len(text))
    return m.back(text, last, len(text))[1]


@pytest.mark.parametrize("backward", [False, True])
def test_scan_of_many_blocks(ship, monkeypatch, backward):
    """1000 places in blocks of 8, so four tiers, by an associative product that does not commute: the same states as in
    one pass, and several tasks multiply."""
    monkeypatch.setattr(spm, "SCAN_BLOCK", 8)
    rng = np.random.default_rng(0)
    maps = {(row, i): rng.integers(0, 5, 5) for row, n in ((1, 1000), (2, 1), (3, 8), (4, 9)) for i in range(n)}
    through = lambda a, b: np.frombuffer(b, np.int64)[np.frombuffer(a, np.int64)].tobytes()
    df = ship.createDataFrame([(r, i, bytearray(x.tobytes())) for (r, i), x in maps.items()], spm.SLIM).repartition(5)
    out = spm.scan(df, np.full(1, 3).tobytes(), through, through, backward).collect()
    got = {(r["row"], r["at"]): int(np.frombuffer(r["state"], np.int64)[0]) for r in out}
    want = {}
    for row in (1, 2, 3, 4):
        state = 3
        for i in sorted((i for r, i in maps if r == row), reverse=backward):
            want[row, i] = state
            state = int(maps[row, i][state])
    assert got == want


def test_matrices_combine_associatively():
    m = spm.load(MODEL)
    text = m.normalize("the segmentation of " * 30)
    parts = [(text[i:i + 64 + m.longest - 1], len(text[i:i + 64])) for i in range(0, len(text), 64)]
    ms = [m.matrix(s, n, i == len(parts) - 1, i == 0) for i, (s, n) in enumerate(parts)]
    left, right = ms[0], ms[-1]
    for x in ms[1:]:
        left = spm.compose(left, x)
    for x in ms[-2::-1]:
        right = spm.compose(x, right)
    assert np.array_equal(left, right) and left[0, 0] == m.encode(text)[0]


def test_a_long_document_in_many_blocks(ship, monkeypatch):
    monkeypatch.setattr(spm, "SCAN_BLOCK", 4)
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab the日") for _ in range(16 * 70)), "".join(rng.choice("ab") for _ in range(500))]
    m = spm.load(MODEL)
    rows = spm.encode(ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, chunk=16).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.part)
        assert (sum(r.score for r in own), b"".join(bytes(r.ids) for r in own)) == m.encode(m.normalize(text))


def test_sentencepiece_round_trip(ship, documents):
    encoded = spm.decode(spm.encode(read_table(ship, SF_SMALL, "documents"), MODEL, chunk=4096), MODEL)
    texts = {}
    for r in sorted(encoded.select("doc_id", "part", "decoded").collect()):
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.decoded
    assert texts == dict(documents)


def test_repeated_giant_rows_are_encoded_each(ship):
    long = "the words of a long text " * 20
    df = ship.createDataFrame([(1, long)] * 3 + [(None, long)] * 2 + [(1, long + "x")], "doc_id long, text string")
    rows = spm.decode(spm.encode(df, MODEL, chunk=100), MODEL).collect()
    parts = {r.part: r.decoded for r in rows if r.doc_id is None}
    assert "".join(parts[p] for p in sorted(parts)) == long
    count = lambda i, p: sum(r.doc_id == i and r.part == p for r in rows)
    assert count(1, 0) == 4 and count(None, 0) == 2 and count(None, max(parts)) == 2


def test_sentencepiece_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("ids", F.lit(1)).withColumn("part", F.lit("p"))
    rows = spm.decode(spm.encode(df, MODEL), MODEL).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.part)):
        by[r.doc_id] = by.get(r.doc_id, []) + [r]
    assert by[3][0].ids is None and by[3][0].decoded is None and by[4][0].ids == b"" and by[4][0].decoded == ""
    assert "".join(r.decoded for r in by[9]) == "x" * 70_000 and len(by[9]) == 2
    assert by[11][0].decoded == "日本語 テキスト 😀" and len(by[2]) == 2
    assert spm.encode(df.limit(0), MODEL).collect() == []


# ---- 4: language ------------------------------------------------------

def test_language_held_out_accuracy(ship):
    docs = read_table(ship, "/root/testdata/sf0.01", "documents")
    out = QUERIES["op4_language_id"](ship, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out))
    rest = out[out.held_out]
    assert (rest.lang == rest.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_slices_add_up(monkeypatch):
    weight = np.random.default_rng(0).normal(size=(language.SLOTS, 3)).astype(np.float32)
    text = "Ein längerer Text, der über mehrere Stücke geht. " * 30
    whole = language.log_likelihood(text, weight)
    monkeypatch.setattr(language, "SLICE", 97)
    assert np.allclose(whole, language.log_likelihood(text, weight))


def test_language_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    out = language.identify(df, df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(edge_rows())
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 8))
    assert by[6].lang_pred == "en" and by[9].lang_pred == "fr"
    assert language.identify(df.limit(0), df).collect() == []
    assert {r.lang_pred for r in language.identify(df, df.limit(0)).collect()} == {"und"}


# ---- 5: packing -------------------------------------------------------

def _library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def test_ids_equal_the_tokenizers_library(documents):
    lib = _library()
    for text in [t for _, t in documents] + ["a<|endoftext|>b", "", " \n\n  x ", "日本語 😀 don't 12,345.67\r\n\ttab"]:
        assert packing.encode(VOCABULARY, text).tolist() == lib.encode(text, add_special_tokens=False).ids


def _check_packed(rows, want, limits):
    """rows: pieces; want: {key: list of id lists}."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.id, []).append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]]
        assert sum(r.length for r in rs) <= limits[0] and len(rs) <= limits[1] and sum(r.n_loss for r in rs) <= limits[2]
    for key, ids in want.items():
        got = sorted(pieces[key], key=lambda r: r.start)
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
        assert b"".join(r.ids for r in got) == np.array(ids, "<u4").tobytes() and {r.n_ids for r in got} == {len(ids)}
    return sequences


def test_packing_places_every_id_once(ship, documents):
    lib = _library()
    rows = packing.pack_texts(read_table(ship, SF_SMALL, "documents"), VOCABULARY).collect()
    want = {d: lib.encode(t, add_special_tokens=False).ids + [0] for d, t in documents}
    sequences = _check_packed(rows, want, (1024, packing.MAX_SEGMENTS, 1024))
    assert sum(r.length for r in rows) / (1024 * len(sequences)) > 0.97


def test_packing_under_all_limits(ship):
    rng = np.random.default_rng(0)
    ex = [(i, rng.integers(0, 99, n).tolist(), (rng.random(n) < rng.random()).tolist())
          for i, n in enumerate(rng.integers(1, 90, 300))] + [(900, [], []), (901, None, None), (902, [5] * 7, None)]
    df = ship.createDataFrame(ex, "id long, ids array<int>, loss array<boolean>").repartition(3)
    rows = packing.pack_examples(df, max_tokens=64, max_segments=4, max_loss=24, lot=50).collect()
    _check_packed(rows, {i: ids for i, ids, _ in ex if ids}, (64, 4, 24))
    loss = {}
    for r in rows:
        loss[r.id] = loss.get(r.id, 0) + r.n_loss
    assert loss == {i: sum(m) if m is not None else len(ids) for i, ids, m in ex if ids}


def test_dot_product_prefers_the_matching_shape():
    limits = np.array([10, 4, 10])
    bins = packing.fill_bins(np.array([[6, 1, 6], [4, 1, 0], [4, 1, 4], [9, 1, 9]]), limits)
    assert bins[0] == [3] and sorted(map(sorted, bins[1:])) == [[0, 2], [1]]


def test_packing_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("id", F.lit("clash")).withColumn("ids", F.lit(0))
    rows = packing.pack_texts(df, VOCABULARY).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert all(by[i][0].ids == b"\0\0\0\0" and by[i][0].n_ids == 1 for i in (3, 4))
    assert len(by[2]) == 2 and len(by[None]) == 1 and sum(r.length for r in by[6]) == by[6][0].n_ids > 80_000
    assert packing.pack_texts(df.limit(0), VOCABULARY).collect() == []


# ---- 6: fingerprints --------------------------------------------------

def _xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _anchors(text, whole=True):
    import re
    h = [_xx([u]) for u in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)]
    low = lambda x: (x & 0xFFFFFFFF) - (1 << 31)
    if len(h) < 5:
        return [low(_xx(h))] if h else []
    z = [_xx(h[i:i + 2]) for i in range(len(h) - 1)]
    out = []
    for i in range(len(z) - 3):
        inner = z[i:i + 4]
        if min(inner) in (inner[0], inner[3]):  # a closed syncmer
            out.append(low(_xx([inner[0], inner[1], inner[3]])))
    return out or [low(_xx(h))] * whole  # no k-mer chosen: the hash of all units


def _fingerprint(text):
    return sorted(set(_anchors(text)))[:64]


def _likeness(a, b):
    both = sorted(set(a) | set(b))[:64]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def test_fingerprints_match_brute_force(ship, documents):
    out = {r.doc_id: r for r in QUERIES["op6_fingerprints"](ship, SF_SMALL).collect()}
    rows = sorted(documents, reverse=True)
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        fp, fe, fn = _fingerprint(t), _fingerprint(edited), _fingerprint(nxt)
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x + (1 << 31):08X}" for x in fp)
        assert r.edited_fingerprint == "".join(f"{x + (1 << 31):08X}" for x in fe)
        assert r.near_edited == pytest.approx(_likeness(fp, fe)) and r.near_next == pytest.approx(_likeness(fp, fn))


def test_anchors_match_positions(ship):
    rng = random.Random(0)
    body = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))
    rows = [(1, body), (2, "a new beginning of seven more words here " + body), (3, "nothing in common " * 9)]
    a = fingerprint.anchors(ship.createDataFrame(rows, "doc_id long, text string"))
    m = {(r.left_id, r.right_id, r["shift"]): r.n_anchors for r in fingerprint.match_positions(a, a).collect()}
    assert m[(1, 2, 8)] == m[(1, 1, 0)] > 40 and not any({x, y} == {1, 3} for x, y, _ in m)


def test_fingerprint_edges(ship):
    df = ship.createDataFrame(edge_rows(), DOCS).withColumn("k", F.lit("clash")).withColumn("need", F.lit(0))
    out = fingerprint.fingerprint_edits(df).collect()
    assert len(out) == len(edge_rows())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].n_chars == 0 and by[3][0].fingerprint == "" and by[1][0].fingerprint == by[2][0].fingerprint == by[None][0].fingerprint
    # after the null id, the last one, comes the largest
    same, top = by[None][0], "日本語 テキスト 😀"
    text = " ".join(f"w{i}" for i in range(40))
    n = len(text)
    assert same.edited_sha256 == hashlib.sha256((text[:n - n // 3] + top[:n // 3]).encode()).hexdigest()
    assert fingerprint.fingerprint_edits(df.limit(0)).collect() == []
    alone = fingerprint.fingerprint_edits(df.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_short_texts_have_anchors_of_their_own(ship):
    """Different texts of 1 to 8 units: none is without a fingerprint, no two have the same."""
    rng = random.Random(0)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in range(1, 9) for _ in range(60)]
    df = ship.createDataFrame([(i, t) for i, t in enumerate([*texts, "", " \n"])], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(df).collect()}
    assert any(len(t.split()) >= 5 and not _anchors(t, whole=False) for t in texts)
    prints = [got[i].fingerprint for i in range(len(texts))]
    assert all(prints) and len(set(prints)) == len(texts)
    for i, t in enumerate(texts):
        if _anchors(t):  # as before
            assert got[i].fingerprint == "".join(f"{x + (1 << 31):08X}" for x in _fingerprint(t))
        assert got[i].near_next == 0.0
    assert got[len(texts)].fingerprint == got[len(texts) + 1].fingerprint == ""
