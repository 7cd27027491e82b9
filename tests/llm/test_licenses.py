"""Operator 12 against regular expressions over the words."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longdoc.llm import licenses as lic
from tests.llm.conftest import DOCS, edge_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(text, known):
    """(template, first word, last word) by trying a regular expression at every word, longest match first."""
    ws, out = _words(text), []
    for t, x in enumerate(known):
        rx = re.compile(lic.to_regex(lic.parse(x.markup)))
        for i in range(len(ws)):
            for j in range(len(ws), i, -1):
                if rx.fullmatch(" " + " ".join(ws[i:j])):
                    out.append((t, i, j - 1))
                    break
    return sorted(out)


def _own(text, known):
    a = lic.Automaton([t.markup for t in known])
    return sorted(a.matches(a.number((text or "").encode())))


TOY = [lic.Template(f"t{i}", f"l{i}", i == 0, m) for i, m in enumerate([
    "a b", 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d', 'b <<var;match="0-2">> a',
    '<<beginOptional>>c<<endOptional>> d <<var;match="1-3">> <<beginOptional>>a<<endOptional>>', "a b a b"])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "x", "A"]), max_size=14).map(" ".join))
def test_automaton_equals_regular_expressions(text):
    assert _own(text, TOY) == _brute(text, TOY)


def _fill(markup, region="the great Example Company"):
    text = re.sub(r"<<beginOptional>>|<<endOptional>>", " ", markup)
    return re.sub(r'<<var;match="\d+-\d+">>', region, text)


@pytest.mark.parametrize("name", [t[0] for t in lic.TEMPLATES])
def test_wording_with_and_without_its_regions(name):
    known = lic.templates()
    t = next(i for i, x in enumerate(known) if x.name == name)
    markup = known[t].markup
    bare = markup
    while "<<beginOptional>>" in bare:
        bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", bare, flags=re.S)
    for text in (_fill(markup), _fill(bare), "some words. " + _fill(bare, "someone").upper() + " more"):
        assert any(m[0] == t for m in _own(text, known))
    # one mandatory word changed, dropped or added: not accepted
    words = _words(_fill(bare))
    mandatory = [x for x in lic.parse(bare) if isinstance(x, bytes)]
    for at in (0, len(mandatory) // 2, len(mandatory) - 1):
        broken = [w for w in words]
        i = next(i for i, w in enumerate(broken) if w.encode() == mandatory[at])
        broken[i] = "zzz"
        if broken.count(mandatory[at].decode()) == 0:
            assert not any(m[0] == t for m in _own(" ".join(broken), known))


def test_replaceable_region_is_bounded():
    known = lic.templates()
    t = next(i for i, x in enumerate(known) if x.name == "mit-text")
    assert not any(m[0] == t for m in _own(_fill(known[t].markup, "word " * 21), known))


@pytest.mark.parametrize("bad", ["a <<beginOptional>> b", "a <<endOptional>>", "a <<vat>> b", '<<var;match="1-2">> a',
                                 "<<beginOptional>>a<<endOptional>>", 'a <<var;match="3-2">> b', ""])
def test_bad_templates_are_errors(bad):
    with pytest.raises(ValueError):
        lic.Automaton([bad])


def test_query_edges(ship):
    extra = ["MIT License mit-license, Apache_License", "mit license", "Under the MIT license. " * 3, "`mit`license{cc}by~gnu general public license",
             "mit " * 2000 + "license", "é mit license", "mitlicense MIT License", "x " * 30_000 + "CC BY " * 20_000]
    rows = edge_rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(extra)]
    df = ship.createDataFrame(rows, DOCS)
    for c in ("n_words", "found", "template", "labels"):
        df = df.withColumn(c, df["lang"])
    out = sorted((tuple(r) for r in lic.digest(lic.scan(df)).collect()), key=repr)
    want = []
    for d, text, *_ in rows:
        ws = _words(text)
        places = [(i, label) for phrase, label in lic.PHRASES
                  for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split()]
        joined = " " + " ".join(ws) + " "
        own = {t.label for t in lic.templates() if not t.base and re.search(lic.to_regex(lic.parse(t.markup)) + " ", joined)}
        base = {x for _, x in places}
        want.append((d, len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
                     ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0))
    assert out == sorted(want, key=repr)
    assert lic.digest(lic.scan(df.limit(0))).collect() == [] and lic.spans(df.limit(0)).collect() == []
    got = {(r.template, r.first_word, r.last_word) for r in lic.spans(df.where("doc_id = 102")).collect()}
    assert ("mit license", 2, 3) in got and ("mit-notice", 0, 3) in got and ("mit-notice", 8, 11) in got
