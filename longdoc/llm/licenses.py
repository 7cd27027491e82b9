"""Operator 12, license scans by template-markup matching.

A template is a license text with markup: ``<<beginOptional>> ... <<endOptional>>`` encloses words that
may be missing, ``<<var;match="lo-hi">>`` stands for ``lo`` to ``hi`` words of any kind. All other
words are mandatory wording. ``compile_templates`` turns the templates into one token automaton: a word
is one transition, an optional region one empty transition around its words, a replaceable region
a chain of transitions on any word. A text is accepted where the mandatory wording stands exactly, in order,
with nothing but the marked regions between.

Every text is scanned as a whole. A word pair table, taken from the automaton, leaves the places where a match
can begin; from each the automaton is run as a deterministic one whose states are made when
first met. No match is longer than the longest template, so a place costs bounded work and a document's memory is two
bytes a word.

Plain phrases are templates without regions. Their labels are the base labels.

Defined cases: a null or empty text has no words and no labels; of a text of any length every place counts;
matches may overlap, and one template counts once per place where it begins (with its longest match); rows with
null or repeated ids are scanned like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.llm.common import as_bytes, byte_slices

#: States of the deterministic automaton that a worker remembers.
MEMO_STATES = 20_000

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_MARK = re.compile(r'<<(?:(beginOptional)|(endOptional)|var;match="(\d+)-(\d+)")>>')

#: The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_NO_WARRANTY_BSD = """
THIS SOFTWARE IS PROVIDED BY <<var;match="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<var;match="1-20">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_CONDITIONS_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>>
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

#: The wording of public licenses and of the notices that name them, (name, label, template).
TEMPLATES = [
    ("mit-text", "mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;match="1-20">> to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;match="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", "isc", """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match="1-20">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""),
    ("bsd-2-clause-text", "bsd-2-clause", _CONDITIONS_BSD + _NO_WARRANTY_BSD),
    ("bsd-3-clause-text", "bsd-3-clause", _CONDITIONS_BSD + """
<<beginOptional>>3.<<endOptional>> Neither the name of <<var;match="1-20">> nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.""" + _NO_WARRANTY_BSD),
    ("apache-2.0-notice", "apache-2.0", """
Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); <<var;match="0-8">> you may not use
<<var;match="1-12">> except in compliance with the License.<<endOptional>>"""),
    ("mit-notice", "mit", """
<<beginOptional>>is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under
<<beginOptional>>the terms of<<endOptional>> the MIT License"""),
    ("gpl-2.0-notice", "gpl-2.0", """
under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
<<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 2"""),
    ("gpl-3.0-notice", "gpl-3.0", """
under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
<<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 3"""),
    ("lgpl-notice", "lgpl", """
under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License"""),
    ("cc-by-4.0-notice", "cc-by-4.0", """
licensed under <<beginOptional>>a Creative Commons Attribution<<endOptional>> <<beginOptional>>the<<endOptional>>
<<beginOptional>>CC BY<<endOptional>> 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>"""),
    ("cc-by-nc-4.0-notice", "cc-by-nc-4.0", """
licensed under <<beginOptional>>the<<endOptional>> CC BY-NC 4.0 <<beginOptional>>License<<endOptional>>"""),
    ("cc0-notice", "cc0", """
released <<beginOptional>>into the public domain<<endOptional>> under <<beginOptional>>the<<endOptional>> CC0"""),
]


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def parse(markup: str) -> list:
    """Words (bytes), regions (lo, hi) and optional parts (lists) of a template."""
    stack, at = [[]], 0
    for m in _MARK.finditer(markup):
        stack[-1] += words_of(markup[at:m.start()].encode())
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ValueError("an optional part ends that has not begun")
            part = stack.pop()
            stack[-1].append(part)
        else:
            lo, hi = int(m[3]), int(m[4])
            if lo > hi:
                raise ValueError(f"no number of words is from {lo} to {hi}")
            stack[-1].append((lo, hi))
    if len(stack) > 1:
        raise ValueError("an optional part doesn't end")
    if "<<" in markup[at:]:
        raise ValueError(f"unknown mark: {markup[markup.index('<<', at):][:40]}")
    return stack[0] + words_of(markup[at:].encode())


def to_regex(nodes: list) -> str:
    """The same language as a regular expression over words that each follow a space: for SQL and tests."""
    out = ""
    for x in nodes:
        if isinstance(x, bytes):
            out += " " + x.decode()
        elif isinstance(x, tuple):
            out += f"(?: [^ ]+){{{x[0]},{x[1]}}}"
        else:
            out += f"(?:{to_regex(x)})?"
    return out


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    base: bool
    markup: str


def templates() -> list[Template]:
    return ([Template(text, label, True, text) for text, label in PHRASES]
            + [Template(name, label, False, text) for name, label, text in TEMPLATES])


class Automaton:
    """The templates' common automaton over word numbers (0: a word of no template)."""

    def __init__(self, markups: list[str]):
        self.arcs: list[list[tuple[int | None, int]]] = [[]]  # per state (word number or None for any word, next state)
        self.empty: list[list[int]] = [[]]
        self.final: dict[int, int] = {}
        self.ids: dict[bytes, int] = {}
        self.longest = 0
        for i, markup in enumerate(markups):
            first = self._state()
            self.empty[0].append(first)
            last, length = self._add(parse(markup), first)
            self.final[last] = i
            self.longest = max(self.longest, length)
        self.start = self._close({0})
        if any(w is None for s in self.start for w, _ in self.arcs[s]) or any(s in self.final for s in self.start):
            raise ValueError("a template must begin with words of its own")
        self.memo: dict[frozenset, tuple[list, tuple[int, ...]]] = {}
        n = len(self.ids) + 1
        self.pairs = np.zeros((n, n), bool)
        for a in range(1, n):
            after = self._move(self.start, a)
            if any(s in self.final for s in after):
                self.pairs[a] = True
            elif after:
                self.pairs[a] = [bool(self._move(after, b)) for b in range(n)]

    def _state(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def _add(self, nodes: list, at: int) -> tuple[int, int]:
        """Adds ``nodes`` behind the state ``at``: the state behind them, and their largest number of words."""
        total = 0
        for x in nodes:
            if isinstance(x, bytes):
                nxt = self._state()
                self.arcs[at].append((self.ids.setdefault(x, len(self.ids) + 1), nxt))
                at, total = nxt, total + 1
            elif isinstance(x, tuple):
                chain = [at]
                for _ in range(x[1]):
                    chain.append(self._state())
                    self.arcs[chain[-2]].append((None, chain[-1]))
                at = self._state()
                for s in chain[x[0]:]:
                    self.empty[s].append(at)
                total += x[1]
            else:
                inside = self._state()
                self.empty[at].append(inside)
                end, length = self._add(x, inside)
                behind = self._state()
                self.empty[end].append(behind)
                self.empty[at].append(behind)
                at, total = behind, total + length
        return at, total

    def _close(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def _move(self, states: frozenset, word: int) -> frozenset:
        return self._close({t for s in states for w, t in self.arcs[s] if w is None or w == word})

    def _enter(self, states: frozenset) -> tuple[list, tuple[int, ...]]:
        """(transitions met so far, templates accepted) of a deterministic state."""
        row = self.memo.get(states)
        if row is None:
            if len(self.memo) >= MEMO_STATES:
                self.memo.clear()
            row = self.memo[states] = ([states] + [None] * (len(self.ids) + 1), tuple(sorted(self.final[s] for s in states if s in self.final)))
        return row

    def number(self, data: bytes) -> np.ndarray:
        """Word numbers of a whole text, read slice by slice."""
        get = self.ids.get
        parts = [np.array([get(w, 0) for w in s.split()], np.uint16) for s in byte_slices(data.translate(_FOLD))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def matches(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last word) of the longest match of each template at each place, in the
        places' order."""
        if not len(numbers):
            return
        begin = self._enter(self.start)
        places = np.flatnonzero(self.pairs[numbers, np.append(numbers[1:], 0)])
        for at in places.tolist():
            ends, here = {}, begin
            for i, w in enumerate(numbers[at:at + self.longest].tolist()):
                nxt = here[0][w + 1]
                if nxt is None:
                    states = self._move(here[0][0], w)
                    nxt = here[0][w + 1] = self._enter(states) if states else ()
                if not nxt:
                    break
                here = nxt
                for t in here[1]:
                    ends[t] = at + i
            for t in sorted(ends):
                yield t, at, ends[t]


@lru_cache(maxsize=4)
def compile_templates(markups: tuple[str, ...]) -> Automaton:
    return Automaton(list(markups))


def spans(docs: DataFrame, known: list[Template] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, template, label, first_word, last_word): every match, words counted from 0."""
    known = known or templates()
    markups = tuple(t.markup for t in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_templates(markups)
        for batch in batches:
            for d, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = list(automaton.matches(automaton.number(as_bytes(value.as_py()))))
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(got), pa.int64()), pa.array([known[t].name for t, _, _ in got], pa.string()),
                         pa.array([known[t].label for t, _, _ in got], pa.string()), pa.array([a for _, a, _ in got], pa.int64()),
                         pa.array([b for _, _, b in got], pa.int64())],
                        names=["doc_id", "template", "label", "first_word", "last_word"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, template string, label string, first_word long, last_word long")


FOUND = "array<struct<template:string,label:string,base:boolean,places:bigint,first_word:bigint,last_word:bigint>>"


def scan(docs: DataFrame, known: list[Template] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, found): per row the templates found, with their number of places and the smallest and
    largest word where one begins."""
    known = known or templates()
    markups = tuple(t.markup for t in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_templates(markups)
        schema = pa.struct([("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("places", pa.int64()),
                            ("first_word", pa.int64()), ("last_word", pa.int64())])
        for batch in batches:
            n_words, found = [], []
            for value in batch.column(1):
                numbers = automaton.number(as_bytes(value.as_py()))
                seen: dict[int, list[int]] = {}
                for t, at, _ in automaton.matches(numbers):
                    if t in seen:
                        seen[t][0] += 1
                        seen[t][2] = at
                    else:
                        seen[t] = [1, at, at]
                n_words.append(len(numbers))
                found.append([{"template": known[t].name, "label": known[t].label, "base": known[t].base, "places": n,
                               "first_word": a, "last_word": b} for t, (n, a, b) in sorted(seen.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(schema))],
                                             names=["doc_id", "n_words", "found"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, found {FOUND}")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns. ``score``: 1 where the wording of a license text or notice stands, 0.5 where only a
    base phrase does, else 0."""
    base = F.filter("found", lambda x: x["base"])

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.aggregate(base, F.lit(0).cast("long"), lambda n, x: n + x["places"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.when(F.exists("found", lambda x: ~x["base"]), 1.0).when(F.size("found") > 0, 0.5).otherwise(0.0).alias("score"))


def _sql() -> str:
    phrases = ", ".join(f"(['{text.replace(' ', chr(39) + ', ' + chr(39))}'], '{label}')" for text, label in PHRASES)
    wording = ",\n  ".join(f"CASE WHEN regexp_matches(t, '{to_regex(parse(markup))} ') THEN '{label}' END"
                           for _, label, markup in TEMPLATES)
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p(ws, label) AS (VALUES {phrases}),
hits AS (SELECT w.r, p.label, unnest(list_filter(range(1, len(w.ws) - len(p.ws) + 2), lambda i: w.ws[i:i + len(p.ws) - 1] = p.ws)) - 1 AS i
       FROM w, p),
b AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM hits GROUP BY r),
joined AS (SELECT r, ' ' || array_to_string(ws, ' ') || ' ' AS t FROM w),
m AS (SELECT r, list_filter([{wording}], lambda x: x IS NOT NULL) AS labels FROM joined)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || m.labels)), ',') AS labels,
  CASE WHEN len(m.labels) > 0 THEN 1.0 WHEN b.n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM w JOIN m USING (r) LEFT JOIN b USING (r)"""


SQL = _sql()
