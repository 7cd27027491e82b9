"""Brute-force versions that the operators are tested against."""

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


class Groups:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_duplicates(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = words(t, lower=True)
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where, groups = defaultdict(list), Groups(sets)
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for e in where[x]:
                shared[e] += 1
            where[x].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                groups.link(d, e)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def cut_repeats(rows, window=13):
    """rows: (doc_id, text). Per row (n_words, n_removed, kept_sha256)."""
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def near_vectors(rows, threshold=0.98):
    """rows: (id, vector, label) with unique ids. {id: (n_links, component)}."""
    groups, degree, good = Groups([r[0] for r in rows]), defaultdict(int), []
    for i, v, label in rows:
        if v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        good.append((i, x / np.linalg.norm(x), label))
    for n, (i, x, a) in enumerate(good):
        for j, y, b in good[:n]:
            if a == b and len(x) == len(y) and float(x @ y) >= threshold:
                degree[i] += 1
                degree[j] += 1
                groups.link(i, j)
    return {r[0]: (degree[r[0]], groups.find(r[0])) for r in rows}
