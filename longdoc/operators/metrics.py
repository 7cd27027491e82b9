"""Text-generation metrics.

Pairs are (id, reference, prediction) rows, scored row by row: tokens come from JVM
expressions, overlaps and alignments from Arrow UDFs that code a batch's tokens as
integers. Nothing is grouped, joined or shuffled by the id, so repeated and
null ids are scored like any other. Token rules are fixed values:
* QA F1/EM: lowercase; drop ASCII punctuation; drop the whole tokens a, an,
  the; split on [ \\t\\n\\r]+.
* ROUGE: tokens are the runs of [a-z0-9] in the lowercased text, no stemming.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.constants import SEED, WS_REGEX
from longdoc.functions.parts import by_parts

# ASCII punctuation class and English articles (QA normalisation)
PUNCT_RE = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
ROUGE_TOKEN_RE = "[a-z0-9]+"


def qa_tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    no_punct = F.regexp_replace(F.lower(c), PUNCT_RE, "")
    return F.filter(F.split(no_punct, WS_REGEX), lambda t: (t != "") & ~t.isin(*ARTICLES))


def rouge_tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_TOKEN_RE), 0)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, row of each value) of a list column; a null list is empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _coded(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of two list columns as integers, with their rows."""
    va, ra = _flat(a)
    vb, rb = _flat(b)
    code = pa.concat_arrays([va, vb]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return code[:len(va)], ra, code[len(va):], rb


def multiset_overlap(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray, rows: int) -> np.ndarray:
    """Per row the size of the multiset intersection of two sides' codes."""
    side = np.concatenate([np.zeros(len(ca), np.int64), np.ones(len(cb), np.int64)])
    code, row = np.concatenate([ca, cb]), np.concatenate([ra, rb])
    order = np.lexsort((side, code, row))
    code, row, side = code[order], row[order], side[order]
    if not len(code):
        return np.zeros(rows, np.int64)
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[first, len(code)])
    n_b = np.add.reduceat(side, first)
    return np.bincount(row[first], weights=np.minimum(n_b, n - n_b), minlength=rows).astype(np.int64)


def _grams(code: np.ndarray, row: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams within each row."""
    if n == 1:
        return code, row
    if n != 2:
        raise ValueError("n-grams of 1 or 2 tokens")
    inside = row[1:] == row[:-1]
    return (code[:-1] * base + code[1:])[inside], row[1:][inside]


def overlap(a, b, n: int = 1) -> Column:
    """Multiset overlap of the n-grams of two token-array columns, row by row."""
    def part(x: pa.Array, y: pa.Array) -> pa.Array:
        ca, ra, cb, rb = _coded(x, y)
        base = int(max(ca.max(initial=0), cb.max(initial=0))) + 1
        ca, ra = _grams(ca, ra, n, base)
        cb, rb = _grams(cb, rb, n, base)
        return pa.array(multiset_overlap(ca, ra, cb, rb, len(x)), pa.int64())

    @F.arrow_udf(T.LongType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return by_parts(part, x, y)

    return run(a, b)


def prf(overlap: Column, n_ref: Column, n_pred: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_pred > 0, overlap / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_ref > 0, overlap / n_ref).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


def _qa_scores(ref, pred) -> tuple[Column, Column]:
    r, p = qa_tokens(ref), qa_tokens(pred)
    nr, np_ = F.size(r), F.size(p)
    both = F.when((nr == 0) & (np_ == 0), 1.0).otherwise(0.0)
    f1 = F.when((nr == 0) | (np_ == 0), both).otherwise(2.0 * overlap(r, p) / (nr + np_))
    return f1, F.when(F.array_join(r, " ") == F.array_join(p, " "), 1.0).otherwise(0.0)


def qa_f1_em(pairs: DataFrame, id_col: str = "id", ref: str = "reference",
             pred: str = "prediction") -> DataFrame:
    """G1: token F1 and exact match per pair, in [0, 1]. Either side empty:
    1 if both are empty, else 0 (for both scores)."""
    f1, em = _qa_scores(_text(ref), _text(pred))
    return pairs.select(id_col, f1.alias("f1"), em.alias("exact_match"))


def _text(col) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _rouge_n(ref: Column, pred: Column, n: int) -> tuple[Column, Column, Column]:
    r, p = rouge_tokens(ref), rouge_tokens(pred)
    size = lambda t: F.greatest(F.size(t) - (n - 1), F.lit(0))
    return prf(overlap(r, p, n), size(r), size(p))


def rouge_n(pairs: DataFrame, n: int, id_col: str = "id", ref: str = "reference",
            pred: str = "prediction") -> DataFrame:
    """ROUGE-n (1 or 2) precision, recall, F on n-gram multiset overlap."""
    p, r, f = _rouge_n(_text(ref), _text(pred), n)
    return pairs.select(id_col, p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


# ---- LCS-based scores: bit-parallel over integer-coded tokens ---------------

def lcs_length(a: list, b: list) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro): O(|b|) word operations
    on |a|-bit integers."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def token_masks(tokens: list) -> dict:
    """The places of each token as bits."""
    masks: dict = {}
    for i, t in enumerate(tokens):
        masks[t] = masks.get(t, 0) | (1 << i)
    return masks


def lcs_positions(ref: list, cand: list, masks: dict | None = None) -> list[int]:
    """Indices into ``ref`` of one LCS, walked back from the end; without a match the walk
    moves along ``cand`` where that keeps the length and the last of ``ref`` adds to it, else
    along ``ref``. Only the bit rows of the recursion are kept (a bit of |ref| per token
    of ``cand``): bit i of row j is clear where ref[i] raises the length. ``masks``: ref's, if they are at hand."""
    m, n = len(ref), len(cand)
    if not m or not n:
        return []
    masks = token_masks(ref) if masks is None else masks
    full = (1 << m) - 1
    rows = [full]
    for t in cand:
        v = rows[-1]
        u = v & masks.get(t, 0)
        rows.append(((v + u) | (v - u)) & full)
    out = []
    i, j = m, n
    while i > 0 and j > 0:
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif not rows[j] >> (i - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def summary_lcs_hits(ref_sents: list[list], cand_sents: list[list]) -> int:
    """ROUGE-Lsum hits: union LCS of each reference sentence against all
    candidate sentences, each token counted at most as often as it occurs on
    both sides (Lin 2004)."""
    cr, cc = Counter(), Counter()
    for s in ref_sents:
        cr.update(s)
    for s in cand_sents:
        cc.update(s)
    # equal sentences give equal positions, and one without a common token none
    different = list(dict.fromkeys(map(tuple, cand_sents)))
    holds: dict = {}
    for j, s in enumerate(different):
        for t in set(s):
            holds.setdefault(t, []).append(j)
    hits = 0
    for r in ref_sents:
        idx, masks = set(), token_masks(r)
        for j in sorted({j for t in masks for j in holds.get(t, ())}):
            idx.update(lcs_positions(r, different[j], masks))
            if len(idx) == len(r):
                break
        for i in sorted(idx):
            tkn = r[i]
            if cr[tkn] > 0 and cc[tkn] > 0:
                hits += 1
                cr[tkn] -= 1
                cc[tkn] -= 1
    return hits


def _rows_of(code: np.ndarray, row: np.ndarray, n: int) -> list[list[int]]:
    return [x.tolist() for x in np.split(code, np.searchsorted(row, np.arange(1, n)))] if n else []


def _lcs_part(a: pa.Array, b: pa.Array) -> pa.Array:
    ca, ra, cb, rb = _coded(a, b)
    return pa.array([lcs_length(x, y) for x, y in zip(_rows_of(ca, ra, len(a)), _rows_of(cb, rb, len(b)), strict=True)],
                    pa.int64())


@F.arrow_udf(T.LongType())
def _lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_parts(_lcs_part, a, b)


def _lsum_part(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([summary_lcs_hits(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist())],
                    pa.int64())


@F.arrow_udf(T.LongType())
def _lsum_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return by_parts(_lsum_part, a, b)


def _rouge_l(ref: Column, pred: Column) -> tuple[Column, Column, Column]:
    r, p = rouge_tokens(ref), rouge_tokens(pred)
    return prf(_lcs_udf(r, p), F.size(r), F.size(p))


def rouge_l(pairs: DataFrame, id_col: str = "id", ref: str = "reference",
            pred: str = "prediction") -> DataFrame:
    """ROUGE-L from the LCS of the whole token sequences."""
    p, r, f = _rouge_l(_text(ref), _text(pred))
    return pairs.select(id_col, p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


def _rouge_lsum(ref: Column, pred: Column) -> tuple[Column, Column, Column]:
    def sents(c):
        return F.filter(F.transform(F.split(c, "\n"), lambda s: rouge_tokens(s)), lambda t: F.size(t) > 0)
    r, p = sents(ref), sents(pred)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.size(s))
    return prf(_lsum_udf(r, p), total(r), total(p))


def rouge_lsum(pairs: DataFrame, id_col: str = "id", ref: str = "reference",
               pred: str = "prediction") -> DataFrame:
    """ROUGE-Lsum, texts split into sentences at newlines."""
    p, r, f = _rouge_lsum(_text(ref), _text(pred))
    return pairs.select(id_col, p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


SCORES = ("f1", "exact_match", "rouge1", "rouge2", "rougeL", "rougeLsum")


def all_scores(pairs: DataFrame, keep: list[str], ref: str = "reference", pred: str = "prediction",
               rouge_ref: str | None = None) -> DataFrame:
    """G1-G4 in one projection: ``keep`` and the six scores of every row. ``rouge_ref``: another
    reference column for the ROUGE scores."""
    r, p, g = _text(ref), _text(pred), _text(rouge_ref or ref)
    f1, em = _qa_scores(r, p)
    fm = (_rouge_n(g, p, 1)[2], _rouge_n(g, p, 2)[2], _rouge_l(g, p)[2], _rouge_lsum(g, p)[2])
    return pairs.select(*keep, f1.alias("f1"), em.alias("exact_match"),
                        *[x.alias(c) for x, c in zip(fm, SCORES[2:], strict=True)])


# ---- corpus-level --------------------------------------------------------

def corpus_mean(scores: DataFrame, col: str = "fmeasure", digits: int = 4) -> DataFrame:
    """G5 (plain mean), rounded like the reference's report."""
    return scores.agg(F.round(F.avg(col), digits).alias("mean"), F.count(F.lit(1)).alias("n"))


def replicate_factors(reps: int, seed: int) -> np.ndarray:
    """One odd 64-bit factor per replicate, from md5 of (seed, replicate)."""
    import hashlib
    return np.array([2 * int(hashlib.md5(f"{seed}|{r}".encode()).hexdigest()[:15], 16) + 1 for r in range(reps)], np.uint64)


def poisson_cdf() -> list[float]:
    """P(W <= j) of Poisson(1) for j = 0 .. 7; all but 1e-5 of the mass."""
    import math
    return [sum(math.exp(-1.0) / math.factorial(i) for i in range(j + 1)) for j in range(8)]


def bootstrap_weights(bits: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(rows, replicates) Poisson(1) weights: the product of a row's 52 hash bits + 1 and the
    replicate's factor, mod 2^64, is the uniform that the CDF is inverted at."""
    with np.errstate(over="ignore"):
        u = ((bits.astype(np.uint64) + np.uint64(1))[:, None] * factors[None, :]) >> np.uint64(12)
    return np.searchsorted(np.array(poisson_cdf()), u.astype(np.float64) / float(1 << 52), side="left")


#: Rows that bootstrap weights are drawn for at a time.
BOOTSTRAP_ROWS = 128


def bootstrap_sums(batches, names: list[str], factors: np.ndarray):
    """(metric, replicate, weighted sum, sum of weights) over batches of hash bits and scores: one record batch per metric,
    none without a row. The weights of at most ``BOOTSTRAP_ROWS`` rows are held, however many rows a batch has."""
    reps, rows = len(factors), 0
    sums, total = np.zeros((len(names), reps)), np.zeros(reps)
    for batch in batches:
        bits = batch.column(0).to_numpy()
        values = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))]
        for a in range(0, len(bits), BOOTSTRAP_ROWS):
            w = bootstrap_weights(bits[a:a + BOOTSTRAP_ROWS], factors).astype(np.float64)
            total += w.sum(axis=0)
            for i, v in enumerate(values):
                sums[i] += v[a:a + BOOTSTRAP_ROWS] @ w
        rows += len(bits)
    for name, part in zip(names if rows else [], sums):
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * reps), pa.array(np.arange(reps, dtype=np.int32)), pa.array(part), pa.array(total)],
            names=["metric", "rep", "s", "w"])


def bootstrap_mid(scores: DataFrame, cols: str | list[str] = "fmeasure", id_col: str = "id", reps: int = 1000,
                  seed: int = SEED, digits: int = 4) -> DataFrame:
    """Bootstrap of the means with Poisson(1) weights, one per (row id, replicate);
    (metric, low, mid, high) are the percentiles 2.5, 50 and 97.5 of the replicate means.
    A task draws the weights of a block of rows as one matrix and adds them up per replicate (``bootstrap_sums``),
    so it sends ``reps`` rows per metric and no row is multiplied."""
    names = [cols] if isinstance(cols, str) else list(cols)
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13),
                  16, 10).cast("long")
    factors = replicate_factors(reps, seed)

    def run(batches):
        return bootstrap_sums(batches, names, factors)

    sums = scores.select(bits.alias("_b"), *[F.col(c).cast("double") for c in names]).mapInArrow(
        run, "metric string, rep int, s double, w double")
    per = sums.groupBy("metric", "rep").agg((F.sum("s") / F.greatest(F.sum("w"), F.lit(1.0))).alias("m"))
    q = per.groupBy("metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select("metric", F.round(F.col("q")[0], digits).alias("low"), F.round(F.col("q")[1], digits).alias("mid"),
                    F.round(F.col("q")[2], digits).alias("high"))


def greedy_match(cands: DataFrame, refs: DataFrame, group: str, id_col: str,
                 vec: str = "embedding", block: int = 2048) -> DataFrame:
    """Greedy matching of token vectors (BERTScore form): P = mean over
    candidate tokens of the best similarity to a reference token, R the
    other way round, F1 = 2PR/(P+R). Inner product (unit vectors -> cosine).
    The best match is an exact top-1 search within the group, tiled."""
    from longdoc.operators.retrieve import knn_within
    c2r = knn_within(cands, refs, group, id_col, id_col, vec, k=1, block=block)
    r2c = knn_within(refs, cands, group, id_col, id_col, vec, k=1, block=block)
    p = c2r.groupBy(group).agg(F.avg("score").alias("precision"))
    r = r2c.groupBy(group).agg(F.avg("score").alias("recall"))
    # every group of either side counts; without a match on the other side it scores 0
    every = cands.select(group).union(refs.select(group)).distinct()
    j = every.join(p, group, "left").join(r, group, "left").na.fill(0.0, ["precision", "recall"])
    return j.select(group, "precision", "recall", _harmonic(F.col("precision"), F.col("recall")).alias("f1"))


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def char_ngram_vectors(tokens: list[str], n: int = 3) -> np.ndarray:
    """The built-in token encoder of G6: unit vectors of the counts of a token's character
    n-grams between a begin and an end mark, over the n-grams of all ``tokens``."""
    place: dict = {}
    at = [[place.setdefault(p[i:i + n], len(place)) for i in range(len(p) - n + 1)] for p in (f"<{t}>" for t in tokens)]
    out = np.zeros((len(tokens), max(len(place), 1)))
    for row, cols in enumerate(at):
        np.add.at(out[row], cols, 1.0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1.0, norm)


def _ngram_rows(tokens: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, n-gram, count) rows of the character n-grams of ``tokens`` between their marks; an n-gram is its code
    points in one number."""
    size = np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens))
    codes = np.frombuffer("".join(f"<{t}>" for t in tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), size)
    m = max(0, len(codes) - n + 1)
    gram = np.zeros(m, np.int64)
    for i in range(n):
        gram = (gram << 21) | codes[i:m + i]
    inside = row[:m] == row[n - 1:m + n - 1]
    row, gram = row[:m][inside], gram[inside]
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(new)
    return row[at], gram[at], np.diff(np.r_[at, len(row)])


#: Cells of the (token, other token) block that similarities are summed up in, and n-gram matches expanded at a time.
MATCH_CELLS = 1 << 22


def best_by_ngrams(tokens: list[str], others: list[str]) -> np.ndarray:
    """The largest cosine of each of ``tokens`` (all different) with one of ``others`` by their character n-gram counts. A
    token that is among them has 1. For the rest the others' n-grams are inverted, and the postings of a block of tokens
    are summed up in a block of bounded size."""
    known = set(others)
    out = np.array([float(t in known) for t in tokens])
    left = np.array([i for i, t in enumerate(tokens) if t not in known], np.int64)
    if not len(left) or not others:
        return out
    other, gram, n = _ngram_rows(others)
    weight = n / np.sqrt(np.bincount(other, weights=n.astype(np.float64) ** 2))[other]
    order = np.argsort(gram, kind="stable")
    other, gram, weight = other[order], gram[order], weight[order]
    row, own, count = _ngram_rows([tokens[i] for i in left])
    norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2))
    first, last = np.searchsorted(gram, own), np.searchsorted(gram, own, side="right")
    matches = last - first
    step = max(1, MATCH_CELLS // len(others))
    for a in range(0, len(left), step):
        i, j = np.searchsorted(row, [a, a + step])
        sums = np.zeros(min(step, len(left) - a) * len(others))
        while i < j:  # some of the block's n-grams at a time
            e = i + max(1, int(np.searchsorted(np.cumsum(matches[i:j]), MATCH_CELLS, side="right")))
            at = np.repeat(first[i:e] - (np.cumsum(matches[i:e]) - matches[i:e]), matches[i:e]) + np.arange(int(matches[i:e].sum()))
            cell = np.repeat((row[i:e] - a) * len(others), matches[i:e]) + other[at]
            sums += np.bincount(cell, weights=np.repeat(count[i:e], matches[i:e]) * weight[at], minlength=len(sums))
            i = e
        out[left[a:a + step]] = sums.reshape(-1, len(others)).max(axis=1) / norm[a:a + step]
    return out


def _best_by_vectors(v: np.ndarray, i: np.ndarray, j: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Largest products of the rows ``i`` of ``v`` with those of ``j``, and the other way round; a block at a time."""
    there, back = np.empty(len(i)), np.full(len(j), -np.inf)
    for a in range(0, len(i), block):
        s = v[i[a:a + block]] @ v[j].T
        there[a:a + block] = s.max(axis=1)
        np.maximum(back, s.max(axis=0), out=back)
    return there, back


def greedy_text_match(pairs: DataFrame, keep: list[str], ref: str = "reference", pred: str = "prediction",
                      encoder=char_ngram_vectors) -> DataFrame:
    """G6 on texts, row by row: the whitespace tokens of both sides as vectors of ``encoder``
    (list of distinct tokens -> unit vectors), greedily matched as in ``greedy_match``. A pair with an empty
    side scores 0, two empty sides 1; every pair gives a row. The built-in vectors are never laid out: their best
    matches come from n-gram postings (``best_by_ngrams``), so a long pair needs memory for its distinct tokens only."""
    from longdoc.functions.text import words

    def part(a: pa.Array, b: pa.Array) -> pa.Array:
        p, r = [], []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if not x or not y:
                p.append(float(not x and not y)), r.append(float(not x and not y))
                continue
            cx, cy = Counter(x), Counter(y)
            if encoder is char_ngram_vectors:
                there, back = best_by_ngrams(list(cx), list(cy)), best_by_ngrams(list(cy), list(cx))
            else:
                place = {t: i for i, t in enumerate(sorted(set(cx) | set(cy)))}
                there, back = _best_by_vectors(np.asarray(encoder(list(place))), np.array([place[t] for t in cx]), np.array([place[t] for t in cy]))
            p.append(float((there * np.array(list(cx.values()))).sum() / len(x)))
            r.append(float((back * np.array(list(cy.values()))).sum() / len(y)))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(r, pa.float64())], names=["precision", "recall"])

    @F.arrow_udf("precision double, recall double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return by_parts(part, a, b)

    m = pairs.select(*keep, run(words(_text(pred)), words(_text(ref))).alias("_m"))
    return m.select(*keep, "_m.precision", "_m.recall", _harmonic(F.col("_m.precision"), F.col("_m.recall")).alias("f1"))


def classification_prf(df: DataFrame, logits: str = "logits", truth: str = "truth",
                       positive: int = 1) -> DataFrame:
    """prediction = argmax of the logits (first maximum); precision,
    recall, F1 of the positive class; NULL when undefined."""
    pred = F.array_position(F.col(logits), F.array_max(F.col(logits))) - 1
    d = df.select(pred.alias("pred"), F.col(truth).alias("truth"))
    tp = F.sum(F.when((F.col("pred") == positive) & (F.col("truth") == positive), 1).otherwise(0))
    fp = F.sum(F.when((F.col("pred") == positive) & (F.col("truth") != positive), 1).otherwise(0))
    fn = F.sum(F.when((F.col("pred") != positive) & (F.col("truth") == positive), 1).otherwise(0))
    a = d.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count(F.lit(1)).alias("n"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return a.select(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "n")


def weighted_mean(df: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """Mean of logged values weighted by batch size."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def corpus_stats(df: DataFrame, split: str = "split", n_tokens: str = "n_tokens",
                 n_chunks: str = "n_chunks", n_abstract: str = "n_abstract") -> DataFrame:
    """Per split: documents, mean and percentiles of token length, mean
    chunks and abstract length. ``percentile`` keeps one count per distinct
    length, so its state is bounded by the longest document."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(n_tokens).alias("mean_tokens"),
        F.percentile(n_tokens, 0.5).alias("p50_tokens"),
        F.percentile(n_tokens, 0.9).alias("p90_tokens"),
        F.avg(n_chunks).alias("mean_chunks"),
        F.avg(n_abstract).alias("mean_abstract"))
