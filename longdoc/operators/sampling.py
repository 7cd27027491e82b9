"""Generation steps as table operators.

Candidates are rows (group, cand, logit). A group is usually one decoding step of one
sequence, of the size of the vocabulary; a larger one is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longdoc.constants import FILTER_THRES, SEED
from longdoc.operators.batches import global_rank
from longdoc.sources.io import written


#: A group with more rows is not sorted as a whole.
HOT_GROUP = 1 << 20
#: Bins that a hot group's logits are counted in, at a time.
BINS = 4096


def topk_fraction(df: DataFrame, grp: str = "grp", cand: str = "cand", logit: str = "logit",
                  thres: float = FILTER_THRES) -> DataFrame:
    """Keep the top k = max(floor((1-thres) * n), 1) candidates per group
    (logit desc, then cand asc). Groups of over ``HOT_GROUP`` rows are selected from by histograms."""
    hot, cold = _hot_groups(df, grp)
    frac = 1.0 - thres
    w = Window.partitionBy(grp).orderBy(F.col(logit).desc(), F.col(cand).asc())
    wn = Window.partitionBy(grp)
    k = F.greatest(F.floor(F.lit(frac) * F.count(F.lit(1)).over(wn)), F.lit(1))
    small = (cold.withColumn("_r", F.row_number().over(w)).withColumn("_k", k)
             .where(F.col("_r") <= F.col("_k")).drop("_r", "_k"))
    if hot is None:
        return small
    goal = hot.select("_grp", F.greatest(F.floor(F.lit(frac) * F.col("_n")), F.lit(1)).cast("double").alias("_goal"))
    rows = df.withColumn("_mass", F.lit(1.0))
    above, inside = _cut_hot(rows, goal, grp, logit)
    # NaN first, null last, as a descending sort has them
    kind = F.when(F.col(logit).isNull(), 2).when(F.isnan(logit), 0).otherwise(1)
    ranked = global_rank(inside, [grp], [kind, F.when(kind == 1, -F.col(logit)), cand], out="_r")
    kept = ranked.where(F.col("_r") <= F.col("_goal") - F.col("_above"))
    return small.unionByName(above.select(*df.columns)).unionByName(kept.select(*df.columns))


def softmax(df: DataFrame, grp: str = "grp", logit: str = "logit", out: str = "prob") -> DataFrame:
    wn = Window.partitionBy(grp)
    e = F.exp(F.col(logit) - F.max(logit).over(wn))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(wn)).drop("_e")


def nucleus(df: DataFrame, grp: str = "grp", cand: str = "cand", logit: str = "logit",
            p: float = FILTER_THRES) -> DataFrame:
    """Smallest prefix (by probability desc, cand asc) whose mass reaches p:
    a candidate stays while the mass before it is below p. Groups of over ``HOT_GROUP`` rows are selected from by
    histograms of their mass."""
    hot, cold = _hot_groups(df, grp)
    s = softmax(cold, grp, logit)
    order = [F.col("prob").desc(), F.col(cand).asc()]
    small = (s.withColumn("_before", F.coalesce(F.sum("prob").over(_before(grp, *order)), F.lit(0.0)))
             .where(F.col("_before") < p).drop("_before"))
    if hot is None:
        return small
    own = df.join(F.broadcast(hot.select("_grp")), F.col(grp).eqNullSafe(F.col("_grp")))
    top = own.groupBy("_grp").agg(F.max(logit).alias("_top"))
    sums = (own.join(F.broadcast(top.withColumnRenamed("_grp", "_g")), F.col("_grp").eqNullSafe(F.col("_g")))
            .groupBy("_grp", "_top").agg(F.sum(F.exp(F.col(logit) - F.col("_top"))).alias("_sum")))
    sums = written(sums.withColumnRenamed("_grp", "_g"), "softmax")
    rows = df.join(F.broadcast(sums), F.col(grp).eqNullSafe(F.col("_g"))).withColumn(
        "prob", F.exp(F.col(logit) - F.col("_top")) / F.col("_sum")).drop("_g", "_top", "_sum")
    rows = rows.withColumn("_mass", F.coalesce("prob", F.lit(0.0)))
    above, inside = _cut_hot(rows, hot.select("_grp", F.lit(float(p)).alias("_goal")), grp, logit)
    # a cut of few rows is summed up in order; in a larger one all have the same mass, so a row's place gives what is before it
    few = inside.where(F.col("_rows") <= HOT_GROUP)
    few = few.withColumn("_sum", F.col("_above") + F.coalesce(F.sum("_mass").over(_before(grp, *order)), F.lit(0.0)))
    many = inside.where(F.col("_rows") > HOT_GROUP)
    kept = [few.where(F.col("_sum") < F.col("_goal"))]
    if not many.isEmpty():
        ranked = global_rank(many, [grp], [cand], out="_r")
        kept.append(ranked.where(F.col("_above") + (F.col("_r") - 1) * F.col("_mass") < F.col("_goal")))
    out = small.unionByName(above.select(*small.columns))
    for k in kept:
        out = out.unionByName(k.select(*small.columns))
    return out


def _before(grp: str, *order) -> Window:
    return Window.partitionBy(grp).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _hot_groups(df: DataFrame, grp: str) -> tuple[DataFrame | None, DataFrame]:
    """(the groups (_grp, _n) of over ``HOT_GROUP`` rows, or None, and the rows of all others). There is at most one hot group
    for every ``HOT_GROUP`` rows of the table."""
    hot = written(df.groupBy(F.col(grp).alias("_grp")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_GROUP), "hot_groups")
    if hot.isEmpty():
        return None, df
    return hot, df.join(F.broadcast(hot.select("_grp")), F.col(grp).eqNullSafe(F.col("_grp")), "left_anti")


def _cut_hot(rows: DataFrame, goal: DataFrame, grp: str, logit: str) -> tuple[DataFrame, DataFrame]:
    """Of the groups of ``goal`` (_grp, _goal): (rows that certainly belong to the largest logits whose ``_mass`` reaches
    the goal, rows of the interval in which it is reached with _above, the mass above it, _rows, its rows, and _goal).

    Each pass counts the rows and the mass of the interval's bins; the bin in which the goal is reached is the next interval, until
    it has at most ``HOT_GROUP`` rows or a single value. A pass shuffles at most ``BINS`` rows per task and group."""
    # null sorts last, NaN first; both ends stay finite
    value = F.when(F.col(logit).isNull(), F.lit(-1.7e308)).when(F.isnan(logit), F.lit(1.7e308)).otherwise(
        F.greatest(F.least(F.col(logit).cast("double"), F.lit(1.7e308)), F.lit(-1.7e308)))
    rows = rows.withColumn("_value", value)
    own = rows.join(F.broadcast(goal.select("_grp")), F.col(grp).eqNullSafe(F.col("_grp"))).drop(grp)
    state = own.groupBy("_grp").agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    state = state.join(F.broadcast(goal.withColumnRenamed("_grp", "_g")), F.col("_grp").eqNullSafe(F.col("_g"))).drop("_g")
    state = written(state.withColumn("_above", F.lit(0.0)), "selection")
    while not state.where((F.col("_rows") > HOT_GROUP) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        share = (F.col("_value") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_no = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        named = state.withColumnRenamed("_grp", "_g")
        inside = own.join(F.broadcast(named), F.col("_grp").eqNullSafe(F.col("_g")) & (F.col("_value") >= F.col("_lo"))
                          & (F.col("_value") <= F.col("_hi")))
        hist = inside.groupBy("_grp", "_goal", "_above", bin_no.alias("_bin")).agg(
            F.sum("_mass").alias("_held"), F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
        hist = written(hist, "selection")
        down = F.col("_bin").desc()
        hist = hist.withColumn("_over", F.col("_above") + F.coalesce(F.sum("_held").over(_before("_grp", down)), F.lit(0.0)))
        # the first bin from above that reaches the goal, or the last one where none does
        reached = hist.where(F.col("_over") < F.col("_goal"))
        last = Window.partitionBy("_grp").orderBy(F.col("_bin").asc())
        state = written(reached.withColumn("_r", F.row_number().over(last)).where("_r = 1")
                        .select("_grp", "_lo", "_hi", "_rows", "_goal", F.col("_over").alias("_above")), "selection")
    held = rows.join(F.broadcast(state.withColumnRenamed("_grp", "_g")), F.col(grp).eqNullSafe(F.col("_g")))
    return held.where(F.col("_value") > F.col("_hi")), held.where((F.col("_value") >= F.col("_lo")) & (F.col("_value") <= F.col("_hi")))


def uniform(seed: int, *cols) -> F.Column:
    """Deterministic U(0,1): the first 52 bits of md5("seed|col|col...") as a
    fraction (+0.5 ulp, so never 0 or 1). md5 makes the draw portable: any
    engine with md5 reproduces it."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                                else c.cast("string") for c in cols])
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def gumbel_sample(df: DataFrame, grp: str = "grp", cand: str = "cand", logit: str = "logit",
                  temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """One draw per group by Gumbel-max: argmax(logit / t + G), G = -log(-log U).
    A grouped aggregate (max_by) with map-side partial aggregation."""
    t = max(temperature, 1e-10)
    u = uniform(seed, F.col(grp), F.col(cand))
    score = F.col(logit) / F.lit(t) - F.log(-F.log(u))
    return df.groupBy(grp).agg(F.max_by(cand, score).alias("sampled"))


def filter_candidates(df: DataFrame, filter_fn: str, **kw) -> DataFrame:
    """E1/E2 by name, as the reference's filter_fn; anything else is rejected."""
    if filter_fn == "top_k":
        return topk_fraction(df, **kw)
    if filter_fn == "top_p":
        return nucleus(df, **{("p" if k == "thres" else k): v for k, v in kw.items()})
    raise ValueError("filter function must be either top_k or top_p")


def extractive_draft(nbrs: DataFrame, articles: DataFrame, max_len: int | None, group: str = "article_id",
                     chunks: str = "text_tokenized") -> DataFrame:
    """Per document, the best pair of each query chunk in query order, a
    chunk used once (first query wins), concatenated and cut to ``max_len`` (None: whole)."""
    from longdoc.operators.retrieve import _pair
    best = nbrs.where(F.col("rank") == 1).groupBy(group, "chunk_no").agg(F.min("query_no").alias("query_no"))
    g = best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("query_no", "chunk_no"))).alias("_d"))
    j = articles.select(group, F.col(chunks).alias("_c")).join(g, group)
    flat = F.flatten(F.transform("_d", lambda s: _pair(F.col("_c"), s["chunk_no"])))
    return j.select(group, (flat if max_len is None else F.slice(flat, 1, max_len)).alias("draft_ids"))


def generate(df: DataFrame, fn: Callable, inputs: str | list[str] = "prompt",
             out: str = "prediction", batch: int = 1, per_task: bool = False) -> DataFrame:
    """E5: a user generator over a table, called on batches of ``batch`` inputs inside
    ``mapInPandas``. With one input column it gets list[value], with several a list of
    dicts (say prompt_ids, article id, text_tokenized, retrieved); it returns list[str].
    ``per_task``: ``fn`` is a factory, called once per task, that returns the generator."""
    def run(it):
        gen = fn() if per_task else fn
        for pdf in it:
            vals = pdf[inputs].tolist() if isinstance(inputs, str) else pdf[inputs].to_dict("records")
            res: list[str] = []
            for i in range(0, len(vals), batch):
                res.extend(gen(vals[i:i + batch]))
            pdf = pdf.copy()
            pdf[out] = pd.Series(res, index=pdf.index, dtype="object")
            yield pdf

    return df.mapInPandas(run, _ddl(df, out))


def _ddl(df: DataFrame, out: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` string"])

