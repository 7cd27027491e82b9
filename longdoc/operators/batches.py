"""Training-batch export: shuffle, rank, batch, collate, pad, shard, cap
(F1-F8, A7, G10).

Global positions never come from a one-partition window: ``global_rank``
range-partitions a slim projection of the group and order columns and a row number, so a
large split or a repeated key spreads over many tasks, numbers rows inside each sorted
partition and adds the per-partition offsets, a table with at most (#partitions x #part
values) rows. Texts and arrays are not part of it: the rows are written once with
their row numbers, and positions are joined back on these.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longdoc.constants import BATCH_SIZE, EOS, PAD, SEED
from longdoc.functions.arrays import attention_mask as _mask
from longdoc.functions.arrays import pad_left as _pad_left
from longdoc.functions.arrays import pad_right as _pad_right
from longdoc.session import scratch_path

_IDX_MASK = (1 << 33) - 1


def global_rank(df: DataFrame, part: list[str], order: list[Column | str],
                out: str = "pos", n_parts: int | None = None) -> DataFrame:
    """1-based position of each row inside its ``part`` group by ``order``.

    Rows that tie on ``order`` get different positions, in any order among themselves (end
    with a unique key for one order in every run). A null group is a group of its own. ``part``
    should have few values (e.g. the split). The rows are written once to the shared folder,
    each with a number; only the slim table of these columns and the number is shuffled by
    range and checkpointed (which fixes the numbering across retries)."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    keys = [*part, *names]
    keyed = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(name) for c, name in zip(order, names, strict=True)],
                      F.monotonically_increasing_id().alias("_row"))
    path = scratch_path(spark, "rank", uuid.uuid4().hex)
    keyed.write.parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    slim = (keyed.select(*keys, "_row").repartitionByRange(n, *keys, "_row").sortWithinPartitions(*keys, "_row")
            .withColumn("_mid", F.monotonically_increasing_id()))
    slim = slim.checkpoint(eager=True)
    slim = (slim.withColumn("_pid", F.shiftright("_mid", 33))
            .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_IDX_MASK))))
    counts = slim.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    w = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", *part, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    pos = _join_null_safe(slim, offs, ["_pid", *part]).select("_row", (F.col("_off") + F.col("_idx")).alias(out))
    return keyed.join(pos, "_row").drop("_row", *names)


def _join_null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    r = b.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in b.columns if c not in on])
    cond = [a[c].eqNullSafe(r[f"_r_{c}"]) for c in on]
    return a.join(r, cond).drop(*[f"_r_{c}" for c in on])


def shuffle_key(id_col: str, seed: int = SEED) -> Column:
    """md5 of seed || id, portable between engines."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))


def shuffle_seeded(df: DataFrame, id_col: str = "article_id", ord_col: str = "ord",
                   seed: int = SEED, split_col: str = "split") -> DataFrame:
    """train rows in seeded random order, val/test keep their order.
    Adds ``pos`` (1-based within the split)."""
    k1 = F.when(F.col(split_col) == "train", shuffle_key(id_col, seed))
    d = df.withColumn("_k1", k1)
    return global_rank(d, [split_col], ["_k1", ord_col, id_col]).drop("_k1")


def batch_assign(df: DataFrame, size: int | dict = BATCH_SIZE, pos: str = "pos",
                 split_col: str = "split") -> DataFrame:
    """consecutive batches of ``size`` (per split when a dict); last may be short."""
    if isinstance(size, dict):
        s = F.lit(BATCH_SIZE)
        for k, v in size.items():
            s = F.when(F.col(split_col) == k, F.lit(v)).otherwise(s)
    else:
        s = F.lit(size)
    return df.withColumn("batch_no", F.floor((F.col(pos) - 1) / s).cast("bigint"))


def shard_assign(df: DataFrame, world: int, pos: str = "pos") -> DataFrame:
    """disjoint shards, row i of the order goes to shard i mod world."""
    return df.withColumn("shard", F.pmod(F.col(pos) - 1, F.lit(world)).cast("int"))


def write_shards(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("shard").parquet(path)


def first_n_per_group(df: DataFrame, n: int, part: str = "split",
                      order: list[str] | None = None) -> DataFrame:
    """The first n rows of each group by ``order`` (after all filters). Rows that tie on ``order`` for the last
    places are taken in any order.

    Only ``part`` and ``order`` are ranked. They give each group the order columns of its n-th row (one row per group, of
    which there are few), and the rows are filtered by comparing with these: no other row is written or shuffled. Rows
    that tie with an n-th row are ranked among themselves where not all of them fit."""
    if n <= 0:
        return df.limit(0)
    order = order or ["ord"]
    names = [f"_by{i}" for i in range(len(order))]
    exprs = [F.col(c) if isinstance(c, str) else c for c in order]
    slim = df.select(F.col(part).alias("_part"), *[c.alias(name) for c, name in zip(exprs, names, strict=True)])
    ranked = global_rank(slim, ["_part"], list(names), out="_rank").select("_part", F.struct(*names).alias("_key"), "_rank")
    cut = ranked.where(F.col("_rank") == n).select(F.col("_part").alias("_of"), F.col("_key").alias("_cut"))
    tied = (ranked.join(F.broadcast(cut), F.col("_part").eqNullSafe(F.col("_of")) & F.col("_key").eqNullSafe(F.col("_cut")))
            .groupBy("_of").agg(F.first("_cut").alias("_cut"), (F.lit(n + 1) - F.min("_rank")).alias("_fit"), F.count(F.lit(1)).alias("_tied")))
    path = scratch_path(df.sparkSession, "cut", uuid.uuid4().hex)
    tied.write.parquet(path)
    tied = df.sparkSession.read.schema(tied.schema).parquet(path)
    own = df.withColumn("_key", F.struct(*[c.alias(name) for c, name in zip(exprs, names, strict=True)]))
    own = own.join(F.broadcast(tied), F.col(part).eqNullSafe(F.col("_of")), "left")
    same = F.col("_key").eqNullSafe(F.col("_cut"))
    kept = own.where(F.col("_cut").isNull() | (F.col("_key") < F.col("_cut")) | (same & (F.col("_fit") == F.col("_tied"))))
    if tied.where("_fit < _tied").isEmpty():
        return kept.select(*df.columns)
    last = global_rank(own.where(same & (F.col("_fit") < F.col("_tied"))), [part], [F.lit(0)], out="_rank")
    return kept.select(*df.columns).unionByName(last.where(F.col("_rank") <= F.col("_fit")).select(*df.columns))


def _field(c: str):
    return lambda r: r[c]


def _padder(c: str, m: Column, v: int, side: str):
    fn = _pad_left if side == "left" else _pad_right
    return lambda r: fn(r[c], m, v)


def _max_size(c: str) -> Column:
    return F.array_max(F.transform("_rows", lambda r: F.size(r[c])))


def collate(df: DataFrame, batch: list[str], pos: str, pads: dict[str, int],
            keep: list[str] | None = None, side: str = "right",
            mask_of: str | None = None) -> DataFrame:
    """one row per batch; rows in batch order; each array column of
    ``pads`` padded to the batch maximum with its value (``side`` right|left);
    ``mask_of``: add ``attention_mask`` from that column's length before padding.
    A batch holds at most the batch size rows, so the collect is bounded."""
    keep = keep or []
    cols = list(pads) + keep
    g = (df.groupBy(*batch)
         .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *cols))).alias("_rows")))
    sel = [*batch] + [F.transform("_rows", _field(c)).alias(c) for c in keep]
    for c, v in pads.items():
        sel.append(F.transform("_rows", _padder(c, _max_size(c), v, side)).alias(c))
    if mask_of:
        m = _max_size(mask_of)
        sel.append(F.transform("_rows", lambda r: _mask(r[mask_of], m)).alias("attention_mask"))
    return g.select(*sel)


def collate_decoder(df: DataFrame, batch=("split", "batch_no"), pos="pos",
                    keep=("article_id",), pad_value: int = EOS) -> DataFrame:
    """prompt_ids and input_ids padded right with EOS (quirk Q10 kept)."""
    return collate(df, list(batch), pos, {"prompt_ids": pad_value, "input_ids": pad_value}, list(keep))


def _nested_padder(c: str, m: Column, filler: Column):
    return lambda r: F.concat(r[c], F.array_repeat(filler, F.greatest(m - F.size(r[c]), F.lit(0))))


def collate_nested(df: DataFrame, batch, pos, cols: dict, keep=(), pad_value: int = EOS) -> DataFrame:
    """Pad the outer axis of nested arrays (``retrieved``: [n][k][2c],
    ``text_tokenized``: [n][c]); a filler element is all ``pad_value`` with the
    inner shape ``cols[c]`` gives (int: [inner]; (k, inner): [k][inner])."""
    keep = list(keep)
    g = (df.groupBy(*batch)
         .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *cols, *keep))).alias("_rows")))
    sel = [*batch] + [F.transform("_rows", _field(c)).alias(c) for c in keep]
    for c, shape in cols.items():
        if isinstance(shape, tuple):
            filler = F.array_repeat(F.array_repeat(F.lit(pad_value), shape[1]), shape[0])
        else:
            filler = F.array_repeat(F.lit(pad_value), shape)
        sel.append(F.transform("_rows", _nested_padder(c, _max_size(c), filler)).alias(c))
    return g.select(*sel)


def collate_encdec(df: DataFrame, batch=("split", "batch_no"), pos="pos", keep=("article_id",)) -> DataFrame:
    """mask from the unpadded input length; input_ids, labels padded with PAD."""
    return collate(df, list(batch), pos, {"input_ids": PAD, "labels": PAD}, list(keep), mask_of="input_ids")


def collate_all(df: DataFrame, batch=("split", "batch_no"), pos="pos", keep=("article_id",),
                value: int = PAD) -> DataFrame:
    """every array column of the batch padded with PAD."""
    from pyspark.sql.types import ArrayType
    arr = [f.name for f in df.schema.fields
           if isinstance(f.dataType, ArrayType) and f.name not in keep]
    return collate(df, list(batch), pos, {c: value for c in arr}, list(keep))


def flatten_batches(batches: DataFrame, batch: list[str], cols: list[str]) -> DataFrame:
    """Per-batch lists back to one row per element (posexplode of the zip)."""
    z = F.arrays_zip(*[F.col(c) for c in cols])
    return (batches.select(*batch, F.posexplode(z).alias("pos_in_batch", "_z"))
            .select(*batch, "pos_in_batch", *[F.col("_z")[c].alias(c) for c in cols]))


#: H2: collate functions by name, as a flow or its caller picks them.
COLLATE = {"decoder": collate_decoder, "encdec": collate_encdec, "all": collate_all}


def collate_by_name(df: DataFrame, name: str, test_mode: bool = False, batch=("split", "batch_no"), pos: str = "pos",
                    keep=("article_id",), c: int = 64) -> DataFrame:
    """H2: the named collate function; in test mode the samples' ``text_tokenized`` is
    padded along and kept too."""
    if name not in COLLATE:
        raise ValueError(f"unknown collate function {name}; one of {sorted(COLLATE)}")
    out = COLLATE[name](df.drop("text_tokenized", "retrieved") if name == "all" else df, batch, pos, keep)
    if test_mode:
        own = collate_nested(df, list(batch), pos, {"text_tokenized": c})
        out = _join_null_safe(out, own, list(batch))
    return out
