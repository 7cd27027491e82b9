"""Readers and writers (A1-A10).

Schemas are declared, never inferred. Input order (``ord``), which the
reference gets from reading files line by line, is rebuilt from the file
metadata: (file path, block start, increasing id within the block) is a total
order equal to the line order.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longdoc.session import scratch_path

ARTICLE_SCHEMA = ("article_id STRING, abstract_text ARRAY<STRING>, article_text ARRAY<STRING>, "
                  "section_names ARRAY<STRING>, sections ARRAY<ARRAY<STRING>>, _corrupt_record STRING")
TITLE_SCHEMA = "id STRING, title STRING"
DOCUMENT_SCHEMA = "text STRING"
RESULT_SCHEMA = ("F1 DOUBLE, `Exact match` DOUBLE, "
                 "ROUGE STRUCT<rouge1: DOUBLE, rouge2: DOUBLE, rougeL: DOUBLE, rougeLsum: DOUBLE>, "
                 "id STRING, truth_output STRING, model_answer STRING, ordinal BIGINT")
SPLITS = ("train", "val", "test")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def input_stamp(spark: SparkSession, *paths: str) -> str:
    """Names, lengths and change times of all files below the paths: part of the key under which
    anything made from them is reused."""
    found = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            found.append(f"{path}|none")
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def file_order() -> Column:
    """Total order of rows equal to their order in the input files."""
    return F.struct(F.col("_metadata.file_path").alias("f"),
                    F.col("_metadata.file_block_start").alias("b"),
                    F.monotonically_increasing_id().alias("i"))


def read_articles(spark: SparkSession, directory: str, splits=SPLITS, fmt: str = "{split}.txt") -> DataFrame:
    """A1: one JSON object per line in ``{split}.txt``; a missing split is
    skipped. Malformed lines are kept with ``_corrupt_record`` set (see
    ``quarantine``)."""
    parts = []
    for s in splits:
        path = f"{directory.rstrip('/')}/{fmt.format(split=s)}"
        if not path_exists(spark, path):
            continue
        df = (spark.read.schema(ARTICLE_SCHEMA)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
              .json(path))
        parts.append(df.select(F.lit(s).alias("split"), "*", file_order().alias("ord")))
    if not parts:
        return spark.createDataFrame([], "split STRING, " + ARTICLE_SCHEMA + ", ord STRUCT<f: STRING, b: BIGINT, i: BIGINT>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """A2: metadata JSON lines, keep (id, title) and the line order."""
    df = spark.read.schema(TITLE_SCHEMA).json(path)
    return df.select("id", "title", file_order().alias("ord"))


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """A3: one JSON document (``{"text": ...}``) per file; the id is the file
    name without extension. For imports: the driver lists a file per document, so large
    collections belong into ``write_documents``' form."""
    df = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(pattern)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("id"), "text",
                     F.col("_metadata.file_path").alias("path"))


def write_documents(df: DataFrame, path: str, id_col: str = "id") -> None:
    """A3 at scale: single documents as JSON lines with their id, many to a file."""
    df.select(F.col(id_col).cast("string").alias("id"), "text").write.mode("overwrite").json(path)


def read_packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of ``write_documents``' files; a corrupt line is an error."""
    return spark.read.schema("id STRING, " + DOCUMENT_SCHEMA).option("mode", "FAILFAST").json(path)


def write_samples(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A4: one output per split (``split=...`` directories)."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A5: prepared samples back, ``split`` from the directory names. JSON lines need the
    schema, and a corrupt line is an error."""
    r = spark.read.format(fmt)
    if schema:
        r = r.schema(schema)
    if fmt == "json":
        if not schema:
            raise ValueError("JSON samples need a schema")
        r = r.option("mode", "FAILFAST")
    return r.load(path)


def import_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5/A9, import mode: the objects of JSON array files (indented or not) with their
    ``ordinal`` (from 0, files by name). A file is read by as many tasks as it has blocks. A corrupt file is an error."""
    from longdoc.sources.json_array import read_array
    return read_array(spark, path, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a table of its own in the shared folder: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, label, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def config_key(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, compute: Callable[[], DataFrame], base: str, config: dict,
                fmt: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """Reuse the table written for this exact config, else compute and
    write it. The path is keyed by a hash of the config (chunk size and all),
    and each split/partition is complete when its job commits (quirk Q5)."""
    path = f"{base.rstrip('/')}/{config_key(config)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        w = compute().write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(path)
    return spark.read.format(fmt).load(path)


def export_first_n(df: DataFrame, n: int, path: str, suffix: str = "", order: list[str] | None = None,
                   fmt: str = "parquet") -> None:
    """The first n samples of each split, written as ``{split}{suffix}``.
    One distributed write partitioned by split into a staging folder, then the
    split folders are renamed (file-system metadata only)."""
    from longdoc.operators.batches import first_n_per_group
    first = first_n_per_group(df, n, "split", order or ["ord"])
    base = path.rstrip("/")
    staging = f"{base}/_staging{suffix}"
    first.write.mode("overwrite").partitionBy("split").format(fmt).save(staging)
    fs, st = _fs(first.sparkSession, staging)
    jvm = first.sparkSession.sparkContext._jvm
    for status in fs.listStatus(st):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("split="):
            target = jvm.org.apache.hadoop.fs.Path(f"{base}/{name[len('split='):]}{suffix}")
            if fs.exists(target):
                fs.delete(target, True)
            fs.rename(status.getPath(), target)
    fs.delete(st, True)


def cap_per_split(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """F8: the first n surviving articles of each split."""
    from longdoc.operators.batches import first_n_per_group
    return first_n_per_group(df, n, "split", order or ["ord"])


def write_results(scores: DataFrame, preds: DataFrame, path: str, order: list[str]) -> None:
    """The score record first (ordinal 0), then the samples (1..n) in the order of the
    ``order`` columns (a total order, say the sample's place in its split, then its id), as
    JSON lines; the ordinal keeps the order across part files."""
    from longdoc.operators.batches import global_rank
    p = global_rank(preds.withColumn("_g", F.lit(0)), ["_g"], order, out="ordinal")
    p = p.select("id", "truth_output", "model_answer", F.col("ordinal").cast("bigint").alias("ordinal"))
    header = scores.select("*", F.lit(0).cast("bigint").alias("ordinal"))
    header.unionByName(p, allowMissingColumns=True).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(score record, samples) of a result set: JSON lines of ``write_results``, or with
    ``array`` a JSON array whose first element is the record (samples without an id get
    their ordinal). The header has neither output nor answer; a corrupt record is an error."""
    if array:
        schema = RESULT_SCHEMA.rsplit(",", 1)[0]
        df = import_array(spark, path, schema)
        df = df.withColumn("id", F.coalesce("id", F.when(F.col("ordinal") > 0, F.col("ordinal").cast("string"))))
        header = F.col("ordinal") == 0
    else:
        df = spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST").json(path)
        header = F.col("ordinal") == 0
    return df.where(header), df.where(~header)


def write_chunk_index(chunks: DataFrame, path: str, n_files: int | None = None,
                      key: str = "article_id", chunk: str = "chunk_no") -> None:
    """A10: chunk vectors clustered by article: range-partitioned on
    (article, chunk) and sorted, so one article's chunks are contiguous and a
    very long article spans several files instead of one; Parquet min/max
    statistics then prune files on an article filter."""
    spark = chunks.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (chunks.repartitionByRange(n, key, chunk).sortWithinPartitions(key, chunk)
     .write.mode("overwrite").parquet(path))


def read_chunk_index(spark: SparkSession, path: str, articles: DataFrame | None = None,
                     key: str = "article_id") -> DataFrame:
    df = spark.read.parquet(path)
    if articles is not None:
        df = df.join(articles.select(key).distinct(), key, "left_semi")
    return df
