"""Incremental reuse (A6): what is made from input files is kept per input file.

``materialize_files`` compares the input's files with the manifest of the last run. New and changed files are computed in one
job and their output is written as one folder each; the output of vanished and changed files is removed; everything else
stays as it is. The manifest is written when all folders are in place, so a run that is cut off is made good by the next.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longdoc.sources.io import _fs, config_key

#: Column by which computed rows name their input file: ``_metadata.file_path`` of the reader.
INPUT_FILE = "input_file"


def input_files(spark: SparkSession, path: str) -> dict[str, str]:
    """{file: length and change time} of all data files below a path (as for Spark's readers, not those that are
    named with a dot or an underscore)."""
    fs, p = _fs(spark, path)
    found: dict[str, str] = {}
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            if not st.getPath().getName().startswith((".", "_")):
                found[st.getPath().toString()] = f"{st.getLen()}-{st.getModificationTime()}"
    return found


def _plain(path: str) -> str:
    """A path without the slashes that name no host (file:///a and file:/a are the same)."""
    scheme, mark, rest = path.partition("://")
    return f"{scheme}:{rest}" if mark and rest.startswith("/") else path


def file_key(path: str) -> str:
    return hashlib.sha1(_plain(path).encode()).hexdigest()[:20]


def _read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {"files": {}, "schema": None}
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Written beside and renamed, so a reader finds the old one or the new one."""
    fs, p = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(beside, p)


def materialize_files(spark: SparkSession, compute: Callable[[list[str]], DataFrame], source: str, base: str, config: dict,
                      fmt: str = "parquet") -> DataFrame:
    """The rows that ``compute`` makes of the files below ``source``; only those of new and changed files are computed.

    ``compute`` gets a list of files and returns rows with the column ``input_file`` (``_metadata.file_path``), each made from
    its own file alone. The result has its other columns. ``config`` keys the folder, as in ``materialize``: another
    configuration shares nothing. An input without files is an error where nothing was made before, as the columns are
    then unknown."""
    root = f"{base.rstrip('/')}/{config_key(config)}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs, _ = _fs(spark, root)
    now = input_files(spark, source)
    manifest = _read_manifest(spark, f"{root}/manifest.json")
    old = manifest["files"]
    todo = sorted(f for f, stamp in now.items() if old.get(f, {}).get("stamp") != stamp)
    gone = [f for f, made in old.items() if now.get(f) != made["stamp"]]
    if not now and not manifest["schema"]:
        raise FileNotFoundError(f"no files below {source}")
    kept = {f: made for f, made in old.items() if f not in gone}
    if todo:
        rows = compute(todo)
        schema = T.StructType([f for f in rows.schema if f.name != INPUT_FILE])
        staging = f"{root}/_staging-{uuid.uuid4().hex}"
        path = F.regexp_replace(INPUT_FILE, "^([A-Za-z0-9]+):///", "$1:/")
        keyed = rows.withColumn("_key", F.substring(F.sha1(path.cast("binary")), 1, 20)).drop(INPUT_FILE)
        keyed.write.partitionBy("_key").format(fmt).save(staging)
        for f in todo:
            key = file_key(jvm_path(f).toUri().toString())  # encoded, as in a reader's metadata
            made = jvm_path(f"{staging}/_key={key}")
            folder = f"{key}-{now[f]}-{uuid.uuid4().hex[:8]}"
            full = fs.exists(made)
            if full:
                fs.mkdirs(jvm_path(f"{root}/data"))
                fs.rename(made, jvm_path(f"{root}/data/{folder}"))
            kept[f] = {"stamp": now[f], "folder": folder if full else None}
        left = [s.getPath().getName() for s in fs.listStatus(jvm_path(staging)) if s.isDirectory()]
        if left:
            raise ValueError(f"rows name other input files than the given ones: {left[:3]}")
        fs.delete(jvm_path(staging), True)
        manifest["schema"] = schema.json()
    if todo or gone:
        _write_manifest(spark, f"{root}/manifest.json", {"files": kept, "schema": manifest["schema"]})
        for f in gone:
            if old[f]["folder"]:
                fs.delete(jvm_path(f"{root}/data/{old[f]['folder']}"), True)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{root}/data/{made['folder']}" for made in kept.values() if made["folder"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(folders)
