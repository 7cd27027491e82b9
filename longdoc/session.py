"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch in sessions of ours: a row is a whole document.
ARROW_BATCH_ROWS = 1024


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "longdoc", conf: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for materialised tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the checkpoint folder set on the context). Where it is
    unset, a local session, whose one process is all its executors, gets a temporary
    folder; on a cluster that is an error, as executors wouldn't see it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        cur = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = cur.get() if cur.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="longdoc-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return os.path.join(shared_dir(spark), "longdoc", *parts)


def ensure_parallelism(df, factor: int = 2):
    """Spread a scan that yields fewer partitions than the cluster has cores
    (e.g. one large Parquet row group, which Spark can't split) before CPU-heavy row-local
    work. On large inputs the scan already has enough splits and nothing is added; the rows
    and results are the same either way."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``longdoc`` importable in the executors' Python workers (the Arrow
    UDFs live in it): zip the package once per application and hand it to
    ``addPyFile``, as ``--py-files`` would."""
    sc = spark.sparkContext
    # A row of an Arrow batch is a whole document here, so the generic bound of 10000 rows
    # is no bound of a worker's memory. Every session of an application that has left it at
    # that default gets ours; results don't depend on it.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import longdoc
    pkg = os.path.dirname(os.path.abspath(longdoc.__file__))
    d = shared_dir(spark)
    local = d[len("file:"):] if d.startswith("file:") else d
    if "://" in local:
        local = tempfile.mkdtemp(prefix="longdoc-pkg-")
    target = os.path.join(local, f"longdoc-{sc.applicationId}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def recommended_conf(input_bytes: int, shared_folder: str, partition_bytes: int = 256 << 20,
                     split_bytes: int = 64 << 20) -> dict:
    """Session settings for a cluster run over ``input_bytes`` of input:
    shuffle partitions of about ``partition_bytes`` each (AQE coalesces small
    ones and splits skewed ones), text-sized input splits (tokenizing is
    CPU-heavy per byte), document-sized Arrow batches, the shared folder for
    checkpoints and materialised tables, and checkpoint cleanup."""
    parts = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_BATCH_ROWS),
        "spark.checkpoint.dir": shared_folder,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
