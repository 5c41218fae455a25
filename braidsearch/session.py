"""Session helpers: a local builder, the shared work folder, and spreading small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORKDIRS: dict[str, str] = {}


def local_session(cores: str | int = "*", app: str = "braidsearch", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="braid-warehouse-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workdir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir`` when it is set.

    Only a master that is one process, as in tests, may fall back to a temporary folder; executors of
    their own, ``local-cluster`` included, would not see it, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_WORKDIRS:
        _LOCAL_WORKDIRS[app] = tempfile.mkdtemp(prefix="braid-work-")
    return _LOCAL_WORKDIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(workdir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def fanout(scan: DataFrame) -> int:
    """Partitions for an explicit repartition of a scanned table.

    As many as the scan has splits, at least one per core, and at most
    ``spark.sql.shuffle.partitions``, the setting by which a cluster is sized.
    """
    spark = scan.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than cores (one small file); leave large scans alone.

    Large inputs already arrive as thousands of splits, and shuffling their whole
    text only to move it would be the most costly step of the job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(fanout(scan), key)
    return scan


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, cuts lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
