"""Parquet tables bucketed by a key, kept at a path of the caller's choice."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _table_name(path: str) -> str:
    return "braid_" + hashlib.md5(path.encode()).hexdigest()[:20]


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, folder: str | None = None
) -> DataFrame:
    """Write ``df`` and return the table, with a folder for each value of column ``folder`` if given.

    Rows already partitioned by ``key`` give one file per bucket (and folder); others are not
    shuffled either, their tasks write a file for each bucket they meet.
    """
    name = _table_name(path)
    writer = df.write.format("parquet").mode("overwrite").bucketBy(buckets, key)
    if folder:
        writer = writer.partitionBy(folder)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(
    spark: SparkSession,
    path: str,
    key: str,
    buckets: int,
    schema: T.StructType | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Open a bucketed table by its path, also in a session that did not write it."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        fields = (schema or spark.read.parquet(path).schema).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {f'PARTITIONED BY ({folder}) ' if folder else ''}"
            f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if folder:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a Parquet table at ``path``, on any file system Spark knows.

    Only a missing path counts as none; a table that is there but cannot be read is an error.
    """
    try:
        spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete the files at ``path`` and the table that was opened on them; whether there were any."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(files.delete(folder, True))
