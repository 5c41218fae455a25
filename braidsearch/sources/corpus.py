"""Documents and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.schemas import CORPUS_JSON


def documents(
    table: DataFrame, title: Column, category: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Any table with a key and a text as ``(doc_id, text, metadata)``.

    A null title or category leaves its key out of the metadata.
    """
    full = F.create_map(F.lit("title"), title, F.lit("category"), category)
    return table.select(
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        F.map_filter(full, lambda _, value: value.isNotNull()).alias("metadata"),
    )


def page_contents(docs: DataFrame) -> DataFrame:
    """``text`` under its exchange name: ``(doc_id, page_content, metadata)``."""
    return docs.select("doc_id", F.col("text").alias("page_content"), "metadata")


def write_corpus(docs: DataFrame, path: str) -> None:
    """One JSON object ``{page_content, metadata}`` per line, any number of files, UTF-8."""
    docs.select(F.col("text").alias("page_content"), "metadata").write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """``(page_content, metadata)``; ``array_file`` reads a file holding one JSON array."""
    return spark.read.schema(CORPUS_JSON).option("multiLine", array_file).json(path)


def ingest_report(docs: DataFrame) -> DataFrame:
    """How many documents came in, and how many different texts.

    Copies combine map-side, so a text that fills a third of the corpus costs one
    row per task.
    """
    distinct = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))
    return distinct.agg(F.count("*").alias("copies")).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_ingested"),
        F.count("*").alias("n_distinct_content"),
    )
