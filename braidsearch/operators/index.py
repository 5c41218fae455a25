"""The document index: one row per document holding its counted terms and its vector.

Rows are hash-partitioned by ``doc_id``. Everything a query needs of a document
then sits in one partition: scores are summed, and the best k of each question
are picked, before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.functions.columns import let
from braidsearch.functions.text import Analyzer, content_key, simple_tokens, term_counts
from braidsearch.functions.vectors import Embedder
from braidsearch.operators.ranking import text_bytes
from braidsearch.session import fanout, fresh_path
from braidsearch.sources.tables import write_bucketed

# Documents that a task holds at most, and bytes of their texts: sums by question and document, the sort
# before a write and what is sent to Python grow with them.
TASK_ROWS, TASK_BYTES = 4096, 8 << 20


def count_terms(
    df: DataFrame, analyzer: Analyzer = simple_tokens, text: str = "text"
) -> DataFrame:
    """Add ``dl`` (length after analysis) and ``terms`` (``array<struct<term, tf>>``), row by row."""
    counted = let(
        analyzer(F.col(text)),
        lambda tokens: F.struct(
            F.size(tokens).cast("bigint").alias("dl"), term_counts(tokens).alias("terms")
        ),
    )
    return df.withColumn("_counted", counted).select(*df.columns, "_counted.*")


def count_and_embed(df: DataFrame, analyzer: Analyzer, embedder: Embedder, text: str = "text") -> DataFrame:
    """`count_terms` and the vector of every row.

    An embedder that looks at terms only (``of_tokens``) counts them too, so tokens go to Python once; the rows are
    the same.
    """
    of_tokens = getattr(embedder, "of_tokens", None)
    if of_tokens is None:
        return count_terms(df, analyzer, text).withColumn("embedding", embedder(F.col(text), F.col("terms")))
    counted = df.withColumn("_counted", of_tokens(analyzer(F.col(text))))
    return counted.select(*df.columns, "_counted.*")


def index_rows(
    docs: DataFrame, analyzer: Analyzer = simple_tokens, embedder: Embedder | None = None
) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, content_id, dl, terms[, embedding])``; no shuffle."""
    counted = count_terms(docs.select("doc_id", "text"), analyzer)
    columns = [F.col("doc_id"), content_key(F.col("text")).alias("content_id"), "dl", "terms"]
    if embedder is not None:
        columns.append(embedder(F.col("text"), F.col("terms")).alias("embedding"))
    return counted.select(*columns)


def places_for(spark: SparkSession, rows: int, size: int) -> int:
    """Tasks (or buckets) that hold `TASK_ROWS` and `TASK_BYTES` of ``rows`` documents of ``size`` bytes each.

    They grow with the documents, so that a task does not; Spark allows no more buckets than its setting says.
    """
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(1, -(-rows // TASK_ROWS), -(-size // TASK_BYTES)))


def buckets_for(docs: DataFrame) -> int:
    """Buckets of an index of ``docs``: those of `fanout`, more where a bucket would hold too much for a task."""
    rows, size = docs.agg(F.count("*"), text_bytes(F.coalesce("text", F.lit("")))).first()
    return max(fanout(docs), places_for(docs.sparkSession, rows, size))


def build_index(
    docs: DataFrame,
    analyzer: Analyzer = simple_tokens,
    embedder: Embedder | None = None,
    path: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Write the index as a table bucketed by ``doc_id`` and return it.

    The one shuffle moves the text to its bucket first, so that analysis already
    runs in as many tasks as there are buckets.
    """
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs)
    placed = docs.select("doc_id", "text").repartition(buckets, "doc_id")
    rows = index_rows(placed, analyzer, embedder)
    return write_bucketed(rows, path or fresh_path(spark, "index"), "doc_id", buckets)


def postings(index: DataFrame) -> DataFrame:
    """The index in long form: ``(doc_id, dl, term, tf)``."""
    return unfold_terms(index, "doc_id", "dl")


def unfold_terms(counted: DataFrame, *keep: str | Column) -> DataFrame:
    """One row ``(*keep, term, tf)`` per entry of ``terms``.

    The outer form on purpose: for the inner one Spark infers a filter on
    ``size(terms)`` and moves it below, where the text is analysed once more.
    """
    unfolded = counted.select(*keep, F.inline_outer("terms"))
    return unfolded.filter(F.col("term").isNotNull())
