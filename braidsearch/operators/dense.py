"""Dense retrieval: exact top-k by dot product or squared distance, and bucketed search."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.functions.vectors import DEFAULT_DIM, as_double, lsh_buckets
from braidsearch.operators.ranking import ROW_BYTES, broadcast_within, top_by_score
from braidsearch.operators.scoring import Scoring, topk

# Bits of a bucket number, bits in which a probed bucket may differ, hash tables.
BITS, RADIUS, TABLES = 10, 2, 12


def dense_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    dim: int = DEFAULT_DIM,
    metric: str = "dot",
    n_questions: int | None = None,
) -> DataFrame:
    """Exact best ``k`` of ``(doc_id, embedding)`` per ``(query_id, embedding)``.

    ``metric`` "dot" ranks high products first, "l2" small squared distances first.
    """
    if metric not in ("dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    return topk(questions, vectors, Scoring(k=k, dim=dim, metric=metric), n_questions)


def add_buckets(
    vectors: DataFrame, bits: int = BITS, tables: int = TABLES, dim: int = DEFAULT_DIM
) -> DataFrame:
    """One row for each vector and hash table, with the table's number and the hyperplane bucket."""
    numbered = lsh_buckets(F.col("embedding"), bits, tables, dim)
    return vectors.select("*", F.posexplode(numbered).alias("hash_table", "bucket"))


def write_buckets(
    vectors: DataFrame, path: str, bits: int = BITS, tables: int = TABLES, dim: int = DEFAULT_DIM
) -> None:
    """Store vectors in a folder for each table and bucket; a hot bucket is split over several tasks."""
    rows = add_buckets(vectors, bits, tables, dim).hint("rebalance", "hash_table", "bucket")
    rows.write.partitionBy("hash_table", "bucket").parquet(path)


def probes(
    questions: DataFrame,
    bits: int = BITS,
    tables: int = TABLES,
    dim: int = DEFAULT_DIM,
    radius: int = RADIUS,
) -> DataFrame:
    """``(query_id, embedding, hash_table, bucket)``: buckets at most ``radius`` bits from the question's."""
    flips = [
        F.lit(sum(1 << bit for bit in flipped))
        for distance in range(radius + 1)
        for flipped in combinations(range(bits), distance)
    ]
    flipped = F.array(*flips).cast("array<bigint>")
    near = F.transform(flipped, lambda flip: F.col("own").bitwiseXOR(flip))
    own = add_buckets(questions, bits, tables, dim).withColumnRenamed("bucket", "own")
    return own.select("query_id", "embedding", "hash_table", F.explode(near).alias("bucket"))


def lsh_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    bits: int = BITS,
    tables: int = TABLES,
    dim: int = DEFAULT_DIM,
    radius: int = RADIUS,
    n_questions: int | None = None,
) -> DataFrame:
    """Approximate best ``k`` by dot product: only vectors of near buckets are scored.

    A vector is scored if in one of ``tables`` hash tables its bucket of ``bits`` bits differs from the
    question's in at most ``radius``. More tables and a larger radius find more and score more, more
    bits find and score less. ``vectors`` may be a table from `write_buckets` with the same ``bits``
    and ``tables``; the join then reads only the folders that are probed.
    """
    n_questions = questions.count() if n_questions is None else n_questions
    asked = probes(questions.select("query_id", "embedding"), bits, tables, dim, radius)
    near = sum(1 for d in range(radius + 1) for _ in combinations(range(bits), d))
    asked = asked.withColumnRenamed("embedding", "asked")
    size = n_questions * tables * near * (4 * dim + ROW_BYTES)
    if "bucket" not in vectors.columns:
        vectors = add_buckets(vectors.select("doc_id", "embedding"), bits, tables, dim)
    met = vectors.select("doc_id", "embedding", "hash_table", "bucket").join(
        broadcast_within(asked, size), ["hash_table", "bucket"]
    )
    products = F.zip_with(as_double(F.col("embedding")), as_double(F.col("asked")), lambda a, b: a * b)
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    # a pair that meets in several tables is one
    scored = met.groupBy("query_id", "doc_id").agg(F.max(score).alias("score"))
    return top_by_score(scored, k)
