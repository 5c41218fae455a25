"""Weighted reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.operators.ranking import ROW_BYTES, broadcast_within, keep_top, rounded

# Fixed value: the rank constant of the fusion formula.
RANK_CONSTANT = 60


def candidate_union(lists: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """All lists below each other with their position and weight, in the order given."""
    if len(lists) != len(weights):
        raise ValueError("one weight per list")
    numbered = [
        ranked.select(
            "query_id",
            "doc_id",
            F.col("rank").cast("bigint").alias("rank"),
            F.lit(n).alias("list_no"),
            F.lit(float(weight)).alias("weight"),
        )
        for n, (ranked, weight) in enumerate(zip(lists, weights))
    ]
    return reduce(DataFrame.unionByName, numbered)


def rrf(
    lists: Sequence[DataFrame],
    weights: Sequence[float],
    content: DataFrame,
    bound: int,
    k: int | None = None,
    c: int = RANK_CONSTANT,
) -> DataFrame:
    """Fuse ranked lists into ``(query_id, doc_id, score, rank)``.

    Entries with the same text count as one document: all of them add to its score
    and the first seen (list order, then rank) stands for it. ``content`` maps
    ``doc_id`` to ``content_id``; ``bound`` is the greatest number of list entries.
    """
    entries = broadcast_within(candidate_union(lists, weights), bound * ROW_BYTES)
    keyed = content.select("doc_id", "content_id").join(entries, "doc_id")
    seen = F.struct("list_no", "rank")
    fused = keyed.groupBy("query_id", "content_id").agg(
        F.sum(F.col("weight") / (c + F.col("rank"))).alias("score"),
        F.min_by("doc_id", seen).alias("doc_id"),
        F.min(seen).alias("first_seen"),
    )
    fused = fused.withColumn("score", rounded(F.col("score")))
    order = [F.col("score").desc(), F.col("first_seen")]
    return keep_top(fused, k or bound, order).select("query_id", "doc_id", "score", "rank")
