"""Ranking rules shared by every retriever.

Scores are rounded to `SCORE_DIGITS` before they are ranked, ties go to the
smaller id, and ranks start at 1, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCORE_DIGITS = 6

# Bytes that may be broadcast or sent along with a task; larger sides are shuffled.
BROADCAST_BYTES = 128 << 20

# Bytes counted for a row of numbers, or for a row besides its text.
ROW_BYTES = 64


def rounded(score: Column) -> Column:
    # adding zero turns -0.0 into 0.0
    return F.round(score, SCORE_DIGITS) + F.lit(0.0)


def keep_top(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """First ``k`` rows per ``by``; Catalyst limits each partition before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def top_by_score(df: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """``(query_id, doc_id, score)`` to the ranked list ``(query_id, doc_id, score, rank)``."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    scored = df.select("query_id", "doc_id", rounded(F.col("score")).alias("score"))
    return keep_top(scored, k, [score, F.col("doc_id")]).select(
        "query_id", "doc_id", "score", "rank"
    )


def fits_broadcast(size: int) -> bool:
    return size <= BROADCAST_BYTES


def broadcast_within(df: DataFrame, size: int) -> DataFrame:
    """Broadcast ``df`` only if ``size``, a proven bound of its bytes, fits; else leave the
    join to Spark, which shuffles and splits skewed partitions."""
    return F.broadcast(df) if fits_broadcast(size) else df


def text_bytes(text: Column) -> Column:
    """Aggregate: bytes of all rows that hold ``text`` and some numbers."""
    return F.coalesce(F.sum(F.octet_length(text) + ROW_BYTES), F.lit(0))
