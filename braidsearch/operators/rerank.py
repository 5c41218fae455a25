"""Second-stage reranking of few candidates with a scorer that sees both texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsearch.functions.columns import let
from braidsearch.functions.text import simple_tokens
from braidsearch.operators.ranking import ROW_BYTES, broadcast_within, keep_top, rounded

# A scorer maps (question, text) to a double; a pandas_udf over both columns fits as well.
Scorer = Callable[[Column, Column], Column]

# Shares of single words and of adjacent pairs in the default score.
WORD_SHARE, PAIR_SHARE = 0.6, 0.4


def overlap_score(question: Column, text: Column) -> Column:
    """Default scorer in [0, 1]: shared distinct words and shared adjacent word pairs."""

    def adjacent(tokens: Column) -> Column:
        last = F.size(tokens) - 2
        pair = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)),
        )
        return F.when(last >= 0, pair).otherwise(F.array().cast("array<string>"))

    def share(asked: Column, found: Column) -> Column:
        return let(
            F.array_distinct(asked),
            lambda wanted: F.size(F.array_intersect(wanted, found))
            / F.greatest(F.size(wanted), F.lit(1)),
        )

    return let(
        simple_tokens(question),
        lambda q: let(
            simple_tokens(text),
            lambda d: WORD_SHARE * share(q, d) + PAIR_SHARE * share(adjacent(q), adjacent(d)),
        ),
    )


def attach(ranked: DataFrame, table: DataFrame, bound: int) -> DataFrame:
    """Join ranked rows to their documents; ``bound`` is the greatest number of ranked rows."""
    return table.join(broadcast_within(ranked, bound * ROW_BYTES), "doc_id")


def rerank_scores(candidates: DataFrame, scorer: Scorer = overlap_score) -> DataFrame:
    """Add ``relevance_score`` to rows holding ``question`` and ``text``."""
    score = rounded(scorer(F.col("question"), F.col("text")))
    return candidates.withColumn("relevance_score", score)


def rerank(
    candidates: DataFrame,
    scorer: Scorer = overlap_score,
    top_n: int = 3,
    threshold: float = 0.0,
) -> DataFrame:
    """Keep the ``top_n`` candidates per question at or above ``threshold``.

    Candidates hold ``query_id, doc_id, rank, question, text``; the earlier rank
    breaks ties. Other columns are kept, ``rank`` becomes the new one and the score
    is also put into ``metadata`` where there is one.
    """
    scored = rerank_scores(candidates, scorer).withColumnRenamed("rank", "_earlier")
    kept = keep_top(scored, top_n, [F.col("relevance_score").desc(), F.col("_earlier")])
    # low scores are last, so cutting them after ranking leaves no gaps
    kept = kept.filter(F.col("relevance_score") >= threshold).drop("_earlier")
    if "metadata" not in kept.columns:
        return kept
    mark = F.create_map(F.lit("relevance_score"), F.col("relevance_score").cast("string"))
    plain = F.map_filter(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        lambda key, _: key != "relevance_score",
    )
    return kept.withColumn("metadata", F.map_concat(plain, mark))
