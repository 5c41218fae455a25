"""Searches by terms, and by terms and vector together.

Sparse scores are a join of postings with the asked terms and a sum by question and document.
In an index bucketed by ``doc_id`` neither the postings nor the sums are shuffled, and Catalyst
keeps the best k of each task before the ranking, so only those travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidsearch.functions.vectors import DEFAULT_DIM
from braidsearch.operators.bm25 import (
    Bm25Model,
    encode_queries,
    okapi_scores,
    sparse_scores,
    terms_size,
    vector_weight,
    weigh_terms,
)
from braidsearch.operators.ranking import keep_top, top_by_score
from braidsearch.operators.scoring import Scoring, topk
from braidsearch.session import materialize

# Ids in a cell of the running order of all ids.
CELL_IDS = 1024


def okapi_topk(
    questions: DataFrame,
    q_terms: DataFrame,
    index: DataFrame,
    model: Bm25Model,
    k: int = 5,
    pad: bool = True,
    size: int | None = None,
) -> DataFrame:
    """Best ``k`` documents of each question by Okapi BM25.

    With ``pad`` the list always has ``k`` rows while there are documents: those
    without a match score 0. Without it only matching documents are listed.
    """
    scores = okapi_scores(q_terms, index, model, size)
    found = top_by_score(scores, k)
    if not pad:
        return found
    padding = _unmatched(questions.select("query_id"), scores, index, model, k)
    return top_by_score(found.select("query_id", "doc_id", "score").unionByName(padding), k)


def _unmatched(
    questions: DataFrame, scores: DataFrame, index: DataFrame, model: Bm25Model, k: int
) -> DataFrame:
    """``(query_id, doc_id, 0.0)`` for documents without a match, at least those a list can need.

    A list needs padding only if fewer than ``k`` documents score above 0; then among the ``2 * k``
    smallest ids at least ``k`` score 0 or are not matched. Where common terms count against a document
    (negative mean idf), matched ones may lie below all others; then the gaps between them are searched.
    """
    matched = scores.select("query_id", "doc_id")
    if model.mean_idf < 0:
        return first_unmatched(questions, matched, index, k).withColumn("score", F.lit(0.0))
    ids = [row.doc_id for row in index.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    listed = F.explode(F.array(*map(F.lit, ids)).cast("array<bigint>"))
    pairs = questions.select("query_id", listed.alias("doc_id"))
    free = pairs.join(matched.filter(F.col("doc_id").isin(ids)), ["query_id", "doc_id"], "left_anti")
    return free.withColumn("score", F.lit(0.0))


def id_cells(index: DataFrame, size: int) -> DataFrame:
    """``doc_id, cell, room``: the ids in running order, cut into cells ``0, 1, …`` of ``size`` ids.

    ``room`` is the number of ids in the cell; only the last holds fewer than ``size``. A range sort gives the order
    within partitions; a row for each partition tells how many ids come before it.
    """
    ordered = index.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # written, so that the numbers are given once
    numbered = materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "id-order")
    rows = 1 << 33  # the function counts rows from a multiple of this in each partition
    placed = numbered.select(
        "doc_id", F.floor(F.col("number") / rows).alias("part"), (F.col("number") % rows).alias("place")
    )
    by_part = placed.groupBy("part").agg(F.count("*").alias("n"))
    in_order = Window.orderBy("part")
    earlier = by_part.select(
        "part",
        (F.sum("n").over(in_order) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    cell = F.floor((F.col("before") + F.col("place")) / size)
    cells = placed.join(F.broadcast(earlier), "part").withColumn("cell", cell)
    return cells.select("doc_id", "cell", F.least(F.lit(size), F.col("total") - cell * size).alias("room"))


def first_unmatched(
    questions: DataFrame, matched: DataFrame, index: DataFrame, k: int, size: int = CELL_IDS
) -> DataFrame:
    """``(query_id, doc_id)``: the ``k`` smallest ids of ``index`` that a question is not matched with.

    ``matched`` holds distinct ``(query_id, doc_id)``. Matches are counted by question and cell of the running order, so
    what is walked along are counts. The cells of a question are full up to the first that no match falls in;
    of those before it only such as have free ids, until there are ``k``, are looked into: at most ``k`` cells and
    the untouched one.
    """
    size = max(size, k)
    cells = materialize(id_cells(index, size), "id-cells")
    held = matched.join(cells, "doc_id").groupBy("query_id", "cell").agg(
        (F.first("room") - F.count("*")).alias("free")
    )
    along = Window.partitionBy("query_id").orderBy("cell")
    walked = held.select(
        "query_id",
        "cell",
        "free",
        (F.row_number().over(along) - 1).alias("nth"),
        (F.sum("free").over(along) - F.col("free")).alias("before"),
    )
    # without a gap so far, the n-th cell with matches is the n-th of all
    touched = materialize(walked.filter(F.col("cell") == F.col("nth")), "touched-cells")
    some = touched.filter((F.col("before") < k) & (F.col("free") > 0)).select("query_id", "cell")
    ends = touched.groupBy("query_id").agg((F.max("cell") + 1).alias("cell"), F.sum("free").alias("free"))
    untouched = questions.select("query_id").join(ends, "query_id", "left")
    untouched = untouched.filter(F.coalesce("free", F.lit(0)) < k)
    wanted = some.unionByName(untouched.select("query_id", F.coalesce("cell", F.lit(0)).alias("cell")))
    free = wanted.join(cells, "cell").join(matched, ["query_id", "doc_id"], "left_anti")
    return keep_top(free.select("query_id", "doc_id"), k, [F.col("doc_id")]).drop("rank")


def convex_topk(
    questions: DataFrame,
    q_terms: DataFrame,
    index: DataFrame,
    model: Bm25Model,
    k: int = 3,
    alpha: float = 0.5,
    dim: int = DEFAULT_DIM,
    n_questions: int | None = None,
    size: int | None = None,
) -> DataFrame:
    """Best ``k`` by ``alpha * dense + (1 - alpha) * sparse``.

    ``questions`` holds ``(query_id, embedding)``, ``q_terms`` their terms. Sparse scores are summed
    first and join the rows of their documents; every document has a dense score.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    size = terms_size(q_terms) if size is None else size
    weights = weigh_terms(index, vector_weight(model, F.col("tf")))
    scores = sparse_scores(weights, encode_queries(q_terms, model, size), size)
    # a document has at most one score for each question
    packed = scores.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "score")).alias("matches"))
    none = F.array().cast("array<struct<query_id:bigint,score:double>>")
    rows = index.select("doc_id", "embedding").join(packed, "doc_id", "left")
    rows = rows.withColumn("matches", F.coalesce("matches", none))
    scoring = Scoring(k=k, dim=dim, metric="dot", alpha=alpha, matches=True)
    return topk(questions, rows, scoring, n_questions)
