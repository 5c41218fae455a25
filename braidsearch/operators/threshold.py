"""The convex score ``alpha * dense + (1 - alpha) * sparse`` by the threshold algorithm.

Two sorted lists of each question are read to the same depth: by vector (`dense_topk`) and by terms (`blockmax_topk` over blocks
of `blockmax.VECTOR` weights). A document in neither list scores at most what the ends of both lists give. Of the
documents in a list only those are resolved that may still be among the best: a list that lacks a document bounds its score by
the list's end. Where the k-th best score is above the bound on unseen documents, the answer is
certified. The other questions read deeper lists; what is still open then, such as questions that all documents answer
alike, is answered by `hybrid.convex_topk`.

No step makes a row for each pair of question and matching document: a question brings at most ``2 * depth`` rows.
Sparse scores are at least 0; dense ones may have any sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.functions.vectors import DEFAULT_DIM, dot
from braidsearch.operators.blockmax import SLACK, Postings, blockmax_topk, full_scores
from braidsearch.operators.bm25 import terms_size
from braidsearch.operators.dense import dense_topk
from braidsearch.operators.hybrid import convex_topk
from braidsearch.operators.ranking import ROW_BYTES, broadcast_within, keep_top, top_by_score
from braidsearch.session import materialize

DEPTHS = (32, 256)


def list_ends(questions: DataFrame, dense: DataFrame, sparse: DataFrame, depth: int) -> DataFrame:
    """``query_id, dense_end, sparse_end``: the most that a document below the lists scores by each.

    ``dense_end`` is null where the list holds every document; a document below a short sparse list has no match.
    """
    ends = questions.select("query_id")
    for name, ranked in (("dense_end", dense), ("sparse_end", sparse)):
        last = ranked.filter(F.col("rank") == depth).select("query_id", F.col("score").alias(name))
        ends = ends.join(last, "query_id", "left")
    return ends.withColumn("sparse_end", F.greatest("sparse_end", F.lit(0.0)))


def contenders(dense: DataFrame, sparse: DataFrame, ends: DataFrame, k: int, alpha: float, n: int) -> DataFrame:
    """``query_id, doc_id`` of listed documents that may be among the best ``k``; ``n`` questions are asked."""
    both = dense.select("query_id", "doc_id", F.col("score").alias("dense")).join(
        sparse.select("query_id", "doc_id", F.col("score").alias("sparse")), ["query_id", "doc_id"], "full"
    )
    listed = both.join(broadcast_within(ends, n * ROW_BYTES), "query_id")

    def convex(by_vector, by_terms):
        return alpha * by_vector + (1 - alpha) * by_terms

    most = convex(F.coalesce("dense", "dense_end"), F.coalesce("sparse", "sparse_end"))
    least = convex(F.col("dense"), F.coalesce("sparse", F.lit(0.0)))
    listed = listed.select("query_id", "doc_id", most.alias("most"), least.alias("least"))
    known = keep_top(listed.filter("least is not null"), k, [F.desc("least"), F.col("doc_id")])
    sure = known.filter(F.col("rank") == k).select("query_id", F.col("least").alias("sure"))
    left = listed.join(broadcast_within(sure, n * ROW_BYTES), "query_id", "left")
    # listed scores are rounded
    reach = F.col("sure").isNull() | (F.col("most") + SLACK >= F.col("sure"))
    return left.filter(reach).select("query_id", "doc_id")


def resolved(
    pairs: DataFrame,
    questions: DataFrame,
    q_terms: DataFrame,
    index: DataFrame,
    stored: Postings,
    alpha: float,
    dim: int,
    n: int,
    size: int,
) -> DataFrame:
    """``query_id, doc_id, score`` of the given pairs in full, from the index rows of their documents."""
    weights = stored.weighing.asked(q_terms, stored.model, size)
    sparse = full_scores(pairs, weights, index, stored, size).withColumnRenamed("score", "sparse")
    wording = questions.select("query_id", F.col("embedding").alias("asked"))
    rows = index.select("doc_id", "embedding").join(pairs, "doc_id")
    rows = rows.join(broadcast_within(wording, n * (8 * dim + ROW_BYTES)), "query_id")
    dense = rows.select("query_id", "doc_id", dot(F.col("embedding"), F.col("asked")).alias("dense"))
    scored = dense.join(sparse, ["query_id", "doc_id"], "left")
    score = alpha * F.col("dense") + (1 - alpha) * F.coalesce("sparse", F.lit(0.0))
    return scored.select("query_id", "doc_id", score.alias("score"))


def certified_topk(
    questions: DataFrame,
    q_terms: DataFrame,
    index: DataFrame,
    stored: Postings,
    k: int,
    alpha: float,
    depth: int,
    dim: int,
    n: int,
    size: int,
) -> DataFrame:
    """Ranked list of the best ``k`` that two lists of ``depth`` prove; no row for a question they leave open."""
    if depth < k:
        raise ValueError("lists must be at least as deep as the answer")
    dense = materialize(dense_topk(questions, index, depth, dim, "dot", n), "by-vector")
    sparse = materialize(blockmax_topk(q_terms, index, stored, depth, size), "by-terms")
    ends = materialize(list_ends(questions, dense, sparse, depth), "list-ends")
    pairs = materialize(contenders(dense, sparse, ends, k, alpha, n), "contenders")
    scores = resolved(pairs, questions, q_terms, index, stored, alpha, dim, n, size)
    best = materialize(top_by_score(scores, k), "resolved")
    last = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    unseen = alpha * F.col("dense_end") + (1 - alpha) * F.col("sparse_end")
    # a tie is not enough, an unseen document may have the smaller id
    proof = F.col("dense_end").isNull() | (F.col("kth") > unseen + SLACK)
    proven = ends.join(last, "query_id", "left").filter(proof).select("query_id")
    return best.join(broadcast_within(proven, n * ROW_BYTES), "query_id", "left_semi")


def threshold_topk(
    questions: DataFrame,
    q_terms: DataFrame,
    index: DataFrame,
    stored: Postings,
    k: int = 3,
    alpha: float = 0.5,
    dim: int = DEFAULT_DIM,
    depths: tuple[int, ...] = DEPTHS,
    size: int | None = None,
) -> DataFrame:
    """The list of `hybrid.convex_topk`: best ``k`` by ``alpha * dense + (1 - alpha) * sparse``.

    ``stored`` are blocks of `blockmax.VECTOR` weights, written from ``index``. Questions without terms, or with a vector of
    zeros, tie all documents and are answered by the scan. An empty index gives no rows.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    size = terms_size(q_terms) if size is None else size
    questions = questions.select("query_id", "embedding")
    found = []
    for depth in sorted({max(depth, k) for depth in depths}):
        n = questions.count()
        if not n:
            break
        best = certified_topk(questions, q_terms, index, stored, k, alpha, depth, dim, n, size)
        found.append(materialize(best, "certified"))
        done = broadcast_within(found[-1].select("query_id").distinct(), n * ROW_BYTES)
        questions = materialize(questions.join(done, "query_id", "left_anti"), "open-questions")
        q_terms = q_terms.join(broadcast_within(questions.select("query_id"), n * ROW_BYTES), "query_id", "left_semi")
    n = questions.count()
    if n or not found:
        found.append(convex_topk(questions, q_terms, index, stored.model, k, alpha, dim, n, size))
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked
