"""Answering a whole table of questions: retrieve, fuse, rerank, write the prompts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.functions.text import Analyzer, analysis_of, simple_tokens
from braidsearch.functions.vectors import DEFAULT_DIM, Embedder, hashed_embedder
from braidsearch.operators import context, fusion, hybrid
from braidsearch.operators.bm25 import Bm25Model, fit
from braidsearch.operators.dense import dense_topk
from braidsearch.operators.index import build_index, count_terms, places_for, unfold_terms
from braidsearch.operators.ranking import ROW_BYTES, broadcast_within, text_bytes
from braidsearch.operators.rerank import Scorer, attach, overlap_score, rerank
from braidsearch.plans.ingest import whole_model_path
from braidsearch.session import materialize
from braidsearch.sources.collection import Collection
from braidsearch.sources.models import load_model

# List depth and weights of the ensemble, sources per answer.
DEPTH = 5
WEIGHTS = (0.5, 0.5)
TOP_K = 3


@dataclass(frozen=True)
class Questions:
    """A question table with its terms and vectors, and the sizes that allow a broadcast."""

    rows: DataFrame
    count: int
    text_size: int
    terms_size: int

    @property
    def terms(self) -> DataFrame:
        return unfold_terms(self.rows, "query_id").withColumnRenamed("tf", "qtf")


@dataclass(frozen=True)
class Retriever:
    """An index with its model, and the documents whose text and metadata answers need.

    ``index`` has ``doc_id, content_id, dl, terms`` and, for the searches that use
    vectors, ``embedding``; ``docs`` has ``doc_id, text, metadata``. ``model`` weighs terms for the convex
    search, ``okapi`` (default: the same) scores the sparse lists and covers all of ``index``. Up to
    ``named_ids`` ranked documents are named in a filter, so that of a table bucketed by ``doc_id``
    only their buckets are read; more are joined. 0 for tables without buckets. An ``index`` that is not bucketed
    by ``doc_id`` is dealt by it to ``dealt`` tasks where scores are summed.
    """

    index: DataFrame
    docs: DataFrame
    model: Bm25Model
    analyzer: Analyzer = simple_tokens
    embedder: Embedder | None = None
    dim: int = DEFAULT_DIM
    metric: str = "l2"
    okapi: Bm25Model | None = None
    named_ids: int = 0
    dealt: int = 0

    @property
    def by_document(self) -> DataFrame:
        return self.index.repartition(self.dealt, "doc_id") if self.dealt else self.index

    def embed(self) -> Embedder:
        return self.embedder or hashed_embedder(self.dim)

    def ask(self, questions: DataFrame) -> Questions:
        """Clean, analyse and embed ``(query_id, question)``, once for every later use."""
        asked = context.clean_questions(questions).select("query_id", "question")
        rows = count_terms(asked, self.analyzer, text="question")
        if "embedding" in self.index.columns:
            embedding = self.embed()(F.col("question"), F.col("terms"))
            rows = rows.withColumn("embedding", embedding)
        rows = materialize(rows, "questions")
        per_term = F.transform("terms", lambda t: F.octet_length(t["term"]) + ROW_BYTES)
        terms_size = F.sum(F.aggregate(per_term, F.lit(0), lambda total, n: total + n))
        sizes = rows.agg(
            F.count("*"), text_bytes(F.col("question")), F.coalesce(terms_size, F.lit(0))
        )
        return Questions(rows, *sizes.first())

    def sparse(self, asked: Questions, k: int = DEPTH) -> DataFrame:
        return self._okapi(asked, k, pad=False)

    def padded(self, asked: Questions, k: int = DEPTH) -> DataFrame:
        return self._okapi(asked, k, pad=True)

    def _okapi(self, asked: Questions, k: int, pad: bool) -> DataFrame:
        model = self.okapi or self.model
        return hybrid.okapi_topk(
            asked.rows, asked.terms, self.by_document, model, k, pad, asked.terms_size
        )

    def dense(self, asked: Questions, k: int = DEPTH, metric: str | None = None) -> DataFrame:
        """Exact list by ``metric``, by default that of the collection."""
        metric = metric or self.metric
        return dense_topk(asked.rows, self.index, k, self.dim, metric, asked.count)

    def hybrid(self, asked: Questions, k: int = TOP_K, alpha: float = 0.5) -> DataFrame:
        return hybrid.convex_topk(
            asked.rows,
            asked.terms,
            self.by_document,
            self.model,
            k,
            alpha,
            self.dim,
            asked.count,
            asked.terms_size,
        )

    def ensemble(
        self, asked: Questions, depth: int = DEPTH, weights: Sequence[float] = WEIGHTS
    ) -> DataFrame:
        """Sparse and dense lists of ``depth``, fused; at most ``2 * depth`` per question."""
        lists = [self.padded(asked, depth), self.dense(asked, depth)]
        return fusion.rrf(lists, weights, self.index, 2 * depth * asked.count)

    def with_text(self, ranked: DataFrame, asked: Questions, per_question: int) -> DataFrame:
        """Ranked rows with text, metadata and question; documents are read only now.

        From a bucketed table only the buckets of the ranked documents are read, as
        long as these are few enough to be named in the filter. The rows are spread by
        question: a scorer gets even work, and ranking or grouping by question follows
        without another shuffle.
        """
        docs, bound = self.docs, per_question * asked.count
        if bound <= self.named_ids:
            ranked = materialize(ranked, "ranked")
            named = ranked.select("doc_id").distinct().collect()
            docs = docs.filter(F.col("doc_id").isin([row.doc_id for row in named]))
        texts = attach(ranked, docs, bound).repartition(self._spread(asked), "query_id")
        wording = broadcast_within(asked.rows.select("query_id", "question"), asked.text_size)
        return texts.join(wording, "query_id")

    def _spread(self, asked: Questions) -> int:
        most = int(self.index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(most, asked.count))

    def reranked(
        self,
        asked: Questions,
        top_n: int = TOP_K,
        scorer: Scorer = overlap_score,
        threshold: float = 0.0,
    ) -> DataFrame:
        """Ensemble candidates, read jointly with the question, best ``top_n`` kept."""
        candidates = self.with_text(self.ensemble(asked), asked, 2 * DEPTH)
        return rerank(candidates, scorer, top_n, threshold)


def index_documents(
    docs: DataFrame,
    analyzer: Analyzer = simple_tokens,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    dense: bool = True,
) -> Retriever:
    """Index ``(doc_id, text, metadata)`` and fit BM25 on it."""
    embed = (embedder or hashed_embedder(dim)) if dense else None
    index = build_index(docs, analyzer, embed)
    model = fit(index, analysis=analysis_of(analyzer))
    return Retriever(index, docs, model, analyzer, embedder, dim)


def open_retriever(
    spark: SparkSession,
    path: str,
    model_path: str,
    analyzer: Analyzer = simple_tokens,
    embedder: Embedder | None = None,
    named_ids: int = 5000,
) -> Retriever:
    """A retriever over an ingested collection and its saved models; fails if one is missing.

    The analyzer must be the one the collection was ingested with, as far as both state what they do.
    """
    collection = Collection.open(spark, path)
    rows = collection.read()
    model = load_model(spark, model_path)
    if not model.analysis.agrees(analysis_of(analyzer)):
        raise ValueError(f"the model was fitted with {model.analysis}, not {analysis_of(analyzer)}")
    whole = load_model(spark, whole_model_path(model_path))
    docs = rows.select("doc_id", "text", "metadata")
    # rows of several batches are not bucketed; without a shuffle by document every pair of question and document is shuffled
    dealt = 0 if collection.gathered() else places_for(spark, whole.n_docs, whole.sum_df * ROW_BYTES)
    return Retriever(
        rows, docs, model, analyzer, embedder, collection.dim, collection.metric, whole, named_ids, dealt
    )


def hybrid_prompts(
    retriever: Retriever, questions: DataFrame, top_k: int = TOP_K, template: str = context.PROMPT
) -> DataFrame:
    """Convex hybrid search to finished prompts, one record per question."""
    asked = retriever.ask(questions)
    found = retriever.with_text(retriever.hybrid(asked, top_k), asked, top_k)
    return context.result_records(asked.rows, context.context_block(found, "score"), template)


def stuffed_prompts(retriever: Retriever, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Convex hybrid search to short prompts whose context is the bare texts."""
    asked = retriever.ask(questions)
    found = retriever.with_text(retriever.hybrid(asked, top_k), asked, top_k)
    return context.result_records(
        asked.rows, context.stuffed_context(found, "score"), context.SHORT_PROMPT
    )


def reranked_prompts(
    retriever: Retriever,
    questions: DataFrame,
    top_k: int = TOP_K,
    scorer: Scorer = overlap_score,
    threshold: float = 0.0,
) -> DataFrame:
    """Ensemble, rerank, finished prompts: one record per question."""
    asked = retriever.ask(questions)
    found = retriever.reranked(asked, top_k, scorer, threshold)
    contexts = context.context_block(found, "relevance_score")
    return context.result_records(asked.rows, contexts)
