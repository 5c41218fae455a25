"""Ingest jobs: keyed upsert into a collection, or a full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidsearch.functions.text import Analyzer, analysis_of, simple_tokens
from braidsearch.functions.vectors import DEFAULT_DIM, Embedder
from braidsearch.operators.bm25 import Bm25Model, fit_totals
from braidsearch.sources.collection import Collection
from braidsearch.sources.corpus import write_corpus


def ingest_upsert(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    model_path: str,
    analyzer: Analyzer = simple_tokens,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    buckets: int | None = None,
) -> tuple[Collection, Bm25Model]:
    """Upsert the batch into the collection at ``path``, fit BM25 on it and on all that is stored.

    Equal texts are merged first, so each is analysed and embedded once; their
    number still counts in the statistics. The model of the batch, returned and saved at
    ``model_path``, weighs terms for the convex search. Okapi lists are always of the whole
    collection, so a second model beside it covers that. Both are fitted from maintained counts: no stored row is
    read but those that the batch replaces.
    """
    collection = Collection.create(spark, path, "documents", dim, "dot", buckets)
    collection.upsert(collection.encode(docs, analyzer, embedder))
    analysis = analysis_of(analyzer)
    fit_totals(*collection.term_totals(), whole_model_path(model_path), analysis)
    return collection, fit_totals(*collection.term_totals(last_batch=True), model_path, analysis)


def whole_model_path(model_path: str) -> str:
    """Where the model of the whole collection stands beside that of its last batch."""
    return f"{model_path.rstrip('/')}-whole"


def ingest_rebuild(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    corpus_path: str,
    model_path: str,
    analyzer: Analyzer = simple_tokens,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    buckets: int | None = None,
) -> tuple[Collection, Bm25Model]:
    """Replace the collection at ``path``, write the corpus file, fit and save BM25."""
    collection = Collection.create(spark, path, "documents", dim, "l2", buckets)
    collection.rebuild(collection.encode(docs, analyzer, embedder, merge=False))
    write_corpus(docs, corpus_path)
    analysis = analysis_of(analyzer)
    counted = collection.term_totals()
    fit_totals(*counted, whole_model_path(model_path), analysis)
    return collection, fit_totals(*counted, model_path, analysis)
