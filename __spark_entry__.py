
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.functions import text as tx
from braidsearch.functions import vectors as vx
from braidsearch.operators import blockmax, bm25, context, dense, fusion, rerank, threshold
from braidsearch.operators.index import buckets_for, count_terms, index_rows, postings
from braidsearch.operators.ranking import rounded
from braidsearch.plans import ingest, retrieve
from braidsearch.session import fresh_path, materialize, spread
from braidsearch.sources import corpus, models
from braidsearch.sources.collection import Collection

ENTRY_DIR = "/root/testdata/sf0.001"
EMBEDDING_DIM = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """The document table as ``(doc_id, text, metadata)``.

    ``gaps`` leaves out the title of French and the category of German documents,
    so that default texts are needed.
    """
    title = F.concat("source", F.lit("#"), F.col("doc_id").cast("string"))
    category = F.col("lang")
    if gaps:
        title = F.when(F.col("lang") != "fr", title)
        category = F.when(F.col("lang") != "de", category)
    return corpus.documents(_table(spark, sf_dir, "documents"), title, category)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted terms of every document, without writing an index."""
    return index_rows(spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id"))


def _retriever(
    spark: SparkSession, sf_dir: str, gaps: bool = False, **options
) -> retrieve.Retriever:
    return retrieve.index_documents(_docs(spark, sf_dir, gaps), **options)


def _titled(docs: DataFrame) -> list:
    return [
        F.try_element_at("metadata", F.lit("title")).alias("title"),
        F.try_element_at("metadata", F.lit("category")).alias("category"),
    ]


# --- sources and sinks


def doc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.page_contents(_docs(spark, sf_dir))
    return pages.select("doc_id", "page_content", *_titled(pages))


def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    corpus.write_corpus(_docs(spark, sf_dir), path)
    pages = corpus.read_corpus(spark, path)
    return pages.select("page_content", *_titled(pages)).withColumn(
        "doc_id", F.substring_index("title", "#", -1).cast("bigint")
    )


def bm25_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "model")
    bm25.fit(_rows(spark, sf_dir), path, tx.analysis_of(tx.simple_tokens))
    return models.load_model(spark, path).vocabulary.select("term", "df")


def bm25_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "model-json")
    models.export_json(bm25.fit(_rows(spark, sf_dir)), path)
    return models.import_json(spark, path)[1]


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "collection")
    collection = Collection.create(spark, path, "documents", buckets=buckets_for(docs))
    collection.upsert(collection.encode(docs))
    # the second batch brings the English documents again, with a new category
    category = F.try_element_at("metadata", F.lit("category"))
    again = docs.filter(category == "en").withColumn(
        "metadata", F.create_map(F.lit("category"), F.lit("updated"))
    )
    collection.upsert(collection.encode(again))
    # the third brings new texts under the ids of the French documents
    third = F.create_map(F.lit("category"), F.lit("third"))
    french = docs.filter(category == "fr").withColumn("text", F.concat("text", F.lit(" (new)")))
    collection.upsert(collection.encode(french.withColumn("metadata", third)))
    rows = collection.read()
    return rows.select("content_id", "doc_id", _titled(rows)[1])


def collection_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "collection")
    collection = Collection.create(spark, path, "documents", buckets=buckets_for(docs))
    for _ in range(2):
        collection.rebuild(collection.encode(docs, merge=False))
    return collection.read().select("doc_id", "content_id")


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingest_report(_docs(spark, sf_dir))


def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = fresh_path(spark, "collection"), _docs(spark, sf_dir)
    collection, _ = ingest.ingest_upsert(
        spark, docs, path, f"{path}-model", buckets=buckets_for(docs)
    )
    return _ingested(collection)


def ingest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = fresh_path(spark, "collection"), _docs(spark, sf_dir)
    collection, _ = ingest.ingest_rebuild(
        spark, docs, path, f"{path}-corpus", f"{path}-model", buckets=buckets_for(docs)
    )
    return _ingested(collection)


def ingest_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, then the Okapi list over all that is stored."""
    path, docs = fresh_path(spark, "collection"), _docs(spark, sf_dir)
    first = F.try_element_at("metadata", F.lit("category")).isin("en", "fr")
    buckets = buckets_for(docs)
    for batch in (docs.filter(first), docs.filter(~first)):
        ingest.ingest_upsert(spark, batch, path, f"{path}-model", buckets=buckets)
    retriever = retrieve.open_retriever(spark, path, f"{path}-model")
    return retriever.sparse(retriever.ask(_questions(spark, sf_dir)))


def _ingested(collection: Collection) -> DataFrame:
    return collection.read().select(
        "doc_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


# --- text


def question_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return context.clean_questions(asked.select("conv_id", "turn", F.col("text").alias("question")))


def _words(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")

    def analyzer(text):
        words = tx.word_tokens_by_language(text, F.col("lang"))
        return tx.stemmed(lambda _: words)(text) if stem else words

    counted = postings(count_terms(docs, analyzer))
    return counted.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"))


def tokens_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, stem=False)


def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, stem=True)


def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bm25.doc_freq(_rows(spark, sf_dir))
    return vocabulary.select("term", tx.term_id(F.col("term")).alias("term_id"))


def term_ids_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bm25.doc_freq(_rows(spark, sf_dir))
    return vocabulary.select("term", tx.murmur_term_id("term").alias("term_id"))


def vocab_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bm25.doc_freq(_rows(spark, sf_dir))
    return vocabulary.orderBy(F.desc("df"), "term").limit(10)


# --- corpus statistics


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = postings(_rows(spark, sf_dir))
    return counted.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", "dl")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_freq(_rows(spark, sf_dir))


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_freq(_rows(spark, sf_dir)).agg(F.count("*").alias("n_terms"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = bm25.corpus_stats(_rows(spark, sf_dir))
    return stats.select("n_docs", rounded(F.col("avgdl")).alias("avgdl"))


def bm25_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bm25.fit(_rows(spark, sf_dir))
    return model.vocabulary.agg(
        F.lit(model.n_docs).cast("bigint").alias("n_docs"),
        F.round(F.lit(model.avgdl), 6).alias("avgdl"),
        F.count("*").alias("n_terms"),
        F.sum("df").alias("sum_df"),
    )


def okapi_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bm25.fit(_rows(spark, sf_dir))
    idf = bm25.okapi_idf(model.n_docs, model.mean_idf)
    return model.vocabulary.select("term", rounded(idf).alias("idf"))


def sparse_doc_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_rows(spark, sf_dir), "counted")
    weights = bm25.encode_documents(rows, bm25.fit(rows))
    return weights.select(
        F.col("doc_id").alias("id"), "term", rounded(F.col("weight")).alias("weight")
    )


def sparse_query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bm25.fit(_rows(spark, sf_dir))
    weights = bm25.encode_queries(bm25.question_terms(_questions(spark, sf_dir)), model)
    return weights.select(
        F.col("query_id").alias("id"), "term", rounded(F.col("weight")).alias("weight")
    )


# --- sparse retrieval


def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, dense=False)
    return retriever.sparse(retriever.ask(_questions(spark, sf_dir)))


def bm25_blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of ``bm25_okapi_topk`` from stored blocks of postings."""
    retriever = _retriever(spark, sf_dir, dense=False)
    asked = retriever.ask(_questions(spark, sf_dir))
    stored = blockmax.write_postings(retriever.index, retriever.model)
    return blockmax.blockmax_topk(asked.terms, retriever.index, stored, size=asked.terms_size)


def bm25_padded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, dense=False)
    return retriever.padded(retriever.ask(_questions(spark, sf_dir)))


def bm25_whitespace_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, analyzer=tx.whitespace_tokens, dense=False)
    return retriever.padded(retriever.ask(_questions(spark, sf_dir)))


# --- dense retrieval


def vector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")
    first = F.transform(F.slice(vector, 1, 10), lambda x: tx.score_text(x.cast("double")))
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(vector).cast("bigint").alias("dim"),
        F.array_join(first, ",").alias("first_values"),
        rounded(vx.norm(vector)).alias("norm"),
    )


def _nonzero(embedded: DataFrame) -> DataFrame:
    cells = embedded.select("id", F.posexplode_outer("embedding").alias("bucket", "value"))
    return cells.filter(F.col("value") != 0).select(
        "id",
        F.col("bucket").cast("bigint").alias("bucket"),
        rounded(F.col("value").cast("double")).alias("value"),
    )


def hash_embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    rows = index_rows(docs, embedder=vx.hashed_embedder())
    return _nonzero(rows.select(F.col("doc_id").alias("id"), "embedding"))


def hash_embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_terms(_questions(spark, sf_dir), text="question")
    embedding = vx.hashed_embedder()(F.col("question"), F.col("terms"))
    return _nonzero(counted.select(F.col("query_id").alias("id"), embedding.alias("embedding")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(_table(spark, sf_dir, "embeddings"), "vec_id")
    return table.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _centroids(vectors: DataFrame) -> DataFrame:
    """One question per label: the mean of its vectors, averaged map-side first."""
    cells = vectors.select("label", F.posexplode(vx.as_double(F.col("embedding"))))
    means = cells.groupBy("label", "pos").agg(F.avg("col").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        ordered["mean"].alias("embedding")
    )


def _by_vector(ranked: DataFrame) -> DataFrame:
    return ranked.withColumnRenamed("doc_id", "vec_id")


def dense_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _by_vector(dense.dense_topk(_centroids(vectors), vectors, 5, EMBEDDING_DIM, "dot"))


def dense_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _by_vector(dense.dense_topk(_centroids(vectors), vectors, 5, EMBEDDING_DIM, "l2"))


def dense_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return _by_vector(
        dense.lsh_topk(_centroids(vectors), vectors, 5, dim=EMBEDDING_DIM)
    )


def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    return retriever.dense(retriever.ask(_questions(spark, sf_dir)), metric="dot")


# --- hybrid retrieval, fusion, rerank


def hybrid_convex_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    return retriever.hybrid(retriever.ask(_questions(spark, sf_dir)))


def hybrid_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of ``hybrid_convex_topk`` by the threshold algorithm over sorted lists."""
    retriever = _retriever(spark, sf_dir)
    asked = retriever.ask(_questions(spark, sf_dir))
    stored = blockmax.write_postings(retriever.index, retriever.model, weighing=blockmax.VECTOR)
    return threshold.threshold_topk(
        asked.rows, asked.terms, retriever.index, stored, dim=retriever.dim, size=asked.terms_size
    )


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    return retriever.ensemble(retriever.ask(_questions(spark, sf_dir)))


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    asked = retriever.ask(_questions(spark, sf_dir))
    lists = [retriever.sparse(asked), retriever.dense(asked), retriever.hybrid(asked)]
    bound = (2 * retrieve.DEPTH + retrieve.TOP_K) * asked.count
    return fusion.rrf(lists, [0.5, 0.3, 0.2], retriever.index, bound)


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    asked = retriever.ask(_questions(spark, sf_dir))
    candidates = retriever.with_text(retriever.ensemble(asked), asked, 2 * retrieve.DEPTH)
    return rerank.rerank_scores(candidates).select("query_id", "doc_id", "relevance_score")


def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir)
    kept = retriever.reranked(retriever.ask(_questions(spark, sf_dir)))
    return kept.select("query_id", "doc_id", "relevance_score", "rank")


# --- context, prompts, citations


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, gaps=True)
    asked = retriever.ask(_questions(spark, sf_dir))
    found = retriever.with_text(retriever.hybrid(asked), asked, retrieve.TOP_K)
    return context.context_block(found).select("query_id", "context")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, gaps=True)
    return context.citations(retriever.reranked(retriever.ask(_questions(spark, sf_dir))))


def _prompt_columns(records: DataFrame) -> DataFrame:
    return records.select("query_id", "prompt", "n_sources")


def rag_prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, gaps=True)
    return _prompt_columns(retrieve.hybrid_prompts(retriever, _questions(spark, sf_dir)))


def rag_prompt_stuff(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, gaps=True)
    return _prompt_columns(retrieve.stuffed_prompts(retriever, _questions(spark, sf_dir)))


def rag_rerank_prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = _retriever(spark, sf_dir, gaps=True)
    return _prompt_columns(retrieve.reranked_prompts(retriever, _questions(spark, sf_dir)))


REGISTERED = [
    doc_source, corpus_roundtrip, bm25_model_roundtrip, bm25_model_json, collection_upsert, collection_rebuild,
    ingest_report, ingest_upsert, ingest_rebuild, ingest_two_batches,
    question_clean, tokens_word, tokens_stemmed, term_ids, term_ids_murmur, vocab_top10,
    term_freq, doc_lengths, doc_freq, vocab_size, bm25_stats, bm25_fit, okapi_idf,
    sparse_doc_vector, sparse_query_vector,
    bm25_okapi_topk, bm25_blockmax_topk, bm25_padded_topk, bm25_whitespace_topk,
    vector_profile, hash_embed_docs, hash_embed_queries,
    dense_dot_topk, dense_l2_topk, dense_lsh_topk, dense_text_topk,
    hybrid_convex_topk, hybrid_threshold_topk, rrf_fusion, rrf_weighted, rerank_scores, rerank_topn,
    context_block, citations, rag_prompt_batch, rag_prompt_stuff, rag_rerank_prompt_batch,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: every benchmark question to a finished, cited prompt."""
    return rag_rerank_prompt_batch(spark, ENTRY_DIR)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage and its pipeline, where they are installed."""
    if not importlib.util.find_spec("braidsearch.llm"):
        return {}, {}
    from braidsearch.llm import oracles, queries as registered

    found, sql = registered.queries(), dict(oracles.ORACLES)
    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in REGISTERED} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    import oracles

    return oracles.built() | _training_data()[1]
