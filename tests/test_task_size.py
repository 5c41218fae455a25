"""What one task holds must not grow with the corpus: registered queries on tables of 120 documents."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as registered
from braidsearch.operators import bm25, hybrid, index

# Documents, those meant for a task, and what hashing of ids may make of it; in 4 tasks, as many as the session
# has shuffle partitions, one would hold 30 at least.
DOCS, ROWS, MOST = 120, 4, 14


def written(spark, folder):
    """Tables of `DOCS` documents, each of which shares a word with every question."""
    texts = [f"sea salt {'bread ' * (i % 3)}harbour{i % 11} ship{i}" for i in range(DOCS)]
    docs = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    table = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, table).write.parquet(f"{folder}/documents.parquet")
    asked = [(0, "salt and bread"), (1, "sea harbour3"), (2, "salt ship17 harbour5")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def summed(spark, folder, query, monkeypatch):
    """Rows of a query, and the most documents whose sums one task holds."""
    sums, plain = [], bm25.sparse_scores

    def noted(*args):
        sums.append(plain(*args))
        return sums[-1]

    with monkeypatch.context() as patch:
        for module in (bm25, hybrid):
            patch.setattr(module, "sparse_scores", noted)
        rows = sorted(map(repr, query(spark, folder).collect()))
    held = sums[0].select(F.spark_partition_id().alias("task"), "doc_id").distinct().collect()
    return rows, max(Counter(row.task for row in held).values())


def bounded_sums(spark, folder, query, monkeypatch):
    folder = written(spark, folder)
    whole, _ = summed(spark, folder, query, monkeypatch)
    monkeypatch.setattr(index, "TASK_ROWS", ROWS, raising=False)
    found, most = summed(spark, folder, query, monkeypatch)
    assert found == whole and found
    assert most <= MOST


def test_padded_lists(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.bm25_padded_topk, monkeypatch)


def test_citations(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.citations, monkeypatch)


def test_reranked_prompts(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.rag_rerank_prompt_batch, monkeypatch)


def test_relevance_scores(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.rerank_scores, monkeypatch)


def test_reranked_lists(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.rerank_topn, monkeypatch)


def test_stuffed_prompts(spark, tmp_path, monkeypatch):
    bounded_sums(spark, tmp_path, registered.rag_prompt_stuff, monkeypatch)


def test_rebuilt_collection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_ROWS", ROWS, raising=False)
    rows = registered.ingest_rebuild(spark, written(spark, tmp_path))
    assert rows.count() == DOCS
    # a task writes the rows that it has encoded as one file
    stored = spark.read.parquet(*rows.inputFiles()).groupBy(F.input_file_name()).count()
    assert stored.agg(F.max("count")).first()[0] <= MOST
