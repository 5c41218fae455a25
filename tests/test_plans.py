import numpy as np
import pandas as pd
import pytest
from brute import close, okapi, top
from conftest import ASKED, TEXTS, ranked_rows
from pyspark.sql import functions as F

from braidsearch.functions.vectors import model_embedder
from braidsearch.operators import context, index
from braidsearch.plans import ingest, retrieve
from braidsearch.schemas import DOCUMENTS, QUESTIONS

PLAIN = [text for text, _, _ in TEXTS]


@pytest.fixture(scope="module")
def retriever(docs):
    return retrieve.index_documents(docs)


@pytest.fixture(scope="module")
def asked(retriever, questions):
    return retriever.ask(questions)


def ids(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_questions_are_cleaned_and_counted(retriever, spark):
    rows = [(0, "  sea salt "), (1, "  "), (2, "sea sea")]
    asked = retriever.ask(spark.createDataFrame(rows, QUESTIONS))
    assert (asked.count, asked.rows.count(), asked.terms.count()) == (2, 2, 3)
    assert asked.text_size == 2 * 64 + len("sea salt") + len("sea sea")
    assert asked.terms_size == 3 * 64 + len("sea") + len("salt") + len("sea")


def test_reranked_is_within_fused_is_within_lists(retriever, asked):
    lists = ids(retriever.padded(asked)) | ids(retriever.dense(asked))
    fused = retriever.ensemble(asked)
    kept = retriever.reranked(asked)
    assert ids(kept) <= ids(fused) <= lists
    assert all(len(entries) <= 10 for entries in ranked_rows(fused).values())
    ranks = kept.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n"))
    assert all(r.m == r.n == 3 for r in ranks.collect())


def test_padded_list_through_the_plan(retriever, asked):
    close(ranked_rows(retriever.padded(asked)), top(okapi(PLAIN, ASKED), 5))


def test_more_rows_asked_than_documents(retriever, asked):
    found = ranked_rows(retriever.hybrid(asked, k=50))
    assert all(len(entries) == len(TEXTS) for entries in found.values())


def test_prompts_for_every_question(retriever, questions):
    for make in (
        retrieve.hybrid_prompts, retrieve.stuffed_prompts, retrieve.reranked_prompts
    ):
        rows = make(retriever, questions).collect()
        assert len(rows) == len(ASKED)
        for row in rows:
            assert row.n_sources == len(row.source_documents) == 3
            assert [s["rank"] for s in row.source_documents] == [1, 2, 3]
            assert ASKED[row.query_id] in row.prompt


def test_records_are_written_whole(spark, retriever, questions, tmp_path):
    records = retrieve.reranked_prompts(retriever, questions)
    records.write.json(str(tmp_path / "json"))
    records.write.parquet(str(tmp_path / "parquet"))
    for back in (
        spark.read.schema(records.schema).json(str(tmp_path / "json")),
        spark.read.parquet(str(tmp_path / "parquet")),
    ):
        assert sorted(back.collect()) == sorted(records.collect())


def test_no_relevant_document_leaves_an_empty_context(retriever, questions):
    rows = retrieve.reranked_prompts(retriever, questions, threshold=0.99).collect()
    assert len(rows) == len(ASKED)
    assert any(r.n_sources == 0 and "Context:\n\n" in r.prompt for r in rows)


def test_ingest_then_ask(spark, docs, questions, tmp_path):
    path, model_path = str(tmp_path / "c"), str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        retrieve.open_retriever(spark, path, model_path)
    ingest.ingest_upsert(spark, docs, path, model_path)
    opened = retrieve.open_retriever(spark, path, model_path)
    built = retrieve.index_documents(docs)

    def prompts(retriever):
        rows = retrieve.hybrid_prompts(retriever, questions).collect()
        return {r.query_id: (r.prompt, r.n_sources) for r in rows}

    assert prompts(opened) == prompts(built)
    # the same batch again changes nothing
    ingest.ingest_upsert(spark, docs, path, model_path)
    assert prompts(retrieve.open_retriever(spark, path, model_path)) == prompts(built)


def scanned_rows(node):
    """Rows read by the scans of a finished plan, by scan name."""
    name, rows = node.nodeName(), {}
    if name.startswith("Scan "):
        rows[name] = node.metrics().apply("numOutputRows").value()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else []
    inner += [node.plan()] if "QueryStage" in name else []
    inner += [node.children().apply(i) for i in range(node.children().size())]
    for child in inner:
        rows.update(scanned_rows(child))
    return rows


def test_answers_read_only_the_buckets_they_need(spark, tmp_path):
    path, model_path = str(tmp_path / "c"), str(tmp_path / "m")
    rows = [(n, f"text number {n}", {}) for n in range(200)]
    ingest.ingest_upsert(
        spark, spark.createDataFrame(rows, DOCUMENTS), path, model_path, buckets=16
    )
    opened = retrieve.open_retriever(spark, path, model_path)
    asked = opened.ask(spark.createDataFrame([(0, "number 77")], QUESTIONS))
    found = opened.with_text(opened.hybrid(asked, 1), asked, 1)
    assert [r.doc_id for r in found.collect()] == [77]
    scans = scanned_rows(found._jdf.queryExecution().executedPlan())
    read = [n for name, n in scans.items() if "braid_" in name]
    assert len(read) == 1 and 0 < read[0] < 40


def test_upsert_counts_copies_in_its_model(spark, tmp_path):
    rows = [(1, "sea salt", {}), (2, "sea salt", {}), (3, "bread", {})]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    collection, model = ingest.ingest_upsert(
        spark, docs, str(tmp_path / "c"), str(tmp_path / "m")
    )
    assert collection.read().count() == 2
    assert (model.n_docs, model.sum_df, model.avgdl) == (3, 5, 5 / 3)


def test_rebuild_then_ask(spark, docs, questions, tmp_path):
    paths = [str(tmp_path / name) for name in ("c", "corpus", "m")]
    for _ in range(2):
        ingest.ingest_rebuild(spark, docs, *paths)
    opened = retrieve.open_retriever(spark, paths[0], paths[2])
    built = retrieve.index_documents(docs)
    asked = opened.ask(questions)
    assert ranked_rows(opened.ensemble(asked)) == ranked_rows(
        built.ensemble(built.ask(questions))
    )


def test_an_id_that_comes_back_gives_each_source_once(spark, tmp_path):
    paths = str(tmp_path / "c"), str(tmp_path / "m")
    for rows in ([(1, "zebra runs"), (2, "zebra sleeps"), (4, "lion")], [(1, "zebra eats"), (3, "zebra drinks")]):
        frame = spark.createDataFrame([(i, t, {}) for i, t in rows], DOCUMENTS)
        ingest.ingest_upsert(spark, frame, *paths)
    opened = retrieve.open_retriever(spark, *paths)
    row = retrieve.hybrid_prompts(opened, spark.createDataFrame([(0, "zebra")], QUESTIONS), 3).first()
    assert row.n_sources == 3 and [s["rank"] for s in row.source_documents] == [1, 2, 3]
    assert "zebra runs" not in row.prompt


def test_a_second_batch_does_not_hide_the_first(spark, tmp_path):
    paths = str(tmp_path / "c"), str(tmp_path / "m")
    for first, texts in ((0, ["zebra runs", "lion", "gnu"]), (3, ["sea", "salt", "ship"])):
        frame = spark.createDataFrame([(first + n, t, {}) for n, t in enumerate(texts)], DOCUMENTS)
        ingest.ingest_upsert(spark, frame, *paths)
    opened = retrieve.open_retriever(spark, *paths)
    assert opened.okapi.n_docs == 6 and opened.model.n_docs == 3
    found = ranked_rows(opened.sparse(opened.ask(spark.createDataFrame([(0, "zebra")], QUESTIONS))))
    assert [d for d, _ in found[0]] == [0]


def test_model_slots(spark, docs, questions):
    def load():
        keys = ["sea", "bread", "ship", "river"]
        return lambda texts: np.array(
            [[float(t.lower().count(k)) for k in keys] for t in texts], dtype=np.float32
        )

    @F.pandas_udf("double")
    def shared_letters(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([len(set(q) & set(t)) / 100 for q, t in zip(question, text)])

    retriever = retrieve.index_documents(docs, embedder=model_embedder(load, 4), dim=4)
    rows = retrieve.reranked_prompts(retriever, questions, 2, shared_letters).collect()
    assert all(r.n_sources == 2 for r in rows)
    asked = retriever.ask(questions)
    near = ranked_rows(retriever.dense(asked, 1, "dot"))
    assert near[1][0][0] in (2, 5)


def test_a_step_can_be_put_between(retriever, questions):
    def upper(found):
        return found.withColumn("text", F.upper("text"))

    asked = retriever.ask(questions)
    found = retriever.with_text(retriever.hybrid(asked), asked, 3).transform(upper)
    records = context.result_records(asked.rows, context.context_block(found))
    assert all(r.prompt.count("Content: ") == 3 for r in records.collect())


def test_partitioning_does_not_change_results(docs, questions):
    def lists(frame):
        retriever = retrieve.index_documents(frame)
        return ranked_rows(retriever.ensemble(retriever.ask(questions.repartition(3))))

    assert lists(docs.coalesce(1)) == lists(docs.repartition(6))


def test_buckets_grow_with_the_documents(spark, monkeypatch):
    rows = [(n, f"sea salt {n}", {}) for n in range(60)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    monkeypatch.setattr(index, "TASK_ROWS", 4)
    # more than the 4 shuffle partitions of the session
    assert index.buckets_for(docs) == 15
    found = retrieve.index_documents(docs, dense=False)
    scored = found.sparse(found.ask(spark.createDataFrame([(0, "salt 7")], QUESTIONS)))
    held = found.index.groupBy(F.spark_partition_id()).count()
    assert scored.count() == 5
    assert len(found.index.inputFiles()) > 8
    assert held.agg(F.sum("count")).first()[0] == 60
    monkeypatch.setattr(index, "TASK_BYTES", 100)
    assert index.buckets_for(docs) > 40


def test_scores_of_two_batches_are_summed_by_document(spark, questions, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_ROWS", 1)
    path = str(tmp_path / "c")
    for batch in (docs.filter("doc_id < 3"), docs.filter("doc_id >= 3")):
        ingest.ingest_upsert(spark, batch, path, path + "-model", buckets=index.buckets_for(docs))
    found = retrieve.open_retriever(spark, path, path + "-model")
    assert found.dealt >= len(TEXTS)
    assert found.by_document.rdd.getNumPartitions() == found.dealt
    close(ranked_rows(found.padded(found.ask(questions))), top(okapi(PLAIN, ASKED), 5))
    alone = retrieve.index_documents(docs)
    assert not alone.dealt and alone.by_document is alone.index
