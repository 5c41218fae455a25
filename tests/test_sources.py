import json

import pytest
from conftest import TEXTS
from pyspark.sql import functions as F

from braidsearch.functions.text import analysis_of, simple_tokens, stemmed, words_without
from braidsearch.operators import bm25
from braidsearch.operators.index import build_index
from braidsearch.plans import ingest, retrieve
from braidsearch.schemas import DOCUMENTS
from braidsearch.session import fresh_path, materialize, spread, workdir
from braidsearch.sources import collection as sources
from braidsearch.sources import corpus, models
from braidsearch.sources.collection import Collection, latest_by_content
from braidsearch.sources.tables import drop_path


def batch(spark, rows):
    return spark.createDataFrame([(i, t, {"v": v}) for i, t, v in rows], DOCUMENTS)


def state(collection):
    rows = collection.read().select("doc_id", "text", "metadata").collect()
    return sorted((r.doc_id, r.text, r.metadata["v"]) for r in rows)


def test_documents_from_any_table(spark):
    table = spark.createDataFrame([(1, "x", None, "c")], "k long, body string, t string, c string")
    row = corpus.documents(table, F.col("t"), F.col("c"), "k", "body").first()
    assert (row.doc_id, row.text, row.metadata) == (1, "x", {"category": "c"})


def test_corpus_roundtrip(spark, edge_docs, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.write_corpus(edge_docs, path)
    texts = sorted(r.page_content for r in corpus.read_corpus(spark, path).collect())
    assert texts == sorted(r.text for r in edge_docs.collect())


def test_corpus_from_a_json_array(spark, tmp_path):
    path = tmp_path / "corpus.json"
    rows = [{"page_content": "Zürich\nline", "metadata": {"title": "T"}}, {"page_content": "b"}]
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    found = corpus.read_corpus(spark, str(path), array_file=True).collect()
    assert [(r.page_content, r.metadata) for r in found] == [
        ("Zürich\nline", {"title": "T"}), ("b", None),
    ]


def test_ingest_report(edge_docs):
    row = corpus.ingest_report(edge_docs).first()
    assert (row.n_ingested, row.n_distinct_content) == (9, 8)
    assert corpus.ingest_report(edge_docs.filter("false")).first().n_ingested == 0


def test_latest_by_content(spark):
    rows = batch(spark, [(1, "a", "1"), (2, "a", "2"), (3, "b", "3")])
    found = {r.doc_id: r.copies for r in latest_by_content(rows).collect()}
    assert found == {2: 2, 3: 1}
    given = rows.withColumn("seq", -F.col("doc_id"))
    assert sorted(r.doc_id for r in latest_by_content(given).collect()) == [1, 3]


def test_upsert(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
    with pytest.raises(FileNotFoundError, match="ingestion"):
        collection.read()
    first = batch(spark, [(1, "a", "old"), (2, "b", "old"), (3, "a", "newer")])
    collection.upsert(collection.encode(first))
    assert state(collection) == [(2, "b", "old"), (3, "a", "newer")]
    collection.upsert(collection.encode(first))
    assert state(collection) == [(2, "b", "old"), (3, "a", "newer")]
    collection.upsert(collection.encode(batch(spark, [(9, "b", "new"), (10, "c", "new")])))
    assert state(collection) == [(3, "a", "newer"), (9, "b", "new"), (10, "c", "new")]
    assert sorted(r.doc_id for r in collection.last_batch().collect()) == [9, 10]
    row = collection.read().filter("doc_id = 10").first()
    assert [(t.term, t.tf) for t in row.terms] == [("c", 1)] and len(row.embedding) == 16


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_upsert_keeps_every_text_and_id_once(spark, tmp_path, limit):
    """The same rows go whether Spark broadcasts the keys or shuffles them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
        for rows in (
            [(5, "alpha sea", "1"), (6, "gamma", "1")], [(5, "beta salt", "2")], [(9, "alpha sea", "3")],
        ):
            collection.upsert(collection.encode(batch(spark, rows)))
        assert state(collection) == [(5, "beta salt", "2"), (6, "gamma", "1"), (9, "alpha sea", "3")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_may_repeat_ids(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
    rows = batch(spark, [(1, "a", "x"), (1, "b", "y"), (2, "a", "z")]).withColumn("seq", F.expr("cast(metadata['v'] as string)"))
    collection.upsert(collection.encode(rows))
    assert state(collection) == [(1, "b", "y"), (2, "a", "z")]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_small_batch_writes_no_stored_row_again(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
    collection.upsert(collection.encode(batch(spark, [(n, f"text {n}", "1") for n in range(200)])))
    stored = files(tmp_path / "c" / "rows")
    collection.upsert(collection.encode(batch(spark, [(7, "text seven", "2")])))
    after = files(tmp_path / "c" / "rows")
    assert stored.items() <= after.items()
    added = spark.read.parquet(str(tmp_path / "c" / "rows" / "v000002"))
    assert added.count() == 1 and collection.read().count() == 200


def test_compact_and_remove_old(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16, buckets=2)
    for n in range(3):
        collection.upsert(collection.encode(batch(spark, [(1, f"text {n}", str(n)), (n + 10, "same", str(n))])))
    wanted = state(collection)
    assert collection.remove_old() == [] and state(collection) == wanted
    collection.compact(buckets=3)
    assert collection.remove_old() == [1, 2, 3] and state(collection) == wanted
    assert sorted(p.name for p in (tmp_path / "c" / "rows").iterdir() if p.is_dir()) == ["v000004"]
    assert collection.remove_old() == []
    plan = collection.read().groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "3 out of 3" in plan or "Exchange" not in plan
    collection.upsert(collection.encode(batch(spark, [(77, "later", "9")])))
    assert len(state(collection)) == len(wanted) + 1


def test_a_damaged_log_is_an_error(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
    (tmp_path / "c" / "log").mkdir()
    (tmp_path / "c" / "log" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|log"):
        collection.version()


def test_rebuild_keeps_copies(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16)
    rows = batch(spark, [(1, "a", "x"), (2, "a", "x")])
    for _ in range(2):
        collection.rebuild(collection.encode(rows, merge=False))
        assert state(collection) == [(1, "a", "x"), (2, "a", "x")]


def test_collection_contract(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError, match="no collection"):
        Collection.open(spark, path)
    created = Collection.create(spark, path, "docs", dim=3)
    assert Collection.create(spark, path, "docs", dim=3) == created
    with pytest.raises(ValueError, match="width 3"):
        Collection.create(spark, path, "docs", dim=4)
    with pytest.raises(ValueError, match="metric"):
        Collection.create(spark, path, "docs", dim=3, metric="l2")


def test_given_vectors_must_have_the_width(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=3)
    rows = batch(spark, [(1, "a", "x")])
    good = rows.withColumn("embedding", F.expr("array(1f, 0f, 0f)"))
    collection.upsert(collection.encode(good))
    assert collection.read().first().embedding == [1.0, 0.0, 0.0]
    bad = rows.withColumn("embedding", F.expr("array(1f, 0f)"))
    with pytest.raises(Exception, match="expected width 3, found 2"):
        collection.rebuild(collection.encode(bad))
    # the failed write is not a version
    assert collection.version() == 1 and collection.read().count() == 1
    collection.rebuild(collection.encode(good))
    assert collection.version() == 2


def test_collection_opens_in_another_session(spark, tmp_path):
    path = str(tmp_path / "c")
    collection = Collection.create(spark, path, "docs", dim=16)
    collection.upsert(collection.encode(batch(spark, [(1, "a", "x"), (2, "b", "y")])))
    wanted = state(collection)
    for table in spark.catalog.listTables():
        if table.name.startswith("braid_"):
            spark.sql(f"DROP TABLE {table.name}")
    reopened = Collection.open(spark, path)
    assert state(reopened) == wanted
    plan = reopened.read().groupBy("doc_id", "content_id").count()
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_model_roundtrip(spark, docs, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError, match="no BM25 model"):
        models.load_model(spark, path)
    fitted = bm25.fit(build_index(docs), path)
    loaded = models.load_model(spark, path)
    for field in ("n_docs", "avgdl", "n_terms", "sum_df", "mean_idf"):
        assert getattr(loaded, field) == getattr(fitted, field)


ENGLISH = stemmed(words_without("en"))


def test_json_exchange(spark, docs, questions, tmp_path):
    fitted = bm25.fit(build_index(docs, ENGLISH), None, analysis_of(ENGLISH))
    path = str(tmp_path / "json")
    models.export_json(fitted, path)
    stats, df = models.import_json(spark, path)
    row = stats.first()
    assert (row.n_docs, row.avgdl, row.k1, row.b) == (6, fitted.avgdl, 1.2, 0.75)
    assert row.lower_case and row.remove_stopwords and row.stem and row.language == "english"
    assert df.count() == fitted.n_terms
    terms = bm25.question_terms(questions, ENGLISH)
    imported = models.imported_model(terms, stats, df)

    def weights(model):
        found = bm25.encode_queries(terms, model).collect()
        return sorted((r.query_id, r.term, round(r.weight, 12)) for r in found)

    assert weights(imported) == weights(fitted)
    assert (imported.n_terms, imported.sum_df) == (fitted.n_terms, fitted.sum_df)
    assert imported.analysis == fitted.analysis


def test_json_of_simple_tokens_claims_no_stemming(spark, docs, tmp_path):
    path = str(tmp_path / "json")
    models.export_json(bm25.fit(build_index(docs), None, analysis_of(simple_tokens)), path)
    row = models.import_json(spark, path)[0].first()
    assert (row.lower_case, row.remove_stopwords, row.stem, row.language) == (True, False, False, None)


def test_a_foreign_object_keeps_its_parameters(spark, questions, tmp_path):
    path = tmp_path / "model.json"
    known = {"indices": [3968454862, 1], "values": [2.0, 1.0]}
    flags = {"lower_case": True, "remove_punctuation": True, "remove_stopwords": True, "stem": True, "language": "english"}
    path.write_text(json.dumps({"avgdl": 4.5, "n_docs": 3, "doc_freq": known, "b": 0.6, "k1": 2.0, **flags}, indent=1))
    stats, df = models.import_json_object(spark, str(path))
    model = models.imported_model(bm25.question_terms(questions), stats, df)
    assert (model.n_docs, model.avgdl, model.k1, model.b, model.n_terms) == (3, 4.5, 2.0, 0.6, 2)
    assert model.analysis.stem and model.analysis.language == "english"


def test_a_model_of_another_analyzer_is_refused(spark, docs, tmp_path):
    path, model_path = str(tmp_path / "c"), str(tmp_path / "m")
    ingest.ingest_upsert(spark, docs, path, model_path, analyzer=ENGLISH)
    with pytest.raises(ValueError, match="fitted with"):
        retrieve.open_retriever(spark, path, model_path)
    assert retrieve.open_retriever(spark, path, model_path, ENGLISH).model.analysis.stem


def test_work_folder(spark):
    assert fresh_path(spark, "x").startswith(workdir(spark))
    frame = spark.range(5).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    assert materialize(frame, "t").count() == 5
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() > 1
    assert spread(spark.range(0, 100, 1, 16), "id").rdd.getNumPartitions() == 16


def test_fixture_has_no_copies():
    assert len({t for t, _, _ in TEXTS}) == len(TEXTS)


@pytest.mark.parametrize("merge", [True, False])
def test_rows_without_id_are_refused(spark, tmp_path, merge):
    rows = [(1, "one", {}), (None, "two", {}), (None, "three", {}), (4, "four", {})]
    read = "doc_id bigint, text string, metadata map<string,string>"  # as files are read
    collection = Collection.create(spark, str(tmp_path / "c"), "c", buckets=2)
    with pytest.raises(Exception, match="without doc_id"):
        collection.upsert(collection.encode(spark.createDataFrame(rows, read), merge=merge))
    assert collection.version() == 0
    collection.upsert(collection.encode(spark.createDataFrame([r for r in rows if r[0]], DOCUMENTS), merge=merge))
    assert collection.read().count() == 2


def counted(totals):
    terms, n_docs = totals
    return sorted(map(tuple, terms.select("term", "df", "count").collect())), n_docs


def recounted(rows):
    return counted((bm25.term_totals(rows), rows.agg(bm25.number_of_docs(rows)).first()[0]))


BATCHES = [
    [(1, "a b b", "1"), (2, "c", "1"), (3, "c", "1"), (4, "only here", "1")],
    [(5, "d a", "2")],  # replaces nothing
    [(1, "a e", "3"), (6, "c", "3")],  # an id, and a text that stood for two documents
    [(1, "f", "4"), (4, "", "4"), (7, "d a", "4")],  # an id again, an emptied text, a text
]


def test_counts_are_maintained_over_batches(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "documents", 8, buckets=2)
    for rows in BATCHES:
        collection.upsert(collection.encode(batch(spark, rows)))
        assert counted(collection.term_totals()) == recounted(collection.read())
        assert counted(collection.term_totals(last_batch=True)) == recounted(collection.last_batch())
    assert "only" not in [term for term, _, _ in counted(collection.term_totals())[0]]
    before = counted(collection.term_totals())
    collection.compact(3)
    assert counted(collection.term_totals()) == before == recounted(collection.read())
    collection.rebuild(collection.encode(batch(spark, BATCHES[0]), merge=False))
    assert counted(collection.term_totals()) == recounted(collection.read())


def test_stored_rows_are_only_read_where_some_are_replaced(spark, tmp_path, monkeypatch):
    collection = Collection.create(spark, str(tmp_path / "c"), "documents", 8, buckets=2)
    collection.upsert(collection.encode(batch(spark, BATCHES[0])))
    log = collection._log()
    opened = []
    real = sources.read_bucketed
    monkeypatch.setattr(sources, "read_bucketed", lambda s, path, *rest: opened.append(path) or real(s, path, *rest))
    collection.upsert(collection.encode(batch(spark, BATCHES[1])))
    assert set(opened) == {collection._folder(2)}
    assert collection._newly_gone(2, log) is None


def test_texts_are_shuffled_once_and_a_bucket_is_a_file(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16, buckets=7)
    rows = batch(spark, [(n, f"text {n % 150}", "1") for n in range(200)]).repartition(5)
    encoded = collection.encode(rows)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [doc_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "ENSURE" in line and "text" in line]
    collection.upsert(encoded)
    collection.upsert(collection.encode(batch(spark, [(n, f"text {n}", "2") for n in range(100, 160)])))
    for version in (1, 2):
        assert len(list((tmp_path / "c" / "rows" / f"v{version:06d}").glob("*.parquet"))) <= 7


def test_replaced_rows_are_found_in_their_buckets(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16, buckets=7)
    collection.upsert(collection.encode(batch(spark, [(n, f"text {n}", "1") for n in range(60)])))
    log = collection._log()
    collection.upsert(collection.encode(batch(spark, [(3, "three", "2"), (70, "text 4", "2"), (5, "text 5", "2")])))
    found = collection._newly_gone(2, log)
    assert sorted(row.doc_id for row in found.collect()) == [3, 4, 5]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [doc_id" in plan
    # what is shuffled does not hold the terms
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Scan parquet" in line and "terms" in line]
    assert shuffled and all("Bucketed: true" in line for line in shuffled)


def test_a_key_that_stands_twice_is_replaced_twice(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "docs", dim=16, buckets=3)
    twice = batch(spark, [(1, "a", "1"), (1, "a", "1"), (1, "b", "1"), (2, "b", "1"), (3, "c", "1")])
    collection.rebuild(collection.encode(twice, merge=False))
    log = collection._log()
    collection.upsert(collection.encode(batch(spark, [(9, "a", "2")])))
    found = collection._newly_gone(2, log).collect()
    assert sorted((row.doc_id, len(row.terms)) for row in found) == [(1, 1), (1, 1)]
    assert counted(collection.term_totals()) == recounted(collection.read())


def test_counts_of_a_collection_that_kept_none(spark, tmp_path):
    collection = Collection.create(spark, str(tmp_path / "c"), "documents", 8, buckets=2)
    collection.upsert(collection.encode(batch(spark, BATCHES[0])))
    for kind in ("batch", "whole"):
        assert drop_path(spark, collection._folder(1, kind))
    assert counted(collection.term_totals()) == recounted(collection.read())
    collection.upsert(collection.encode(batch(spark, BATCHES[2])))
    assert counted(collection.term_totals()) == recounted(collection.read())


def test_models_of_two_batches_equal_refitting(spark, tmp_path):
    path = str(tmp_path / "c")
    for rows in (BATCHES[0], BATCHES[2]):
        collection, model = ingest.ingest_upsert(spark, batch(spark, rows), path, f"{path}-model", dim=8, buckets=2)
    for found, rows in (
        (model, collection.last_batch()),
        (models.load_model(spark, ingest.whole_model_path(f"{path}-model")), collection.read()),
    ):
        again = bm25.fit(rows)
        assert (found.n_docs, found.avgdl, found.n_terms, found.sum_df) == (
            again.n_docs, again.avgdl, again.n_terms, again.sum_df,
        )
        assert sorted(map(tuple, found.vocabulary.collect())) == sorted(map(tuple, again.vocabulary.collect()))
