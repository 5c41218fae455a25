import random

import pytest
from brute import close, okapi, simple, sparse_dot, top
from conftest import ASKED, EDGE_TEXTS, TEXTS, document_rows, ranked_rows
from pyspark.sql import functions as F

from braidsearch.functions.text import analysis_of, simple_tokens, whitespace_tokens
from braidsearch.operators import bm25, ranking
from braidsearch.operators.hybrid import first_unmatched, okapi_topk
from braidsearch.operators.index import build_index, index_rows
from braidsearch.schemas import DOCUMENTS, QUESTIONS
from braidsearch.sources import models

PLAIN = [text for text, _, _ in TEXTS]


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs)


@pytest.fixture(scope="module")
def model(index):
    return bm25.fit(index)


@pytest.fixture(scope="module")
def q_terms(questions):
    return bm25.question_terms(questions)


def test_model_scalars(model):
    lengths = [len(simple(t)) for t in PLAIN]
    vocabulary = {t for text in PLAIN for t in simple(text)}
    assert model.n_docs == len(PLAIN)
    assert model.avgdl == sum(lengths) / len(PLAIN)
    assert model.n_terms == len(vocabulary)
    assert model.sum_df == sum(len(set(simple(t))) for t in PLAIN)


def test_empty_documents_count(spark, edge_docs):
    index = build_index(edge_docs)
    assert {r.doc_id: r.dl for r in index.collect()}[0] == 0
    assert bm25.fit(index).n_docs == len(EDGE_TEXTS)


def test_empty_corpus_fails_clearly(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    with pytest.raises(ValueError, match="empty corpus"):
        bm25.fit(build_index(empty))
    assert bm25.corpus_stats(build_index(empty)).first().avgdl is None


def test_corpus_of_empty_texts_scores_nothing(spark, questions):
    index = build_index(spark.createDataFrame([(1, "", {}), (2, "", {})], DOCUMENTS))
    model = bm25.fit(index)
    terms = bm25.question_terms(questions)
    assert bm25.okapi_scores(terms, index, model).count() == 0
    assert okapi_topk(questions, terms, index, model, pad=False).count() == 0
    padded = ranked_rows(okapi_topk(questions, terms, index, model, k=5))
    assert all(entries == [(1, 0.0), (2, 0.0)] for entries in padded.values())


def test_okapi_topk_is_brute_force(questions, index, model, q_terms):
    wanted = top(okapi(PLAIN, ASKED), 3)
    found = ranked_rows(okapi_topk(questions, q_terms, index, model, 3, pad=False))
    matched = {q: [e for e in entries if e[1] != 0] for q, entries in wanted.items()}
    close(found, {q: entries for q, entries in matched.items() if entries})


def test_padded_topk_is_brute_force(questions, index, model, q_terms):
    for k in (1, 3, 50):
        found = ranked_rows(okapi_topk(questions, q_terms, index, model, k))
        close(found, top(okapi(PLAIN, ASKED), k))


def test_negative_mean_idf_ranks_unmatched_first(spark):
    texts = ["sea sea", "sea salt", "sea", "sea", "salt"]
    asked = ["sea"]
    docs = spark.createDataFrame([(n, t, {}) for n, t in enumerate(texts)], DOCUMENTS)
    questions = spark.createDataFrame(list(enumerate(asked)), QUESTIONS)
    index = build_index(docs)
    model = bm25.fit(index)
    assert model.mean_idf < 0
    terms = bm25.question_terms(questions)
    found = ranked_rows(okapi_topk(questions, terms, index, model, k=2))
    close(found, top(okapi(texts, asked), 2))
    assert found[0][0] == (4, 0.0)


def test_negative_mean_idf_of_many_documents(spark):
    """Free ids lie after long runs of matched ones, between them, at both ends, or nowhere."""
    texts = [
        " ".join(
            ["sea"] * (n < 8000 or n % 3 == 0) + ["sun"] * (n >= 1500) + ["salt"] * (n % 1000 != 7) + ["all"]
        )
        for n in range(10000)
    ]
    asked = ["sea", "sun", "salt", "sea sun", "all", "zebra", "salt all"]
    docs = spark.createDataFrame([(n, t, {}) for n, t in enumerate(texts)], DOCUMENTS)
    questions = spark.createDataFrame(list(enumerate(asked)), QUESTIONS)
    index = build_index(docs)
    model = bm25.fit(index)
    assert model.mean_idf < 0
    terms = bm25.question_terms(questions)
    found = ranked_rows(okapi_topk(questions, terms, index, model, k=5))
    close(found, top(okapi(texts, asked), 5))


@pytest.mark.parametrize("size", [1, 4, 64])
def test_first_unmatched_is_brute_force(spark, size):
    rng = random.Random(size)
    ids = sorted(rng.sample(range(-500, 5000), 300))
    taken = {q: {d for n, d in enumerate(ids) if rng.random() < share or n < 70 * q} for q, share in enumerate((0, 0.2, 0.9, 0.99))}
    taken[4], taken[5] = set(ids), set(ids[:-2])
    index = spark.createDataFrame([(d,) for d in ids], "doc_id bigint").repartition(5)
    matched = spark.createDataFrame([(q, d) for q, held in taken.items() for d in held], "query_id bigint, doc_id bigint")
    questions = spark.createDataFrame([(q,) for q in range(7)], "query_id bigint")
    found = first_unmatched(questions, matched, index, 4, size).collect()
    wanted = {(q, d) for q in range(7) for d in [d for d in ids if d not in taken.get(q, ())][:4]}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_floor_of_common_terms(index, model):
    idf = {
        r.term: (r.df, r.idf)
        for r in model.vocabulary.withColumn(
            "idf", bm25.okapi_idf(model.n_docs, model.mean_idf)
        ).collect()
    }
    common = [(df, value) for df, value in idf.values() if df > model.n_docs / 2]
    assert common
    assert all(value == pytest.approx(0.25 * model.mean_idf) for _, value in common)


def test_whitespace_analyzer(spark, docs, questions):
    index = build_index(docs, whitespace_tokens)
    model = bm25.fit(index)
    terms = bm25.question_terms(questions, whitespace_tokens)
    found = ranked_rows(okapi_topk(questions, terms, index, model, k=4))
    close(found, top(okapi(PLAIN, ASKED, tokens=str.split), 4))


def pair_scores(df):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}


def test_pair_scores_are_brute_force(index, model, q_terms):
    found = pair_scores(bm25.okapi_scores(q_terms, index, model))
    wanted = okapi(PLAIN, ASKED)
    assert found
    for (q, d), score in found.items():
        assert score == pytest.approx(wanted[q][d])
    assert all(s == 0 for q in wanted for d, s in wanted[q].items() if (q, d) not in found)


def test_many_questions_are_joined_by_shuffle(monkeypatch, index, model, q_terms):
    wanted = pair_scores(bm25.okapi_scores(q_terms, index, model))
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 2)
    scores = bm25.okapi_scores(q_terms, index, model)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [term" in plan
    assert pair_scores(scores) == wanted


@pytest.mark.parametrize("pad", [True, False])
def test_lists_do_not_depend_on_the_join(monkeypatch, questions, index, model, q_terms, pad):
    wanted = ranked_rows(okapi_topk(questions, q_terms, index, model, 3, pad))
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 2)
    assert ranked_rows(okapi_topk(questions, q_terms, index, model, 3, pad)) == wanted


def test_sparse_lists_run_in_spark_alone(questions, index, model, q_terms):
    found = okapi_topk(questions, q_terms, index, model, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "WindowGroupLimit" in plan


def test_padding_looks_further_where_terms_count_against(spark):
    # every document but the last holds the term, which most documents hold
    texts = ["sea"] * 60 + [""]
    docs = spark.createDataFrame([(n, t, {}) for n, t in enumerate(texts)], DOCUMENTS)
    questions = spark.createDataFrame([(0, "sea")], QUESTIONS)
    index = build_index(docs)
    model = bm25.fit(index)
    assert model.mean_idf < 0
    found = ranked_rows(okapi_topk(questions, bm25.question_terms(questions), index, model, k=2))
    close(found, top(okapi(texts, ["sea"]), 2))
    assert found[0][0] == (60, 0.0)


def test_model_states_how_it_was_made(spark, docs, tmp_path):
    path = str(tmp_path / "model")
    fitted = bm25.fit(build_index(docs), path, analysis_of(simple_tokens), k1=0.9, b=0.4)
    loaded = models.load_model(spark, path)
    assert (loaded.k1, loaded.b, loaded.analysis) == (0.9, 0.4, fitted.analysis)
    assert (loaded.analysis.stem, loaded.analysis.remove_stopwords) == (False, False)
    row = bm25.encode_documents(build_index(docs), loaded).filter("doc_id = 0 and term = 'rivers'").first()
    tokens = simple(PLAIN[0])
    assert row.weight == pytest.approx(1 / (0.9 * (0.6 + 0.4 * len(tokens) / loaded.avgdl) + 1))


def test_fit_shuffles_no_text_and_writes_no_index(docs):
    fitted = bm25.fit(index_rows(docs))
    again = bm25.fit(build_index(docs))
    for field in ("n_docs", "avgdl", "n_terms", "sum_df", "mean_idf"):
        assert getattr(fitted, field) == getattr(again, field)


def test_query_weights_sum_to_one(q_terms, model):
    weights = bm25.encode_queries(q_terms, model)
    sums = weights.groupBy("query_id").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == len(ASKED)
    assert all(r.s == pytest.approx(1.0) for r in sums)
    repeated = [r for r in weights.collect() if r.query_id == 3]
    assert sorted(r.term for r in repeated) == ["in", "rivers", "winter"]


def test_query_weights_do_not_depend_on_the_join(monkeypatch, q_terms, model):
    def rows():
        found = bm25.encode_queries(q_terms, model).collect()
        return sorted((r.query_id, r.term, round(r.weight, 12)) for r in found)

    wanted = rows()
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 1)
    assert rows() == wanted


def test_document_weights(index, model):
    rows = bm25.encode_documents(index, model).collect()
    wanted = {}
    for i, text in enumerate(PLAIN):
        tokens = simple(text)
        norm = 1.2 * (0.25 + 0.75 * len(tokens) / model.avgdl)
        for term in set(tokens):
            tf = tokens.count(term)
            wanted[i, term] = tf / (norm + tf)
    assert {(r.doc_id, r.term) for r in rows} == set(wanted)
    assert all(r.weight == pytest.approx(wanted[r.doc_id, r.term]) for r in rows)


def test_packed_vectors_hold_the_same_weights(index, model):
    packed = bm25.sparse_vectors(index, model).collect()
    plain = bm25.encode_documents(index, model).collect()
    assert sum(len(r.sparse["indices"]) for r in packed) == len(plain)
    for row in packed:
        assert row.sparse["indices"] == sorted(row.sparse["indices"])
        mine = sorted(round(r.weight, 9) for r in plain if r.doc_id == row.doc_id)
        assert sorted(round(v, 9) for v in row.sparse["values"]) == mine


def test_sparse_dot_is_brute_force(index, model, q_terms):
    weights = bm25.encode_queries(q_terms, model)
    doc_weights = bm25.encode_documents(index, model)
    scores = bm25.sparse_scores(doc_weights, weights, size=100).collect()
    wanted = sparse_dot(PLAIN, ASKED)
    assert scores
    for row in scores:
        assert row.score == pytest.approx(wanted[row.query_id][row.doc_id])
    matched = sum(1 for by_doc in wanted.values() for s in by_doc.values() if s > 0)
    assert len(scores) == matched


def test_scores_of_an_index_need_no_shuffle_of_postings(index, model, q_terms):
    doc_weights = bm25.weigh_terms(index, bm25.okapi_weight(model, F.col("tf")))
    small = bm25.okapi_queries(q_terms, model)
    plan = bm25.sparse_scores(doc_weights, small, 100)._jdf.queryExecution().executedPlan()
    before_join = plan.toString().split("BroadcastHashJoin")[0]
    assert "Exchange" not in before_join


def test_copies_count_like_documents(spark):
    rows = [(n, t, {}) for n, t in enumerate(["a b", "a b", "b c"])]
    every = build_index(spark.createDataFrame(rows, DOCUMENTS))
    merged = build_index(spark.createDataFrame([rows[0], rows[2]], DOCUMENTS)).withColumn(
        "copies", F.when(F.col("doc_id") == 0, 2).otherwise(1).cast("bigint")
    )
    a, b = bm25.fit(every), bm25.fit(merged)
    assert (a.n_docs, a.avgdl, a.sum_df, a.mean_idf) == (b.n_docs, b.avgdl, b.sum_df, b.mean_idf)
    assert sorted(a.vocabulary.collect()) == sorted(b.vocabulary.collect())


def test_partitioning_does_not_change_ranks(docs, questions, q_terms):
    def lists(frame, buckets):
        index = build_index(frame, buckets=buckets)
        return ranked_rows(okapi_topk(questions, q_terms, index, bm25.fit(index)))

    assert lists(docs, 1) == lists(docs.repartition(5), 7)


def test_fixture_rows_are_documents(spark):
    assert spark.createDataFrame(document_rows(TEXTS), DOCUMENTS).count() == len(TEXTS)
