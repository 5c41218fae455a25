import random

import pytest
from pyspark.sql import functions as F

from braidsearch.functions.vectors import hashed_embedder
from braidsearch.operators import blockmax as bx
from braidsearch.operators import bm25, hybrid, threshold
from braidsearch.operators.index import count_terms, index_rows
from braidsearch.schemas import QUESTIONS
from braidsearch.session import materialize
from tests.conftest import ranked_rows
from tests.test_blockmax import zipf

DIM = 32


def setting(spark, texts, questions):
    embedder = hashed_embedder(DIM)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = materialize(index_rows(docs, embedder=embedder), "index")
    model = bm25.fit(index)
    rows = spark.createDataFrame(list(enumerate(questions)), QUESTIONS)
    counted = count_terms(rows, text="question")
    asked = counted.withColumn("embedding", embedder(F.col("question"), F.col("terms")))
    return index, model, asked, bm25.question_terms(rows)


@pytest.mark.parametrize("alpha,depths", [(0.5, (4, 16)), (0.2, (64,)), (0.0, (8,)), (1.0, (3, 600))])
def test_equals_the_scan(spark, alpha, depths):
    texts, questions = zipf(300, 9)
    index, model, asked, terms = setting(spark, [*texts, ""], [*questions, ""])
    stored = bx.write_postings(index, model, block=8, parts=4, weighing=bx.VECTOR)
    found = threshold.threshold_topk(asked, terms, index, stored, 3, alpha, DIM, depths)
    assert ranked_rows(found) == ranked_rows(hybrid.convex_topk(asked, terms, index, model, 3, alpha, DIM))


def test_lists_certify_and_few_documents_are_resolved(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join(rng.choices(words, k=30)) + " common" for _ in range(400)]
    questions = [" ".join(text.split()[:12]) + " common" for text in texts[:20]]
    index, model, asked, terms = setting(spark, texts, questions)
    stored = bx.write_postings(index, model, block=16, parts=4, weighing=bx.VECTOR)
    size = bm25.terms_size(terms)
    proven = threshold.certified_topk(asked, terms, index, stored, 1, 0.5, 32, DIM, 20, size)
    assert [r.doc_id for r in proven.orderBy("query_id").collect()] == list(range(20))
    dense = threshold.dense_topk(asked, index, 32, DIM, "dot", 20)
    sparse = threshold.blockmax_topk(terms, index, stored, 32, size)
    ends = threshold.list_ends(asked, dense, sparse, 32)
    # every document matches every question by its common word
    assert threshold.contenders(dense, sparse, ends, 1, 0.5, 20).count() < 20 * 20


def test_open_questions_are_left_out(spark):
    index, model, asked, terms = setting(spark, ["a b"] * 50, ["a", "zebra", ""])
    stored = bx.write_postings(index, model, weighing=bx.VECTOR)
    proven = threshold.certified_topk(asked, terms, index, stored, 3, 0.5, 8, DIM, 3, 1000)
    assert proven.count() == 0
    found = ranked_rows(threshold.threshold_topk(asked, terms, index, stored, 3, 0.5, DIM, (8,)))
    assert {q: [d for d, _ in entries] for q, entries in found.items()} == dict.fromkeys(range(3), [0, 1, 2])


def test_few_documents_and_nothing_asked(spark):
    index, model, asked, terms = setting(spark, ["a b", "c"], ["a", "c c"])
    stored = bx.write_postings(index, model, weighing=bx.VECTOR)
    found = ranked_rows(threshold.threshold_topk(asked, terms, index, stored, 3, 0.5, DIM))
    assert found == ranked_rows(hybrid.convex_topk(asked, terms, index, model, 3, 0.5, DIM))
    none = threshold.threshold_topk(asked.limit(0), terms.limit(0), index, stored, 3, 0.5, DIM)
    assert none.collect() == []
    with pytest.raises(ValueError):
        threshold.threshold_topk(asked, terms, index, stored, 3, 1.5, DIM)
