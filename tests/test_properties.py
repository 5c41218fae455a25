"""Random inputs against plain Python, many rows per job."""

from collections import Counter, defaultdict

import numpy as np
from brute import close, okapi, simple, top
from conftest import ranked_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidsearch.functions import text as tx
from braidsearch.operators import bm25
from braidsearch.operators.fusion import rrf
from braidsearch.operators.hybrid import okapi_topk
from braidsearch.operators.index import build_index
from braidsearch.schemas import DOCUMENTS, QUESTIONS

few = settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
letters = st.text(alphabet="abcDEF 12,.-'\n\téßñ", max_size=60)
words = st.lists(st.sampled_from(["sea", "salt", "ship", "oven", "lamp"]), max_size=8)


@few
@given(st.lists(letters, min_size=20, max_size=60))
def test_tokens_and_counts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    text = F.col("text")
    rows = frame.select(
        "n",
        tx.simple_tokens(text).alias("simple"),
        tx.whitespace_tokens(text).alias("split"),
        tx.term_counts(tx.simple_tokens(text)).alias("counts"),
        tx.trim_whitespace(text).alias("trimmed"),
        tx.snippet(text).alias("snippet"),
    ).collect()
    for row in rows:
        given_text = texts[row.n]
        assert row.simple == simple(given_text)
        assert row.split == given_text.split()
        assert {c.term: c.tf for c in row.counts} == Counter(simple(given_text))
        assert row.trimmed == given_text.strip()
        assert row.snippet == given_text[:150].replace("\n", " ") + "..."


@few
@given(st.lists(words, min_size=2, max_size=25), st.lists(words, min_size=1, max_size=6))
def test_okapi_of_small_vocabularies(spark, texts, asked):
    texts, asked = [" ".join(t) for t in texts], [" ".join(q) for q in asked]
    if not any(texts):
        texts[0] = "sea"
    docs = spark.createDataFrame([(n, t, {}) for n, t in enumerate(texts)], DOCUMENTS)
    questions = spark.createDataFrame(list(enumerate(asked)), QUESTIONS)
    index = build_index(docs)
    terms = bm25.question_terms(questions)
    found = ranked_rows(okapi_topk(questions, terms, index, bm25.fit(index), 4))
    wanted = top(okapi(texts, asked), 4)
    assert found.keys() == wanted.keys()
    for q in wanted:
        # equal scores may round apart in the last digit, so compare scores, not ids
        assert np.allclose([s for _, s in found[q]], [s for _, s in wanted[q]], atol=2e-6)


@few
@given(st.data())
def test_fusion(spark, data):
    content = {d: data.draw(st.sampled_from("abcdefgh")) for d in range(12)}
    weights = data.draw(st.lists(st.sampled_from([0.2, 0.5, 1.0]), min_size=2, max_size=3))
    lists = [
        {q: data.draw(st.permutations(range(12)))[:5] for q in range(3)} for _ in weights
    ]
    schema = "query_id long, doc_id long, rank long"
    frames = [
        spark.createDataFrame(
            [(q, d, r) for q, docs in ranked.items() for r, d in enumerate(docs, 1)], schema
        )
        for ranked in lists
    ]
    table = spark.createDataFrame(list(content.items()), "doc_id long, content_id string")
    found = ranked_rows(rrf(frames, weights, table, 15 * len(lists)))
    for q in range(3):
        score, first = defaultdict(float), {}
        for n, ranked in enumerate(lists):
            for r, d in enumerate(ranked[q], 1):
                score[content[d]] += weights[n] / (60 + r)
                first.setdefault(content[d], (n, r, d))
        order = sorted(score, key=lambda c: (-round(score[c], 6), first[c]))
        close(
            {q: found[q]}, {q: [(first[c][2], round(score[c], 6)) for c in order]}
        )
