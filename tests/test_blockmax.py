import random

import pytest

from braidsearch.operators import bm25, hybrid
from braidsearch.operators import blockmax as bx
from braidsearch.operators.index import index_rows
from braidsearch.schemas import QUESTIONS
from braidsearch.session import materialize
from tests import brute
from tests.conftest import ASKED, TEXTS, ranked_rows


def corpus(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = index_rows(docs)
    return index, bm25.fit(index)


def asked(spark, questions):
    return bm25.question_terms(spark.createDataFrame(list(enumerate(questions)), QUESTIONS))


def zipf(n, seed):
    """Texts of few common and many rare words, and questions of both."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    chances = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, chances, k=rng.randint(0, 60))) for _ in range(n)]
    texts += texts[:5]  # ties
    questions = [" ".join(rng.choices(words, chances, k=k)) for k in (1, 2, 5, 30)]
    return texts, [*questions, texts[7], "w399 w398", "nothing known", "w0 w0 w1"]


@pytest.mark.parametrize("block,parts,k", [(3, 4, 5), (128, 64, 3), (1, 1, 1)])
def test_equals_the_scan(spark, block, parts, k):
    texts, questions = zipf(300, block)
    index, model = corpus(spark, texts)
    q_terms = asked(spark, questions)
    stored = bx.write_postings(index, model, block=block, parts=parts)
    found = ranked_rows(bx.blockmax_topk(q_terms, index, stored, k))
    rows = spark.createDataFrame(list(enumerate(questions)), QUESTIONS)
    assert found == ranked_rows(hybrid.okapi_topk(rows, q_terms, index, model, k, pad=False))


def test_equals_brute_force(spark):
    texts = [text for text, _, _ in TEXTS]
    index, model = corpus(spark, texts)
    found = ranked_rows(bx.blockmax_topk(asked(spark, ASKED), index, bx.write_postings(index, model), 3))
    wanted = brute.top(brute.okapi(texts, ASKED), 3)
    matched = {q: [e for e in entries if e[1] != 0] for q, entries in wanted.items()}
    brute.close(found, {q: entries for q, entries in matched.items() if entries})


def test_common_terms_that_count_against_a_document(spark):
    texts = ["a b", "a b", "a b c", "a", "b"]
    index, model = corpus(spark, texts)
    assert model.mean_idf < 0
    q_terms = asked(spark, ["a", "a c", "b"])
    rows = spark.createDataFrame(list(enumerate(["a", "a c", "b"])), QUESTIONS)
    found = ranked_rows(bx.blockmax_topk(q_terms, index, bx.write_postings(index, model), 3))
    assert found == ranked_rows(hybrid.okapi_topk(rows, q_terms, index, model, 3, pad=False))


def test_blocks_hold_every_posting_once_by_falling_weight(spark):
    texts, _ = zipf(200, 1)
    index, model = corpus(spark, texts)
    blocks = bx.write_postings(index, model, block=7, parts=3).blocks.collect()
    kept = [(b.term, d) for b in blocks for d in b.docs]
    assert len(kept) == len(set(kept)) == sum(len(set(text.split())) for text in texts)
    assert all(b.most == b.weights[0] and list(b.weights) == sorted(b.weights, reverse=True) for b in blocks)
    assert max(len(b.docs) for b in blocks) == 7


def test_few_documents_are_scored_in_full(spark):
    """Rare terms decide: common ones are not read, and most matching documents are no candidates."""
    rng = random.Random(3)
    texts = [f"common often {'usual ' * rng.randint(1, 4)}" + (f"rare{n % 5} " * 2 if n < 30 else "") for n in range(600)]
    index, model = corpus(spark, texts)
    q_terms = asked(spark, ["common usual rare1 rare2"])
    size = bm25.terms_size(q_terms)
    stored = bx.write_postings(index, model, block=8, parts=4)
    weights = bm25.okapi_queries(q_terms, model, size)
    limits = bx.bounds(stored, weights, size)
    beat = bx.to_beat(stored, limits, 5, size)
    assert bx.candidates(stored, limits, beat, 5, size).count() <= 12
    levels = {r.term: r for r in bx.levels(limits, beat, size).collect()}
    assert levels["common"].bound < levels["common"].level < levels["rare1"].bound
    unseen = sum(r.rest for r in levels.values())
    assert unseen <= bx.UNSEEN * levels["rare1"].beat + 1e-9


def test_only_folders_of_asked_terms_are_read(spark):
    texts, _ = zipf(100, 2)
    index, model = corpus(spark, texts)
    stored = bx.write_postings(index, model)
    limits = bx.bounds(stored, bm25.okapi_queries(asked(spark, ["w5 w6"]), model), 1000)
    plan = limits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "part" in plan


def test_nothing_asked(spark):
    index, model = corpus(spark, ["a b", "c"])
    stored = bx.write_postings(index, model)
    assert bx.blockmax_topk(asked(spark, []).limit(0), index, stored).collect() == []
    assert bx.blockmax_topk(asked(spark, ["zebra"]), index, stored).collect() == []


def test_a_hot_term_is_spread_and_whole(spark, monkeypatch):
    """Places for few postings each, so that one word needs many; every posting stays, once."""
    monkeypatch.setattr(bx, "HELD", 64)
    texts = ["hot " + ("rare" if n == 7 else f"w{n % 20}") for n in range(400)]
    index, model = corpus(spark, texts)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    stored = bx.write_postings(index.repartition(3), model, block=8, parts=2)
    files = stored.blocks.filter("term = 'hot'").select("_metadata.file_name").distinct().count()
    assert files == int(tasks) // 2
    kept = [(b.term, d) for b in stored.blocks.collect() for d in b.docs]
    assert sorted(kept) == sorted((word, n) for n, text in enumerate(texts) for word in text.split())
    found = ranked_rows(bx.blockmax_topk(asked(spark, ["hot rare"]), index, stored, 3))
    assert found[0][0][0] == 7


def test_shares_grow_with_the_documents_and_sums_stay_in_them(spark, monkeypatch):
    monkeypatch.setattr(bx, "SHARE_DOCS", 50)
    texts, questions = zipf(300, 5)
    index, model = corpus(spark, texts)
    q_terms = asked(spark, questions)
    stored = bx.write_postings(index, model, block=8, parts=2)
    rows = stored.blocks.collect()
    held = {}
    for row in rows:
        held.setdefault(row.share, set()).update(row.docs)
    assert len(held) == 7 and all(row.held == len(row.docs) for row in rows)
    assert sum(map(len, held.values())) == sum(1 for text in texts if text)
    size = bm25.terms_size(q_terms)
    limits = materialize(bx.bounds(stored, bm25.okapi_queries(q_terms, model, size), size), "limits")
    known = materialize(bx.levels(limits, bx.to_beat(stored, limits, 3, size), size), "levels")
    plan = bx.seen_above(stored, known, size)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in dealt if "share" in line or "doc" in line]
    rows = spark.createDataFrame(list(enumerate(questions)), QUESTIONS)
    found = ranked_rows(bx.blockmax_topk(q_terms, index, stored, 3))
    assert found == ranked_rows(hybrid.okapi_topk(rows, q_terms, index, model, 3, pad=False))


def test_postings_are_opened_by_their_path(spark, tmp_path):
    index, model = corpus(spark, ["a b", "b c", "c c a"])
    path = f"{tmp_path}/postings"
    written = {(b.term, *b.docs) for b in bx.write_postings(index, model, path, parts=2).blocks.collect()}
    for table in spark.catalog.listTables():
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    opened = bx.read_postings(spark, path, model, parts=2).blocks
    assert {(b.term, *b.docs) for b in opened.collect()} == written
