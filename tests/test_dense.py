import hashlib

import numpy as np
import pytest
from brute import close, simple, sparse_dot, top
from conftest import ASKED, TEXTS, ranked_rows
from pyspark.sql import functions as F

from braidsearch.functions import text as tx
from braidsearch.functions import vectors as vx
from braidsearch.operators import bm25, dense, ranking, scoring
from braidsearch.operators.hybrid import convex_topk
from braidsearch.operators.index import build_index, count_and_embed, count_terms
from braidsearch.session import materialize

PLAIN = [text for text, _, _ in TEXTS]
VECTORS = "doc_id long, embedding array<float>"
ASKING = "query_id long, embedding array<float>"


@pytest.fixture(scope="module")
def random_vectors(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(60, 8)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[5] = 0
    rows[11] = rows[10]
    asked = rng.normal(size=(9, 8)).astype(np.float32)
    asked[3] = rows[10]
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], VECTORS)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], ASKING)
    return questions.repartition(3), stored.repartition(5), asked, rows


def scores(asked, rows, metric):
    a, b = asked.astype(np.float64), rows.astype(np.float64)
    if metric == "dot":
        table = a @ b.T
    else:
        table = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return {q: dict(enumerate(row)) for q, row in enumerate(table)}


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_exact_topk_is_brute_force(random_vectors, metric, k):
    questions, stored, asked, rows = random_vectors
    found = ranked_rows(dense.dense_topk(questions, stored, k, 8, metric))
    close(found, top(scores(asked, rows, metric), k, descending=metric == "dot"))


@pytest.mark.parametrize("pass_bytes", [1 << 26, 300])
@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_many_questions(monkeypatch, random_vectors, metric, pass_bytes):
    questions, stored, _, _ = random_vectors
    wanted = ranked_rows(dense.dense_topk(questions, stored, 4, 8, metric))
    monkeypatch.setattr(scoring, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(scoring, "BLOCK_QUESTIONS", 2)
    assert ranked_rows(dense.dense_topk(questions, stored, 4, 8, metric)) == wanted


def test_blocks_of_questions_read_the_stored_rows_once(monkeypatch, spark, random_vectors):
    questions, stored, _, _ = random_vectors
    stored = materialize(stored, "vectors")
    monkeypatch.setattr(scoring, "BLOCK_QUESTIONS", 2)
    plan = dense.dense_topk(questions, stored, 4, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_small_steps_do_not_change_results(monkeypatch, random_vectors):
    questions, stored, _, _ = random_vectors
    wanted = ranked_rows(dense.dense_topk(questions, stored, 4, 8))
    monkeypatch.setattr(scoring, "CELLS", 20)
    assert ranked_rows(dense.dense_topk(questions, stored, 4, 8)) == wanted


def test_ties_go_to_the_smaller_id(random_vectors):
    questions, stored, _, _ = random_vectors
    found = ranked_rows(dense.dense_topk(questions, stored, 2, 8, "l2"))
    assert found[3] == [(10, 0.0), (11, 0.0)]


def test_no_questions_and_no_vectors(spark, random_vectors):
    questions, stored, _, _ = random_vectors
    assert dense.dense_topk(questions.filter("false"), stored, 3, 8).count() == 0
    assert dense.dense_topk(questions, stored.filter("false"), 3, 8).count() == 0


def test_wrong_width_fails(spark, random_vectors):
    questions, _, _, _ = random_vectors
    bad = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    with pytest.raises(Exception, match="width 8"):
        dense.dense_topk(questions, bad, 1, 8).collect()
    with pytest.raises(Exception, match="expected width 3, found 2"):
        bad.select(vx.check_width(F.col("embedding"), 3)).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        dense.dense_topk(questions, bad, 1, 8, "cosine")


def test_vector_functions(spark):
    rows = [([0.6, 0.8, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    out = frame.select(
        vx.dot(F.col("a"), F.col("b")).alias("dot"),
        vx.squared_l2(F.col("a"), F.col("b")).alias("l2"),
        vx.norm(F.col("a")).alias("norm"),
    ).collect()
    assert out[0].dot == pytest.approx(0.8)
    assert out[0].l2 == pytest.approx(2 - 2 * 0.8)
    assert (out[1].dot, out[1].l2, out[1].norm) == (0.0, 1.0, 0.0)


def hashed(text, dim):
    vector = np.zeros(dim)
    for term in simple(text):
        digest = hashlib.md5(term.encode()).hexdigest()
        vector[int(digest[:8], 16) % dim] += 1 if int(digest[8:16], 16) % 2 == 0 else -1
    length = np.linalg.norm(vector)
    return (vector / length if length else vector).astype(np.float32)


def test_hashed_embedder(spark, edge_docs):
    counted = count_terms(edge_docs)
    embed = vx.hashed_embedder(16)
    rows = counted.select("text", embed(F.col("text"), F.col("terms")).alias("v")).collect()
    for row in rows:
        assert np.allclose(row.v, hashed(row.text, 16))
    assert any(not any(row.v) for row in rows)


def test_corpus_without_terms_embeds_to_zero(spark):
    rows = spark.createDataFrame([(1, ""), (2, "...")], "doc_id long, text string")
    embed = vx.hashed_embedder(4)
    found = count_terms(rows).select(embed(F.col("text"), F.col("terms")).alias("v"))
    assert [r.v for r in found.collect()] == [[0.0] * 4] * 2


def test_convex_topk_is_brute_force(spark, docs, questions):
    embed = vx.hashed_embedder(32)
    index = build_index(docs, embedder=embed)
    model = bm25.fit(index)
    asked = count_terms(questions, text="question")
    asked = asked.withColumn("embedding", embed(F.col("question"), F.col("terms")))
    terms = bm25.question_terms(questions)
    sparse = sparse_dot(PLAIN, ASKED)
    near = scores(
        np.stack([hashed(t, 32) for t in ASKED]), np.stack([hashed(t, 32) for t in PLAIN]), "dot"
    )
    for alpha in (0.0, 0.5, 1.0):
        found = ranked_rows(convex_topk(asked, terms, index, model, 4, alpha, 32))
        mixed = {
            q: {d: alpha * near[q][d] + (1 - alpha) * sparse[q][d] for d in near[q]} for q in near
        }
        close(found, top(mixed, 4))
    with pytest.raises(ValueError, match="alpha"):
        convex_topk(asked, terms, index, model, 4, 1.5, 32)


@pytest.mark.parametrize("pass_bytes", [1 << 26, 700])
def test_convex_of_many_questions(monkeypatch, docs, questions, pass_bytes):
    embed = vx.hashed_embedder(32)
    index = build_index(docs, embedder=embed)
    model = bm25.fit(index)
    asked = count_terms(questions, text="question")
    asked = asked.withColumn("embedding", embed(F.col("question"), F.col("terms")))
    terms = bm25.question_terms(questions)
    wanted = ranked_rows(convex_topk(asked, terms, index, model, 4, dim=32))
    monkeypatch.setattr(scoring, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(scoring, "BLOCK_QUESTIONS", 2)
    assert ranked_rows(convex_topk(asked, terms, index, model, 4, dim=32)) == wanted


def clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 16))
    rows = np.concatenate([c + 0.15 * rng.normal(size=(40, 16)) for c in centers])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], VECTORS)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], ASKING)
    return asked, stored


def test_lsh_recall(spark):
    asked, stored = clustered(spark)
    exact = ranked_rows(dense.dense_topk(asked, stored, 5, 16))
    near = ranked_rows(dense.lsh_topk(asked, stored, 5, 6, 8, 16, 1))
    hits = sum(len({d for d, _ in exact[q]} & {d for d, _ in near.get(q, [])}) for q in exact)
    assert hits / 50 >= 0.9
    everything = dense.lsh_topk(asked, stored, 5, 6, 1, 16, radius=6)
    assert ranked_rows(everything) == exact


def test_lsh_meets_in_buckets_only(spark):
    asked, stored = clustered(spark)
    found = dense.lsh_topk(asked, stored, 5, 6, 8, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [hash_table" in plan and "CartesianProduct" not in plan


def test_lsh_from_stored_buckets(monkeypatch, spark, tmp_path):
    asked, stored = clustered(spark)
    path = str(tmp_path / "buckets")
    dense.write_buckets(stored, path, 6, 4, 16)
    kept = spark.read.parquet(path)
    wanted = ranked_rows(dense.lsh_topk(asked, stored, 5, 6, 4, 16))
    assert ranked_rows(dense.lsh_topk(asked, kept, 5, 6, 4, 16)) == wanted
    one = dense.lsh_topk(asked.filter("query_id = 0"), kept, 5, 6, 4, 16)
    assert ranked_rows(one) == {0: wanted[0]}
    assert "dynamicpruning" in one._jdf.queryExecution().toString()
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    assert ranked_rows(dense.lsh_topk(asked, kept, 5, 6, 4, 16)) == wanted


def test_buckets_match_planes(spark):
    _, stored = clustered(spark)
    planes = vx.hyperplanes(12, 16)
    assert set(np.unique(planes)) == {-1.0, 1.0}
    for row in dense.add_buckets(stored, 6, 2, 16).collect():
        sides = planes @ np.array(row.embedding) >= 0
        assert row.bucket == sum(1 << p for p in range(6) if sides[6 * row.hash_table + p])


def test_model_slot(spark, docs):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    embed = vx.model_embedder(load, 2)
    rows = build_index(docs, embedder=embed).select("doc_id", "embedding").collect()
    assert {r.doc_id: r.embedding for r in rows} == {
        i: [float(len(t)), 1.0] for i, t in enumerate(PLAIN)
    }
    with pytest.raises(Exception, match="width 3"):
        build_index(docs, embedder=vx.model_embedder(load, 3)).collect()


def test_a_large_batch_is_folded_in_pieces(spark, monkeypatch):
    assert list(vx.pieces(np.array([3, 0, 2]))) == [(0, 3)]
    monkeypatch.setattr(vx, "FOLD_ROWS", 4)
    monkeypatch.setattr(vx, "FOLD_TERMS", 10)
    cut = list(vx.pieces(np.array([1, 1, 1, 1, 1, 9, 0, 30, 2])))
    assert cut == [(0, 4), (4, 5), (5, 7), (7, 8), (8, 9)]
    monkeypatch.undo()
    rows = [(n, f"a{n % 7} a{n % 7} b{n}") for n in range(2 * vx.FOLD_ROWS + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def folded(tasks):
        counted = count_terms(docs.repartition(tasks, "doc_id"))
        found = counted.select("doc_id", vx.hashed_embedder(8)(F.col("text"), F.col("terms")).alias("v"))
        return {row.doc_id: row.v for row in found.collect()}

    whole = folded(1)
    assert whole == folded(6) and len(whole) == len(rows)


@pytest.mark.parametrize("analyzer", [tx.simple_tokens, tx.whitespace_tokens, tx.stemmed(tx.word_tokens)])
def test_counting_with_the_vector_gives_the_same_rows(spark, edge_docs, analyzer):
    many = [(n, f"\uffff z{n % 7} z{n % 7} \U0001d400 É{n} " * (n % 5)) for n in range(2 * vx.FOLD_ROWS + 5)]
    many += [(-1, None), (-2, "")]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string"))
    embed = vx.hashed_embedder(16)
    kept = ["doc_id", "text", "dl", "terms", "embedding"]
    counted = count_terms(docs, analyzer)
    wanted = counted.withColumn("embedding", embed(F.col("text"), F.col("terms"))).select(kept)
    found = count_and_embed(docs.coalesce(1), analyzer, embed).select(kept)
    assert found.dtypes == wanted.dtypes
    assert sorted(found.collect(), key=str) == sorted(wanted.collect(), key=str)
    blank = count_and_embed(docs.filter("doc_id < 0"), analyzer, embed).select("dl", "terms", "embedding")
    assert [tuple(row) for row in blank.collect()] == [(0, [], [0.0] * 16)] * 2
