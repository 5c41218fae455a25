import random

import numpy as np
import pytest

from braidsearch.llm import topk

NAN, INF = float("nan"), float("inf")


def vectors(n, dim=12, seed=3):
    own = random.Random(seed)
    return [(i, [own.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as label")


def test_equals_sql(spark, against_sql):
    rows = vectors(230)
    rows += [(1000 + n, rows[50][1]) for n in range(40)] + [(2000 + n, rows[100][1]) for n in range(3)]
    rows += [(300, None), (350, [None] * 12), (400, [NAN] * 12), (450, [INF] * 12), (500, rows[7][1])]
    found = against_sql("op10_exact_topk", embeddings=table(spark, rows))
    assert {r[0] for r in found} >= {0, 50, 100, 1000, 500} and not {300, 350, 400, 450} & {r[0] for r in found}


def test_few_and_none(spark, against_sql):
    assert len(against_sql("op10_exact_topk", embeddings=table(spark, vectors(3)))) == 2
    assert against_sql("op10_exact_topk", embeddings=table(spark, vectors(1))) == []
    empty = table(spark, vectors(1)).filter("false")
    whole = empty.selectExpr("vec_id", "cast(embedding as array<bigint>) as vector")
    assert topk.exact_topk(whole, whole).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_blocks_and_ties(spark, block):
    rows = [(i, [1, 0, 0, 0] if i % 3 else [0, 1, 0, 0]) for i in range(60)]
    whole = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    asked = whole.filter("vec_id % 10 = 0")
    found = topk.exact_topk(asked, whole, 4, block=block).collect()
    for query in range(0, 60, 10):
        mine = dict(rows)[query]
        wanted = sorted(
            ((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in rows if i != query)
        )[:4]
        got = sorted((r["rank"], -r.score, r.vec_id) for r in found if r.query_id == query)
        assert [(s, i) for _, s, i in got] == wanted


def test_large_components_stay_exact(spark):
    rows = [(i, [10**7 + i, -(10**7) + 3 * i, 5]) for i in range(30)]
    whole = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    found = topk.exact_topk(whole.filter("vec_id = 4"), whole, 5).collect()
    wanted = sorted(((-sum(a * b for a, b in zip(rows[4][1], v, strict=True)), i) for i, v in rows if i != 4))[:5]
    assert [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == wanted


@pytest.mark.parametrize("spread,most", [(0.05, 0.15), (1.0, 0.4)])
def test_threshold_leaves_few_entries_to_resolve(spread, most):
    """Every entry at the bound is collected; of vectors in clusters few others are."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 64))
    rows = centers[rng.integers(20, size=4000)] + spread * rng.normal(size=(4000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    cuts = [slice(n, n + 16) for n in range(0, 64, 16)]
    shares = topk._shares(rows[:80], rows, cuts)
    scores = rows[:80] @ rows.T
    bound = np.sort(scores, axis=1)[:, -5]
    question, row = topk.collect(shares, bound)
    collected = set(zip(question.tolist(), row.tolist(), strict=True))
    assert collected >= set(zip(*(side.tolist() for side in np.nonzero(scores >= bound[:, None])), strict=True))
    assert len(collected) < most * scores.size
    assert (topk._resolved(shares, question, row) == scores[question, row]).all()


def test_threshold_below_zero_is_safe():
    rng = np.random.default_rng(6)
    rows = rng.integers(-50, 10, size=(300, 8))
    cuts = [slice(0, 4), slice(4, 8)]
    for asked in (-rows[:20], np.abs(rows[:20])):
        shares, scores = topk._shares(asked, rows, cuts), asked @ rows.T
        for place in (-1, -5, -300):
            bound = np.sort(scores, axis=1)[:, place]
            question, row = topk.collect(shares, bound)
            collected = set(zip(question.tolist(), row.tolist(), strict=True))
            assert collected >= set(zip(*(side.tolist() for side in np.nonzero(scores >= bound[:, None])), strict=True))
