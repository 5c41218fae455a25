import pytest
from conftest import ranked_rows

from braidsearch.operators.fusion import rrf

RANKED = "query_id long, doc_id long, score double, rank long"


def ranked(spark, rows):
    return spark.createDataFrame([(q, d, 0.0, r) for q, d, r in rows], RANKED)


def contents(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, content_id string")


def test_hand_computed_scores(spark):
    content = contents(spark, [(1, "a"), (2, "b"), (3, "c")])
    sparse = ranked(spark, [(0, 1, 1), (0, 2, 2)])
    near = ranked(spark, [(0, 1, 1), (0, 3, 2)])
    found = ranked_rows(rrf([sparse, near], [0.5, 0.5], content, 4))
    # b and c tie, b stands in the first list
    assert found[0] == [(1, 0.016393), (2, 0.008065), (3, 0.008065)]


def test_only_first_ranks(spark):
    content = contents(spark, [(1, "a"), (2, "b")])
    found = ranked_rows(
        rrf([ranked(spark, [(0, 1, 1)]), ranked(spark, [(0, 2, 1)])], [0.5, 0.5], content, 2)
    )
    assert found[0] == [(1, 0.008197), (2, 0.008197)]


def test_same_text_twice_in_a_list_adds_and_first_seen_stands(spark):
    content = contents(spark, [(7, "same"), (3, "same")])
    twice = ranked(spark, [(0, 7, 1), (0, 3, 2)])
    empty = ranked(spark, [])
    assert ranked_rows(rrf([twice, empty], [0.5, 0.5], content, 2))[0] == [(7, 0.016261)]


def test_weights_and_cut(spark):
    content = contents(spark, [(1, "a"), (2, "b"), (3, "c")])
    lists = [ranked(spark, [(0, d, 1), (1, d, 1)]) for d in (1, 2, 3)]
    found = ranked_rows(rrf(lists, [0.2, 0.5, 0.3], content, 6, k=2))
    assert found[0] == found[1] == [(2, round(0.5 / 61, 6)), (3, round(0.3 / 61, 6))]
    with pytest.raises(ValueError, match="one weight per list"):
        rrf(lists, [1.0], content, 6)


def test_no_candidates(spark):
    content = contents(spark, [(1, "a")])
    assert rrf([ranked(spark, [])], [1.0], content, 0).count() == 0
