import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidsearch.operators.rerank import overlap_score, rerank

CANDIDATES = (
    "query_id long, doc_id long, rank long, question string, text string, "
    "metadata map<string,string>"
)


def score(spark, question, text):
    frame = spark.createDataFrame([(question, text)], "q string, t string")
    return frame.select(overlap_score(F.col("q"), F.col("t")).alias("s")).first().s


def test_default_scorer(spark):
    assert score(spark, "salt of the sea", "salt of the sea") == pytest.approx(1.0)
    assert score(spark, "salt of the sea", "sea the of salt") == pytest.approx(0.6)
    assert score(spark, "salt of the sea", "salt of bread") == pytest.approx(
        0.6 * 2 / 4 + 0.4 * 1 / 3
    )
    assert score(spark, "sea", "the sea") == pytest.approx(0.6)
    assert score(spark, "zeppelin", "the sea") == 0.0
    assert score(spark, "", "the sea") == 0.0
    assert score(spark, "the sea", "") == 0.0


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [
        (0, 1, 1, "salt of the sea", "bread", {"title": "x"}),
        (0, 2, 2, "salt of the sea", "the sea", None),
        (0, 3, 3, "salt of the sea", "salt of the sea", {"relevance_score": "old"}),
        (0, 4, 4, "salt of the sea", "nothing", {}),
        (1, 1, 1, "bread", "bread", {"title": "x"}),
    ]
    return spark.createDataFrame(rows, CANDIDATES)


def kept(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.relevance_score) for r in df.collect())


def test_top_n_and_tie_by_earlier_rank(candidates):
    found = kept(rerank(candidates, top_n=3))
    assert [(q, r, d) for q, r, d, _ in found] == [(0, 1, 3), (0, 2, 2), (0, 3, 1), (1, 1, 1)]
    assert found[0][3] == 1.0 and found[2][3] == 0.0


def test_threshold_drops_and_leaves_no_gaps(candidates):
    found = kept(rerank(candidates, top_n=4, threshold=0.1))
    assert [(q, r, d) for q, r, d, _ in found] == [(0, 1, 3), (0, 2, 2), (1, 1, 1)]


def test_score_is_put_into_metadata(candidates):
    rows = {(r.query_id, r.doc_id): r for r in rerank(candidates, top_n=3).collect()}
    assert rows[0, 3].metadata == {"relevance_score": "1.0"}
    assert set(rows[0, 2].metadata) == {"relevance_score"}
    assert rows[1, 1].metadata["title"] == "x"


def test_scorer_slot_takes_a_pandas_function(candidates):
    @F.pandas_udf("double")
    def by_length(question: pd.Series, text: pd.Series) -> pd.Series:
        return -(text.str.len().astype("float64"))

    found = kept(rerank(candidates, by_length, top_n=1, threshold=-100.0))
    assert [(q, d) for q, _, d, _ in found] == [(0, 1), (1, 1)]


def test_no_candidates_give_no_rows(candidates):
    assert rerank(candidates.filter("false")).count() == 0
