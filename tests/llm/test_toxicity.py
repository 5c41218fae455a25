import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidsearch.llm import toxicity as tx

from .conftest import sentence

RUDE = ["grumblefoo", "snarkwit", "blatherskite", "numbskullery"]


def rows(n, first=0):
    own = random.Random(first)
    out = []
    for i in range(first, first + n):
        words, toxic = sentence(own.randint(10, 80), i).split(), i % 5 == 0
        for _ in range(own.randint(1, 20) if toxic else 0):
            words.insert(own.randrange(len(words)), own.choice(RUDE))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(rows(600), "doc_id bigint, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return tx.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"), "toxic")


def test_held_out_accuracy(spark, model):
    fresh = spark.createDataFrame(rows(300, 10_000), "doc_id bigint, text string, toxic int")
    found = tx.with_severity(fresh, model, "severity").collect()
    assert np.mean([(r.severity.p_toxic >= 0.5) == bool(r.toxic) for r in found]) > 0.99
    count = [sum(w in RUDE for w in r.text.split()) for r in found]
    severity = [r.severity.expected_severity for r in found]
    assert np.corrcoef(np.argsort(np.argsort(count)), np.argsort(np.argsort(severity)))[0, 1] > 0.5
    assert all(0 <= s <= len(model.thresholds) for s in severity)


def test_thresholds_ascend_and_weights_are_shared():
    own = np.random.default_rng(0)
    held = [np.flatnonzero(own.random(6) < 0.4) for _ in range(3000)]
    truth = np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0])
    latent = np.array([truth[h].sum() for h in held]) + own.logistic(size=3000)
    grades = np.digitize(latent, [0.0, 1.5, 3.0])
    weights, thresholds = tx.fit_ordinal(held, grades, 6, penalty=0.0, rounds=800)
    assert (np.diff(thresholds) > 0).all()
    assert np.abs(weights - truth).max() < 0.3 and np.abs(thresholds - [0.0, 1.5, 3.0]).max() < 0.3


def test_given_grades_are_used(labelled):
    graded = labelled.withColumn("grade", F.col("toxic") * (1 + F.col("doc_id") % 2).cast("int"))
    model = tx.fit(graded.select("doc_id", "text"), graded.select("doc_id", "grade"), "grade", ordered=True)
    assert len(model.thresholds) == 2


def test_drop_keeps_clean_rows_unchanged(labelled, model):
    docs = labelled.withColumnRenamed("toxic", "severity")
    left = tx.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.filter("severity = 1").count() <= 1
    assert left.filter("severity = 0").exceptAll(docs).count() == 0 and left.filter("severity = 0").count() == 480


def test_sample_is_bounded_and_of_labelled_rows(spark, labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")
    assert 25 < tx.sample(docs, labels, "toxic", 50).count() < 80
    assert tx.sample(docs, labels, "toxic", 600).count() == 600
    # an id of many rows counts once
    hot = docs.union(spark.range(500).selectExpr("1", "concat('text ', id)"))
    many = labels.union(spark.range(500).selectExpr("1", "0"))
    assert tx.sample(hot, many, "toxic", 1000).count() == 600


def test_edges(spark, edge, nothing, labelled, model):
    found = tx.with_severity(edge, model, "level").collect()
    assert len(found) == edge.count() and len({r.level.p_toxic for r in found if not (r.text or "").strip()}) == 1
    assert tx.with_severity(nothing, model, "level").count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    harmless = tx.fit(edge.select("doc_id", "text"), labels, "toxic")
    assert max(r.level.p_toxic for r in tx.with_severity(edge, harmless, "level").collect()) < 1e-9
    none = labels.filter("toxic = 7")
    assert tx.drop_toxic(edge, tx.fit(edge, none, "toxic")).count() == edge.count()
