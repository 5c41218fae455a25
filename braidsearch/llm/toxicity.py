"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Severity is an ordered grade 0..K. One weight per feature is shared by all thresholds:
``P(grade > k) = sigmoid(weights . x - threshold_k)`` with ascending thresholds. The expected
severity is the sum of these probabilities.

Features of a text are its distinct words and their openings of four and five bytes, hashed. Which
of them are kept (`FEATURES`, by how unevenly they stand in both classes) is counted over the
training sample inside tasks, so the driver only sees the chosen ones. The sample is
about `SAMPLE` labelled documents, taken by a hash of their ids; scoring reads every document, one
narrow pass in which nothing is shuffled.

Where labels only say toxic or not, `severity_grades` orders the toxic ones by how many of the most
telling features they hold.

Defined results: null and empty texts have no features, so they get the score of the bare
thresholds; documents without labels are only scored; a null label takes no part; an id with several
labels counts once with the highest, one that several documents have with its smallest text; without
toxic labels everything has severity 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsearch.llm import words as wd
from braidsearch.session import materialize

# Labelled documents that a model is fitted on, about; never more than there are.
SAMPLE = 20_000
# Hashed features, and how many of them a model keeps.
BITS = 20
FEATURES = 2048
# Sampled documents that must hold a feature before it is kept.
LEAST_DOCS = 5
# Telling features that lift a toxic document to each grade above the first.
STEPS = (6, 12)
PENALTY = 0.2

SCORES = T.StructType(
    [
        T.StructField("expected_severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("p_toxic", T.DoubleType()),
    ]
)


@dataclass
class Model:
    """Kept features (sorted hashes), a weight for each, and ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) by text and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -500, 500)))


def _features(cut: wd.Cut) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and opening, with repeats."""
    parts, docs = [cut.hash], [cut.doc]
    for size in (4, 5):
        long = cut.end - cut.start >= size
        start = cut.start[long]
        # an opening never equals a word: its hash is turned by its size
        parts.append(wd.mix(cut.rolling.pieces(start, start + size) + np.uint64(size)))
        docs.append(cut.doc[long])
    hashed = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(docs), hashed


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc << BITS) | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's ``(text, toxic)`` rows, how many hold each feature, and how many of them are toxic."""
    docs, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high, cut in wd.cuts(batch.column(0)):
            doc, feature = _distinct(*_features(cut))
            docs += np.bincount(feature, minlength=1 << BITS)
            toxic += np.bincount(feature[marks[low:high][doc] > 0], minlength=1 << BITS)
    held = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held), pa.array(docs[held]), pa.array(toxic[held])], names=["feature", "docs", "toxic"]
    )


def _kept_rows(features: np.ndarray):
    """Per text, which of the kept features it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[int]] = []
            for low, high, cut in wd.cuts(batch.column(0)):
                rows: list[list[int]] = [[] for _ in range(low, high)]
                doc, feature = _matched(features, cut)
                for d, f in zip(doc.tolist(), feature.tolist(), strict=True):
                    rows[d].append(f)
                held += rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(held, pa.list_(pa.int32()))], names=["grade", "held"]
            )

    return run


def _matched(features: np.ndarray, cut: wd.Cut) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of kept feature), once each."""
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    doc, feature = _features(cut)
    at = place[feature]
    known = at >= 0
    both = np.unique(doc[known] * len(features) + at[known])
    return both // max(1, len(features)), both % max(1, len(features))


def sample(docs: DataFrame, labels: DataFrame, grade: str, rows: int, text: str = "text") -> DataFrame:
    """``(text, grade, doc_id)`` of about ``rows`` labelled documents, all if there are no more.

    Ids are taken by a hash of theirs, so no task gathers and no row travels that is not taken.
    """
    graded = labels.filter(F.col("doc_id").isNotNull() & F.col(grade).isNotNull())
    graded = graded.groupBy("doc_id").agg(F.max(F.col(grade).cast("int")).alias("grade"))
    n = graded.count()
    if n > rows:
        steps = 1 << 40
        graded = graded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(steps * rows / n))
    # about ``rows`` ids, 12 bytes each
    joined = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(graded), "doc_id")
    one = joined.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return materialize(one.select("text", "grade", "doc_id"), "toxicity-sample")


def chosen_features(rows: DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` features that stand most unevenly in toxic and other texts, and their log odds."""
    counted = rows.select("text", (F.col("grade") > 0).alias("toxic")).mapInArrow(
        _count_features, "feature bigint, docs bigint, toxic bigint"
    )
    totals = rows.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("t")).first()
    n, toxic = totals.n, totals.t or 0
    if not toxic or toxic == n:
        return np.zeros(0, np.int64), np.zeros(0)
    sums = counted.groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    expected = F.col("docs") * F.lit(toxic / n)
    uneven = (F.col("toxic") - expected) ** 2 / (expected * F.lit(1 - toxic / n))
    best = (
        sums.filter(F.col("docs") >= LEAST_DOCS)
        .select("feature", "docs", "toxic", uneven.alias("uneven"))
        .filter(F.col("uneven") > 15.14)  # one in ten thousand by chance
        .orderBy(F.desc("uneven"), "feature")
        .limit(keep)
        .toPandas()
        .sort_values("feature")
    )
    odds = np.log((best.toxic + 0.5) / (toxic + 1)) - np.log((best.docs - best.toxic + 0.5) / (n - toxic + 1))
    return best.feature.to_numpy(np.int64), odds.to_numpy(float)


def severity_grades(held: list[np.ndarray], toxic: np.ndarray, odds: np.ndarray, steps=STEPS) -> np.ndarray:
    """Grades from yes/no labels: toxic documents rise with the telling features they hold."""
    telling = odds > 2
    count = np.array([telling[row].sum() if len(row) else 0 for row in held])
    return np.where(toxic > 0, 1 + sum((count >= step).astype(int) for step in steps), 0)


def fit_ordinal(
    held: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = PENALTY, rounds: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by gradient descent.

    Thresholds are a first one and positive gaps, so their order holds at every step; the shared
    weights carry an L2 penalty.
    """
    levels = max(1, int(grades.max(initial=0)))
    text = np.repeat(np.arange(len(held)), [len(row) for row in held])
    feature = np.concatenate([np.zeros(0, np.int64), *held]).astype(np.int64)
    weights = np.zeros(n_features)
    share = np.array([np.mean(grades > k) for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    base = np.log((1 - share) / share)
    free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.1))])
    first, second = (np.zeros(n_features + levels) for _ in range(2))
    for t in range(1, rounds + 1):
        thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        margin = np.bincount(text, weights[feature], minlength=len(held))
        above = 1 / (1 + np.exp(thresholds[None, :] - margin[:, None]))
        # P(grade = k) is the difference of neighbours in 1, above_0, ..., above_K-1, 0
        edges = np.concatenate([np.ones((len(held), 1)), above, np.zeros((len(held), 1))], axis=1)
        row = np.arange(len(held))
        high, low = edges[row, grades], edges[row, grades + 1]
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        d_margin = -(slope_high - slope_low) / chance / len(held)
        d_threshold = np.zeros(levels)
        up, down = grades > 0, grades < levels
        np.add.at(d_threshold, grades[up] - 1, (slope_high / chance)[up] / len(held))
        np.add.at(d_threshold, grades[down], -(slope_low / chance)[down] / len(held))
        after = np.cumsum(d_threshold[::-1])[::-1]
        d_free = np.concatenate([after[:1], after[1:] * np.exp(free[1:])])
        d_weights = np.bincount(feature, d_margin[text], minlength=n_features)
        step = np.concatenate([d_weights + penalty / max(1, len(held)) * weights, d_free])
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, free = weights - move[:n_features], free - move[n_features:]
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(
    docs: DataFrame, labels: DataFrame, grade: str, rows: int = SAMPLE, keep: int = FEATURES, ordered: bool = False
) -> Model:
    """A model from ``labels`` (doc_id, ``grade``); ``ordered`` says that grades go beyond yes/no."""
    taken = sample(docs, labels, grade, rows)
    features, odds = chosen_features(taken, keep)
    # at most ``rows`` rows of at most ``keep`` small numbers
    held_rows = taken.orderBy("doc_id", "grade", "text").select("text", "grade").mapInArrow(
        _kept_rows(features), "grade int, held array<int>"
    ).toArrow()
    grades = held_rows.column("grade").to_numpy().astype(np.int64)
    held = [np.array(row, np.int64) for row in held_rows.column("held").to_pylist()]
    if not len(features):
        return Model(features, np.zeros(0), np.array([np.inf]))
    if not ordered:
        grades = severity_grades(held, grades, odds)
    weights, thresholds = fit_ordinal(held, grades, len(features))
    return Model(features, weights, thresholds)


def _score(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected severity, likeliest grade and P(grade > 0) of each text."""
    margins = np.zeros(len(texts))
    for low, high, cut in wd.cuts(texts):
        if len(model.features):
            doc, feature = _matched(model.features, cut)
            margins[low:high] = np.bincount(doc, model.weights[feature], minlength=high - low)
    above = model.above(margins)
    edges = np.concatenate([np.ones((len(margins), 1)), above, np.zeros((len(margins), 1))], axis=1)
    return above.sum(axis=1), np.argmax(-np.diff(edges, axis=1), axis=1), above[:, 0]


def with_severity(docs: DataFrame, model: Model, severity: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``severity``: expected severity, grade, chance of being toxic."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(severity, SCORES)])
    names = [field.name for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, grade, toxic = _score(batch.column(at), model)
            scores = pa.StructArray.from_arrays(
                [pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(toxic)],
                names=["expected_severity", "grade", "p_toxic"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=names)

    return wd.mapped(docs, run, schema)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose chance of being toxic is below ``limit``, unchanged."""
    severity = wd.free_name(docs, "severity")
    return with_severity(docs, model, severity).filter(F.col(severity)["p_toxic"] < limit).drop(severity)
