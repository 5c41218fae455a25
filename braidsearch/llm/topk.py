"""Exact top-k inner products in three phases with a uniform threshold.

The components of a vector are cut into ``parts``; each part ranks all vectors by its own share of
the score. No phase sums the shares of every pair.

1. *Gather.* Every task lists, for each question and part, its ``LIST`` vectors with the greatest shares; only those
   get their full scores, and the k best are sent on. The k-th best of all tasks is a score that the k-th
   answer surely reaches. A vector whose shares all lie below that score / ``parts`` cannot reach it.
2. *Collect.* This cutoff goes to all tasks, which collect the entries with a share at the cutoff or above.
3. *Resolve.* The other shares of these entries are added, in the task that holds the vector; of those that reach the
   score to beat, a task sends its k best on, and the best of all tasks' are the answer.

Equal vectors are one entry with its smallest ids, as many as an answer can name, so a vector
that a third of all rows hold costs no more than any other. Questions are asked in blocks of
``BLOCK`` (broadcast: 8 bytes a component); all vectors meet all questions inside tasks, which
emit bounded lists, never a row for each pair.

Defined results: vectors that are null, of another width than most, or hold null or non-finite
components take no part; ties go to the smaller id; rows that repeat an id and vector count once;
fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidsearch.session import materialize

PARTS = 4
LIST = 32
BLOCK = 4096
# Scores that a task holds at once.
CELLS = 1 << 22


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``, x as double; null if one is null or not finite."""
    numbers = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    return F.when(finite, numbers)


def _distinct(vectors: DataFrame, ids: int) -> DataFrame:
    """``(vector, vec_id)``: of every distinct vector the ``ids`` smallest ids.

    Catalyst limits each task's rows of a vector before they are shuffled.
    """
    ranked = Window.partitionBy("vector").orderBy("vec_id")
    smallest = vectors.dropDuplicates().withColumn("n", F.row_number().over(ranked))
    return smallest.filter(F.col("n") <= ids)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch ``(vec_id, vector)``."""
    rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(zero_copy_only=False), rows


def _shares(questions: np.ndarray, rows: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """Scores by part: part, question, row; in the fastest type that holds every sum exactly."""
    most = rows.shape[1] * np.abs(questions).max(initial=0) * np.abs(rows).max(initial=0)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    questions, rows = questions.astype(kind), rows.astype(kind)
    return np.stack([questions[:, cut] @ rows[:, cut].T for cut in cuts])


def _steps(batch: pa.RecordBatch, questions: int, parts: int) -> Iterator[tuple]:
    ids, rows = _matrix(batch)
    step = max(1, CELLS // (questions * parts))
    for low in range(0, len(ids), step):
        yield ids[low : low + step], rows[low : low + step]


def _best(question, vec_id, score, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best entries of each question; ties to the smaller id."""
    order = np.lexsort((vec_id, -score, question))
    question, vec_id, score = question[order], vec_id[order], score[order]
    new = np.flatnonzero(np.append(True, question[1:] != question[:-1])[: len(question)])
    place = np.arange(len(question)) - np.repeat(new, np.diff(np.append(new, len(question))))
    keep = place < k
    return question[keep], vec_id[keep], score[keep]


def _entries(numbers: np.ndarray, question, vec_id, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers[question]), pa.array(vec_id), pa.array(score.astype(np.int64))],
        names=["query_id", "vec_id", "score"],
    )


def _resolved(shares: np.ndarray, question: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Full scores of the given entries only."""
    return shares[:, question, row].sum(axis=0).astype(np.int64)


def _phase_one(questions: np.ndarray, numbers: np.ndarray, cuts: list[slice], k: int):
    """Of each question, the ``k`` best scores among the heads of a task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for ids, rows in _steps(batch, len(questions), len(cuts)):
                shares = _shares(questions, rows, cuts)
                size = min(LIST, len(ids))
                heads = np.argpartition(shares, len(ids) - size, axis=2)[:, :, len(ids) - size :]
                # an entry may head several lists
                listed = np.unique(np.arange(len(questions))[None, :, None] * len(ids) + heads)
                question, row = listed // len(ids), listed % len(ids)
                more = (question, ids[row], _resolved(shares, question, row))
                found = _best(*(np.concatenate(both) for both in zip(found, more, strict=True)), k)
        yield _entries(numbers, *found)

    return run


def collect(shares: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(question, row)`` of the entries with a share at the cutoff, the only ones that can reach ``bound``.

    ``shares`` by part, question and row are whole numbers, ``bound`` is one for each question.
    """
    # rounded up to whole numbers, as shares are, so that comparing stays in their type
    cutoff = (-(-bound // len(shares))).astype(shares.dtype)
    return np.nonzero((shares >= cutoff[None, :, None]).any(axis=0))


def _phase_two_and_three(questions, numbers, cuts, bound: np.ndarray, k: int):
    """Entries with a share at the cutoff, their scores resolved: the ``k`` best of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for ids, rows in _steps(batch, len(questions), len(cuts)):
                shares = _shares(questions, rows, cuts)
                question, row = collect(shares, bound)
                scores = _resolved(shares, question, row)
                reach = scores >= bound[question]
                more = (question[reach], ids[row[reach]], scores[reach])
                found = _best(*(np.concatenate(both) for both in zip(found, more, strict=True)), k)
        yield _entries(numbers, *found)

    return run


ENTRIES = "query_id bigint, vec_id bigint, score bigint"


def _first(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of each question, with their place ``n``."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)


def _asked(entries: DataFrame, questions: np.ndarray, numbers: np.ndarray, k: int, parts: int):
    """One block: the best ``k`` distinct vectors of each question, ``query_id, vec_id, score``."""
    edges = np.linspace(0, questions.shape[1], parts + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    gathered = entries.mapInArrow(_phase_one(questions, numbers, cuts, k), ENTRIES)
    at = {number: n for n, number in enumerate(numbers.tolist())}
    bound = np.full(len(numbers), -(1 << 62), np.int64)
    # one row for each question of the block
    for row in _first(gathered, k).filter(F.col("n") == k).toArrow().to_pylist():
        bound[at[row["query_id"]]] = row["score"]
    collected = entries.mapInArrow(_phase_two_and_three(questions, numbers, cuts, bound, k), ENTRIES)
    return _first(collected, k).drop("n")


def exact_topk(
    questions: DataFrame, vectors: DataFrame, k: int = 5, parts: int = PARTS, block: int = BLOCK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each question's row.

    Both sides are ``(vec_id, vector array<bigint>)``; a question is never its own answer.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "vector").filter("vec_id is not null and vector is not null")
    questions = questions.select("vec_id", "vector").filter("vec_id is not null and vector is not null")
    dim = vectors.agg(F.mode(F.size("vector"), True)).first()[0] or 0
    vectors, questions = (
        side.filter(F.size("vector") == dim).select("vec_id", "vector") for side in (vectors, questions)
    )
    # one more of each, since the question's own row is left out
    smallest = materialize(_distinct(vectors, k + 1), "topk-vectors")
    entries = smallest.filter(F.col("n") == 1).select("vec_id", "vector")
    heads = smallest.join(entries.withColumnRenamed("vec_id", "head"), "vector").select("head", "vec_id")
    # a question that several rows repeat is asked once
    asked = questions.dropDuplicates()
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)))
    found = []
    for n in range(blocks):
        mine = dealt.filter(F.col("block") == n).select("vec_id", "vector").toArrow()
        if not mine.num_rows or not dim:
            continue
        mine = mine.sort_by("vec_id")
        batch = mine.combine_chunks().to_batches()[0]
        numbers, rows = _matrix(batch)
        found.append(materialize(_asked(entries, rows, numbers, k + 1, parts), "topk-found"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rows = best.withColumnRenamed("vec_id", "head").join(heads, "head")
    rows = rows.filter(F.col("vec_id") != F.col("query_id"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.withColumn("rank", F.row_number().over(by_score))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
