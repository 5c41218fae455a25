"""Scoring of whole question blocks against batches of stored vectors.

Exact dense search has to look at every (question, vector) pair, but it need not
make a row of each. Each task multiplies its vectors with blocks of questions and
keeps its best k per question, so a task emits at most ``questions * k`` rows and
only those are shuffled.

Questions travel to the tasks with the function, `PASS_BYTES` of them at a time. A task keeps each
batch of stored rows and goes through the blocks of `BLOCK_QUESTIONS` one by one, so the stored
rows are read once for as many questions as that holds, and once more for each further lot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.functions.vectors import matrix
from braidsearch.operators.ranking import ROW_BYTES, SCORE_DIGITS, top_by_score

# Questions that are multiplied at once, bytes of them that a task holds, scores it holds at once.
BLOCK_QUESTIONS = 4096
PASS_BYTES = 64 << 20
CELLS = 1 << 19

CANDIDATES = pa.schema(
    [("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]
)
CANDIDATES_DDL = "query_id long, doc_id long, score double"


@dataclass(frozen=True)
class Scoring:
    """How a question and a vector are compared.

    ``metric`` is "dot" or "l2" (squared distance, smaller is better). ``alpha`` weighs the dense
    part; with ``matches`` the stored rows bring sparse scores for the rest.
    """

    k: int
    dim: int
    metric: str = "dot"
    alpha: float = 1.0
    matches: bool = False


class Block:
    """A bounded set of questions as arrays: ids in ascending order and their vectors."""

    def __init__(self, questions: pa.Table, scoring: Scoring):
        columns = questions.combine_chunks()
        self.ids = columns["query_id"].to_numpy()
        self.dense = matrix(_chunk(columns["embedding"]), scoring.dim)

    def match_scores(self, matches: pa.ListArray) -> np.ndarray:
        """(documents, questions) sparse scores, 0 where a document brings none."""
        doc = np.repeat(np.arange(len(matches)), matches.value_lengths().fill_null(0).to_numpy())
        pairs = matches.flatten()
        question, score = (pairs.field(n).to_numpy(zero_copy_only=False) for n in (0, 1))
        at = np.searchsorted(self.ids, question)
        mine = at < len(self.ids)
        mine[mine] = self.ids[at[mine]] == question[mine]
        sums = np.zeros((len(matches), len(self.ids)))
        sums[doc[mine], at[mine]] = score[mine]
        return sums

    def dense_scores(self, vectors: np.ndarray, metric: str) -> np.ndarray:
        dots = vectors @ self.dense.T
        if metric == "dot":
            return dots
        squares = (vectors * vectors).sum(axis=1)[:, None] + (self.dense * self.dense).sum(axis=1)
        return np.maximum(squares - 2 * dots, 0.0)


def _chunk(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _round(scores: np.ndarray) -> np.ndarray:
    scale = 10.0**SCORE_DIGITS
    return np.trunc(scores * scale + np.copysign(0.5, scores)) / scale + 0.0


class Best:
    """The best k rows per question seen so far, ties to the smaller id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.bound = np.full(questions, -np.inf)
        self.question = np.empty(0, dtype=np.int64)
        self.doc = np.empty(0, dtype=np.int64)
        self.key = np.empty(0, dtype=np.float64)

    def add(self, ids: np.ndarray, keys: np.ndarray) -> None:
        if len(ids) == 0:
            return
        floor = self.bound
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(keys, -self.k, axis=0)[-self.k])
        rows, questions = np.nonzero((keys >= floor) & (keys > -np.inf))
        question = np.concatenate([self.question, questions])
        doc = np.concatenate([self.doc, ids[rows]])
        key = np.concatenate([self.key, keys[rows, questions]])
        order = np.lexsort((doc, -key, question))
        question = question[order]
        place = np.arange(len(order)) - np.searchsorted(question, question)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.question = np.concatenate([self.question, questions])[kept]
        self.doc, self.key = doc[kept], key[kept]
        self.bound[question[place == self.k - 1]] = key[full]

    def candidates(self, block: Block, descending: bool) -> pa.RecordBatch:
        score = self.key if descending else -self.key + 0.0
        return pa.RecordBatch.from_arrays(
            [pa.array(block.ids[self.question]), pa.array(self.doc), pa.array(score)],
            schema=CANDIDATES,
        )


def score_batch(best: Best, block: Block, scoring: Scoring, batch: pa.RecordBatch) -> None:
    """Fold one batch of stored rows into ``best``, a bounded number of cells at a time."""
    step = max(1, CELLS // max(1, len(block.ids)))
    for offset in range(0, batch.num_rows, step):
        part = batch.slice(offset, step)
        vectors = matrix(_chunk(part["embedding"]), scoring.dim)
        scores = scoring.alpha * block.dense_scores(vectors, scoring.metric)
        if scoring.matches:
            scores = scores + (1.0 - scoring.alpha) * block.match_scores(_chunk(part["matches"]))
        keys = _round(scores)
        best.add(part["doc_id"].to_numpy(), -keys if scoring.metric == "l2" else keys)


def topk(
    questions: DataFrame,
    stored: DataFrame,
    scoring: Scoring,
    n_questions: int | None = None,
) -> DataFrame:
    """Ranked list of the best ``scoring.k`` stored rows per question.

    ``questions``: ``query_id, embedding``. ``stored``: ``doc_id, embedding`` and, if the scoring says so,
    ``matches``, an array of question ids and sparse scores.
    """
    questions = questions.select("query_id", "embedding")
    stored = stored.select("doc_id", "embedding", *(["matches"] if scoring.matches else []))
    n_questions = questions.count() if n_questions is None else n_questions
    passes = max(1, -(-n_questions * (8 * scoring.dim + ROW_BYTES) // PASS_BYTES))
    lots = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = [_one_pass(questions.filter(lots == lot), stored, scoring) for lot in range(passes)]
    return top_by_score(reduce(DataFrame.unionByName, found), scoring.k, scoring.metric == "l2")


def _one_pass(questions: DataFrame, stored: DataFrame, scoring: Scoring) -> DataFrame:
    table = questions.toArrow().sort_by("query_id")
    starts = range(0, max(1, table.num_rows), BLOCK_QUESTIONS)
    blocks = [Block(table.slice(start, BLOCK_QUESTIONS), scoring) for start in starts]

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(len(block.ids), scoring.k) for block in blocks]
        for batch in batches:
            for block, best in zip(blocks, bests, strict=True):
                score_batch(best, block, scoring, batch)
        for block, best in zip(blocks, bests, strict=True):
            yield best.candidates(block, scoring.metric != "l2")

    return stored.mapInArrow(best_of_task, CANDIDATES_DDL)
