"""Search by terms over postings in blocks, with MaxScore pruning.

Postings are stored once per model and weighing (`OKAPI`, or `VECTOR` for the sparse part of the convex score). Documents are dealt
to shares by a hash of their id; in a share postings are ordered by term and falling weight, and cut into blocks of `BLOCK`;
a block knows its greatest weight. Folders by a hash of the term let a batch of questions read only the
folders of its terms (dynamic partition pruning). In a folder the table is bucketed by share, so the postings of a hot term are
spread over all shares, and what a question's terms add to a document meets in one task.

A search takes three steps for all questions at once.

1. *A score to beat.* The first block of each asked term gives documents with partial scores; the k-th best of them is
   a score that the k-th answer surely reaches.
2. *Candidates.* Every question gets a level: a document whose postings all add less than it, or less than their
   terms' bounds, stays below the share `UNSEEN` of the score to beat. Only blocks whose greatest weight reaches the level
   are read; common terms, whose bounds are low, are mostly not read at all. What was seen of a document, with the
   level or the bound for each term not seen, is the most it can score. What was seen gives a closer score to beat as well;
   documents that can reach it are candidates.
3. *Scores.* Candidates are scored in full from the index rows of their documents, and ranked.

Sums run where postings are read, share by share, and are not shuffled; the number of shares grows with the documents, so that a
task does not. Bounds need weights of at least 0; where common terms count against a document (negative mean
idf) no bound holds, and every matching document is a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from braidsearch.operators.bm25 import (
    Bm25Model,
    encode_queries,
    okapi_queries,
    okapi_weight,
    terms_size,
    vector_weight,
    weigh_terms,
)
from braidsearch.operators.index import unfold_terms
from braidsearch.operators.ranking import ROW_BYTES, SCORE_DIGITS, broadcast_within, keep_top, top_by_score
from braidsearch.session import fresh_path, materialize
from braidsearch.sources.tables import read_bucketed, write_bucketed

BLOCK = 128
PARTS = 64
# Postings that a task packs at a time, some 50 MB.
HELD = 1 << 20
# Documents and postings of a share, which one task packs and sums.
SHARE_DOCS, SHARE_POSTINGS = 1 << 13, 1 << 22
# Share of the score to beat that postings below the level may add up to.
UNSEEN = 0.1
# What rounding scores may add to one, so that ties after rounding are not lost.
SLACK = 2 * 10.0**-SCORE_DIGITS

# ``share`` is the smallest id of the documents dealt there, ``held`` the number of postings of a block.
PACKED = "share bigint, term string, most double, held int, docs array<bigint>, weights array<double>"
BLOCKS = f"{PACKED}, part int"


@dataclass(frozen=True)
class Weighing:
    """What a posting and an asked term weigh; a score is the sum of their products.

    ``posting(model, tf)`` is an expression over a row with ``dl``, ``asked(q_terms, model, size)`` a table
    ``query_id, term, weight``; ``bounded(model)`` tells whether no weight is below 0.
    """

    posting: Callable[[Bm25Model, Column], Column]
    asked: Callable[[DataFrame, Bm25Model, int], DataFrame]
    bounded: Callable[[Bm25Model], bool]


OKAPI = Weighing(okapi_weight, okapi_queries, lambda model: model.mean_idf >= 0)
VECTOR = Weighing(vector_weight, encode_queries, lambda model: True)


@dataclass(frozen=True)
class Postings:
    """Stored blocks, the model whose weights they hold, which weights these are, and the number of
    folders that terms are dealt to."""

    blocks: DataFrame
    model: Bm25Model
    weighing: Weighing = OKAPI
    parts: int = PARTS


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _blocks(table: pa.Table, size: int) -> pa.RecordBatch:
    """Blocks of up to ``size`` postings from ``share, term, doc_id, weight`` of one share, in any order."""
    terms = table.column("term").combine_chunks().dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False)
    docs, weights = (table.column(name).to_numpy() for name in ("doc_id", "weight"))
    order = np.lexsort((docs, -weights, codes))
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    starts = np.flatnonzero(place % size == 0)
    ends = pa.array(np.append(starts, len(codes)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            table.column("share").combine_chunks().take(pa.array(order[starts])),
            terms.dictionary.take(pa.array(codes[starts])),
            pa.array(weights[order[starts]]),
            pa.array(np.diff(np.append(starts, len(codes))).astype(np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(docs[order])),
            pa.ListArray.from_arrays(ends, pa.array(weights[order])),
        ],
        names=["share", "term", "most", "held", "docs", "weights"],
    )


def _gathered(size: int):
    """Blocks of the postings of a task, `HELD` at a time; a term with more of them gives several runs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield _blocks(pa.Table.from_batches(held), size)
                held, n = [], 0
        if n:
            yield _blocks(pa.Table.from_batches(held), size)

    return run


def shares_for(spark: SparkSession, model: Bm25Model, parts: int) -> int:
    """Shares that hold `SHARE_DOCS` documents and `SHARE_POSTINGS` postings of the model's corpus; more where tasks are many."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) // parts
    return min(most, max(1, tasks, -(-model.n_docs // SHARE_DOCS), -(-model.sum_df // SHARE_POSTINGS)))


def write_postings(
    index: DataFrame,
    model: Bm25Model,
    path: str | None = None,
    block: int = BLOCK,
    parts: int = PARTS,
    weighing: Weighing = OKAPI,
) -> Postings:
    """Store the blocks of ``index`` under ``path`` (default: the shared work folder).

    Index rows are shuffled once, to the share of their document, and packed there; no posting is shuffled. A share is named
    by its smallest id, which falls into the bucket of that share by Spark's own rule.
    """
    spark = index.sparkSession
    path = path or fresh_path(spark, "postings")
    shares = shares_for(spark, model, parts)
    number = F.pmod(F.hash(F.col("doc_id").cast("bigint")), F.lit(shares))
    names = index.select("doc_id", number.alias("number")).groupBy("number").agg(F.min("doc_id").alias("share"))
    rows = index.select("doc_id", "dl", "terms", number.alias("number")).repartitionById(shares, F.col("number"))
    rows = rows.join(broadcast_within(names, shares * ROW_BYTES), "number")
    weight = weighing.posting(model, F.col("tf")).alias("weight")
    weighed = unfold_terms(rows, "share", "doc_id", "dl").select("share", "term", "doc_id", weight)
    packed = weighed.mapInArrow(_gathered(block), PACKED).withColumn("part", part_of(F.col("term"), parts))
    write_bucketed(packed, f"{path}/blocks", "share", shares, "part")
    spark.range(1).select(F.lit(shares).alias("shares")).coalesce(1).write.parquet(f"{path}/shares")
    return read_postings(spark, path, model, weighing, parts)


def read_postings(
    spark: SparkSession, path: str, model: Bm25Model, weighing: Weighing = OKAPI, parts: int = PARTS
) -> Postings:
    """The blocks under ``path``; weighing and number of folders must be those that they were written with."""
    shares = spark.read.schema("shares int").parquet(f"{path}/shares").first().shares
    blocks = read_bucketed(spark, f"{path}/blocks", "share", shares, T.StructType.fromDDL(BLOCKS), "part")
    return Postings(blocks, model, weighing, parts)


def _asked_blocks(stored: Postings, asked: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Blocks of the asked terms; the join on ``part`` prunes folders at run time.

    Spark only does so for a side that is filtered; no term is empty.
    """
    asked = asked.filter(F.col("term") != "").withColumn("part", part_of(F.col("term"), stored.parts))
    return stored.blocks.select("part", "term", *columns).join(broadcast_within(asked, size), ["part", "term"])


def full_scores(pairs: DataFrame, weights: DataFrame, index: DataFrame, stored: Postings, size: int) -> DataFrame:
    """``(query_id, doc_id, score)`` of the given distinct pairs, from the index rows of their documents."""
    rows = index.select("doc_id", "dl", "terms").join(pairs, "doc_id")
    held = unfold_terms(rows, "query_id", "doc_id", "dl")
    matched = held.join(broadcast_within(weights.withColumnRenamed("weight", "asked"), size), ["query_id", "term"])
    score = F.sum(stored.weighing.posting(stored.model, F.col("tf")) * F.col("asked"))
    return matched.groupBy("query_id", "doc_id").agg(score.alias("score"))


def bounds(stored: Postings, weights: DataFrame, size: int) -> DataFrame:
    """``query_id, term, weight, most, lead, bound``: the greatest weight of each asked term, that of the last of its first
    blocks, which hold `BLOCK` postings of all shares, and what the term adds at most."""
    asked = weights.select("term").distinct()
    first = keep_top(_asked_blocks(stored, asked, size, ["most", "held"]), BLOCK, [F.desc("most"), F.desc("held")], "term")
    falling = Window.partitionBy("term").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("held").over(falling), F.lit(0))).filter(F.col("before") < BLOCK)
    most = first.groupBy("term").agg(F.max("most").alias("most"), F.min("most").alias("lead"))
    return weights.join(broadcast_within(most, size), "term").withColumn("bound", F.col("weight") * F.col("most"))


def to_beat(stored: Postings, limits: DataFrame, k: int, size: int) -> DataFrame:
    """``query_id, beat``: a score that the k-th answer of a question reaches; no row where too few are known."""
    lead = _asked_blocks(stored, limits.drop("most"), size, ["share", "most", "docs", "weights"])
    lead = lead.filter(F.col("most") >= F.col("lead"))
    each = lead.select("share", "query_id", "weight", F.inline(F.arrays_zip("docs", "weights")))
    partial = each.groupBy("share", "query_id", F.col("docs").alias("doc_id")).agg(
        F.sum(F.col("weight") * F.col("weights")).alias("score")
    )
    return _kth(partial, k)


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, beat`` from scores that documents reach at least."""
    known = top_by_score(scores, k).filter(F.col("rank") == k)
    return known.select("query_id", (F.col("score") - SLACK).alias("beat"))


def levels(limits: DataFrame, beat: DataFrame, size: int) -> DataFrame:
    """``query_id, term, weight, beat, level, rest, unseen`` of all asked terms.

    ``rest`` is what a posting of the term that is not read adds at most, the smaller of bound and level; ``unseen`` their sum.
    The level is the greatest for which that sum is at most `UNSEEN` of the score to beat: with the bounds
    in rising order, the best of (that share - the first j bounds) / (n - j) over all j.
    """
    of_question = Window.partitionBy("query_id")
    rising = of_question.orderBy("bound", "term")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    known = limits.join(broadcast_within(beat, size), "query_id", "left")
    known = known.withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
    less = F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    left = F.count("*").over(of_question) - F.row_number().over(rising) + 1
    known = known.withColumn("level", (F.lit(UNSEEN) * F.col("beat") - less) / left)
    known = known.withColumn("level", F.max("level").over(of_question))
    known = known.withColumn("rest", F.greatest(F.least("bound", "level"), F.lit(0.0)))
    unseen = F.sum("rest").over(of_question).alias("unseen")
    return known.select("query_id", "term", "weight", "bound", "beat", "level", "rest", unseen)


def seen_above(stored: Postings, known: DataFrame, size: int) -> DataFrame:
    """``query_id, doc_id, score, most, unseen``: what postings above the level add to documents that may still reach
    the score to beat, and the most that these can score."""
    read = known.filter(F.col("bound") >= F.col("level"))
    blocks = _asked_blocks(stored, read, size, ["share", "most", "docs", "weights"])

    def reaches(weight: str) -> Column:
        return F.col("weight") * F.col(weight) >= F.col("level")

    each = blocks.filter(reaches("most")).select(
        "share", "query_id", "weight", "level", "rest", F.inline(F.arrays_zip("docs", "weights"))
    )
    adds = F.col("weight") * F.col("weights")
    # a document is in one share, so its sums stay in the share's task
    seen = each.filter(reaches("weights")).groupBy("share", "query_id", F.col("docs").alias("doc_id")).agg(
        F.sum(adds).alias("score"), F.sum("rest").alias("rest")
    )
    asked = known.select("query_id", "beat", "unseen").distinct()
    seen = seen.join(broadcast_within(asked, size), "query_id")
    seen = seen.withColumn("most", F.col("score") - F.col("rest") + F.col("unseen"))
    return seen.filter(F.col("most") >= F.col("beat")).select("query_id", "doc_id", "score", "most")


def candidates(stored: Postings, limits: DataFrame, beat: DataFrame, k: int, size: int) -> DataFrame:
    """``query_id, doc_id`` of every document that may be among the best ``k``."""
    seen = materialize(seen_above(stored, levels(limits, beat, size), size), "seen")
    # what was seen is a closer score to beat than that of the leads
    closer = materialize(_kth(seen, k), "asked-beat")
    left = seen.join(broadcast_within(closer, size), "query_id", "left")
    return left.filter(F.col("beat").isNull() | (F.col("most") >= F.col("beat"))).select("query_id", "doc_id")


def blockmax_topk(
    q_terms: DataFrame, index: DataFrame, stored: Postings, k: int = 5, size: int | None = None
) -> DataFrame:
    """Best ``k`` matching documents of each question; by `OKAPI` weights the list of `hybrid.okapi_topk` without padding.

    ``index`` are the rows that ``stored`` was written from, ``q_terms`` the terms of the questions.
    """
    size = terms_size(q_terms) if size is None else size
    weights = materialize(stored.weighing.asked(q_terms, stored.model, size), "asked-terms")
    limits = materialize(bounds(stored, weights, size), "asked-bounds")
    if stored.weighing.bounded(stored.model):
        beat = materialize(to_beat(stored, limits, k, size), "asked-beat")
    else:
        beat = limits.select("query_id", F.lit(0.0).alias("beat")).limit(0)
    pairs = materialize(candidates(stored, limits, beat, k, size), "candidates")
    return top_by_score(full_scores(pairs, weights, index, stored, size), k)
