"""Families of near copies, with Spark functions only.

A text is the set of its five-word shingles, of which the `KEPT` smallest hashes are its sketch; texts of
fewer shingles are kept whole, so short texts are compared exactly. Texts meet where two of the elements
that `BANDS` pairs of orders put first are the same: a pair of similarity 0.8 meets with probability
0.9999999, one of 0.5 with 0.99. Members of a bucket are compared with its smallest member, so
a bucket of any size costs a comparison for each member, and pairs that prove similar are edges. A family
is what edges connect; labels go along them until none changes.

Texts are named by a hash; texts that are alone in their family have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.session import materialize

SHINGLE = 5
KEPT = 128
BANDS = 16


def _orders() -> list[int]:
    """Two constants for each band; hashes xored with one are in another order."""
    mixed = (n * 0x9E3779B97F4A7C15 % (1 << 64) for n in range(1, 2 * BANDS + 1))
    return [(n ^ n >> 29) * 0xBF58476D1CE4E5B9 % (1 << 63) for n in mixed]


def sketches(texts: DataFrame, id: str = "id") -> DataFrame:
    """``id, sketch`` of every text that has words, once for each id."""
    words = texts.select(id, F.expr("transform(split(trim(text), r'\\s+'), w -> xxhash64(w))").alias("words"))
    following = ", ".join(f"get(words, i + {n})" for n in range(1, SHINGLE))
    shingles = words.select(
        id, F.expr(f"slice(transform(words, (w, i) -> xxhash64(w, {following})), 1, greatest(size(words) - {SHINGLE - 1}, 1))").alias("shingles")
    )
    kept = shingles.select(id, F.slice(F.sort_array(F.array_distinct("shingles")), 1, KEPT).alias("sketch"))
    return kept.groupBy(id).agg(F.first("sketch").alias("sketch"))


def edges(texts: DataFrame, least: float) -> DataFrame:
    """``a, b, similar``: texts and a smaller member of one of their buckets, at least so similar."""
    known = materialize(sketches(texts), "family-sketches")
    # least elements as aggregates: compiled, where a function over each array is not
    mixed = known.select("id", F.explode("sketch").alias("x")).select("id", F.xxhash64("x").alias("x"))
    firsts = mixed.groupBy("id").agg(
        *(F.min(F.col("x").bitwiseXOR(F.lit(c))).alias(f"first_{n}") for n, c in enumerate(_orders()))
    )
    bands = F.array(*(F.xxhash64(F.lit(n), f"first_{2 * n}", f"first_{2 * n + 1}") for n in range(BANDS)))
    met = materialize(firsts.select("id", F.explode(bands).alias("band")), "family-bands")
    heads = met.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = met.join(heads, "band").filter("id != b").select(F.col("id").alias("a"), "b").distinct()
    of_a = known.select(F.col("id").alias("a"), F.col("sketch").alias("of_a"))
    of_b = known.select(F.col("id").alias("b"), F.col("sketch").alias("of_b"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    first = both.withColumn("first", F.slice(F.sort_array(F.array_union("of_a", "of_b")), 1, KEPT))
    shared = F.size(F.array_intersect(F.array_intersect("first", "of_a"), "of_b"))
    compared = first.select("a", "b", (shared / F.size("first")).alias("similar"))
    return materialize(compared.filter(F.col("similar") >= least), "family-edges")


def connected(edges: DataFrame, label: str) -> DataFrame:
    """``id, label``: the smallest id that edges connect to each id."""
    ways = edges.select("a", "b").union(edges.select("b", "a"))
    labels = materialize(
        ways.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias(label)), "family-labels"
    )
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col(label).alias("seen"))
        around = ways.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("near"))
        # the label of a label, so that long chains take few turns
        jump = labels.select(F.col("id").alias(label), F.col(label).alias("far"))
        turned = labels.join(around, "id").join(jump, label).select(
            "id", F.least(label, "near", "far").alias(label), (F.least("near", "far") < F.col(label)).alias("moved")
        )
        turned = materialize(turned, "family-labels")
        labels = turned.drop("moved")
        if turned.filter("moved").isEmpty():
            return labels
