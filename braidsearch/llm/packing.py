"""Length buckets with least padding, and batches of a token budget inside each.

The lengths of all documents are counted into one histogram; dynamic programming chooses the bucket
boundaries, and with them the lengths that texts are padded to, for which padding is least among
all choices of that many buckets. Inside a bucket, batches hold as many documents as the token
budget has room for at the bucket's length, and every batch but a bucket's last is full.

The histogram is bounded whatever the corpus: lengths up to ``2^PRECISION`` are counted one by one,
longer ones in cells a ``2^-PRECISION``-th of their size wide, at most some 8,000 cells in all. A cell stands for
the longest length in it, so every boundary is the length of a document. Texts are not shuffled:
ids and lengths are dealt into chunks, ranked inside them, and a running sum of the chunks' counts
turns that into ranks of the bucket. No chunk, task or window holds more than its share.

Defined results: a null or empty text has no tokens; it goes to a bucket like any other length, and a
batch of it holds as many documents as ``budget``; a text longer than the budget is a batch of its own;
null ids come first; rows with equal id and length are interchangeable; fewer lengths than buckets
give a bucket each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidsearch.llm import words as wd
from braidsearch.session import materialize

BUCKETS = 12
BUDGET = 65_536
PRECISION = 8
# Documents that are ranked together.
CHUNK = 1024


def cell(length: Column, precision: int = PRECISION) -> Column:
    """The histogram cell of a length: itself, or its leading ``precision + 1`` binary digits."""
    digits = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    shift = F.greatest(digits - precision, F.lit(0))
    return F.call_function("shiftright", length, shift) + F.lit(1 << 40) * shift


def chunk_of(doc_id: Column, chunks: int) -> Column:
    """The first 60 bits of the MD5 of an id, modulo ``chunks``; a null id is as ''."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % chunks


def boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of the buckets with the least padding.

    Cells come in ascending order with their longest length, documents and tokens. Ties go to the
    fewest buckets, then to the smallest cut. The cost of a bucket fulfils the quadrangle inequality, so the best
    cut moves one way and each layer needs about n log n looks.
    """
    n = len(longest)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)

    def cost(low, high: int):
        """Padding of one bucket that holds the cells ``low`` to ``high`` - 1."""
        return longest[high - 1] * (docs[high] - docs[low]) - (tokens[high] - tokens[low])

    best = np.array([0] + [cost(0, high) for high in range(1, n + 1)], dtype=np.int64)
    cuts: list[np.ndarray] = []
    for layer in range(2, min(buckets, n) + 1):
        after, cut = np.full(n + 1, np.iinfo(np.int64).max), np.zeros(n + 1, np.int64)
        todo = [(layer, n, layer - 1, n - 1)]
        while todo:
            first, last, least, most = todo.pop()
            if first > last:
                continue
            high = (first + last) // 2
            low = np.arange(least, min(most, high - 1) + 1)
            costs = best[low] + cost(low, high)
            at = int(np.argmin(costs))
            after[high], cut[high] = costs[at], low[at]
            todo += [(first, high - 1, least, int(low[at])), (high + 1, last, int(low[at]), most)]
        if after[n] >= best[n]:
            break
        best = after
        cuts.append(cut)
    ends, high = [n], n
    for cut in cuts[::-1]:
        high = int(cut[high])
        ends.append(high)
    return [int(longest[high - 1]) for high in ends[::-1]]


def histogram(lengths: DataFrame, precision: int = PRECISION):
    """Longest length, documents and tokens of every cell, ascending; a bounded number of rows."""
    cells = lengths.groupBy(cell(F.col("n_tokens"), precision).alias("cell")).agg(
        F.max("n_tokens").alias("longest"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")
    )
    rows = cells.orderBy("longest").toPandas()
    return (rows[name].to_numpy(np.int64) for name in ("longest", "docs", "tokens"))


def pack(
    docs: DataFrame,
    n_tokens: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    precision: int = PRECISION,
    chunk: int = CHUNK,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_to, batch, slot`` of every document.

    ``n_tokens`` is the length of a document, by default its number of words. Batches count from 0 in
    each bucket, slots from 0 in each batch.
    """
    length = wd.words_count(F.col("text")) if n_tokens is None else n_tokens
    lengths = docs.select("doc_id", F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"))
    lengths = materialize(lengths, "packing-lengths")
    ends = boundaries(*histogram(lengths, precision), buckets) or [0]
    limits = F.array(*(F.lit(end).cast("bigint") for end in ends))
    bucket = F.size(F.filter(limits, lambda end: end < F.col("n_tokens")))
    placed = lengths.withColumn("bucket", bucket).withColumn("padded_to", F.element_at(limits, F.col("bucket") + 1))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("bigint")

    chunks = max(1, -(-lengths.count() // chunk))
    placed = placed.withColumn("chunk", chunk_of(F.col("doc_id"), chunks))
    within = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")
    ranked = placed.withColumn("n", F.row_number().over(within) - 1)
    # where each chunk begins in its bucket: a row for each bucket and chunk, not for each document
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("docs"))
    begins = sizes.select("bucket", "chunk", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("begin"))
    rank = F.col("n") + F.col("begin")
    return ranked.join(begins, ["bucket", "chunk"]).select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        "padded_to",
        F.floor(rank / room).cast("bigint").alias("batch"),
        (rank % room).cast("int").alias("slot"),
    )
