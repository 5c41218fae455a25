"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

A term is a longest run of ASCII letters, lower-cased, and characters beyond ASCII. A language keeps the
terms that at least `LEAST_DOCS` of its documents hold. Each source, and the language as a whole, gives every
kept term its smoothed share, a whole number of billionths: ``1 + floor(10^9 (count + 5) / (N + 5 V))``.

*Pairs.* The distance of two sources is the sum of differences over all kept terms. Terms are dealt into
chunks by a hash; a chunk holds the shares of all sources of its terms as a matrix (sources without a term
have the share of count 0) and returns sums by pair, never a row for a pair and term. Languages of many
sources are cut into blocks of sources as well.

*Terms.* Which terms a source uses more than its language is a top-k of a score that grows with the
count in the source, falls with the count in the language, and breaks ties by earlier UTF-8. A term that
``k`` others beat in all three cannot be among the best ``k``, whatever the totals. So each partition keeps its
k-skyband, the terms dominated by fewer than ``k`` others, without knowing any share; skybands are merged, and
what remains is ranked exactly.

Counting combines in each task, flushed at `HELD` terms; a hot source or term is a few rows of each task.
Whole numbers are exact at every size (products are decimals of 31 digits).

Defined results: null text, language or source are read as ''; every (lang, source) that occurs has its
pairs, even without terms (value 0 where the language keeps none); repeated rows count as often as they
stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidsearch.session import materialize

LEAST_DOCS = 30
TOP = 50
# Distinct terms that a counting task holds before it emits them.
HELD = 1 << 18
# Bytes of a text that are cut at once.
PIECE = 1 << 20
# Least rows of a chunk, sources of a block, numbers of a matrix.
CHUNK_ROWS, BLOCK, CELLS = 1 << 14, 256, 1 << 20
# Rows that are added to a partition's skyband at once, and skybands that are merged in one task.
BUFFER, FAN_IN = 1 << 16, 32

# ASCII letters in lower case, bytes of other characters as they are, blanks for the rest.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


# --- counting


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, piece by piece, cut at blanks."""
    raw = raw.translate(LETTERS)
    low = 0
    while low < len(raw):
        high = raw.find(b" ", low + PIECE)
        high = len(raw) if high < 0 else high
        yield raw[low:high].split()
        low = high


def _entries(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (count, docs, rows) in held.items():
        # the row without a term says that the group occurs
        terms = [None, *count]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *count.values()], pa.int64()),
                pa.array([rows, *(docs[term] for term in count)], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(2).cast(pa.large_string()).cast(pa.large_binary())
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns[:2]), texts.to_pylist(), strict=True):
                    group = held.setdefault((lang, source), [Counter(), Counter(), 0])
                    before, seen = len(group[0]), set()
                    for words in _words(text):
                        group[0].update(words)
                        seen.update(words)
                    group[1].update(seen)
                    group[2] += 1
                    size += len(group[0]) - before
                    if size > most:
                        yield from _entries(held)
                        held, size = {}, 0
        yield from _entries(held)

    return run


def counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; a null term for the group itself."""
    read = docs.select(*(F.coalesce(name, F.lit("")).alias(name) for name in ("lang", "source", "text")))
    found = read.mapInArrow(_counted(held), "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))``, exactly; null where no term is kept."""
    wide = (count + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    all_shares = F.nullif((total + 5 * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    parts = F.call_function("div", wide, all_shares)
    return F.lit(1).cast("bigint") + parts


class Audit:
    """Counted terms of a table: ``terms`` (lang, source, term, n, of_lang) and ``groups``.

    ``groups``: ``lang, source, number, total, lang_total, v, sources, rows``; one row for each group, numbered
    in its language.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCS):
        every = materialize(counts(docs), "divergence-counts")
        found = every.filter("term is not null")
        of_lang = found.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs"))
        kept = materialize(of_lang.filter(F.col("docs") >= least).drop("docs"), "divergence-kept")
        self.terms = materialize(
            found.drop("docs").join(kept, ["lang", "term"]), "divergence-terms"
        )
        totals = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
        sizes = kept.groupBy("lang").agg(F.sum("of_lang").alias("lang_total"), F.count("*").alias("v"))
        named = every.filter("term is null").select("lang", "source")
        joined = named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        joined = joined.fillna(0, ["total", "rows", "lang_total", "v"])
        of_lang = Window.partitionBy("lang")
        self.groups = materialize(
            joined.withColumn("number", F.row_number().over(of_lang.orderBy("source")) - 1)
            .withColumn("sources", F.count("*").over(of_lang))
            .withColumn("rows", F.sum("rows").over(of_lang)),
            "divergence-groups",
        )


# --- pairs


def _differences(chunk: pa.Table, groups: pa.Table, size: int) -> pa.Table:
    """Sums of differences over the terms of a chunk, between the ``size`` sources of a block and all others."""
    groups = groups.sort_by("number")
    base = groups["base"].to_numpy()
    lang, block = groups["lang"][0].as_py(), groups["block"][0].as_py()
    mine = np.arange(len(base))[block * size : (block + 1) * size]
    sums = np.zeros((len(mine), len(base)), np.int64)
    coded = chunk["term"].combine_chunks().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    term, number, p = term[order], chunk["number"].to_numpy()[order], chunk["p"].to_numpy()[order]
    step = max(1, CELLS // len(base))
    for low in range(0, len(coded.dictionary), step):
        part = slice(*np.searchsorted(term, [low, low + step]))
        shares = np.tile(base, (min(step, len(coded.dictionary) - low), 1))
        shares[term[part] - low, number[part]] = p[part]
        for n, source in enumerate(mine):
            sums[n] += np.abs(shares - shares[:, source : source + 1]).sum(axis=0)
    other = np.tile(np.arange(len(base)), len(mine))
    own = np.repeat(mine, len(base))
    pair = own != other
    return pa.table(
        {
            "lang": pa.array([lang] * int(pair.sum()), pa.string()),
            "number": pa.array(own[pair].astype(np.int64)),
            "other": pa.array(other[pair].astype(np.int64)),
            "value": pa.array(sums.ravel()[pair]),
        }
    )


def pairs(audit: Audit, chunk_rows: int = CHUNK_ROWS, block: int = BLOCK) -> DataFrame:
    """``lang, source, item, value, rank``: the distance of each source to each other one of its language."""
    groups = audit.groups.withColumn("base", share(F.lit(0).cast("bigint"), F.col("total"), F.col("v")))
    groups = groups.withColumn("base", F.coalesce("base", F.lit(0)))
    # a chunk reads at least as many rows as it returns sums
    most = F.greatest(F.lit(chunk_rows), F.col("sources") * F.least("sources", F.lit(block)))
    chunks = F.ceil((F.col("rows") + 1) / most)
    blocks = F.ceil(F.col("sources") / block)
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block")
    dealt = audit.terms.join(groups, ["lang", "source"]).select(
        "lang", "term", "number", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        F.pmod(F.xxhash64("term"), chunks).alias("chunk"), every_block,
    )
    sides = groups.select("lang", "number", "base", "sources", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"))
    # both sides come from the groups, so these columns are named anew
    sides = sides.select(*(F.col(name).alias(name) for name in ("lang", "number", "base", "chunk")), every_block)
    key = ["lang", "chunk", "block"]
    summed = dealt.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(
        lambda chunk, side: _differences(chunk, side, block), "lang string, number bigint, other bigint, value bigint"
    )
    summed = summed.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    own = groups.select("lang", "number", "source")
    other = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    named = summed.join(own, ["lang", "number"]).join(other, ["lang", "other"])
    return _ranked(named.select("lang", "source", "item", "value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


# --- terms


def skyband(rows: pa.Table, k: int) -> pa.Table:
    """The rows that fewer than ``k`` others of their (lang, source) dominate.

    One dominates another by a count ``n`` as high, ``of_lang`` as low and an earlier ``term``. Only rows kept
    so far are looked at: a row that k others dominate is dominated by k of these.
    """
    rows = rows.sort_by(
        [("lang", "ascending"), ("source", "ascending"), ("n", "descending"), ("of_lang", "ascending"), ("term", "ascending")]
    ).combine_chunks()
    size = rows.num_rows
    if size <= k:
        return rows
    new = np.zeros(size, bool)
    for name in ("lang", "source"):
        column = rows[name].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    of_lang = rows["of_lang"].to_numpy()
    place = pc.rank(rows["term"].combine_chunks(), tiebreaker="dense").to_numpy()
    kept = np.zeros(size, bool)
    edges = np.concatenate([[0], np.flatnonzero(new), [size]])
    for first, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        low_kept, place_kept = np.zeros(0, np.int64), np.zeros(0, place.dtype)
        at = first
        while at < end:
            step = min(end, at + max(k, min(512, (1 << 22) // (len(low_kept) + 1))))
            low, early = of_lang[at:step], place[at:step]
            beaten = ((low_kept[:, None] <= low) & (place_kept[:, None] < early)).sum(axis=0)
            open_rows = np.flatnonzero(beaten < k)
            low, early = low[open_rows], early[open_rows]
            # the order puts a row after all that dominate it
            inside = np.triu((low[:, None] <= low) & (early[:, None] < early), 1).sum(axis=0)
            stays = beaten[open_rows] + inside < k
            kept[at + open_rows[stays]] = True
            low_kept = np.concatenate([low_kept, low[stays]])
            place_kept = np.concatenate([place_kept, early[stays]])
            at = step
    return rows.filter(pa.array(kept))


TERMS = "lang string, source string, term string, n bigint, of_lang bigint"


def _skybands(k: int, buffer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= buffer:
                best = skyband(pa.Table.from_batches([*(best.to_batches() if best else ()), *waiting]), k)
                waiting, size = [], 0
        if waiting:
            best = skyband(pa.Table.from_batches([*(best.to_batches() if best else ()), *waiting]), k)
        if best:
            yield from best.to_batches()

    return run


def leading_terms(audit: Audit, k: int = TOP, buffer: int = BUFFER) -> DataFrame:
    """``lang, source, item, value, rank``: the ``k`` terms that a source uses most beyond its language."""
    rows = audit.terms.select("lang", "source", "term", "n", "of_lang")
    parts = rows.mapInArrow(_skybands(k, buffer), TERMS).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "divergence-skybands")

    def merged(table: pa.Table) -> pa.Table:
        return skyband(table.drop_columns("part"), k)

    fan_in = F.floor(F.col("part") / FAN_IN)
    band = parts.groupBy("lang", "source", fan_in).applyInArrow(merged, TERMS)
    known = band.join(audit.groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("of_lang"), F.col("lang_total"), F.col("v"))
    scored = known.select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    return _ranked(scored.filter("value > 0")).filter(F.col("rank") <= k)


def audit(docs: DataFrame, least: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``; ``part`` is ``pair`` or ``term``."""
    found = Audit(docs, least)
    parts = [pairs(found).withColumn("part", F.lit("pair")), leading_terms(found, k).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))
