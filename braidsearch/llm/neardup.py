"""Near-duplicate documents by DartMinHash signatures and a banded join.

A text is the weighted set of its five-word shingles, the weight of one being how often it stands
there; a text of fewer words, but not none, is one shingle. Similarity is the weighted Jaccard
measure, links need `SIMILAR`.

*Signature.* Over every element hangs a sheet of darts, the same for all texts: a Poisson number of
them in each cell of weight and rank, with places drawn from a hash of element and cell. A text
of total weight W sees the darts below each element's weight and of rank below t / W, about
t = K ln K + 2 K in all, whatever its size. Each dart belongs to one of K coordinates; the earliest of each
is the signature. Texts that leave a coordinate empty look twice as far. Two signatures agree in a
coordinate with the probability of their similarity.

*Banded join.* ``ROWS`` coordinates are a band; texts that agree in a band meet in a bucket. With 24
bands of 5 a pair of similarity 0.8 meets with probability 0.99993. Every meeting pair is decided
by its shingles, but no group is paired with itself: members are first compared with the head of
their bucket, the one that meets most texts, and what proves similar is one class. Then only members
of different classes that still share a bucket are compared: those outside the bucket's largest class
against all others, in tiles of bounded size, inside tasks that return links and no pairs.

Exact copies of words are one text from the start, so any number of them costs one signature, and
links and classes are joins and aggregates of ids; nothing is collected.

Defined results: texts without words (null and empty ones too) are in no group, each row is a class
of its own; repeated rows and ids are copies; null ids are kept, their class is null only if all
its ids are; ties go to the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsearch.llm import words as wd
from braidsearch.session import materialize

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 24
# Height of the lowest rank cell; each further one is as high as all below it.
LOWEST = 0.125
# Texts whose darts a task throws at once: some 800 each, however short they are.
SIGNED = 512
# Members of a bucket on each side of a tile, rows that a task compares at once, and shared elements it
# holds.
TILE, GROUP_ROWS, SHARED = 256, 2000, 1 << 21
# Bytes of ids that may be broadcast to pick the texts to compare.
BROADCAST_BYTES = 64 << 20


# --- signatures


def shingles(cut: wd.Cut, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text and shingle."""
    n = np.diff(cut.first)
    start = np.arange(len(cut.hash))
    # windows begin at every word but the last ones of a text; short texts begin one at their first
    last = np.maximum(cut.first[1:] - size, cut.first[:-1])
    start = start[start <= last[cut.doc]]
    end = np.minimum(start + size, cut.first[cut.doc[start] + 1])
    keys = wd.Rolling(cut.hash).pieces(start, end)
    doc = np.repeat(np.arange(len(n)), np.where(n > 0, last - cut.first[:-1] + 1, 0))
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(doc)))
    return doc[at], keys[at], weight


_poisson: dict[float, np.ndarray] = {}


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities; their number is bounded by the spread of the mean."""
    if mean not in _poisson:
        n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
        _poisson[mean] = np.cumsum(np.exp(n * np.log(mean) - mean - logs))
    return _poisson[mean]


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _cells(limit: float, lowest: float) -> Iterator[tuple[int, float, float]]:
    """Number, bottom and height of the cells below ``limit``: 0..lowest, then doubling."""
    yield 0, 0.0, lowest
    n, bottom = 1, lowest
    while bottom < limit:
        yield n, bottom, bottom
        n, bottom = n + 1, 2 * bottom


def _darts(doc, key, weight, reach, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, coordinate, rank, dart) of the darts that each text sees, cell by cell.

    ``reach`` is the rank up to which a text looks.
    """
    if not len(doc):
        return
    far = reach[doc]
    for column, left, width in _cells(float(weight.max()), 1.0):
        inside = weight > left
        for level, bottom, height in _cells(float(far[inside].max()), LOWEST):
            seen = inside & (far > bottom) if bottom else inside
            cell = (((column << 8) + level) * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
            base = wd.mix(key[seen] ^ np.uint64(cell))
            count = np.searchsorted(_poisson_table(width * height), _uniform(base))
            total = int(count.sum())
            if not total:
                continue
            owner = np.repeat(np.flatnonzero(seen), count)
            number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            dart = wd.mix(np.repeat(base, count) + (number + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            rank = bottom + height * _uniform(wd.mix(dart + np.uint64(1)))
            good = rank <= far[owner]
            if column or width != 1.0:
                good &= left + width * _uniform(wd.mix(dart + np.uint64(2))) <= weight[owner]
            owner, dart = owner[good], dart[good]
            yield doc[owner], (wd.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64), rank[good], dart


def signatures(doc, key, weight, n: int, k: int) -> np.ndarray:
    """Earliest dart of every coordinate for each of ``n`` texts; 0 for texts without elements.

    ``doc`` is sorted; a weight may be any positive number: cells above 1 double in width.
    """
    total = np.bincount(doc, weight, minlength=n)
    goal = k * np.log(k) + 2 * k
    reach = np.zeros(n)
    np.divide(goal, total, out=reach, where=total > 0)
    found = np.zeros((n, k), np.uint64)
    left = total > 0
    while left.any():
        mine = left[doc]
        first = np.full(n * k, np.inf)
        # darts of one cell at a time, each beside the earliest so far
        for text, coordinate, rank, dart in _darts(doc[mine], key[mine], weight[mine], reach, k):
            place = text * k + coordinate
            np.minimum.at(first, place, rank)
            won = rank == first[place]
            found[text[won], coordinate[won]] = dart[won]
        empty = np.isinf(first).reshape(n, k).any(axis=1)
        left &= empty
        reach = np.where(left, 2 * reach, reach)
    return found


def bands(found: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates."""
    n, k = found.shape
    keys = np.zeros((n, k // rows), np.uint64)
    for at in range(rows):
        keys = wd.mix(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, at::rows][:, : k // rows])
    return wd.mix(keys + np.arange(k // rows, dtype=np.uint64))


def _copy_keys(cut: wd.Cut) -> list[bytes | None]:
    """128 bits that name the word sequence of each text; null without words."""
    first, end = cut.first[:-1], cut.first[1:]
    low = wd.Rolling(cut.hash).pieces(first, end)
    high = wd.Rolling(wd.mix(cut.hash + np.uint64(1))).pieces(first, end)
    both = np.stack([high, low], axis=1).astype(">u8")
    return [row.tobytes() if n else None for row, n in zip(both, (end - first).tolist(), strict=True)]


def _signed(rows: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, cut in wd.cuts(batch.column(1), SIGNED):
                doc, key, weight = shingles(cut)
                found = signatures(doc, key, weight.astype(float), high - low, rows * n_bands)
                keys = bands(found, rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(_copy_keys(cut), pa.binary()),
                        pa.array(np.bincount(doc, weight, minlength=high - low).astype(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), n_bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "copy", "weight", "bands"],
                )

    return run


def signed(docs: DataFrame, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """``row, doc_id, copy, weight, bands`` of every document; ``row`` is unique, once written."""
    found = docs.mapInArrow(
        _signed(rows, n_bands), "doc_id bigint, copy binary, weight bigint, bands array<bigint>"
    )
    return found.withColumn("row", F.monotonically_increasing_id())


# --- links


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of texts as sets of numbers: the n-th copy of a shingle is an element of its own."""
    for batch in batches:
        for low, high, cut in wd.cuts(batch.column(0)):
            doc, key, weight = shingles(cut)
            copies = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            element = wd.mix(np.repeat(key, weight) + copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ends = np.cumsum(np.bincount(np.repeat(doc, weight), minlength=high - low))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            sets = pa.ListArray.from_arrays(offsets, pa.array(element.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_copy_keys(cut), pa.binary()), sets], names=["copy", "elements"]
            )


def _elements(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text, elements`` of the texts in ``wanted``; any document with their id may supply them."""
    named = texts.join(wanted, "text").select("text", "doc_id", "copy")
    ids = named.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = materialize(ids, "neardup-wanted")
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    found = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = found.select("text").mapInArrow(_multisets, "copy binary, elements array<bigint>")
    return named.join(sets, "copy").dropDuplicates(["text"]).select("text", "elements")


def similar_pairs(pairs: DataFrame, elements: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The ``a, b`` whose weighted Jaccard measure reaches ``similar``."""
    left = elements.select(F.col("text").alias("a"), F.col("elements").alias("of_a"))
    right = elements.select(F.col("text").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return both.filter(shared >= F.lit(similar) * union - F.lit(1e-9)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``text, class``: the smallest text that each linked one reaches.

    Every round takes the smallest label among neighbours, then the label of that label, so
    rounds grow with the logarithm of a chain's length.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    both = materialize(both.distinct(), "neardup-links")
    labels = both.groupBy(F.col("a").alias("text")).agg(F.min("b").alias("near"))
    labels = labels.select("text", F.least("text", "near").alias("class"))
    labels = materialize(labels, "neardup-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("text", "b"), "b").groupBy("a").agg(F.min("class").alias("near"))
        closer = labels.join(seen, labels["text"] == seen["a"]).select(
            "text", F.col("class").alias("old"), F.least("class", "near").alias("class")
        )
        over = labels.select(F.col("text").alias("class"), F.col("class").alias("next"))
        moved = closer.join(over, "class", "left").select(
            "text", "old", F.least("class", F.coalesce("next", "class")).alias("class")
        )
        moved = materialize(moved, "neardup-labels")
        labels = moved.select("text", "class")
        if moved.filter(F.col("old") != F.col("class")).isEmpty():
            return labels


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (text, class) after links between classes."""
    joined = components(links)
    kept = classes.join(joined.select(F.col("text").alias("class"), F.col("class").alias("to")), "class", "left")
    return materialize(kept.select("text", F.coalesce("to", "class").alias("class")), "neardup-classes")


def classes(docs: DataFrame, rows: int = ROWS, n_bands: int = BANDS, similar: float = SIMILAR) -> DataFrame:
    """``row, doc_id, copy, class, group`` of every document of ``docs`` (``doc_id``, ``text``).

    ``class`` is the smallest doc_id of its group; ``group`` is null for texts without words.
    """
    docs = docs.select("doc_id", "text")
    every = materialize(signed(docs, rows, n_bands), "neardup-signed")
    with_words = every.filter(F.col("copy").isNotNull())
    firsts = with_words.groupBy("copy").agg(F.min("row").alias("text"))
    # one row for each distinct text, named by its first row
    texts = materialize(
        every.join(firsts.select("text"), every["row"] == F.col("text"))
        .select("text", "doc_id", "copy", "weight", "bands"),
        "neardup-texts",
    )
    members = texts.select("text", "weight", F.explode("bands").alias("key"))
    met = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    buckets = materialize(members.join(met, "key"), "neardup-buckets")
    # the texts that meet most others are the likeliest to be similar to all of a group
    company = buckets.groupBy("text").agg(F.sum("n").alias("company"))
    ranked = buckets.join(company, "text")
    first = F.struct("company", -F.col("text"))
    heads = ranked.groupBy("key").agg(F.max(first).alias("best"))
    heads = heads.select("key", (-F.col("best.col2")).alias("head"), F.col("best.company").alias("company"))
    pairs = buckets.join(heads, "key").filter(F.col("head") != F.col("text"))
    pairs = materialize(
        pairs.groupBy(F.col("head").alias("a"), F.col("text").alias("b")).agg(
            F.max("company").alias("company"), F.max("weight").alias("weight_b")
        ),
        "neardup-heads",
    )
    wanted = buckets.select("text").distinct()
    elements = materialize(_elements(docs, texts, wanted), "neardup-elements")

    # first with one head each: most of a group falls together here
    best = F.max_by("a", F.struct("company", -F.col("a"))).alias("a")
    tried = materialize(pairs.groupBy("b").agg(best).select("a", "b"), "neardup-tried")
    found = wanted.withColumn("class", F.col("text"))
    found = _merged(found, similar_pairs(tried, elements, similar))
    # then with the heads of all buckets, where classes differ
    more = materialize(_with_heads(pairs, found, texts, similar).join(tried, ["a", "b"], "left_anti"), "neardup-tried")
    found = _merged(found, _between(similar_pairs(more, elements, similar), found))
    # then all that still share a bucket
    links = materialize(_across(buckets, found, elements, similar), "neardup-across")
    found = _merged(found, _between(similar_pairs(links, elements, similar), found))

    of_text = firsts.join(found, "text", "left").select("copy", F.coalesce("class", "text").alias("group"))
    grouped = with_words.join(of_text, "copy").select("row", "doc_id", "copy", "group")
    names = grouped.groupBy("group").agg(F.min("doc_id").alias("class"))
    alone = every.filter(F.col("copy").isNull()).select("row", "doc_id", "copy", F.col("doc_id").alias("class"))
    return grouped.join(names, "group").select("row", "doc_id", "copy", "class", "group").unionByName(
        alone.withColumn("group", F.lit(None).cast("bigint"))
    )


def _possible(similar: float):
    """Weights between which a link can be: the smaller is at least ``similar`` times the larger."""
    low, high = F.least("weight_a", "weight_b"), F.greatest("weight_a", "weight_b")
    return low >= F.lit(similar) * high - F.lit(1e-9)


def _between(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links between texts as links between their classes."""
    of_a = found.select(F.col("text").alias("a"), F.col("class").alias("class_a"))
    of_b = found.select(F.col("text").alias("b"), F.col("class").alias("class_b"))
    ends = links.join(of_a, "a").join(of_b, "b").filter(F.col("class_a") != F.col("class_b"))
    return ends.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _with_heads(pairs: DataFrame, found: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Members and heads of buckets that are in different classes."""
    weights = texts.select(F.col("text").alias("a"), F.col("weight").alias("weight_a"))
    of_a = found.select(F.col("text").alias("a"), F.col("class").alias("class_a"))
    of_b = found.select(F.col("text").alias("b"), F.col("class").alias("class_b"))
    open_pairs = pairs.join(of_a, "a").join(of_b, "b").filter(F.col("class_a") != F.col("class_b"))
    return open_pairs.join(weights, "a").filter(_possible(similar)).select("a", "b")


def _across(buckets: DataFrame, found: DataFrame, elements: DataFrame, similar: float) -> DataFrame:
    """Links between members of different classes in one bucket, at least one for each two classes.

    Members outside the largest class of a bucket meet all members, in tiles of `TILE` rows.
    Shingles travel as 32 bits, which can only find too much; links are decided in full afterwards.
    """
    members = buckets.join(found, "text").select("key", "text", "weight", "class")
    sizes = members.groupBy("key", "class").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("key").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"), F.sum("n").alias("all"),
        (F.sum("n") - F.max("n")).alias("outside"),
    ).filter(F.col("outside") > 0)
    mixed = materialize(members.join(spread, "key"), "neardup-mixed")
    short = elements.select("text", F.transform("elements", lambda e: F.shiftright(e, 32).cast("int")).alias("elements"))
    down, over = (F.ceil(F.col(side) / TILE).cast("int") for side in ("outside", "all"))

    def tiled(rows: DataFrame, own: str, n_own, other: str, n_other) -> DataFrame:
        dealt = rows.withColumn(own, F.pmod(F.xxhash64("text"), n_own).cast("int"))
        every = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))
        # one number for the tile: rows of different tiles are never compared
        tile = F.xxhash64("key", "down", "over").alias("tile")
        joined = every.select(tile, "text", "weight", "class").join(short, "text")
        # both sides come from the same rows, so each names its columns anew
        return joined.select(*(F.col(name).alias(name) for name in joined.columns))

    left = tiled(mixed.filter(F.col("class") != F.col("main")), "down", down, "over", over)
    right = tiled(mixed, "over", over, "down", down)
    # rows of all tiles, counted before any is made
    tiles = F.sum((F.col("outside") * over + F.col("all") * down) / F.col("all"))
    groups = max(1, int(mixed.agg(tiles).first()[0] or 0) // GROUP_ROWS)

    def dealt(rows: DataFrame):
        return rows.groupBy(F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("group"))

    return dealt(left).cogroup(dealt(right)).applyInArrow(_compared(similar), "a bigint, b bigint").distinct()


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, element mixed with the row's tile) of all rows."""
    sets = table["elements"].combine_chunks()
    row = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy())
    tile = table["tile"].to_numpy().astype(np.int64).view(np.uint64)
    element = sets.flatten().to_numpy().astype(np.int64).view(np.uint64)
    return row, wd.mix(tile[row] + element * np.uint64(0x9E3779B97F4A7C15))


def _compared(similar: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts_a, weight_a = left["text"].to_numpy(), left["weight"].to_numpy()
        texts_b, weight_b = right["text"].to_numpy(), right["weight"].to_numpy()
        ones, others = [], []
        class_a, class_b = left["class"].to_numpy(), right["class"].to_numpy()
        row_a, key_a = _flat(left)
        row_b, key_b = _flat(right)
        order = np.argsort(key_a)
        row_a, key_a = row_a[order], key_a[order]
        low = np.searchsorted(key_a, key_b, "left")
        count = np.searchsorted(key_a, key_b, "right") - low
        ends = np.cumsum(np.bincount(row_b, count, minlength=len(texts_b))).astype(np.int64)
        first = np.searchsorted(row_b, np.arange(len(texts_b) + 1))
        start = 0
        while start < len(texts_b):
            done = ends[start - 1] if start else 0
            # as many rows of the right as share a bounded number of elements with the left
            end = max(start + 1, int(np.searchsorted(ends, done + SHARED, "right")))
            end = min(end, start + max(1, SHARED // max(1, len(texts_a))))
            part = slice(first[start], first[end])
            n = count[part]
            at = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = row_a[at] * (end - start) + np.repeat(row_b[part] - start, n)
            shared = np.bincount(cell, minlength=len(texts_a) * (end - start))
            hit = np.flatnonzero(shared)
            i, j = hit // (end - start), hit % (end - start) + start
            union = weight_a[i] + weight_b[j] - shared[hit]
            good = (shared[hit] >= similar * union - 1e-9) & (class_a[i] != class_b[j])
            ones.append(texts_a[i[good]])
            others.append(texts_b[j[good]])
            start = end
        empty = np.zeros(0, np.int64)
        found = np.stack([np.concatenate([empty, *ones]), np.concatenate([empty, *others])])
        found = np.unique(np.sort(found, axis=0), axis=1)
        return pa.table({"a": found[0].astype(np.int64), "b": found[1].astype(np.int64)})

    return run


def _with_copy_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the name of each text's word sequence as one binary column more."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    names = [field.name for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key for _, _, cut in wd.cuts(batch.column(at)) for key in _copy_keys(cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names)

    return wd.mapped(docs, run, schema)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Of every group the document with the smallest id, its row unchanged.

    Null ids come last; documents that share id and words count as one.
    """
    found = materialize(classes(docs, **options), "neardup-found").filter(F.col("group").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")
    stays = found.groupBy("group").agg(F.min(order).alias("stays"))
    rows = found.select("group", "doc_id", "copy").distinct().join(stays, "group")
    goes = rows.filter(
        ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("copy") == F.col("stays.copy")))
    )
    key, gone_id, gone_copy = (wd.free_name(docs, name) for name in ("copy", "gone_id", "gone_copy"))
    goes = materialize(goes.select(F.col("doc_id").alias(gone_id), F.col("copy").alias(gone_copy)), "neardup-gone")
    if goes.count() * 48 <= BROADCAST_BYTES:
        goes = F.broadcast(goes)
    keyed = _with_copy_key(docs, key)
    same = (F.col(key) == F.col(gone_copy)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
    kept = keyed.join(goes, same, "left_anti")
    repeats = found.groupBy("doc_id", "copy").count().filter(F.col("count") > 1)
    if not repeats.isEmpty():
        kept = kept.filter(F.col(key).isNotNull()).dropDuplicates(["doc_id", key]).union(
            kept.filter(F.col(key).isNull())
        )
    return kept.select(*wd.quoted(docs))
