"""Benchmark decontamination: windows of test items looked up in training texts.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none,
is one window. Hashes of all windows are a sorted set that goes to every task; a task cuts
its texts into words, hashes every window, looks it up, and compares the words of what it
finds, so a hash alone never counts. The set is bounded: items are dealt into blocks of
about ``BLOCK_WORDS`` words, and each block is one narrow pass that appends to the hits of a
row. No text is shuffled and no document group is formed, so hot sources or copies cost
what their bytes cost.

Defined results: null and empty texts have no words and no hits; items that are null, empty or
without id take no part; an id on several item rows counts once; repeated documents are
separate rows; an empty benchmark hits nothing. Other columns are neither read nor changed,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsearch.llm import words as wd
from braidsearch.session import materialize

WIDTH = 13
# Words of test items whose windows are held by a task at once (about 60 bytes each).
BLOCK_WORDS = 1_000_000
# A document is contaminated if at least one word in so many is hit.
SHARE = 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
    ]
)


class Windows:
    """Windows of some test items, by width: sorted hashes, words, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        texts = pa.array([text for _, text in items], pa.large_string())
        for low, _, cut in wd.cuts(texts):
            for n in range(len(cut.first) - 1):
                first, last = int(cut.first[n]), int(cut.first[n + 1])
                size = min(width, last - first)
                if not size:
                    continue
                rolled = wd.Rolling(cut.hash[first:last])
                start = np.arange(last - first - size + 1)
                for at, key in zip(start, rolled.pieces(start, start + size), strict=True):
                    same = found.setdefault(size, {}).setdefault(int(key), {})
                    phrase = cut.joined(first + at, first + at + size)
                    same.setdefault(phrase, set()).add(items[low + n][0])
        self.by_size = {}
        for size, keys in found.items():
            ordered = np.array(sorted(keys), dtype=np.uint64)
            self.by_size[size] = (ordered, [keys[int(key)] for key in ordered], _marks(ordered))

    def find(self, cut: wd.Cut) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of every window in the texts of ``cut``, verified."""
        rolled = wd.Rolling(cut.hash)
        for size, (ordered, phrases, marks) in self.by_size.items():
            start = np.arange(max(0, len(cut.hash) - size + 1))
            start = start[cut.doc[start] == cut.doc[start + size - 1]]
            key = rolled.pieces(start, start + size)
            maybe = marks[(key >> np.uint64(44)).astype(np.int64)]
            start, key = start[maybe], key[maybe]
            at = np.searchsorted(ordered, key)
            at[at == len(ordered)] = 0
            same = ordered[at] == key
            for first, number in zip(start[same], at[same], strict=True):
                items = phrases[number].get(cut.joined(first, first + size))
                if items:
                    yield int(first), int(first) + size, items


def _marks(ordered: np.ndarray) -> np.ndarray:
    """For the high bits of a hash, whether the set holds any such."""
    marks = np.zeros(1 << 20, dtype=bool)
    marks[(ordered >> np.uint64(44)).astype(np.int64)] = True
    return marks


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(texts: pa.Array, windows: Windows, before: list[dict] | None) -> list[dict]:
    rows = []
    for low, high, cut in wd.cuts(texts):
        spans: list[list[tuple[int, int]]] = [[] for _ in range(low, high)]
        items: list[set[str]] = [set() for _ in range(low, high)]
        for first, end, names in windows.find(cut):
            n, offset = int(cut.doc[first]), int(cut.first[cut.doc[first]])
            spans[n].append((first - offset, end - offset))
            items[n] |= names
        for n, size in enumerate(np.diff(cut.first).tolist()):
            if before and before[low + n]:
                old = before[low + n]
                spans[n] += zip(old["starts"], old["ends"], strict=True)
                items[n] |= set(old["items"])
            merged = _merged(spans[n])
            rows.append(
                {
                    "n_words": size,
                    "n_hit": sum(end - start for start, end in merged),
                    "items": sorted(items[n]),
                    "starts": [start for start, _ in merged],
                    "ends": [end for _, end in merged],
                }
            )
    return rows


def blocks(benchmark: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[list]:
    """Items in bounded blocks: ``[(id as string, text)]``."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    items = items.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    # words are no more than half the bytes
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    n = -(-size // block_words) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for block in range(n):
        rows = dealt.filter(F.col("block") == block).select("id", "text").collect()
        yield [(row.id, row.text) for row in rows]


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    hits: str,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a struct column ``hits``: word count, hit words, items, hit word spans."""
    schema = T.StructType([*docs.schema.fields, T.StructField(hits, HITS)])
    at = docs.columns.index(text)
    arrow = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    )

    def one_pass(windows: Windows, again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist() if again else None
                found = pa.array(_scan(batch.column(at), windows, before), arrow)
                kept = batch.columns[:-1] if again else batch.columns
                names = [field.name for field in schema.fields]
                yield pa.RecordBatch.from_arrays([*kept, found], names=names)

        return run

    out = docs
    for n, items in enumerate(blocks(benchmark, item_text, item_id, block_words)):
        if n:  # one set in memory at a time
            out = materialize(out, "decontaminate")
        out = wd.mapped(out, one_pass(Windows(items, width), bool(n)), schema)
    return out


def contaminated(hits: Column, share: int = SHARE) -> Column:
    return (hits["n_hit"] > 0) & (share * hits["n_hit"] >= hits["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    hits = wd.free_name(docs, "hits")
    found = with_hits(docs, benchmark, hits, **options)
    return found.filter(~contaminated(F.col(hits))).drop(hits)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with every hit span cut out of the text.

    A span runs from the first byte of its first word to the last of its last; what stands
    around it stays as it is.
    """
    hits = wd.free_name(docs, "hits")
    found = with_hits(docs, benchmark, hits, text=text, **options)
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            hit = [n for n, row in enumerate(spans) if row["starts"]]
            kept = texts.to_pylist()
            for n in hit:
                raw = kept[n].encode()
                cut = wd.cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for start, end in zip(spans[n]["starts"][::-1], spans[n]["ends"][::-1], strict=True):
                    raw = raw[: cut.start[start]] + raw[cut.end[end - 1] :]
                kept[n] = raw.decode()
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return wd.mapped(found, run, docs.schema)
