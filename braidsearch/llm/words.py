"""Words of a text, by one rule, as Spark columns and as NumPy arrays inside tasks.

A-Z are lower-cased, then a word is a longest run of digits, a-z and characters beyond
ASCII. In UTF-8 that is a rule on single bytes, so tasks may cut the bytes of a batch
without decoding them. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Texts of a batch are cut together until they hold this many bytes.
SLICE_BYTES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    # splitting at the gaps takes a quarter of the time of extracting the words
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return F.array_remove(pieces, "")


def words_count(text: Column) -> Column:
    """Number of words, counted without lower-casing any."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.array_remove(pieces, "")).cast("bigint")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use, whatever the case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any name; ``run`` returns columns in the order of ``schema``."""
    plain = T.StructType([T.StructField(f"c{n}", field.dataType) for n, field in enumerate(schema)])

    def numbered(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    rows = df.toDF(*(f"c{n}" for n in range(len(df.columns))))
    return rows.mapInArrow(numbered, plain).toDF(*schema.names)


def _byte_codes() -> np.ndarray:
    """A 64-bit number for each byte; 0 for separators, equal for A-Z and a-z."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for byte in range(256):
        if not (48 <= byte <= 57 or 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128):
            codes[byte] = 0
    codes[65:91] = codes[97:123]
    return codes


CODES = _byte_codes()
_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number modulo 2^64, and their inverses."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of many pieces of one sequence of numbers from a single running sum."""

    def __init__(self, numbers: np.ndarray):
        up, self.down = _powers_to(len(numbers))
        self.sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
        np.cumsum(numbers * up[: len(numbers)], out=self.sums[1:])

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Cut:
    """The words of some texts: byte range, hash and text number of each, in order."""

    data: np.ndarray
    rolling: Rolling
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end

    def joined(self, start: int, end: int) -> bytes:
        """Words ``start`` to ``end`` in lower case, joined by blanks."""
        spans = zip(self.start[start:end], self.end[start:end], strict=True)
        return b" ".join(self.data[a:b].tobytes().lower() for a, b in spans)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and where each begins; null as empty."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts that hold `SLICE_BYTES` together, or one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1
        high = min(n, max(high, low + 1), low + (most or n))
        yield low, high
        low = high


def cut(data: np.ndarray, offsets: np.ndarray) -> Cut:
    """Words of the texts that ``offsets`` bound in ``data``."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    codes = CODES[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = codes != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    opens[edges] = inside[edges]  # a text ends the word before it
    start = np.flatnonzero(opens[:-1])
    closes = ~inside
    closes[offsets] = True
    ends = np.flatnonzero(closes)
    end = ends[np.searchsorted(ends, start, side="right")] if len(start) else start
    rolling = Rolling(codes)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(edges)), np.diff(first))
    return Cut(data, rolling, start, end, doc, rolling.pieces(start, end), first)


def cuts(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, Cut]]:
    """The texts of an Arrow column, slice by slice (`slices`): first text, end, words."""
    data, offsets = text_buffers(texts)
    for low, high in slices(offsets, most):
        yield low, high, cut(data, offsets[low : high + 1])
