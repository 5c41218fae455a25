"""Token ids of documents, packed into fixed-length rows by best fit, longest first.

A document is its token ids and an end mark. One that is longer than a row is cut into pieces of a whole
row each and a rest, so nothing is lost: the pieces in order are the document. Pieces are dealt into groups
of bounded size by a hash of what they hold. In a group they are placed longest first, each into
the open row whose free room fits it most closely; a segment tree over the possible amounts of room
finds that row in the logarithm of the row length. Rows are written as Parquet: the ids as a
little-endian matrix row padded to its length, the cumulative lengths of its segments, and the
positions at which counting restarts, with each segment's document, piece and first position.

A group is about ``GROUP_BYTES`` of text, so it fits a task, however large the corpus, and a
document of any length is spread by piece. The vocabulary, a file of ranks, is read on the driver
(its path is a parameter) and goes to the tasks.

Defined results: a null or empty text is a segment of only the end mark; repeated rows are packed
each; null ids are kept; ties go to the smaller id and piece; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
GROUP_BYTES = 4 << 20
# Characters that are encoded at once, and pieces that are handed on at once.
SPAN, HANDED = 1 << 16, 2048

PIECES = "doc_id bigint, piece int, n int, ids binary"
ROWS = (
    "group bigint, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>, first_positions array<bigint>"
)

_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The encoding of a ranks file; made once in each worker."""
    key = hash(ranks)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}
        )
    return _encodings[key]


def vocabulary_size(ranks: bytes) -> int:
    """Ids of the vocabulary; the next one is the end mark."""
    return max(int(line.split()[1]) for line in ranks.splitlines()) + 1


def encoded(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text.

    Long texts are encoded in spans that end before a blank after a letter, where the pattern cuts anyway.
    """
    parts, low = [], 0
    while low < len(text):
        high = low + SPAN
        while high < len(text) and not (text[high] == " " and text[high - 1].isalpha()):
            high += 1
        parts.append(np.asarray(codec.encode_ordinary(text[low:high]), dtype=np.uint32))
        low = high
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _cut(ranks: bytes, length: int, kind: str, end_mark: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(ranks)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                ids = np.append(encoded(codec, text or ""), np.uint32(end_mark)).astype(kind)
                for piece, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((doc_id, piece, len(part), part.tobytes()))
                    if len(rows) >= HANDED:
                        yield _pieces(rows)
                        rows = []
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "n", "ids"])


class Rooms:
    """Open rows by free room; finds the least room that fits."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.held = [0] * (2 * self.base)  # rows below each node
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.base
        while node:
            self.held[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The least room of at least ``need`` and a row that has it, which leaves the tree."""
        node = need + self.base
        if not self.held[node]:
            # up until a right neighbour holds rows, then down along the left
            while node > 1 and (node & 1 or not self.held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.held[2 * node] else 2 * node + 1
        room = node - self.base
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Places numbers of pieces, longest first, into rows; ``sizes`` are in descending order."""
    rooms, rows = Rooms(length), []
    for number, size in enumerate(sizes):
        found = rooms.take(size)
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(number)
        if room > size:
            rooms.add(room - size, row)
    return rows


def _packed(length: int, kind: str, pad: int):
    width = np.dtype(kind).itemsize
    fill = np.array([pad], kind).tobytes()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = [("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")]
        table = table.sort_by(order)
        sizes, ids = table["n"].to_pylist(), table["ids"].to_pylist()
        docs, pieces = table["doc_id"].to_pylist(), table["piece"].to_pylist()
        out: list[dict] = []
        for row, placed in enumerate(best_fit(sizes, length)):
            ends = np.cumsum([0] + [sizes[n] for n in placed]).tolist()
            joined = b"".join(ids[n] for n in placed)
            out.append(
                {
                    "group": key[0].as_py(), "row": row, "n_tokens": ends[-1],
                    "ids": joined + fill * (length - len(joined) // width),
                    "cu_seqlens": ends, "resets": ends[:-1],
                    "doc_ids": [docs[n] for n in placed], "pieces": [pieces[n] for n in placed],
                    "first_positions": [pieces[n] * length for n in placed],
                }
            )
        return pa.Table.from_pylist(
            out,
            pa.schema(
                [
                    ("group", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                    ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
                    ("first_positions", pa.list_(pa.int64())),
                ]
            ),
        )

    return run


def id_kind(ranks: bytes) -> str:
    """The smallest little-endian type for all ids and the end mark."""
    return "<u2" if vocabulary_size(ranks) < 1 << 16 else "<u4"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Packed rows, see `ROWS`, of all documents (``doc_id``, ``text``)."""
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    end_mark, kind = vocabulary_size(ranks), id_kind(ranks)
    pieces = docs.mapInArrow(_cut(ranks, length, kind, end_mark), PIECES)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_packed(length, kind, end_mark), ROWS)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed rows to ``path``; read them back."""
    pack(docs, **options).write.parquet(path)
    return docs.sparkSession.read.schema(ROWS).parquet(path)


def positions(cu_seqlens: list[int], first_positions: list[int], length: int) -> np.ndarray:
    """Position of every token of a row; counting restarts with each segment, pad counts from 0."""
    out = np.arange(length, dtype=np.int64)
    for start, end, first in zip(cu_seqlens[:-1], cu_seqlens[1:], first_positions, strict=True):
        out[start:end] = first + np.arange(end - start)
    out[cu_seqlens[-1] :] = np.arange(length - cu_seqlens[-1])
    return out
