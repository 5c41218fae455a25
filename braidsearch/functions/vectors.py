"""Vector columns: arithmetic, the hashed embedder, hyperplane buckets.

An embedder maps a text and its counted terms (see `text.term_counts`) to
``array<float>``. `hashed_embedder` needs no weights and looks at the terms; a real
model goes into the same slot through `model_embedder` and looks at the text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 384

# Rows and counted terms that a worker folds at once, some 20 MB.
FOLD_ROWS, FOLD_TERMS = 1024, 1 << 17

# What `hashed_embedder` makes of a document's tokens at once.
COUNTED = "dl bigint, terms array<struct<term: string, tf: int>>, embedding array<float>"

Embedder = Callable[[Column, Column], Column]


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def check_width(vector: Column, dim: int) -> Column:
    """``vector`` itself, failing the job on a row of another width."""
    message = F.concat(F.lit(f"expected width {dim}, found "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as one float64 matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * dim:
        raise ValueError(f"every vector must have width {dim}")
    return flat.reshape(len(vectors), dim).astype(np.float64)


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def big_endian_words(digests: pa.Array) -> np.ndarray:
    """16-byte digests as rows of four unsigned 32-bit numbers."""
    if len(digests) == 0:
        return np.empty((0, 4), dtype=np.int64)
    digests = digests.cast(pa.binary())
    _, offsets, data = digests.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[digests.offset]
    words = np.frombuffer(data, dtype=">u4", count=4 * len(digests), offset=int(first))
    return words.reshape(-1, 4).astype(np.int64)


def pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of up to `FOLD_ROWS` rows, cut where their ``lengths`` pass a multiple of `FOLD_TERMS`."""
    lot = np.cumsum(lengths) // FOLD_TERMS
    ends = np.arange(1, len(lengths))
    cuts = ends[(np.diff(lot) > 0) | (ends % FOLD_ROWS == 0)]
    return itertools.pairwise([0, *cuts.tolist(), len(lengths)])


def hashed_embedder(dim: int = DEFAULT_DIM) -> Embedder:
    """Signed feature hashing of counted terms to ``dim`` numbers of unit length.

    The MD5 of a term gives its bucket (hex digits 1-8) and sign (parity of digits
    9-16). Sums are whole numbers, so the result does not depend on term order.
    A document without terms keeps the zero vector.
    """

    def folded(digests: pa.Array, counts: pa.Array) -> pa.Array:
        rows = len(digests)
        row = np.repeat(np.arange(rows), digests.value_lengths().to_numpy())
        words = big_endian_words(digests.flatten())
        signed = counts.flatten().to_numpy() * np.where(words[:, 1] % 2 == 0, 1, -1)
        cell = row * dim + words[:, 0] % dim
        sums = np.bincount(cell, weights=signed, minlength=rows * dim).reshape(rows, dim)
        return list_column(unit_rows(sums))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def fold(digests: pa.Array, counts: pa.Array) -> pa.Array:
        if len(digests) == 0:
            return pa.array([], pa.list_(pa.float32()))
        parts = pieces(digests.value_lengths().to_numpy())
        return pa.concat_arrays(folded(digests[low:high], counts[low:high]) for low, high in parts)

    def embed(_text: Column, terms: Column) -> Column:
        # Two arguments on purpose: `terms` then stays a column of its own. Spark cannot
        # call a Python function on the nested lambdas that count the terms.
        digests = F.transform(terms, lambda t: F.unhex(F.md5(t["term"])))
        return fold(digests, terms["tf"])

    @F.arrow_udf(COUNTED)
    def count_and_fold(tokens: pa.Array) -> pa.Array:
        lengths = tokens.value_lengths().fill_null(0).to_numpy()
        coded, words = term_codes(tokens.flatten())
        hashed = big_endian_words(md5(words))
        bucket, sign = hashed[:, 0] % dim, np.where(hashed[:, 1] % 2 == 0, 1, -1)
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        sizes, terms, counts, vectors = [], [], [], []
        for low, high in pieces(lengths) if len(lengths) else ():
            rows = high - low
            cells = np.repeat(np.arange(rows), lengths[low:high]) * len(words) + coded[starts[low] : starts[high]]
            cells, tf = np.unique(cells, return_counts=True)
            row, term = np.divmod(cells, max(1, len(words)))
            cell, signed = row * dim + bucket[term], tf * sign[term]
            sums = np.bincount(cell, weights=signed, minlength=rows * dim).reshape(rows, dim)
            vectors.append(unit_rows(sums))
            sizes.append(np.bincount(row, minlength=rows))
            terms.append(term.astype(np.int32))
            counts.append(tf.astype(np.int32))
        listed = pa.StructArray.from_arrays(
            [words.take(pa.array(joined(terms, np.int32))), pa.array(joined(counts, np.int32))], ["term", "tf"]
        )
        offsets = np.concatenate([[0], np.cumsum(joined(sizes, np.int64))]).astype(np.int32)
        columns = [
            pa.array(lengths.astype(np.int64), mask=tokens.is_null().to_numpy(zero_copy_only=False)),
            pa.ListArray.from_arrays(pa.array(offsets), listed),
            list_column(np.concatenate(vectors or [np.empty((0, dim), np.float32)])),
        ]
        return pa.StructArray.from_arrays(columns, ["dl", "terms", "embedding"])

    embed.of_tokens = count_and_fold
    return embed


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def term_codes(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each token as the number of its term, and the terms in Spark's order, that of their UTF-8 bytes."""
    if tokens.null_count:
        raise ValueError("an analyzer must not give a null token")
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def md5(words: pa.Array) -> pa.Array:
    digests = pa.array([], pa.binary(16))
    for at in range(0, len(words), FOLD_TERMS):
        some = words.slice(at, FOLD_TERMS).cast(pa.binary()).to_pylist()
        some = pa.array([hashlib.md5(word).digest() for word in some], pa.binary(16))
        digests = pa.concat_arrays([digests, some])
    return digests


def unit_rows(sums: np.ndarray) -> np.ndarray:
    """Rows of unit length; a row of zeros stays."""
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(length == 0, 1.0, length)).astype(np.float32)


def model_embedder(load_model: Callable[[], Callable], dim: int, batch_size: int = 64) -> Embedder:
    """Slot for a real model: ``load_model`` runs once per Python worker and returns
    a function from an array of texts to a ``(rows, dim)`` float32 array."""

    def load() -> Callable:
        model = load_model()

        def checked(texts: np.ndarray) -> np.ndarray:
            vectors = model(texts)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"expected vectors of width {dim}, found {vectors.shape}")
            return vectors

        return checked

    predict = predict_batch_udf(
        load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return lambda text, _terms: predict(text)


def hyperplanes(bits: int, dim: int) -> np.ndarray:
    """``(bits, dim)`` of +1/-1, reproducible everywhere: parity of MD5 digits 1-8 of 'plane:dim'."""

    def sign(plane: int, axis: int) -> int:
        digest = hashlib.md5(f"{plane}:{axis}".encode()).hexdigest()
        return 1 - 2 * (int(digest[:8], 16) % 2)

    return np.array([[sign(p, a) for a in range(dim)] for p in range(bits)], dtype=np.float64)


def bucket_numbers(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit p of a vector's bucket says on which side of plane p it lies."""
    sides = vectors @ planes.T >= 0
    return sides @ (1 << np.arange(len(planes), dtype=np.int64))


def lsh_buckets(vector: Column, bits: int, tables: int, dim: int) -> Column:
    """The random-hyperplane bucket of a vector in each hash table, in ``[0, 2**bits)``."""
    planes = hyperplanes(bits * tables, dim)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def buckets(vectors: pa.Array) -> pa.Array:
        rows = matrix(vectors, dim)
        own = [bucket_numbers(rows, planes[t * bits : (t + 1) * bits]) for t in range(tables)]
        return list_column(np.stack(own, axis=1)) if len(rows) else pa.array([], pa.list_(pa.int64()))

    return buckets(vector)
