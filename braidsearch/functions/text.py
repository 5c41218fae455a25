r"""Text analysis as Column expressions: tokens, counts, keys, previews.

Analyzers map a text Column to ``array<string>``. All of them run in the JVM on
one row at a time, so analysing a corpus needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass, replace
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsearch.functions.columns import let, run_starts

Analyzer = Callable[[Column], Column]

# Token patterns, white space as Unicode defines it, language names, preview width.
SEPARATORS = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|'s"
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
PREVIEW_CHARS = 150


@dataclass(frozen=True)
class Analysis:
    """What an analyzer does, as saved models state it; None where it is not known."""

    lower_case: bool | None = None
    remove_punctuation: bool | None = None
    remove_stopwords: bool | None = None
    stem: bool | None = None
    language: str | None = None

    def flags(self) -> tuple:
        return astuple(self)

    def agrees(self, other: Analysis) -> bool:
        """Whether no flag that both know differs."""
        pairs = zip(self.flags(), other.flags(), strict=True)
        return all(a == b for a, b in pairs if a is not None and b is not None)


def analysis_of(analyzer: Analyzer) -> Analysis:
    """The ``analysis`` an analyzer carries; nothing is known of one without it."""
    return getattr(analyzer, "analysis", Analysis())


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(_text(text)), SEPARATORS), "")


def whitespace_tokens(text: Column) -> Column:
    """Case and punctuation kept; split on any white space."""
    return F.array_remove(F.split(_text(text), WHITESPACE), "")


simple_tokens.analysis = Analysis(True, True, False, False)
whitespace_tokens.analysis = Analysis(False, False, False, False)


def word_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words (hyphenated words whole, possessive 's apart) without stop words."""
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit(WORD), F.lit(0))
    return drop_words(words, stop_words)


def words_without(language: str) -> Analyzer:
    """The analyzer `word_tokens` with the stop words of ``language``."""

    def analyzer(text: Column) -> Column:
        return word_tokens(text, stop_words(language))

    analyzer.analysis = Analysis(True, True, True, False, LANGUAGES.get(language, language))
    return analyzer


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    # a literal list this long becomes a hash-set lookup in the optimizer
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


@cache
def stop_words(language: str) -> tuple[str, ...]:
    """The lists that ship with Spark, kept as plain files so that no jar is needed."""
    file = Path(__file__).parent / "stop_words" / f"{LANGUAGES.get(language, language)}.txt"
    return tuple(file.read_text(encoding="utf-8").split())


def word_tokens_by_language(text: Column, lang: Column) -> Column:
    """`word_tokens` with the stop words of each row's own language; none when it is unknown."""
    words = word_tokens(text)
    picked = words
    for code in LANGUAGES:
        picked = F.when(lang == code, drop_words(words, stop_words(code))).otherwise(picked)
    return picked


def light_stem(token: Column) -> Column:
    """Plural endings only: -ies to -y, -sses to -ss, a final -s unless after s or u."""

    def cut(n: int) -> Column:
        return F.substring(token, F.lit(1), F.length(token) - n)

    return (
        F.when(F.endswith(token, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(token, F.lit("sses")), cut(2))
        .when(F.endswith(token, F.lit("ss")) | F.endswith(token, F.lit("us")), token)
        .when(F.endswith(token, F.lit("s")), cut(1))
        .otherwise(token)
    )


def stemmed(analyzer: Analyzer) -> Analyzer:
    """``analyzer`` with `light_stem` on every token."""

    def stemming(text: Column) -> Column:
        # the possessive token 's would stem to a bare apostrophe, so it is left as it is
        return F.transform(
            analyzer(text), lambda t: F.when(t == "'s", t).otherwise(light_stem(t))
        )

    stemming.analysis = replace(analysis_of(analyzer), stem=True)
    return stemming


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one document, sorted by term.

    Counting inside the row (sort, then measure runs) replaces an explode and a
    shuffle of every token of the corpus.
    """

    def count_runs(ordered: Column) -> Column:
        return let(
            run_starts(ordered, lambda a, b: a == b),
            lambda starts: F.transform(
                starts,
                lambda start, n: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(starts, n + 1), F.size(ordered)) - start).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), count_runs)


def trim_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")


def content_key(text: Column) -> Column:
    return F.sha2(_text(text), 256)


def term_id(term: Column) -> Column:
    """Default integer id of a term: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def snippet(text: Column) -> Column:
    head = F.translate(F.substring(text, 1, PREVIEW_CHARS), "\n", " ")
    return F.concat(head, F.lit("..."))


def score_text(score: Column) -> Column:
    """Four digits, rounded by the exact binary value, which ``format_string`` would not do.

    Only 0.00005 itself differs from C and Python: it gives 0.0000.
    """
    return F.translate(F.format_number(score, 4), ",", "")


@F.arrow_udf(T.LongType())
def murmur_term_id(terms: pa.Array) -> pa.Array:
    """32-bit Murmur3 (x86, seed 0) of each UTF-8 term, the id used by saved model files.

    Spark's own ``hash`` uses another seed and another rule for trailing bytes.
    """
    whole = terms.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = whole.buffers()
    starts = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    ids = np.zeros(len(whole), dtype=np.int64)
    lengths = np.diff(starts)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        cells = data[starts[rows][:, None] + np.arange(length)]
        ids[rows] = murmur3_same_length(cells, int(length))
    return pa.array(ids, mask=terms.is_null().to_numpy(zero_copy_only=False))


def murmur3_same_length(values: np.ndarray, length: int) -> np.ndarray:
    """Public-domain MurmurHash3_x86_32 over byte strings of one length, a row each, column by column."""
    # The published constants of the hash.
    c1, c2, add = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32(0xE6546B64)
    mix1, mix2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)

    def rotate(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))

    padded = -(-length // 4) * 4
    data = np.zeros((len(values), padded), dtype=np.uint8)
    if length:
        data[:, :length] = values
    words = data.view("<u4")
    state = np.zeros(len(values), dtype=np.uint32)
    for column in range(padded // 4):
        mixed = rotate(words[:, column] * c1, 15) * c2
        state ^= mixed
        if (column + 1) * 4 <= length:
            state = rotate(state, 13) * np.uint32(5) + add
    state ^= np.uint32(length)
    state ^= state >> np.uint32(16)
    state *= mix1
    state ^= state >> np.uint32(13)
    state *= mix2
    state ^= state >> np.uint32(16)
    return state.astype(np.int64)
