import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from braidsearch.llm import words as wd

from .conftest import EDGE, words_of


def cut_words(texts):
    out = []
    for _, _, cut in wd.cuts(pa.array(texts, pa.string())):
        for n in range(len(cut.first) - 1):
            joined = cut.joined(cut.first[n], cut.first[n + 1]).decode()
            out.append(joined.split(" ") if joined else [])
    return out


def test_columns_and_arrays_cut_the_same_words(edge):
    found = edge.select("text", wd.words(edge.text).alias("w"), wd.words_count(edge.text).alias("n")).collect()
    for row in found:
        assert row.w == words_of(row.text) and row.n == len(row.w)
    assert cut_words(EDGE) == [words_of(text) for text in EDGE]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 é.\n数", max_size=12), max_size=6))
def test_arrays_cut_words(texts):
    assert cut_words(texts) == [words_of(text) for text in texts]


def test_hashes_tell_words_apart_and_ignore_case():
    texts = [f"Word{n} {n}" for n in range(2000)] + ["word7 WORD7"]
    hashes, names = [], []
    for _, _, cut in wd.cuts(pa.array(texts)):
        hashes += cut.hash.tolist()
        names += [cut.joined(n, n + 1) for n in range(len(cut.hash))]
    assert len(set(hashes)) == len(set(names)) == len(set(zip(hashes, names, strict=True)))


def test_slices_hold_every_text_once():
    offsets = np.array([0, 5, 5, wd.SLICE_BYTES * 3, wd.SLICE_BYTES * 3 + 1])
    found = list(wd.slices(offsets))
    assert [low for low, _ in found] == [0] + [high for _, high in found[:-1]] and found[-1][1] == 4


def test_free_name(edge):
    assert wd.free_name(edge, "LICENSE") == "_LICENSE" and wd.free_name(edge, "fresh") == "fresh"
