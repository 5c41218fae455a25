import pytest
from pyspark.sql import functions as F

from braidsearch.llm import decontaminate as dc

from .conftest import sentence, words_of

ITEM = sentence(20, 50)
SHORT = "Quokka zebu numbat"
BENCH = [(1, ITEM), (1, ITEM), (12, SHORT), (3, None), (4, ""), (None, "one two three"), (5, sentence(13, 51))]
TEXTS = [
    None, "", ITEM, ITEM.upper() + "!", "so: quokka, ZEBU; numbat. quokka zebu", sentence(400, 52) + " " + " ".join(ITEM.split()[3:17]),
    " ".join(ITEM.split()[:12]), sentence(13, 51) + " " + sentence(13, 51), sentence(5000, 53) + " quokka zebu numbat " + sentence(10, 54),
    "quokka zebu", sentence(30, 55),
]


def brute(texts, bench, width=13):
    windows = {}
    for item, text in bench:
        w = words_of(text)
        if item is None or not w:
            continue
        size = min(width, len(w))
        for n in range(len(w) - size + 1):
            windows.setdefault(tuple(w[n : n + size]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, items = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for n in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[n : n + size]))) is not None:
                    hit |= set(range(n, n + size))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out


@pytest.fixture()
def tables(spark):
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)], "doc_id bigint, text string, hits string")
    return docs, spark.createDataFrame(BENCH, "item_id bigint, text string")


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_hits_are_those_of_brute_force(tables, block_words):
    docs, bench = tables
    found = dc.with_hits(docs, bench, "found", block_words=block_words).orderBy("doc_id").collect()
    assert [(r.found.n_words, r.found.n_hit, r.found["items"]) for r in found] == brute(TEXTS, BENCH)
    assert found[0].hits == "x"


def test_registered_query(against_sql, tables):
    docs, bench = tables
    found = against_sql("op5_decontaminate", documents=docs, benchmark=bench)
    assert sum(row[0] for row in found) == 4  # contaminated comes first by name


def test_drop_and_cut(tables):
    docs, bench = tables
    left = {r.doc_id for r in dc.drop_contaminated(docs, bench).collect()}
    assert left == {n for n, (w, h, _) in enumerate(brute(TEXTS, BENCH)) if not (h and 20 * h >= w)}
    cut = {r.doc_id: r.text for r in dc.cut_spans(docs, bench).collect()}
    assert cut[4] == "so: . quokka zebu" and cut[2] == "" and cut[0] is None and cut[10] == TEXTS[10]
    assert all(h == 0 for _, h, _ in brute([cut[n] for n in (2, 3, 4, 8)], BENCH))


def test_edges(edge, nothing, tables):
    bench = tables[1]
    assert dc.with_hits(edge, bench, "found").count() == edge.count()
    assert dc.with_hits(nothing, bench, "found").count() == 0
    none = bench.filter(F.lit(False))
    assert dc.with_hits(edge, none, "found").filter("found.n_hit > 0").count() == 0
    assert dc.drop_contaminated(edge, none).columns == edge.columns
