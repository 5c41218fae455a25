import random
import re

import pyarrow as pa
import pytest

from braidsearch.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, part string, `a.b` int"


def brute(rows, least, k):
    """Every row of the audit, by plain counting."""
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(UPPER))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        terms = {t for d in mine for t in d[2]}
        kept = [t for t in terms if sum(t in set(d[2]) for d in mine) >= least]

        def shares(words):
            count = {t: words.count(t) for t in kept}
            total = sum(count.values()) + 5 * len(kept)
            return count, {t: 1 + 10**9 * (n + 5) // total for t, n in count.items()}

        _, q = shares([t for d in mine for t in d[2]])
        of = {s: shares([t for d in mine if d[1] == s for t in d[2]]) for s in {d[1] for d in mine}}
        for source, (count, p) in of.items():
            found = {"pair": [(sum(abs(p[t] - r[t]) for t in kept), s) for s, (_, r) in of.items() if s != source]}
            found["term"] = [(p[t] - q[t], t) for t in kept if count[t] and p[t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda v: (-v[0], v[1].encode()))
                for rank, (value, item) in enumerate(items[: k if part == "term" else None], 1):
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def table(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "BE", "été", "数") for b in ("na", "Ro", "x\x80", "ß", "tu")] + ["don't", "x9y", "ÀB"]
    rows = []
    for i in range(n):
        lang = rng.choices(["en", "de", None, "", "rare"], [6, 3, 1, 1, 0.3])[0]
        source = rng.choices(["hot", "a", "b", "c", None, "ü"], [6, 2, 2, 2, 1, 1])[0]
        lean = rng.choices(words, range(1, len(words) + 1), k=4) if source == "hot" else words
        text = rng.choice([None, "", " ".join(rng.choices(lean, k=rng.randint(1, 40))), "; ".join(rng.choices(words, k=9))])
        rows.append((i, text, lang, source, 1, "t", "p", 2))
    return [*rows, *rows[:20], (1, "alna " * 30_000, "en", "a", 1, "t", "p", 2)]


@pytest.mark.parametrize("least,k,small", [(5, 3, True), (2, 50, False)])
def test_equals_brute_force(spark, least, k, small):
    rows = table(150, k)
    found = dv.Audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least)
    sizes = ({"chunk_rows": 7, "block": 2}, {"buffer": 5}) if small else ({}, {})
    pairs, terms = dv.pairs(found, **sizes[0]), dv.leading_terms(found, k, **sizes[1])
    got = [(r.lang, r.source, "pair", r.item, r.value, r["rank"]) for r in pairs.collect()]
    got += [(r.lang, r.source, "term", r.item, r.value, r["rank"]) for r in terms.collect()]
    assert sorted(got) == brute(rows, least, k)


def test_counting_in_parts(spark):
    docs = spark.createDataFrame(table(60, 2), SCHEMA)
    assert sorted(dv.counts(docs, 3).collect(), key=str) == sorted(dv.counts(docs).collect(), key=str)


def test_long_texts_are_cut_at_blanks():
    text = ("abcdef " * 400_000 + "Z" * (1 << 21) + " 9end").encode()
    found = [w for words in dv._words(text) for w in words]
    assert found == [b"abcdef"] * 400_000 + [b"z" * (1 << 21), b"end"]


@pytest.mark.parametrize("k", [1, 4])
def test_skyband(k):
    rng = random.Random(k)
    rows = [
        {"lang": "en", "source": rng.choice("ab"), "term": f"t{n * 7919 % 1000}", "n": rng.randint(1, 9), "of_lang": rng.randint(9, 20)}
        for n in range(700)
    ]

    def beats(a, b):
        return a["source"] == b["source"] and a["n"] >= b["n"] and a["of_lang"] <= b["of_lang"] and a["term"] < b["term"]

    wanted = [b for b in rows if sum(beats(a, b) for a in rows) < k]
    found = dv.skyband(pa.Table.from_pylist(rows), k).to_pylist()
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    halves = [dv.skyband(pa.Table.from_pylist(half), k) for half in (rows[:350], rows[350:])]
    assert sorted(map(str, dv.skyband(pa.concat_tables(halves), k).to_pylist())) == sorted(map(str, wanted))


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    counts = [(0, 1, 1), (10**12, 10**13, 10**7), (9 * 10**17, 9 * 10**17, 3), (7, 13, 0)]
    rows = spark.createDataFrame(counts, "n bigint, total bigint, v bigint")
    found = rows.select("n", "total", "v", dv.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.v) for r in found)


def test_nothing(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_sql(spark, against_sql):
    assert against_sql("op13_source_divergence", documents=spark.createDataFrame(table(400, 5), SCHEMA))
