import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidsearch.llm import pii
from tests.llm.conftest import LONG, sentence

# The base patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for n, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in GIVEN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def ordered(spans):
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


pieces = st.sampled_from(
    ["a", "Z.", "@", "b-c", ".com", "..", "@@x.y", "1", "12", "255", "256", "007", ".", "4539 1488 0343 6467", "378282246310005", "+", "+1 (", ") 555-", "0101", "-", " ", "  ", "\n", "é", "数", "%_+"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=25).map("".join))
def test_base_spans_equal_the_given_patterns(text):
    assert ordered(pii.base_spans(text)) == brute(text)


def test_base_spans_of_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "a@" * 100_000, "+1 " * 100_000, "1 " * 150_000, "A1" * 150_000):
        base = pii.base_spans(text)
        pii.added_candidates(text, base)


@pytest.mark.parametrize("n", range(3))
def test_aggregate_equals_span_by_span(n):
    """Expectation-maximisation over counts is the same over single spans, by plain loops."""
    rng = random.Random(n)
    spans = []
    for _ in range(120):
        truth, kind = rng.random() < 0.5, rng.randrange(3)
        cast = [rng.choice([0, 2 if (rng.random() < 0.85) == truth else 1]) for _ in pii.LABELERS]
        spans.append((kind, sum(v * 3**j for j, v in enumerate(cast))))
    spans += spans[:40]
    digits = [[v // 3**j % 3 for j in range(len(pii.LABELERS))] for _, v in spans]
    belief = [(d.count(2) + 0.5) / (d.count(1) + d.count(2) + 1) for d in digits]
    for _ in range(200):
        chance = [[[1.0] * 3 for _ in pii.LABELERS] for _ in range(2)]
        for d, b in zip(digits, belief, strict=True):
            for j, v in enumerate(d):
                chance[1][j][v] += b
                chance[0][j][v] += 1 - b
        kinds = [k for k, _ in spans]
        prior = {k: (sum(b for b, o in zip(belief, kinds, strict=True) if o == k) + 1) / (kinds.count(k) + 2) for k in kinds}
        turned = []
        for k, d in zip(kinds, digits, strict=True):
            odds = prior[k] / (1 - prior[k])
            for j, v in enumerate(d):
                odds *= chance[1][j][v] / sum(chance[1][j]) / (chance[0][j][v] / sum(chance[0][j]))
            turned.append(odds / (1 + odds))
        belief = turned
    groups = sorted(set(spans))
    kind, vote = (np.array(side) for side in zip(*groups, strict=True))
    found = pii.aggregate(kind, vote, np.array([spans.count(g) for g in groups]))
    for span, b in zip(spans, belief, strict=True):
        assert abs(found[groups.index(span)] - b) < 1e-6


def test_classifier_reaches_the_least_loss():
    rng = np.random.default_rng(0)
    held = [np.unique(rng.integers(0, 6, rng.integers(1, 4))) for _ in range(200)]
    goal, weight = rng.random(200), rng.integers(1, 5, 200).astype(float)
    weights = pii.fit_classifier(held, goal, weight, rounds=3000)
    margin = np.array([weights[row].sum() + weights[-1] for row in held])
    slope = weight / weight.sum() * (1 / (1 + np.exp(-margin)) - goal)
    step = np.zeros(len(weights))
    for row, s in zip(held, slope, strict=True):
        step[row] += s
        step[-1] += s
    assert np.abs(step + 1e-5 * weights).max() < 1e-4


def person(rng):
    """A text with one span, its kind and place, and whether it is personal."""
    n = "".join(rng.choices("123456789", k=16))
    value, kind, before, real = rng.choice(
        [
            (f"{rng.choice('abc')}.{n[:4]}@mail.{rng.choice(['com', 'org'])}", "email", "write to", True),
            (f"+44 {n[:4]} {n[4:7]} {n[7:10]}", "phone", "call", True),
            (f"jo{n[:3]} at mail{n[3]} dot com", "spelled", "my email is", True),
            (f"0{n[:3]} {n[3:6]} {n[6:10]}", "local", "my phone", True),
            (f"{n[:3]}-{n[3:5].replace('0', '1')}-{n[5:9]}", "ssn", "social security", True),
            (f"{rng.choice(['Anna', 'Paul', 'John'])} {rng.choice(['Miller', 'Weber', 'Smith'])}", "name", "my name is", True),
            (f"{n[:8]}", "account", "order no.", False),
            (f"{n[:9]}", "account", "commit", False),
            (f"{n[:3]} {n[3:6]} {n[6:10]}", "local", "version", False),
        ]
    )
    head = f"{sentence(rng.randint(1, 9), rng.random())} {before} "
    return f"{head}{value} {sentence(3, rng.random())}", (kind, len(head), len(head) + len(value)), real


def test_added_spans_on_held_out_texts(spark):
    rng = random.Random(3)
    known = [person(rng) for _ in range(1500)]
    docs = spark.createDataFrame([(n, text) for n, (text, _, _) in enumerate(known)], "doc_id bigint, text string")
    model = pii.fit(docs, rows=800)
    caught, spared = [], []
    for text, span, real in (person(rng) for _ in range(600)):
        found = [(s["kind"], s["start"], s["end"]) for s in pii.text_spans(text, model)]
        (caught if real else spared).append((span in found) == real)
    assert np.mean(caught) > 0.95 and np.mean(spared) > 0.95
    # reliabilities come out as they are: announced spans are likelier than those announced as something else
    assert min(b for (k, _), b in model.beliefs.items() if k == "email") > 0.5


def test_edges(spark, edge, nothing):
    model = pii.fit(edge)
    found = pii.with_spans(edge, model, "spans")
    assert found.columns == [*edge.columns, "spans"] and found.count() == edge.count()
    assert all(row.spans == [] for row in found.collect())
    assert sorted(map(str, pii.redacted(edge, model).collect())) == sorted(map(str, edge.collect()))
    empty = pii.fit(nothing)
    assert pii.with_spans(nothing, empty, "spans").collect() == []
    assert [s["kind"] for s in pii.text_spans(LONG + " é a@b.co 10.0.0.1", empty)] == ["email", "ip"]


def test_redacted(spark):
    text = "é a@b.co, call +44 20 7946 0958 now"
    docs = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    rows = {row.id: row.text for row in pii.redacted(docs, pii.Model(None, {})).collect()}
    assert rows == {1: "é <email>, call <phone> now", 2: None}


def test_query_equals_brute_force(spark):
    from braidsearch.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in queries()["op11_personal_data"](spark, folder).collect()}
    model = pii.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        row, base = rows[doc_id], brute(text)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in pii.BASE] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        more = [(s["kind"], s["start"], s["end"]) for s in pii.text_spans(text or "", model)]
        assert set(base) <= set(more) and row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in more)


def test_hot_copies_do_not_grow_the_sample(spark):
    docs = spark.range(3000).select("id", F.lit("mail me at x@y.com").alias("text"))
    assert pii.candidates(docs).count() == 1 and pii.fit(docs, rows=10).weights is not None
