"""Plain Python versions of the scores, for small inputs."""

import math
import re
from collections import Counter


def simple(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def okapi(texts, questions, tokens=simple, k1=1.5, b=0.75):
    """{query: {doc: score}} with every document scored."""
    docs = [Counter(tokens(t)) for t in texts]
    n = len(docs)
    lengths = [sum(d.values()) for d in docs]
    avgdl = sum(lengths) / n
    df = Counter(term for d in docs for term in d)
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0.0
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    scores = {}
    for q, question in enumerate(questions):
        scores[q] = {}
        for i, d in enumerate(docs):
            total = 0.0
            for term in tokens(question):
                if term in d:
                    tf = d[term]
                    norm = k1 * (1 - b + b * lengths[i] / avgdl)
                    total += idf[term] * tf * (k1 + 1) / (tf + norm)
            scores[q][i] = total
    return scores


def sparse_dot(texts, questions, tokens=simple, k1=1.2, b=0.75):
    docs = [Counter(tokens(t)) for t in texts]
    n = len(docs)
    lengths = [sum(d.values()) for d in docs]
    avgdl = sum(lengths) / n
    df = Counter(term for d in docs for term in d)
    scores = {}
    for q, question in enumerate(questions):
        terms = set(tokens(question))
        idf = {t: math.log((n + 1) / (df.get(t, 1) + 0.5)) for t in terms}
        whole = sum(idf.values())
        scores[q] = {}
        for i, d in enumerate(docs):
            norm = k1 * (1 - b + b * lengths[i] / avgdl)
            scores[q][i] = sum(
                idf[t] / whole * d[t] / (norm + d[t]) for t in terms if t in d
            )
    return scores


def top(scores, k, descending=True):
    """{query: [(doc, score)]}: rounded first, ties to the smaller id."""
    sign = -1 if descending else 1
    ranked = {}
    for q, by_doc in scores.items():
        rounded = [(d, round(s, 6) + 0.0) for d, s in by_doc.items()]
        ranked[q] = sorted(rounded, key=lambda e: (sign * e[1], e[0]))[:k]
    return ranked


def close(found, wanted):
    assert found.keys() == wanted.keys()
    for q in wanted:
        assert [d for d, _ in found[q]] == [d for d, _ in wanted[q]], q
        for (_, a), (_, b) in zip(found[q], wanted[q]):
            assert abs(a - b) < 2e-6
