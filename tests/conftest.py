import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from braidsearch.schemas import DOCUMENTS, QUESTIONS
from braidsearch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


TEXTS = [
    ("Rivers carry silt to the sea, and the sea keeps it.", "Rivers", "Earth"),
    ("A lighthouse warns ships; its lamp turns all night above the sea.", "Lighthouse", "Coast"),
    ("Bread needs flour, water, salt and time. Time most of all.", "Bread", "Kitchen"),
    ("The baker's oven is hot before the ships leave the harbour.", "Oven", "Kitchen"),
    ("High-altitude lakes freeze early; rivers below run all winter.", "Lakes", "Earth"),
    ("Salt from the sea flavours bread in harbour towns.", "Salt", "Coast"),
]

ASKED = [
    "Why does the sea hold salt?",
    "what does bread need",
    "ships at night near a lighthouse",
    "rivers rivers in winter",
    "zeppelin quartz",
]

EDGE_TEXTS = [
    "",
    "the and of",
    TEXTS[0][0],
    TEXTS[0][0],
    "A template may say {question} or {context} and 100% of it must stay.",
    "first line\nsecond line",
    "long " * 60,
    "Ünïcode wörter über Zürich, naïve café",
    "state-of-the-art ship's hull",
]


def document_rows(texts):
    return [
        (n, text, {"title": title, "category": category})
        for n, (text, title, category) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(TEXTS), DOCUMENTS)


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame([(n, text, {}) for n, text in enumerate(EDGE_TEXTS)], DOCUMENTS)


@pytest.fixture(scope="session")
def questions(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), QUESTIONS)


def ranked_rows(df, key="doc_id"):
    """{query_id: [(id, score), ...] in rank order}, with ranks checked to run 1..m."""
    lists = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(row.query_id, []).append((row[key], row.score, row["rank"]))
    for entries in lists.values():
        assert [rank for _, _, rank in entries] == list(range(1, len(entries) + 1))
    return {q: [(i, s) for i, s, _ in entries] for q, entries in lists.items()}
