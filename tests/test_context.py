import pytest

from braidsearch.operators import context as cx

FOUND = "query_id long, rank long, doc_id long, text string, metadata map<string,string>, score double"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        (0, 2, 8, "second\ntext with 100%", {"title": "T2"}, 0.25),
        (0, 1, 9, "has {question} and {context}", {"category": "C1"}, 0.5),
        (0, 3, 7, "third", None, 0.125),
        (1, 1, 9, "has {question} and {context}", {"title": "T", "category": "C"}, 1.0),
    ]
    return spark.createDataFrame(rows, FOUND).repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(0, "Why?"), (1, "Is {context} safe?"), (2, "No sources")]
    return spark.createDataFrame(rows, "query_id long, question string")


def test_context_block(found):
    blocks = {r.query_id: r for r in cx.context_block(found).collect()}
    assert blocks[0].context == (
        "[1] Source: Untitled Document (Category: C1)\nContent: has {question} and {context}\n\n"
        "[2] Source: T2 (Category: General)\nContent: second\ntext with 100%\n\n"
        "[3] Source: Untitled Document (Category: General)\nContent: third"
    )
    assert blocks[0].n_sources == 3
    assert blocks[1].n_sources == 1


def test_stuffed_context(found):
    blocks = {r.query_id: r.context for r in cx.stuffed_context(found).collect()}
    assert blocks[0] == "has {question} and {context}\n\nsecond\ntext with 100%\n\nthird"


def test_records_keep_documents_as_they_are(found, asked):
    records = cx.result_records(asked, cx.context_block(found, "score"))
    rows = {r.query_id: r for r in records.collect()}
    assert set(rows) == {0, 1, 2}
    assert "Content: has {question} and {context}\n" in rows[0].prompt
    assert rows[0].prompt.startswith("You are an AI Assistant")
    assert rows[0].prompt.endswith("\n\nQuestion: Why?\n\nAnswer:")
    assert rows[1].prompt.endswith("\n\nQuestion: Is {context} safe?\n\nAnswer:")
    assert rows[2].n_sources == 0 and rows[2].source_documents is None
    assert "Context:\n\n\nQuestion: No sources" in rows[2].prompt
    sources = rows[0].source_documents
    assert [(s["rank"], s.doc_id, s.title, s.category, s.score) for s in sources] == [
        (1, 9, None, "C1", 0.5), (2, 8, "T2", None, 0.25), (3, 7, None, None, 0.125),
    ]
    assert rows[0].query == "Why?"


def test_short_prompt(found, asked):
    contexts = cx.stuffed_context(found)
    records = cx.result_records(asked, contexts, cx.SHORT_PROMPT)
    prompt = {r.query_id: r.prompt for r in records.collect()}[0]
    assert prompt == cx.SHORT_PROMPT.replace(
        "{context}", "has <q> and <c>\n\nsecond\ntext with 100%\n\nthird"
    ).replace("{question}", "Why?").replace("<q>", "{question}").replace("<c>", "{context}")


def test_citations(found):
    rows = {(r.query_id, r["rank"]): r for r in cx.citations(found, "score").collect()}
    first = rows[0, 1]
    assert (first.title, first.category, first.score_text) == ("Unknown", "C1", "0.5000")
    assert rows[0, 2].snippet == "second text with 100%..."
    assert rows[0, 3].category == "Unknown"


def test_citations_without_score(found):
    rows = cx.citations(found.drop("score")).collect()
    assert {r.score_text for r in rows} == {"0.0000"}


def test_clean_questions(spark):
    rows = [(0, " what \n"), (1, "   "), (2, "\t"), (3, ""), (4, None), (5, "a b")]
    frame = spark.createDataFrame(rows, "query_id long, question string")
    kept = cx.clean_questions(frame).collect()
    assert [(r.query_id, r.question) for r in kept] == [(0, "what"), (5, "a b")]
