import pytest
from pyspark.sql import functions as F

from braidsearch.llm import families as fm
from braidsearch.llm import lines as ln

from .conftest import sentence

BOILER = "Subscribe to our weekly newsletter today please"
FIELD = "Posted by user {} on day {} at noon sharp"
NAMED = "This page was brought to you by {} and friends"


@pytest.fixture()
def docs(spark):
    rows = []
    for n in range(30):
        body = [sentence(8, 1000 + 10 * n + k) for k in range(4)]
        if n < 12:
            body.insert(2, BOILER)
        if n < 10:
            body.insert(0, FIELD.format(f"id{n}", n))
            body.append(NAMED.format(sentence(1, 5000 + n)))
        if n < 7:
            body.append("Seven documents hold this line only")
        rows.append((n, "\n".join(body), "k"))
    whole = "\n".join(sentence(9, 9000 + k) for k in range(30))
    rows += [(100 + n, whole, "k") for n in range(40)]  # copies of one document
    near = [whole.replace("\n", f" n{n}\n", 1).replace("ba", "ab", n % 3) for n in range(40)]
    rows += [(200 + n, text, "k") for n, text in enumerate(near)]
    rows += [(300, None, "k"), (301, "", "k"), (302, "\n\n", "k"), (303, "\n".join(["again and again and again"] * 50), "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string")


def test_recurring_templates_go_and_the_rest_stays(docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in ln.drop_recurring_lines(docs).collect()}
    for n in range(30):
        wanted = [
            line for line in before[n].split("\n")
            if line != BOILER and not line.startswith(("Posted by user", "This page was"))
        ]
        assert after[n] == "\n".join(wanted)
    # copies and near copies recur as documents, not as lines
    assert all(after[n] == before[n] for n in before if n >= 100)


def test_a_variable_field_is_one_template(docs):
    found = ln.recurring_lines(docs).groupBy("template").agg(F.countDistinct("line").alias("lines")).collect()
    assert sorted(r.lines for r in found) == [1, 10, 10]


def test_a_text_of_recurring_lines_becomes_empty(spark):
    rows = [(n, "Exactly this footer line of text") for n in range(3)]
    rows += [(10 + n, f"Exactly this footer line of text\n{sentence(6, n)}\n\nend {sentence(3, 50 + n)}") for n in range(20)]
    found = {r.doc_id: r.text for r in ln.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[0] == "" and found[10] == f"{sentence(6, 0)}\n\nend {sentence(3, 50)}"


def test_edges(edge, nothing):
    found = ln.drop_recurring_lines(edge)
    assert found.columns == edge.columns and sorted(found.collect(), key=str) == sorted(edge.collect(), key=str)
    assert ln.drop_recurring_lines(nothing).count() == 0


def test_only_spark_functions_run(docs):
    plan = ln.drop_recurring_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def cleaned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in ln.drop_recurring_lines(rows).orderBy("doc_id").collect()]


def one_edit(text, n):
    words = text.split(" ")
    words[n % len(words)] = f"edit{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}"
    return " ".join(words)


def test_a_large_family_of_near_copies_vetoes_no_shared_line(spark):
    shared = sentence(60, 1)
    unrelated = [f"{sentence(9, 100 + n)}\n{shared}\n{sentence(9, 9000 + n)}" for n in range(20)]
    body = [sentence(10, 20_000 + n) for n in range(31)]
    near = ["\n".join([one_edit(" ".join(body[:1]), n), *body[1:15], shared, *body[15:]]) for n in range(10)]
    near += ["\n".join([*body[:k], one_edit(body[k], n), *body[k + 1 : 31], shared]) for k in range(31) for n in range(3)]
    after = cleaned(spark, unrelated + near)
    assert after == [text.replace(f"{shared}\n", "").replace(f"\n{shared}", "") for text in unrelated + near]


@pytest.mark.parametrize("own", [1, 4])
def test_a_passage_of_several_lines_in_short_texts_goes(spark, own):
    passage = "\n".join(sentence(9, n) for n in range(6))
    texts = [passage + "".join(f"\n{sentence(9, 1000 + 10 * n + k)}" for k in range(own)) for n in range(40)]
    assert cleaned(spark, texts) == [text.removeprefix(f"{passage}\n") for text in texts]


def test_word_edits_in_long_lines_lose_no_text(spark):
    body = [sentence(150, n) for n in range(3)]
    texts = ["\n".join(one_edit(line, 150 * n + 40 + k) for k, line in enumerate(body)) for n in range(16)]
    assert cleaned(spark, texts) == texts


def test_a_full_leaf_hides_no_line(spark):
    head = sentence(4, 77)
    shared = f"{head} {sentence(16, 78)}"
    named = [f"{head} {sentence(15, 79)} name{'abcdefghijkl'[n]}" for n in range(12)]
    texts = [f"{sentence(9, 100 + n)}\n{shared}\n{named[n]}" for n in range(12)]
    other = [f"{head} {sentence(16, 4000 + n)}" for n in range(400)]
    after = cleaned(spark, [*texts, *other])
    assert after == [*(text.split("\n")[0] for text in texts), *other]


@pytest.mark.parametrize("n", [2, 7])
def test_a_long_line_of_few_unrelated_texts_goes(spark, n):
    shared, short = sentence(60, 1), sentence(12, 2)
    texts = [f"{sentence(99, 100 + k)}\n{shared}\n{short}\n{sentence(80, 900 + k)}" for k in range(n)]
    assert cleaned(spark, texts) == [text.replace(f"{shared}\n", "") for text in texts]


def test_versions_of_one_text_keep_their_long_lines(spark):
    body = [sentence(70, n) for n in range(10)]
    # three in ten lines differ: half alike, but no near copies
    texts = ["\n".join([*body[:7], *(sentence(70, 100 * n + k) for k in range(3))]) for n in (1, 2)]
    assert cleaned(spark, texts) == texts


def test_texts_are_cut_into_lines_twice_for_templates(docs, monkeypatch):
    cut = {}

    def noted(df, label):
        cut[label] = df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(split(text#")
        return materialize(df, label)

    materialize = ln.materialize
    monkeypatch.setattr(ln, "materialize", noted)
    ln.recurring_lines(docs)
    assert cut.pop("line-common") == cut.pop("line-leaves") == 1
    assert not any(cut.values())


def test_a_field_is_a_token_with_a_digit(spark):
    texts = ["a1 b 2", "1", "ab1cd2ef gh", "x  7  y", "né1 é2é ß", "tab\t3 end", "none here", "", "9 9 9", "a-1, (b)2c. d"]
    frame = spark.createDataFrame([(text,) for text in texts], "line string")
    found = [r.masked for r in frame.select(F.expr(ln.MASKED.format("line")).alias("masked")).collect()]
    assert found == [" ".join(ln.FIELD if set(token) & set("0123456789") else token for token in text.split(" ")) for text in texts]


def test_bands_are_least_elements_of_two_orders(spark):
    texts = spark.createDataFrame([(n, sentence(40 + n, n // 2)) for n in range(8)], "id bigint, text string")
    sketch = {r.id: r.sketch for r in fm.sketches(texts).collect()}
    both = [sorted({*sketch[a], *sketch[b]})[: fm.KEPT] for a, b in ((1, 0), (3, 2))]
    wanted = [len({*sketch[a]} & {*sketch[b]} & {*some}) / len(some) for (a, b), some in zip(((1, 0), (3, 2)), both, strict=True)]
    found = {(r.a, r.b): r.similar for r in fm.edges(texts, 0.5).collect()}
    assert [found[1, 0], found[3, 2]] == wanted
