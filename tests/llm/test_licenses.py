import pytest

from braidsearch.llm import licenses as ls

from .conftest import sentence, words_of

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
TEXTS = [
    None, "", "Released under the MIT License. The MIT-License!", "CC BY", "cc, by: NC cc by-sa", "GNU general public", "gnu general public license",
    "the license of mit", sentence(20_000, 9) + " Apache License, Version 2.0", MIT, MIT.replace("without restriction", "with care"),
    "Permission " * 400, "license " * 3000 + "mit license", "All rights reserved.", "CC BY",
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(n, t, "mine") for n, t in enumerate(TEXTS)], "doc_id bigint, text string, license string")


def test_base_places_are_those_of_brute_force(docs):
    found = ls.scan(docs).orderBy("doc_id").collect()
    for row, text in zip(found, TEXTS, strict=True):
        w = words_of(text)
        wanted = sorted(
            (t.label, n) for t in ls.BASE for n in range(len(w)) if w[n : n + len(t.words)] == t.words
        )
        assert sorted((p.label, p.at) for p in row["_license"].base) == wanted
        assert row["_license"].n_words == len(w) and row.license == "mine"


def test_notices_need_their_keys_and_half_their_rare_words(docs):
    found = {r.doc_id: r["_license"] for r in ls.scan(docs).collect()}
    assert found[9].labels == ["mit"] and found[9].base == [] and 0.5 <= found[9].score <= 1
    assert found[10].labels == [] and found[11].labels == [] and found[11].score == 0
    assert found[4].labels == ["cc-by", "cc-by-nc", "cc-by-sa"] and found[4].score == 1
    assert found[8].labels == ["apache", "apache-2.0"]


def test_registered_query(against_sql, docs, edge):
    # without whole notices, which SQL does not judge
    against_sql("op2_license_scan", documents=docs.filter("doc_id not in (9, 10)").drop("license"))
    against_sql("op2_license_scan", documents=edge)


def test_edges(edge, nothing):
    assert ls.scan(nothing).count() == 0
    assert ls.scan(edge).columns == [*edge.columns, "_license"]
    only = ls.scan(edge, ls.BASE, ())
    assert only.filter("size(_license.labels) > 0").count() == 0
