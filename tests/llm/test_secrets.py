import re

import pytest

from braidsearch.llm import secrets as sc

TEXTS = [
    None, "", "password=abcdef", "Password : 'abc'", "secret=token: abcdefgh", "say token=token=abcdef; AKIA" + "A" * 16,
    "AKIA" + "A" * 15, "é数 api_key = \"zzzzzz\" APIKEY=123456 " + "0af" * 9, "0af" * 7, "-----BEGIN RSA PRIVATE KEY-----",
    "x " * 50_000 + "passwd=hunter2hunter2", "password=abcdef", "https://me:secret99@host/path ghp_" + "a1" * 18,
    "password=" + "ab" * 20 + " deadbeef" * 4,
]

KINDS = [
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        found += [
            (m.start(), n, f"{kind}:{m.start()}:{m.end()}")
            for m in pattern.finditer(text or "")
            if len(m[group]) >= least
        ]
    return [span for _, _, span in sorted(found)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def spans(found, kinds=("assign", "access", "hex")):
    return {
        r.path: [f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in kinds] for r in found.collect()
    }


def test_base_spans_are_those_of_python(docs, tmp_path):
    found = spans(sc.findings(docs, str(tmp_path / "ledger")))
    assert found == {n: base(text) for n, text in enumerate(TEXTS)}


def test_added_kinds(docs, tmp_path):
    found = spans(sc.findings(docs, str(tmp_path / "ledger")), [rule.name for rule in sc.ADDED])
    assert [f.split(":")[0] for f in found[9]] == ["pem"] and [f.split(":")[0] for f in found[12]] == ["login", "github"]


def test_only_unseen_blobs_and_rules_are_scanned(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    first, second = docs.filter("doc_id < 6"), docs
    sc.findings(first, path, sc.BASE)
    entries = sc.ledger(spark, path).count()
    sc.findings(first, path, sc.BASE)
    assert sc.ledger(spark, path).count() == entries  # nothing new
    sc.findings(second, path, sc.BASE)
    distinct = len({t or "" for t in TEXTS})
    assert sc.ledger(spark, path).count() == distinct  # each blob once, copies too
    newer = (sc.Rule("access", 2, r"AKIA[A-Z]+", least=10), *sc.BASE[2:])
    found = spans(sc.findings(second, path, newer))
    scanned = [row.rules for row in sc.ledger(spark, path).collect()]
    assert sum(rules == ["access@2"] for rules in scanned) == distinct and len(scanned) == 2 * distinct
    assert found[6] == ["access:0:19"] and not any(f.startswith("assign") for f in found[2])


def test_registered_query_and_edges(against_sql, docs, edge, nothing, tmp_path):
    against_sql("op8_secret_scan", documents=docs)
    assert sc.findings(edge, str(tmp_path / "edge")).count() == edge.count()
    assert sc.findings(nothing, str(tmp_path / "none")).count() == 0
