import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidsearch.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, `at` int, `a.b` int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    parts = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    found = []
    for level in tree[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        found.append([node for i, node in enumerate(run, at // 2 * 2) if i != at] or [None])
        at //= 2
    return [beside[0] for beside in found]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every row."""
    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        held = leaf(doc_id, source, lang, n_chars + 1, text) if hit else own
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, doc_id, held))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: levels([row[2] for row in sorted(trees[lang])]) for lang in order}
    top = levels([built[lang][-1][0] for lang in order])
    out = []
    for n, lang in enumerate(order):
        for at, (_, _, own, doc_id, held) in enumerate(sorted(trees[lang])):
            below, up = path(built[lang], at), path(top, n)
            folded = merkle.fold(merkle.fold(held, at, below), n, up)
            proof = h(*(node for node in below + up if node))
            out.append((doc_id, own, built[lang][-1][0], top[-1][0], proof, folded))
    return out


def table(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "Zulu", "été", "", None])
        text = rng.choice([None, "", "naïve 数字", "a" * 70_000, f"text {i}"])
        rows.append((i, text, lang, rng.choice(["s", None]), rng.choice([None, i, 12]), "r", 1, 2))
    # ties: the same id with other fields, whole rows repeated, no id, a tree of one leaf
    return [*rows, (3, "other", "en", "s", 1, "r", 1, 2), *rows[:9], (None, "x", "en", "s", 1, "r", 1, 2), (5, "y", "lone", "s", 1, "r", 1, 2)]


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_proofs_equal_brute_force(spark, bits):
    rows = table(70, bits)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = merkle.document_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits)
    held = merkle.checked(found).select("row_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()
    assert sorted(map(tuple, held), key=key) == sorted(brute(rows), key=key)
    assert {row.root for row in found.root.collect()} == {row.root for row in held}
    tampered = {row.row_id for row in held if row.folded_root != row.root}
    assert tampered == {r[0] for r in rows if r[0] is not None and r[4] is not None and crc32(str(r[0]).encode()) % 7 == 0}


def test_part_of_the_leaves(spark):
    docs = spark.createDataFrame(table(60, 9), SCHEMA)
    found = merkle.document_manifest(docs, bits=2)
    some = merkle.proofs(found, F.col("row_id") % 11 == 3).collect()
    every = {(row.tree, row["at"]): row for row in merkle.proofs(found).collect()}
    assert 0 < len(some) < len(every)
    for row in some:
        assert row == every[row.tree, row["at"]]
        subroot = merkle.fold(row.leaf, row["at"], row.siblings)
        assert subroot == row.subroot and merkle.fold(subroot, row.top_at, row.top_siblings) == row.root
        wrong = merkle.fold(h(row.leaf), row["at"], row.siblings)
        assert wrong != row.subroot


def test_missing_is_least():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 16, 33):
        for _ in range(20):
            at = np.unique(rng.integers(0, n, rng.integers(1, n + 1)))
            wanted = set(merkle.missing(at, n))
            # a node is needed if it stands beside a path and no asked leaf lies below it
            below, size, level, needed = set(at.tolist()), n, 0, set()
            while size > 1:
                needed |= {(level, i ^ 1) for i in below if i ^ 1 < size and i ^ 1 not in below}
                below, size, level = {i // 2 for i in below}, (size + 1) // 2, level + 1
            assert wanted == needed
            nodes = levels([h(str(i)) for i in range(n)])
            fetched = {(lev, i): nodes[lev][i] for lev, i in wanted}
            proofs = merkle.expand(at, [nodes[0][i] for i in at], n, fetched)
            assert proofs == [path(nodes, i) for i in at.tolist()]


def test_nothing(spark):
    found = merkle.document_manifest(spark.createDataFrame([], SCHEMA))
    assert merkle.checked(found).collect() == [] == found.root.collect()


def test_one_row(spark):
    row = (1, None, None, None, None, "r", 1, 2)
    only = merkle.checked(merkle.document_manifest(spark.createDataFrame([row], SCHEMA))).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == h("")


def test_against_sql(spark, against_sql):
    docs = spark.createDataFrame(table(90, 4), SCHEMA)
    assert len(against_sql("op12_merkle_manifest", documents=docs)) == 102
