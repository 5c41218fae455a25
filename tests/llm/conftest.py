"""Texts that every operator must get through: null, empty, very long, repeated, odd characters."""

import random
import re

import duckdb
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

rng = random.Random(7)
SYLLABLES = ["ba", "ko", "ri", "tu", "ne", "la", "mo", "shi", "ver", "and"]


def sentence(words: int, seed: int) -> str:
    own = random.Random(seed)
    return " ".join("".join(own.choices(SYLLABLES, k=own.randint(1, 4))) for _ in range(words))


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


LONG = sentence(30_000, 1)
EDGE = [
    None, "", " \n\t", "one", "one two three", "Zürich ÉTÉ İstanbul K 数字 naïve", LONG, LONG, "one two three",
    sentence(60, 2), sentence(60, 2) + " tail", "\n".join([sentence(9, 3)] * 5), "...!!!", "a" * 5000,
]

SCHEMA = "doc_id bigint, text string, lang string, hits string, License string, `copy` string, severity string, slot int, `a.b` int"


def rows(texts, first=0):
    return [(first + n, text, "en", f"h{n}", None, "c", "s", n, n) for n, text in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts with extra columns whose names the operators would like to use."""
    return spark.createDataFrame([*rows(EDGE), *rows(EDGE)[:2], (None, "no id", *rows(["x"])[0][2:])], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def against_sql(spark, tmp_path):
    """Write tables to a folder, run a registered query and its SQL on it, compare the rows."""
    from braidsearch.llm.oracles import ORACLES
    from braidsearch.llm.queries import queries

    def ordered(names, found):
        order = sorted(range(len(names)), key=names.__getitem__)
        picked = [tuple(row[i] for i in order) for row in found]
        return sorted(picked, key=lambda r: tuple((v is not None, v) for v in r))

    def compare(name, **tables):
        duck = duckdb.connect()
        for table, frame in tables.items():
            frame.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        frame = queries()[name](spark, str(tmp_path))
        relation = duck.sql(ORACLES[name])
        found = ordered(frame.columns, frame.collect())
        assert sorted(frame.columns) == sorted(relation.columns)
        assert found == ordered(relation.columns, relation.fetchall())
        return found

    return compare
