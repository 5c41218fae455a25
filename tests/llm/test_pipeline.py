import corpus_pipeline as cp
import pytest

from __spark_entry__ import ENTRY_DIR, oracle_sql, queries
from braidsearch.llm import decontaminate, lines, neardup, packing, toxicity

from .test_decontaminate import brute as hits_of
from .test_neardup import brute as groups_of


def test_stages_follow_each_other(spark):
    """Every stage against a plain one on what the stage before has kept."""
    docs = spark.read.parquet(f"{ENTRY_DIR}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{ENTRY_DIR}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{ENTRY_DIR}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, ENTRY_DIR).cache()
        rows = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(rows)
        if name == "packing":
            assert rows.keys() == kept.keys()
            break
        assert out.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, labels, "toxic")
            bad = {r.doc_id for r in toxicity.with_severity(docs, model, "s").filter("s.p_toxic >= 0.5").collect()}
            assert rows == {n: r for n, r in kept.items() if n not in bad} and bad
        elif name == "near-duplicates":
            groups = groups_of([(n, r.text) for n, r in kept.items()])
            assert rows == {n: kept[n] for n in set(groups.values())}
        elif name == "decontamination":
            hits = hits_of([r.text for r in kept.values()], bench)
            bad = {n for n, (w, h, _) in zip(kept, hits, strict=True) if h and 20 * h >= w}
            assert rows == {n: r for n, r in kept.items() if n not in bad} and bad
        else:
            assert rows.keys() == kept.keys()
        docs, kept = out, rows


def test_run_gives_the_last_stage(spark):
    found = cp.run(spark, ENTRY_DIR)
    assert found.columns == ["doc_id", "n_tokens", "bucket", "padded_to", "batch", "slot"] and found.count() > 0


def test_stages_use_the_operators():
    used = (toxicity.drop_toxic, lines.drop_recurring_lines, neardup.drop_near_duplicates, decontaminate.drop_contaminated, packing.pack)
    for (_, stage), operator in zip(cp.STAGES, used, strict=True):
        assert operator.__name__ in stage.__code__.co_names


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, against_sql, name):
    tables = {t: spark.read.parquet(f"{ENTRY_DIR}/{t}.parquet") for t in ("documents", "benchmark", "embeddings", "labels")}
    assert against_sql(name, **tables)


def test_every_operator_has_a_query(spark):
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
