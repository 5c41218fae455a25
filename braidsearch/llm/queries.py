"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.llm import (
    decontaminate,
    divergence,
    licenses,
    lines,
    merkle,
    neardup,
    packing,
    pii,
    secrets,
    sharding,
    tokenids,
    topk,
    toxicity,
)
from braidsearch.session import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    seen = F.col("license")
    return found.select(
        "doc_id",
        seen["n_words"].alias("n_words"),
        F.size(seen["base"]).cast("bigint").alias("n_base"),
        F.array_min(seen["base"]["at"]).cast("bigint").alias("first_word"),
        F.array_max(seen["base"]["at"]).cast("bigint").alias("last_word"),
        F.array_join(seen["base_labels"], ",").alias("base_labels"),
        F.array_join(seen["labels"], ",").alias("labels"),
        F.round(seen["score"], 6).alias("score"),
    )


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenids.write_packed(_documents(spark, sf_dir), fresh_path(spark, "packed-ids"))
    return rows.select(
        "group",
        "row",
        "n_tokens",
        F.size("doc_ids").alias("n_segments"),
        "doc_ids",
        "pieces",
        "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"),
    )


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = decontaminate.with_hits(docs, _table(spark, sf_dir, "benchmark"), "hits")
    hits = F.col("hits")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic")
    severity = F.col("severity")
    return toxicity.with_severity(docs, model, "severity").select(
        "doc_id",
        F.round(severity["expected_severity"], 6).alias("expected_severity"),
        severity["grade"].alias("grade"),
        F.round(severity["p_toxic"], 6).alias("p_toxic"),
        (severity["p_toxic"] >= 0.5).alias("toxic"),
    )


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("class").alias("class_id"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "secret-ledger")
    found = secrets.findings(_documents(spark, sf_dir), path)
    all_found = F.col("findings")

    def count(kind: str):
        mine = F.filter(all_found, lambda f: f["kind"] == kind)
        return F.size(mine).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
        )

    base = F.filter(all_found, lambda f: f["n"] <= len(secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(rule.name) for rule in secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(all_found).alias("spans"),
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("before", F.size(F.split("text", "\n")))
    cleaned = lines.drop_recurring_lines(docs)
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return cleaned.select(
        "doc_id",
        F.col("before").cast("bigint").alias("n_lines"),
        left.cast("bigint").alias("n_kept"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    vectors = table.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    return topk.exact_topk(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = pii.with_spans(docs, pii.fit(docs), "spans")
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.BASE),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    held = merkle.checked(merkle.document_manifest(docs, tampered))
    return held.withColumnRenamed("row_id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


REGISTERED = [
    op1_length_buckets, op2_license_scan, op3_packed_ids, op4_shard_table, op5_decontaminate, op6_toxicity,
    op7_dart_minhash, op8_secret_scan, op9_line_templates, op10_exact_topk, op11_personal_data,
    op12_merkle_manifest, op13_source_divergence,
]


def queries() -> dict:
    return {query.__name__: query for query in REGISTERED}
